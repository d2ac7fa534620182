"""Queries of incremental maintenance, hierarchies and change measures, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import classify, fcm, incremental as inc, metrics
from . import tables as T
from .clustering import BASE, M, _membership, scored

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return add


def _tops(docs: DataFrame) -> DataFrame:
    return docs.withColumn("top", F.col("label") % 3)


_LEVELS = BASE + """,
f AS (SELECT id, label, label % 3 AS top, unnest(range(0, len(x))) AS dim, unnest(x) AS v FROM n),
t0 AS (SELECT top AS k, dim, sum(v) AS v FROM f GROUP BY ALL), t1 AS (SELECT k, sqrt(sum(v * v)) AS s FROM t0 GROUP BY k), tc AS (SELECT t0.k, list(v / s ORDER BY dim) AS c FROM t0 JOIN t1 USING (k) GROUP BY t0.k),
l0 AS (SELECT label AS k, dim, sum(v) AS v FROM f GROUP BY ALL), l1 AS (SELECT k, sqrt(sum(v * v)) AS s FROM l0 GROUP BY k), lc AS (SELECT l0.k, list(v / s ORDER BY dim) AS c FROM l0 JOIN l1 USING (k) GROUP BY l0.k),
""" + _membership("t", "SELECT n.id, n.label, tc.k, greatest(2 - 2 * list_dot_product(n.x, tc.c), 0) AS d2 FROM n, tc", M) + """,
ta AS (SELECT id, k AS level_1, u AS p1 FROM tu QUALIFY row_number() OVER (PARTITION BY id ORDER BY u DESC, k) = 1), """ + _membership("l", "SELECT n.id, n.label, (lc.k // 3) AS k, greatest(2 - 2 * list_dot_product(n.x, lc.c), 0) AS d2 FROM n JOIN ta USING (id) JOIN lc ON lc.k % 3 = ta.level_1", M) + """,
la AS (SELECT id, k AS level_2, u AS p2 FROM lu QUALIFY row_number() OVER (PARTITION BY id ORDER BY u DESC, k) = 1),
h AS (SELECT id, level_1, level_2, p1, p2, level_1 || '/' || level_2 AS cluster_path FROM ta JOIN la USING (id))"""


def two_levels(spark, sf_dir) -> DataFrame:
    """Embeddings assigned to top centers (label % 3) and then to the label centers below their top."""
    docs = _tops(T.embeddings(spark, sf_dir))
    _, tops = fcm.label_centers(docs, "top")
    keys, leaves = fcm.label_centers(docs, "label")
    level = fcm.e_step(docs, tops, M).select("id", "label", "x", F.col("cluster").alias("level_1"), F.get("u", F.col("cluster").cast("int")).alias("p1"))
    parts = []
    for top in range(len(tops)):
        mine = [i for i, k in enumerate(keys) if k % 3 == top]
        s = fcm.e_step(level.where(F.col("level_1") == top), leaves[mine], M)
        parts.append(s.select("id", "label", "x", "level_1", "p1", F.col("cluster").alias("level_2"), F.get("u", F.col("cluster").cast("int")).alias("p2")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("cluster_path", F.concat_ws("/", F.col("level_1").cast("string"), F.col("level_2").cast("string")))


@_query("hierarchy_assign_2level", _LEVELS + " SELECT id, level_1, level_2, cluster_path, 2::BIGINT AS leaf_level, level_2 AS cluster FROM h")
def hierarchy_assign_2level(spark, sf_dir):
    flagged = two_levels(spark, sf_dir).withColumn("is_natural_noise", F.lit(False)).withColumn("is_forced_noise", F.lit(False))
    return classify.assignments(flagged, ["level_1", "level_2"]).select("id", "level_1", "level_2", "cluster_path", "leaf_level", "cluster")


@_query("conditional_path_probability", _LEVELS + " SELECT id, cluster_path, round(p1 * p2, 6) AS probability FROM h")
def conditional_path_probability(spark, sf_dir):
    return two_levels(spark, sf_dir).select("id", "cluster_path", F.round(F.col("p1") * F.col("p2"), 6).alias("probability"))


@_query("tree_counts", _LEVELS + " SELECT path, count(*) AS size, sum(noise)::BIGINT AS noise_count FROM (SELECT unnest(['', level_1::VARCHAR, cluster_path]) AS path, (id % 7 = 0)::INT AS noise FROM h) GROUP BY path")
def tree_counts(spark, sf_dir):
    prefixes = F.array(F.lit(""), F.col("level_1").cast("string"), F.col("cluster_path"))
    rows = two_levels(spark, sf_dir).select(F.explode(prefixes).alias("path"), (F.col("id") % 7 == 0).cast("long").alias("noise"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("noise").alias("noise_count"))


@_query("hierarchy_xb", _LEVELS + f""", sep AS (SELECT top, min(s) AS s FROM (SELECT a.k % 3 AS top, 2 - 2 * list_dot_product(a.c, b.c) AS s FROM lc a JOIN lc b ON a.k <> b.k AND a.k % 3 = b.k % 3) GROUP BY top),
node AS (SELECT level_1, count(DISTINCT lu.id) AS n, sum(pow(u, {M}) * d2) / count(DISTINCT lu.id) AS compact FROM lu JOIN ta USING (id) GROUP BY level_1)
SELECT round(sum(compact / greatest(s, 1e-12) * n) / sum(n), 6) AS xb, count(*) AS nodes FROM node JOIN sep ON top = level_1""")
def hierarchy_xb(spark, sf_dir):
    """Index of every node below the root, weighted by its documents."""
    docs = _tops(T.embeddings(spark, sf_dir))
    _, tops = fcm.label_centers(docs, "top")
    keys, leaves = fcm.label_centers(docs, "label")
    level = fcm.e_step(docs, tops, M).select("id", "x", F.col("cluster").alias("level_1"))
    nodes = []
    for top in range(len(tops)):
        mine = leaves[[i for i, k in enumerate(keys) if k % 3 == top]]
        s = fcm.e_step(level.where(F.col("level_1") == top), mine, M)
        nodes.append(s.agg(F.count(F.lit(1)).alias("n"), metrics.xie_beni(M, metrics.min_separation(mine)).alias("xb")))
    rows = nodes[0].unionByName(nodes[1]).unionByName(nodes[2])
    return rows.agg(F.round(F.sum(F.col("xb") * F.col("n")) / F.sum("n"), 6).alias("xb"), F.count(F.lit(1)).alias("nodes"))


def _batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored rows (ids below 400) and a batch that replaces some (from 380) and adds others."""
    docs = T.embeddings(spark, sf_dir)
    old = docs.where("id < 400").select("id", "label", F.col("id").alias("pos"))
    new = docs.where("id >= 380").select("id", (F.col("label") + 100).alias("label"), (F.col("id") - 380).alias("pos"), F.lit("batch").alias("origin"))
    return old, new


@_query("upsert_merge", "WITH o AS (SELECT vec_id AS id, label::BIGINT AS label, vec_id AS pos FROM embeddings WHERE vec_id < 400), b AS (SELECT vec_id AS id, label::BIGINT + 100 AS label, vec_id - 380 AS pos, 'batch' AS origin FROM embeddings WHERE vec_id >= 380) SELECT coalesce(o.id, b.id) AS id, coalesce(b.label, o.label) AS label, coalesce(o.pos, b.pos + (SELECT max(pos) + 1 FROM o)) AS pos, b.origin FROM o FULL JOIN b ON o.id = b.id")
def upsert_merge(spark, sf_dir):
    return inc.upsert(*_batches(spark, sf_dir))


@_query("replaced_appended", "SELECT CASE WHEN vec_id < 400 THEN 'replaced' ELSE 'appended' END AS kind, count(*) AS n FROM embeddings WHERE vec_id >= 380 GROUP BY ALL")
def replaced_appended(spark, sf_dir):
    replaced, appended = inc.split_batch(*_batches(spark, sf_dir))
    return replaced.select(F.lit("replaced").alias("kind")).unionByName(appended.select(F.lit("appended").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_CENTERS = BASE + """, f AS (SELECT id, label, unnest(range(0, len(x))) AS dim, unnest(x) AS v FROM n), c0 AS (SELECT label AS k, dim, sum(v) AS v FROM f GROUP BY ALL),
c1 AS (SELECT k, sqrt(sum(v * v)) AS s FROM c0 GROUP BY k), c AS (SELECT c0.k, list(v / s ORDER BY dim) AS c FROM c0 JOIN c1 USING (k) GROUP BY c0.k), """ + _membership("", "SELECT n.id, n.label, c.k, greatest(2 - 2 * list_dot_product(n.x, c.c), 0) AS d2 FROM n, c", M)
_KEPT = _CENTERS + f""", g0 AS (SELECT u.k, dim, sum(pow(u, {M}) * v) AS v FROM u JOIN f USING (id) WHERE id >= 50 GROUP BY ALL), g1 AS (SELECT k, sqrt(sum(v * v)) AS s FROM g0 GROUP BY k)"""


def _delta(spark, sf_dir):
    s, keys, centers = scored(spark, sf_dir)
    contrib = inc.contributions(s, M)
    held = contrib.where("id < 450")
    stats = inc.apply_delta(inc.statistics(held), held.where("id < 50"), contrib.where("id >= 450"))
    old = fcm.centers_frame(spark, centers).withColumn("path", F.lit(""))
    return contrib, old, inc.centers_from_statistics(stats, old)


@_query("center_delta_update", _KEPT + " SELECT g0.k, dim, round(v / s, 6) AS value FROM g0 JOIN g1 USING (k)")
def center_delta_update(spark, sf_dir):
    """Ids below 50 leave and ids from 450 come; the oracle adds up the remaining rows at once."""
    _, _, new = _delta(spark, sf_dir)
    return new.select("k", F.posexplode("center").alias("dim", "value")).select("k", F.col("dim").cast("long"), F.round("value", 6).alias("value"))


_MOVED = _KEPT + ", g AS (SELECT g0.k, list(v / s ORDER BY dim) AS c FROM g0 JOIN g1 USING (k) GROUP BY g0.k), mv AS (SELECT c.k, list_distance(c.c, g.c) AS movement FROM c JOIN g USING (k))"


@_query("center_movement", _MOVED + " SELECT round(avg(movement), 6) AS mean, round(max(movement), 6) AS largest FROM mv")
def center_movement(spark, sf_dir):
    _, old, new = _delta(spark, sf_dir)
    return inc.center_movement(old, new).agg(F.round(F.avg("movement"), 6).alias("mean"), F.round(F.max("movement"), 6).alias("largest"))


@_query("selective_refresh_ids", _MOVED + f", i AS (SELECT id, max(pow(u, {M}) * movement) AS influence FROM u JOIN mv USING (k) WHERE movement >= 0.01 GROUP BY id) SELECT id, round(influence, 6) AS influence FROM i WHERE influence >= 0.05")
def selective_refresh_ids(spark, sf_dir):
    contrib, old, new = _delta(spark, sf_dir)
    return inc.affected_ids(contrib, inc.center_movement(old, new)).select("id", F.round("influence", 6).alias("influence"))


def _before_after(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    path = lambda k: F.concat_ws("/", (F.col("label") % 3).cast("string"), F.pmod(F.col("label") + F.when(F.col("id") % k == 0, 1).otherwise(0), F.lit(10)).cast("string")).alias("cluster_path")
    return docs.select("id", path(1000)), docs.select("id", path(4))


_PATHS = "WITH p AS (SELECT vec_id AS id, (label % 3) || '/' || ((label + (vec_id % 1000 = 0)::INT) % 10) AS path FROM embeddings), q AS (SELECT vec_id AS id, (label % 3) || '/' || ((label + (vec_id % 4 = 0)::INT) % 10) AS path FROM embeddings)"


@_query("occupancy_change", _PATHS + ", a AS (SELECT path, count(*) / (SELECT count(*) FROM p) AS s FROM p GROUP BY path), b AS (SELECT path, count(*) / (SELECT count(*) FROM q) AS s FROM q GROUP BY path) SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2, 6) AS distance FROM a FULL JOIN b USING (path)")
def occupancy_change(spark, sf_dir):
    return inc.occupancy_change(*_before_after(spark, sf_dir)).select(F.round("distance", 6).alias("distance"))


@_query("assignment_change_rate", _PATHS + " SELECT round(avg((p.path <> q.path)::INT), 6) AS rate FROM p JOIN q USING (id)")
def assignment_change_rate(spark, sf_dir):
    return inc.change_rate(*_before_after(spark, sf_dir)).select(F.round("rate", 6).alias("rate"))


_DAYS = "SELECT date_trunc('day', ts) AS o, count(*) FILTER (event_type = 'error')::DOUBLE AS noise, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY date_trunc('day', ts)) AS i FROM events GROUP BY 1"


@_query("drift_ewma", f"""WITH RECURSIVE d AS ({_DAYS}),
s AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS pn, 0::DOUBLE AS pt, NULL::DOUBLE AS ewma, false AS alarm, 0 AS cool, NULL::DOUBLE AS ratio, false AS fired, false AS evaluated
UNION ALL SELECT i, CASE WHEN ev THEN 0 ELSE pn END, CASE WHEN ev THEN 0 ELSE pt END, e2, al, CASE WHEN ev AND al AND cool = 0 THEN 3 WHEN cool > 0 THEN cool - 1 ELSE 0 END, CASE WHEN ev THEN pn / pt END, ev AND al AND cool = 0, ev FROM (
 SELECT *, CASE WHEN ev THEN CASE WHEN alarm THEN NOT (e2 <= 0.1) ELSE e2 > 0.2 END ELSE alarm END AS al FROM (
 SELECT *, CASE WHEN ev THEN coalesce(0.3 * pn / pt + 0.7 * ewma, pn / pt) ELSE ewma END AS e2 FROM (
 SELECT d.i, s.pn + d.noise AS pn, s.pt + d.n AS pt, s.pt + d.n >= 20 AS ev, s.ewma, s.alarm, s.cool FROM s JOIN d ON d.i = s.i + 1))))
SELECT strftime(o, '%Y-%m-%d') AS day, evaluated, round(ratio, 6) AS ratio, round(ewma, 6) AS ewma, alarm, fired AS recluster FROM s JOIN d USING (i)""")
def drift_ewma(spark, sf_dir):
    """The drift detector over daily batches of events; errors are the noise."""
    days = T.read(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("batch")).agg(F.sum(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("noise"), F.count(F.lit(1)).alias("n"))
    out = inc.drift(days, inc.DriftPolicy(enter=0.2, release=0.1))
    return out.select(F.col("batch").alias("day"), "evaluated", F.round("ratio", 6).alias("ratio"), F.round("ewma", 6).alias("ewma"), "alarm", "recluster")


@_query("global_forced_noise", "WITH s AS (SELECT vec_id AS id, label::BIGINT AS label, vec_id % 97 AS score FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id::VARCHAR) <= ceil((SELECT count(*) FROM s) * 0.02) AS forced FROM s) SELECT id, CASE WHEN forced OR id % 11 = 0 THEN -1 ELSE label END AS cluster, CASE WHEN forced OR id % 11 = 0 THEN label || '/noise' ELSE label::VARCHAR END AS cluster_path, forced AS is_forced_noise FROM r")
def global_forced_noise(spark, sf_dir):
    """Forced noise ranked again over all accumulated rows, with the assignment columns rebuilt."""
    rows = T.embeddings(spark, sf_dir).select("id", F.col("label").alias("level_1"), (F.col("id") % 97).cast("double").alias("noise_score"), (F.col("id") % 11 == 0).alias("is_natural_noise"))
    return classify.assignments(classify.forced_noise(rows, 0.02), ["level_1"]).select("id", "cluster", "cluster_path", "is_forced_noise")
