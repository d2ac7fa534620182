"""Queries over embeddings: steps of fuzzy C-means, metrics, thresholds and neighbours, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators import classify, extract, fcm, metrics, neighbors
from . import tables as T

QUERIES: dict = {}
ORACLES: dict = {}
M = 1.2

BASE = """WITH e AS (SELECT vec_id AS id, label::BIGINT AS label, list_transform(embedding, lambda v: v::DOUBLE) AS r FROM embeddings),
n AS (SELECT id, label, list_transform(r, lambda v: v / sqrt(list_dot_product(r, r))) AS x FROM e)"""
CENTERS = BASE + """,
f AS (SELECT id, label, unnest(range(0, len(x))) AS dim, unnest(x) AS v FROM n),
c0 AS (SELECT label AS k, dim, sum(v) AS v FROM f GROUP BY ALL),
c1 AS (SELECT k, sqrt(sum(v * v)) AS s FROM c0 GROUP BY k),
c AS (SELECT c0.k, list(c0.v / c1.s ORDER BY dim) AS c FROM c0 JOIN c1 USING (k) GROUP BY c0.k)"""


def _membership(prefix: str, d: str, m: float) -> str:
    """CTEs of squared distances and memberships: <prefix>u(id, label, k, d2, u)."""
    p = f"pow(d2 / least, {-1 / (m - 1)!r})"
    hit = "CASE WHEN d2 <= 1e-12 THEN 1.0 ELSE 0.0 END"
    return f"""{prefix}d AS ({d}), {prefix}w AS (SELECT *, min(d2) OVER (PARTITION BY id) AS least FROM {prefix}d),
{prefix}u AS (SELECT id, label, k, d2, CASE WHEN least <= 1e-12 THEN ({hit}) / sum({hit}) OVER (PARTITION BY id) ELSE {p} / sum({p}) OVER (PARTITION BY id) END AS u FROM {prefix}w)"""


SCORED = CENTERS + ",\n" + _membership("", "SELECT n.id, n.label, c.k, greatest(2 - 2 * list_dot_product(n.x, c.c), 0) AS d2 FROM n, c", M) + """,
a0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY u DESC, k) AS rn, max(u) OVER (PARTITION BY id) AS top1 FROM u),
a AS (SELECT a0.id, a0.label, a0.k AS cluster, a0.d2, a0.u AS top1, b.u AS top2 FROM a0 JOIN a0 AS b ON a0.id = b.id AND b.rn = 2 WHERE a0.rn = 1)"""


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def scored(spark: SparkSession, sf_dir: str, m: float = M) -> tuple[DataFrame, list, object]:
    """Embeddings scored against their labels' centers."""
    docs = T.embeddings(spark, sf_dir)
    keys, centers = fcm.label_centers(docs)
    return fcm.e_step(docs, centers, m), keys, centers


def _long(spark: SparkSession, centers, keys: list | None = None) -> DataFrame:
    return fcm.centers_frame(spark, centers, keys).select("k", F.posexplode("center").alias("dim", "value")).select("k", F.col("dim").cast("long"), F.round("value", 6).alias("value"))


@_query("l2_normalize_stats", BASE + " SELECT count(*) AS n, min(len(r)) AS min_dim, max(len(r)) AS max_dim, round(avg(sqrt(list_dot_product(x, x))), 6) AS mean_norm, round(sum(x[1]), 6) AS first_sum FROM n JOIN e USING (id)")
def l2_normalize_stats(spark, sf_dir):
    x = T.embeddings(spark, sf_dir)
    return x.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).cast("long").alias("min_dim"), F.max(F.size("x")).cast("long").alias("max_dim"), F.round(F.avg(V.norm("x")), 6).alias("mean_norm"), F.round(F.sum(F.get("x", F.lit(0))), 6).alias("first_sum"))


@_query("label_centers", CENTERS + " SELECT c0.k, dim, round(v / s, 6) AS value FROM c0 JOIN c1 USING (k)")
def label_centers(spark, sf_dir):
    keys, centers = fcm.label_centers(T.embeddings(spark, sf_dir))
    return _long(spark, centers, keys)


@_query("center_separation", CENTERS + " SELECT a.k, round(min(2 - 2 * list_dot_product(a.c, b.c)), 6) AS nearest FROM c a JOIN c b ON a.k <> b.k GROUP BY a.k")
def center_separation(spark, sf_dir):
    keys, centers = fcm.label_centers(T.embeddings(spark, sf_dir))
    c = F.broadcast(fcm.centers_frame(spark, centers, keys))  # K vectors, a model
    other = c.select(F.col("k").alias("j"), F.col("center").alias("other"))
    return c.join(other, F.col("k") != F.col("j")).groupBy("k").agg(F.round(F.min(V.squared_chord("center", "other")), 6).alias("nearest"))


@_query("sfcm_estep", SCORED + " SELECT id, k, round(u, 6) AS u, round(d2, 6) AS d2 FROM u")
def sfcm_estep(spark, sf_dir):
    s, _, _ = scored(spark, sf_dir)
    return s.select("id", F.posexplode(F.arrays_zip("u", "d2")).alias("k", "z")).select("id", F.col("k").cast("long"), F.round("z.u", 6).alias("u"), F.round("z.d2", 6).alias("d2"))


@_query("sfcm_exact_match_ties", BASE + ", c AS (SELECT unnest([0, 1, 2]) AS k, unnest([0, 1, 1]) AS ref), " + _membership("", "SELECT n.id, n.label, c.k, greatest(2 - 2 * list_dot_product(n.x, r.x), 0) AS d2 FROM n, c JOIN n r ON r.id = c.ref", 2.0) + " SELECT id, k::BIGINT AS k, round(u, 6) AS u FROM u")
def sfcm_exact_match_ties(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    points = {r["id"]: r["x"] for r in docs.where("id < 2").collect()}
    u = fcm.e_step(docs, [points[0], points[1], points[1]], 2.0)
    return u.select("id", F.posexplode("u").alias("k", "u")).select("id", F.col("k").cast("long"), F.round("u", 6).alias("u"))


@_query("sfcm_labels", SCORED + " SELECT id, cluster, round(top1, 6) AS top1, round(top1 - top2, 6) AS gap FROM a")
def sfcm_labels(spark, sf_dir):
    s, _, _ = scored(spark, sf_dir)
    return s.select("id", "cluster", F.round(V.top("u", 1), 6).alias("top1"), F.round(V.gap("u"), 6).alias("gap"))


def _m_step_sql(u: str, out: str) -> str:
    return f"""{out}0 AS (SELECT {u}.k, f.dim, sum(pow({u}.u, {M}) * f.v) AS v FROM {u} JOIN f USING (id) GROUP BY ALL),
{out}1 AS (SELECT k, sqrt(sum(v * v)) AS s FROM {out}0 GROUP BY k), {out} AS (SELECT {out}0.k, dim, v / s AS v FROM {out}0 JOIN {out}1 USING (k))"""


@_query("sfcm_mstep", SCORED + ", " + _m_step_sql("u", "v1") + " SELECT k, dim, round(v, 6) AS value FROM v1")
def sfcm_mstep(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    _, centers = fcm.label_centers(docs)
    return _long(spark, fcm.m_step(docs, centers, M)[0])


@_query("sfcm_two_steps", SCORED + ", " + _m_step_sql("u", "v1") + ", q AS (SELECT k, list(v ORDER BY dim) AS c FROM v1 GROUP BY k), " + _membership("s", "SELECT n.id, n.label, q.k, greatest(2 - 2 * list_dot_product(n.x, q.c), 0) AS d2 FROM n, q", M) + ", " + _m_step_sql("su", "v2") + " SELECT k, dim, round(v, 6) AS value FROM v2")
def sfcm_two_steps(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    _, centers = fcm.label_centers(docs)
    for _ in range(2):
        centers = fcm.m_step(docs, centers, M)[0]
    return _long(spark, centers)


def _geometry(name: str):
    def run(spark, sf_dir):
        docs = T.embeddings(spark, sf_dir)
        _, centers = fcm.label_centers(docs)
        s = fcm.e_step(docs, centers, 2.0, name)
        return s.select("id", F.posexplode("u").alias("k", "u")).select("id", F.col("k").cast("long"), F.round("u", 6).alias("u"))

    return run


_query("geometry_estep_euclid", CENTERS + ", " + _membership("", "SELECT n.id, n.label, c.k, list_distance(n.x, c.c) ** 2 AS d2 FROM n, c", 2.0) + " SELECT id, k, round(u, 6) AS u FROM u")(_geometry("euclidean"))
_query("geometry_estep_cosine_raw", CENTERS + ", " + _membership("", "SELECT n.id, n.label, c.k, greatest(1 - list_cosine_similarity(n.x, c.c), 0) AS d2 FROM n, c", 2.0) + " SELECT id, k, round(u, 6) AS u FROM u")(_geometry("cosine_raw"))

_SEPARATION = "(SELECT min(2 - 2 * list_dot_product(a.c, b.c)) FROM c a JOIN c b ON a.k < b.k)"
_OBJECTIVE = f"(SELECT sum(pow(u, {M}) * d2) / count(DISTINCT id) FROM u)"
_PC = "(SELECT sum(u * u) / count(DISTINCT id) FROM u)"
_ENTROPY = "(SELECT -sum(u * ln(greatest(u, 1e-12))) / count(DISTINCT id) FROM u)"
_K = "(SELECT count(*) FROM c)"
_PROXY = """(SELECT sum((o - own) / greatest(own, o, 1e-12) * w) / sum(w) FROM (SELECT sqrt(a.d2) AS own, sqrt((SELECT min(u.d2) FROM u WHERE u.id = a.id AND u.k <> a.cluster)) AS o, greatest(top1 - top2, 1e-12) AS w FROM a))"""
_FUZZY = """(SELECT avg((b - a) / greatest(a, b)) FROM (SELECT id, sum(u * u * sqrt(d2)) / sum(u * u) AS a, list_sort(list(sqrt(d2)))[2] AS b FROM u GROUP BY id))"""
_EXTRACTOR = f"(SELECT sum(u * u * d2) / count(DISTINCT id) FROM u) / greatest({_SEPARATION}, 1e-12)"


@_query("fcm_objective", SCORED + f" SELECT round({_OBJECTIVE}, 6) AS objective")
def fcm_objective(spark, sf_dir):
    s, _, _ = scored(spark, sf_dir)
    return s.agg(F.round(metrics.objective(s, M), 6).alias("objective"))


@_query("xie_beni", SCORED + f" SELECT round({_OBJECTIVE} / greatest({_SEPARATION}, 1e-12), 6) AS xie_beni")
def xie_beni(spark, sf_dir):
    s, _, centers = scored(spark, sf_dir)
    return s.agg(F.round(metrics.xie_beni(M, metrics.min_separation(centers)), 6).alias("xie_beni"))


@_query("partition_coefficients", SCORED + f" SELECT round({_PC}, 6) AS pc, round(({_PC} - 1.0 / {_K}) / (1 - 1.0 / {_K}), 6) AS mpc")
def partition_coefficients(spark, sf_dir):
    s, keys, _ = scored(spark, sf_dir)
    return s.agg(F.round(metrics.partition_coefficient(), 6).alias("pc"), F.round(metrics.modified_partition_coefficient(len(keys)), 6).alias("mpc"))


@_query("partition_entropy", SCORED + f" SELECT round({_ENTROPY}, 6) AS entropy, round({_ENTROPY} / ln({_K}), 6) AS normalized")
def partition_entropy(spark, sf_dir):
    s, keys, _ = scored(spark, sf_dir)
    return s.agg(F.round(metrics.partition_entropy(), 6).alias("entropy"), F.round(metrics.partition_entropy() / F.log(F.lit(float(len(keys)))), 6).alias("normalized"))


@_query("fuzzy_silhouette_proxy", SCORED + f" SELECT round({_PROXY}, 6) AS proxy")
def fuzzy_silhouette_proxy(spark, sf_dir):
    return scored(spark, sf_dir)[0].agg(F.round(metrics.fuzzy_silhouette_proxy(), 6).alias("proxy"))


@_query("extractor_xb_fuzzy_silhouette", SCORED + f" SELECT round({_EXTRACTOR}, 6) AS xb, round({_FUZZY}, 6) AS silhouette")
def extractor_xb_fuzzy_silhouette(spark, sf_dir):
    s, _, centers = scored(spark, sf_dir)
    return s.agg(F.round(metrics.xie_beni(2.0, metrics.min_separation(centers)), 6).alias("xb"), F.round(metrics.extractor_silhouette(), 6).alias("silhouette"))


@_query("silhouette_exact", SCORED + """, p AS (SELECT x.id, x.cluster, y.cluster AS other, sum(list_distance(n1.x, n2.x)) AS d, count(*) AS c FROM a x JOIN n n1 ON n1.id = x.id, a y JOIN n n2 ON n2.id = y.id WHERE x.id <> y.id GROUP BY ALL),
q AS (SELECT id, cluster, max(CASE WHEN other = cluster THEN d / c END) AS a, min(CASE WHEN other <> cluster THEN d / c END) AS b FROM p GROUP BY ALL)
SELECT cluster, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM q GROUP BY cluster""")
def silhouette_exact(spark, sf_dir):
    s, _, _ = scored(spark, sf_dir)
    return metrics.silhouette(s).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 5).alias("silhouette"))


_CONTINGENCY = ", t AS (SELECT label AS t, cluster AS p, count(*) AS n FROM a GROUP BY ALL)"
_EXTERNAL = _CONTINGENCY + """, r AS (SELECT t, sum(n)::DOUBLE AS n FROM t GROUP BY t), l AS (SELECT p, sum(n)::DOUBLE AS n FROM t GROUP BY p), z AS (SELECT sum(n)::DOUBLE AS n FROM t),
h AS (SELECT (SELECT -sum(r.n / z.n * ln(r.n / z.n)) FROM r, z) AS ht, (SELECT -sum(l.n / z.n * ln(l.n / z.n)) FROM l, z) AS hp, (SELECT -sum(t.n / z.n * ln(t.n / z.n)) FROM t, z) AS hb,
(SELECT sum(n * (n - 1) / 2) FROM t) AS b, (SELECT sum(n * (n - 1) / 2) FROM r) AS tt, (SELECT sum(n * (n - 1) / 2) FROM l) AS pp, (SELECT n * (n - 1) / 2 FROM z) AS al),
o AS (SELECT (b - tt * pp / al) / ((tt + pp) / 2 - tt * pp / al) AS ari, (ht + hp - hb) / ((ht + hp) / 2) AS nmi, (ht + hp - hb) / ht AS homogeneity, (ht + hp - hb) / hp AS completeness FROM h)"""


@_query("contingency", SCORED + _CONTINGENCY + " SELECT t, p, n FROM t")
def contingency(spark, sf_dir):
    return metrics.contingency(scored(spark, sf_dir)[0], "label", "cluster")


@_query("external_metrics", SCORED + _EXTERNAL + " SELECT round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v_measure FROM o")
def external_metrics(spark, sf_dir):
    out = metrics.external_metrics(metrics.contingency(scored(spark, sf_dir)[0], "label", "cluster"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_query("tag_fragmentation", SCORED + " SELECT round(avg(k), 6) AS fragmentation FROM (SELECT label, count(DISTINCT cluster) AS k FROM a GROUP BY label)")
def tag_fragmentation(spark, sf_dir):
    return metrics.tag_fragmentation(scored(spark, sf_dir)[0], "label", "cluster").select(F.round("fragmentation", 6).alias("fragmentation"))


@_query("sfcm_quality", SCORED + _EXTERNAL + f""" SELECT unnest(['objective', 'xie_beni', 'pc', 'entropy', 'proxy', 'ari', 'nmi']) AS name,
round(unnest([{_OBJECTIVE}, {_OBJECTIVE} / greatest({_SEPARATION}, 1e-12), {_PC}, {_ENTROPY}, {_PROXY}, (SELECT ari FROM o), (SELECT nmi FROM o)]), 6) AS value""")
def sfcm_quality(spark, sf_dir):
    """The flagship: one pass of spherical fuzzy C-means with its internal, fuzzy and external metrics."""
    s, _, centers = scored(spark, sf_dir)
    s = s.persist()
    sep = metrics.min_separation(centers)
    internal = s.agg(metrics.objective(s, M).alias("objective"), metrics.xie_beni(M, sep).alias("xie_beni"), metrics.partition_coefficient().alias("pc"), metrics.partition_entropy().alias("entropy"), metrics.fuzzy_silhouette_proxy().alias("proxy"))
    external = metrics.external_metrics(metrics.contingency(s, "label", "cluster")).select("ari", "nmi")
    row = internal.crossJoin(external)  # two single rows
    return row.unpivot([], list(row.columns), "name", "value").select("name", F.round("value", 6).alias("value"))


@_query("restart_stability", CENTERS + "".join(", " + _membership(f"m{i}", "SELECT n.id, n.label, c.k, greatest(2 - 2 * list_dot_product(n.x, c.c), 0) + CASE WHEN (n.id + c.k) % %d = 0 THEN 0.2 ELSE 0 END AS d2 FROM n, c".replace("%d", str(3 + i)), M) + f", b{i} AS (SELECT id, arg_max(k, u) AS p FROM m{i}u GROUP BY id)" for i in range(3)) + "".join(f""", t{i}{j} AS (SELECT x.p AS t, y.p AS p, count(*)::DOUBLE AS n FROM b{i} x JOIN b{j} y USING (id) GROUP BY ALL), s{i}{j} AS (SELECT {i} AS run_a, {j} AS run_b, (SELECT sum(n * (n - 1) / 2) FROM t{i}{j}) AS b, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t{i}{j} GROUP BY t)) AS tt, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t{i}{j} GROUP BY p)) AS pp, (SELECT sum(n) * (sum(n) - 1) / 2 FROM t{i}{j}) AS al)""" for i in range(3) for j in range(i + 1, 3)) + " SELECT round(avg((b - tt * pp / al) / ((tt + pp) / 2 - tt * pp / al)), 6) AS stability FROM (SELECT * FROM s01 UNION ALL SELECT * FROM s02 UNION ALL SELECT * FROM s12)")
def restart_stability(spark, sf_dir):
    """Mean ARI of pairs among three labelings, each from distances shifted by its own rule."""
    s, _, _ = scored(spark, sf_dir)
    for i in range(3):
        shifted = F.expr(f"transform(d2, (d, k) -> d + IF((id + k) % {3 + i} = 0, 0.2D, 0.0D))")
        s = s.withColumn(f"run{i}", V.argmax(V.memberships(shifted, M)))
    pairs = [metrics.external_metrics(metrics.contingency(s, f"run{i}", f"run{j}")).select("ari") for i in range(3) for j in range(i + 1, 3)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).agg(F.round(F.avg("ari"), 6).alias("stability"))


_ROBUST = SCORED + """, md AS (SELECT cluster, median(sqrt(d2)) AS med FROM a GROUP BY cluster),
th AS (SELECT a.cluster, count(*) AS n, any_value(med) AS med, median(abs(sqrt(d2) - med)) AS mad FROM a JOIN md USING (cluster) GROUP BY a.cluster),
tr AS (SELECT cluster, n, med, mad, CASE WHEN n < 4 OR mad <= 1e-12 THEN 'inf'::DOUBLE ELSE med + %s * 1.4826 * mad END AS threshold FROM th)"""


def _with_distance(spark, sf_dir):
    s, _, _ = scored(spark, sf_dir)
    return s.withColumn("distance", F.sqrt(F.get("d2", F.col("cluster").cast("int"))))


@_query("robust_thresholds", _ROBUST % "3.0" + " SELECT cluster, n, round(med, 6) AS median, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM tr")
def robust_thresholds(spark, sf_dir):
    t = metrics.robust_thresholds(_with_distance(spark, sf_dir), "cluster", "distance")
    return t.select("cluster", "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "threshold")])


_MIN_U, _GAP, _Z = 0.9, 0.6, 0.5


@_query("document_types", _ROBUST % str(_Z) + f""", ty AS (SELECT id, a.cluster, CASE WHEN top1 < {_MIN_U} AND top1 - top2 < {_GAP} AND sqrt(d2) > threshold THEN 'noise' WHEN top1 < {_MIN_U} AND top1 - top2 < {_GAP} THEN 'boundary' ELSE 'core' END AS document_type FROM a JOIN tr USING (cluster))
SELECT id, cluster, document_type FROM ty""")
def document_types(spark, sf_dir):
    s = _with_distance(spark, sf_dir)
    limits = metrics.robust_thresholds(s, "cluster", "distance", _Z).select("cluster", "threshold")
    typed = s.join(F.broadcast(limits), "cluster")  # one row for each cluster
    return typed.select("id", "cluster", classify.document_type(F.col("distance"), F.col("threshold"), "u", _MIN_U, _GAP).alias("document_type"))


_RANK = lambda x, part="": f"(rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part.replace('PARTITION BY ', '') + ', ' if part else ''}{x}) - 1) / 2.0) / count(*) OVER ({part})"
_NOISE = SCORED + f""", k0 AS (SELECT id, cluster, round(1 - top1, 12) AS a1, round(1 - (top1 - top2), 12) AS a2, round(sqrt(d2), 12) AS a3 FROM a),
ns AS (SELECT id, cluster, round(cbrt({_RANK('a1')} * {_RANK('a2')} * {_RANK('a3', 'PARTITION BY cluster')}), 6) AS noise_score FROM k0)"""


@_query("noise_scores", _NOISE + " SELECT id, cluster, noise_score FROM ns")
def noise_scores(spark, sf_dir):
    return classify.noise_scores(_with_distance(spark, sf_dir)).select("id", "cluster", F.round("noise_score", 6).alias("noise_score"))


@_query("forced_noise_topk", _NOISE + " SELECT id, noise_score FROM ns QUALIFY row_number() OVER (ORDER BY noise_score DESC, id::VARCHAR) <= ceil((SELECT count(*) FROM ns) * 0.05)")
def forced_noise_topk(spark, sf_dir):
    return classify.forced_noise(noise_scores(spark, sf_dir), 0.05).where("is_forced_noise").select("id", "noise_score")


@_query("filter_small_clusters", SCORED + ", z AS (SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM a) SELECT id, dense_rank() OVER (ORDER BY cluster) - 1 AS cluster, size FROM z WHERE size >= 50")
def filter_small_clusters(spark, sf_dir):
    return classify.keep_large_clusters(scored(spark, sf_dir)[0].select("id", "cluster"), "cluster", 50).select("id", "cluster", "size")


_KNN = lambda name, dims: f"""{name}0 AS (SELECT id, x[1:{dims}] AS y FROM n), {name}1 AS (SELECT id, list_transform(y, lambda v: v / sqrt(list_dot_product(y, y))) AS y FROM {name}0),
{name} AS (SELECT a.id, b.id AS neighbor, 1 - list_dot_product(a.y, b.y) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_dot_product(a.y, b.y), b.id) AS rank FROM {name}1 a JOIN {name}1 b ON a.id <> b.id QUALIFY rank <= 10)"""  # noqa: E731


@_query("knn_topk", BASE + ", " + _KNN("k", 64) + " SELECT id, neighbor, rank, round(distance, 6) AS distance FROM k")
def knn_topk(spark, sf_dir):
    x = T.embeddings(spark, sf_dir)
    return neighbors.knn(x, x, 10).select("id", "neighbor", "rank", F.round("distance", 6).alias("distance"))


@_query("knn_preservation", BASE + ", " + _KNN("k", 64) + ", " + _KNN("j", 16) + " SELECT round(count(j.id) / count(*), 6) AS preservation FROM k LEFT JOIN j USING (id, neighbor)")
def knn_preservation(spark, sf_dir):
    x = T.embeddings(spark, sf_dir)
    return neighbors.preservation(neighbors.knn(x, x, 10), neighbors.knn(x, x, 10, dims=16), 10).select(F.round("preservation", 6).alias("preservation"))


_EXTRACTED = SCORED + _EXTERNAL + """,
g AS (SELECT label, count(DISTINCT cluster) AS k FROM a GROUP BY label),
k AS (SELECT count(DISTINCT k)::DOUBLE AS k FROM u),
q AS (SELECT avg(pc) AS pc, avg(pe) AS pe FROM (SELECT id, sum(u * u) AS pc, -sum(u * ln(greatest(u, 1e-12))) AS pe FROM u GROUP BY id)),
s0 AS (SELECT u.k, f.dim, sum(u.u * u.u * f.v) AS v FROM u JOIN f USING (id) GROUP BY ALL), s1 AS (SELECT k, sqrt(sum(v * v)) AS s FROM s0 GROUP BY k), sc AS (SELECT s0.k, list(v / s ORDER BY dim) AS c FROM s0 JOIN s1 USING (k) GROUP BY s0.k),
sd AS (SELECT u.id, u.u, greatest(2 - 2 * list_dot_product(n.x, sc.c), 0) AS d2 FROM u JOIN n USING (id) JOIN sc USING (k)),
sp AS (SELECT min(2 - 2 * list_dot_product(x.c, y.c)) AS s FROM sc x JOIN sc y ON x.k <> y.k),
sf AS (SELECT id, sum(u * u * sqrt(d2)) / sum(u * u) AS a, (list(sqrt(d2) ORDER BY d2))[2] AS b FROM sd GROUP BY id)"""


@_query("extract_metrics", _EXTRACTED + """ SELECT (SELECT count(*) FROM n) AS samples, (SELECT count(DISTINCT cluster) FROM a) AS clusters, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round((SELECT avg(k) FROM g), 6) AS tag_fragmentation,
round(pc, 6) AS partition_coefficient, round((pc - 1 / k.k) / (1 - 1 / k.k), 6) AS modified_partition_coefficient, round(pe / ln(k.k), 6) AS normalized_partition_entropy,
round((SELECT sum(u * u * d2) FROM sd) / (SELECT count(*) FROM n) / (SELECT s FROM sp), 6) AS xie_beni, round((SELECT avg((b - a) / greatest(a, b)) FROM sf), 6) AS fuzzy_silhouette FROM o, q, k""")
def extract_metrics(spark, sf_dir):
    """Metrics of assignments, with centers from the squared memberships."""
    s, _, _ = scored(spark, sf_dir)
    out = extract.extract_metrics(s.select("id", "cluster", F.col("label").cast("string").alias("class"), "u", "x"))
    values = ("ari", "nmi", "tag_fragmentation", "partition_coefficient", "modified_partition_coefficient", "normalized_partition_entropy", "xie_beni", "fuzzy_silhouette")
    return out.select("samples", "clusters", *[F.round(c, 6).alias(c) for c in values])
