"""Queries over configurations, thresholds, targets and sample sizes, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import vectors as V
from ..operators import analysis, incremental
from . import tables as T

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_JSON = "SELECT l_linenumber::BIGINT AS line, CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE WHEN l_linenumber = 2 THEN 'inf'::DOUBLE WHEN l_linenumber = 3 THEN '-inf'::DOUBLE ELSE l_tax::DOUBLE END AS x FROM lineitem"


@_query("json_safe", f"SELECT line, count(*) FILTER (WHERE NOT isnan(x) AND NOT isinf(x))::BIGINT AS held, round(sum(x) FILTER (WHERE NOT isnan(x) AND NOT isinf(x)), 4) AS total FROM ({_JSON}) GROUP BY line")
def json_safe(spark, sf_dir):
    line = F.col("l_linenumber").cast("long")
    x = F.when(line == 1, float("nan")).when(line == 2, float("inf")).when(line == 3, float("-inf")).otherwise(F.col("l_tax").cast("double"))
    safe = T.read(spark, sf_dir, "lineitem").select(line.alias("line"), analysis.json_safe(x).alias("x"))
    return safe.groupBy("line").agg(F.count("x").alias("held"), F.round(F.sum("x"), 4).alias("total"))


@_query("probability_rows", "WITH c AS (SELECT vec_id AS id, [greatest(v::DOUBLE, 0) FOR v IN embedding[1:6]] AS u FROM embeddings), s AS (SELECT id, u, list_sum(u) AS t FROM c), p AS (SELECT id, unnest(CASE WHEN t > 0 THEN [v / t FOR v IN u] ELSE u END) AS p, generate_subscripts(u, 1) AS k FROM s) SELECT id, k::BIGINT AS k, round(p, 6) AS p FROM p")
def probability_rows(spark, sf_dir):
    rows = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice(V.doubles("embedding"), 1, 6).alias("v"))
    return rows.select("id", F.posexplode(V.normalized_rows("v")).alias("k", "p")).select("id", (F.col("k") + 1).cast("long").alias("k"), F.round("p", 6).alias("p"))


@_query("projection_outliers", "SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, (l_tax::DOUBLE > 0 AND l_discount::DOUBLE < l_tax::DOUBLE) AS outlier FROM lineitem")
def projection_outliers(spark, sf_dir):
    outlier = analysis.projection_outlier(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))
    return T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"), outlier.alias("outlier"))


@_query("sample_sizes", "WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, n, least(n, greatest(40, ceil(n * 0.2)))::BIGINT AS sample FROM n) SELECT source, n::BIGINT AS n, sample, greatest(2, ceil(20 * sample / n))::BIGINT AS min_size FROM s")
def sample_sizes(spark, sf_dir):
    counts = T.read(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    sized = counts.withColumn("sample", analysis.sample_size(F.col("n"), 2, 0.2, None, 20))
    return sized.withColumn("min_size", analysis.scaled_min_size(20, F.col("n"), F.col("sample")))


_LEAVES = "SELECT r_name AS top, n_name AS sub, lower(n_name) AS leaf FROM nation JOIN region ON n_regionkey = r_regionkey"


def _leaves(spark, sf_dir):
    regions = T.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return T.read(spark, sf_dir, "nation").join(regions, "n_regionkey").select(F.col("r_name").alias("top"), F.col("n_name").alias("sub"), F.lower("n_name").alias("leaf"))


@_query("hierarchy_problems", f"WITH h AS ({_LEAVES} UNION ALL SELECT 'EXTRA', 'ONE', 'france' UNION ALL SELECT 'EXTRA', ' ', 'two'), t AS (SELECT top, count(*) AS n FROM h GROUP BY top) SELECT 'empty name' AS problem, leaf AS name FROM h WHERE trim(top) = '' OR trim(sub) = '' OR trim(leaf) = '' UNION ALL SELECT 'number of subtopics', top FROM t WHERE n NOT BETWEEN 3 AND 5 UNION ALL SELECT 'number of tops', (SELECT count(*) FROM t)::VARCHAR WHERE (SELECT count(*) FROM t) <> 5 UNION ALL SELECT 'leaf used twice', leaf FROM h GROUP BY leaf HAVING count(*) > 1")
def hierarchy_problems(spark, sf_dir):
    extra = spark.createDataFrame([("EXTRA", "ONE", "france"), ("EXTRA", " ", "two")], "top string, sub string, leaf string")
    return analysis.hierarchy_problems(_leaves(spark, sf_dir).unionByName(extra), 5, 3, 5)


@_query("hierarchy_signature", f"WITH h AS ({_LEAVES}), t AS (SELECT top, '{{' || string_agg('\"' || sub || '\": \"' || leaf || '\"', ', ' ORDER BY sub) || '}}' AS held FROM h GROUP BY top) SELECT sha256('{{' || string_agg('\"' || top || '\": ' || held, ', ' ORDER BY top) || '}}') AS signature FROM t")
def hierarchy_signature(spark, sf_dir):
    return analysis.hierarchy_signature(_leaves(spark, sf_dir))


@_query("added_targets", "SELECT e.vec_id AS id, e.label::BIGINT AS class, d.lang AS class_hierarchy FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def added_targets(spark, sf_dir):
    documents = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("class"), F.col("lang").alias("class_hierarchy"))
    docs = T.embeddings(spark, sf_dir).select("id", F.col("label").alias("class"))
    return analysis.add_targets(docs.join(documents.select("id"), "id", "left_semi"), documents)


@_query("supervision_memberships", "SELECT vec_id AS id, round((0.1 + label) / sqrt((0.1 + label) * (0.1 + label) + 1.0), 6)::DOUBLE AS a, round(1.0 / sqrt((0.1 + label) * (0.1 + label) + 1.0), 6)::DOUBLE AS b, 'memberships' AS kind FROM embeddings")
def supervision_memberships(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir).select("id", "label", F.array(F.col("label") + 0.1, F.lit(1.0)).alias("u"))
    found, kind = analysis.supervision(docs, "u", "label")
    return found.select("id", F.round(F.get("target", F.lit(0)), 6).alias("a"), F.round(F.get("target", F.lit(1)), 6).alias("b"), F.lit(kind).alias("kind"))


@_query("supervision_labels", "SELECT vec_id AS id, (dense_rank() OVER (ORDER BY label) - 1)::BIGINT AS target, 'labels' AS kind FROM embeddings")
def supervision_labels(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir).select("id", "label", F.array(F.lit(0.0), F.lit(0.0)).alias("u"))
    found, kind = analysis.supervision(docs, "u", "label")
    return found.select("id", "target", F.lit(kind).alias("kind"))


_PRICES = "SELECT l_returnflag AS path, l_linenumber::BIGINT AS k, CASE WHEN l_linenumber = 7 THEN 1.0 ELSE l_extendedprice::DOUBLE END AS d FROM lineitem WHERE l_linenumber < 7 OR l_returnflag <> 'A'"


@_query("refreshed_thresholds", f"WITH p AS ({_PRICES}), m AS (SELECT path, k, median(d) AS md, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT path, k, any_value(md) AS md, any_value(n) AS n, median(abs(d - md)) AS mad FROM p JOIN m USING (path, k) GROUP BY ALL), old AS (SELECT DISTINCT l_returnflag AS path, l_linenumber::BIGINT AS k FROM lineitem) SELECT path, k, CASE WHEN coalesce(n, 0) < 4 THEN 0.5 WHEN mad <= 1e-12 THEN 'inf'::DOUBLE ELSE round(md + 3.5 * 1.4826 * mad, 4) END AS threshold FROM old LEFT JOIN s USING (path, k)")
def refreshed_thresholds(spark, sf_dir):
    lines = T.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("path"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_extendedprice").cast("double").alias("distance"))
    old = lines.select("path", "k").distinct().withColumn("threshold", F.lit(0.5))
    scored = lines.where("k < 7 or path <> 'A'").withColumn("distance", F.when(F.col("k") == 7, 1.0).otherwise(F.col("distance")))
    return incremental.refreshed_thresholds(scored, old).select("path", "k", F.round("threshold", 4).alias("threshold"))


@_query("xb_degradation", f"SELECT k::BIGINT AS k, coalesce((xb - lag(xb) OVER (ORDER BY k)) / greatest(abs(lag(xb) OVER (ORDER BY k)), 1e-12) >= 0.05, false) AS refit FROM {T.values_sql(T.CANDIDATES, 'k, xb, silhouette, stability, mpc, objective')}")
def xb_degradation(spark, sf_dir):
    base = F.lag("xb").over(Window.orderBy("k"))
    return T.candidates(spark).select("k", F.coalesce(incremental.xie_beni_degraded(F.col("xb"), base), F.lit(False)).alias("refit"))


@_query("held_out_split", "WITH k AS (SELECT unnest(['initial rows and new rows are all rows', 'modified rows are initial too', 'both halves are near their share', 'noise has its length']) AS fact) SELECT fact, true AS holds FROM k")
def held_out_split(spark, sf_dir):
    """Facts about the split of all embeddings, each of which must hold."""
    docs = T.embeddings(spark, sf_dir)
    split = incremental.held_out_split(docs, 0.3, 0.1)
    was = docs.select("id", F.col("x").alias("was"))
    moved = F.abs(F.sqrt(V.squared_euclid("x", "was")) - 0.1) < 1e-9
    rows = split.join(was, "id").agg(*[F.sum((F.col("operation") == k).cast("int")).alias(k) for k in ("initial", "new", "modified")], F.min(F.when(F.col("operation") == "modified", moved)).alias("noise"), F.countDistinct("id").alias("ids"))
    near = lambda c: F.abs(F.col(c) / F.col("ids") - 0.15) < 0.05
    facts = {"initial rows and new rows are all rows": F.col("initial") + F.col("new") == F.col("ids"), "modified rows are initial too": F.col("modified") < F.col("initial"), "both halves are near their share": near("new") & near("modified"), "noise has its length": F.col("noise")}
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("holds")) for k, v in facts.items()])).alias("f")).select("f.fact", "f.holds")
