"""Queries over runs, histories and names, with their oracles; and synthetic collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis
from ..sources import synthetic
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


@_query("sweep_baseline_delta", "WITH r AS (SELECT l_returnflag AS variant, l_linenumber::BIGINT AS n, avg(l_discount)::DOUBLE AS v FROM lineitem GROUP BY ALL) SELECT r.variant, r.n, round(r.v, 6) AS v, round(r.v - b.v, 6) AS delta FROM r LEFT JOIN r b ON b.variant = 'A' AND b.n = r.n")
def sweep_baseline_delta(spark, sf_dir):
    runs = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").cast("long").alias("n")).agg(F.avg(F.col("l_discount").cast("double")).alias("v"))
    return analysis.baseline_delta(runs, "variant", "A", ["n"], "v").select("variant", "n", F.round("v", 6).alias("v"), F.round("delta", 6).alias("delta"))


_RUNS = "WITH a AS (SELECT vec_id AS id, label::VARCHAR AS t FROM embeddings), b AS (SELECT vec_id AS id, ((label + (vec_id % 6 = 0)::INT) % 10)::VARCHAR AS p FROM embeddings), x AS (SELECT t, p FROM a JOIN b USING (id)), c AS (SELECT t, p, count(*)::DOUBLE AS n FROM x GROUP BY ALL)"


@_query("run_comparison", _RUNS + ", s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY t)) AS tt, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY p)) AS pp, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS al) SELECT (SELECT count(*) FROM x) AS rows, round((SELECT avg((t = p)::INT) FROM x), 6) AS equal, round((b - tt * pp / al) / ((tt + pp) / 2 - tt * pp / al), 6) AS ari FROM s")
def run_comparison(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    a = docs.select("id", F.col("label").cast("string").alias("path"))
    b = docs.select("id", F.pmod(F.col("label") + F.when(F.col("id") % 6 == 0, 1).otherwise(0), F.lit(10)).cast("string").alias("path"))
    return analysis.compare_runs(a, b).select("rows", F.round("equal", 6).alias("equal"), F.round("ari", 6).alias("ari"))


@_query("hdbscan_soft_summary", "WITH s AS (SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS hard, CASE WHEN vec_id % 20 = 0 THEN -1 ELSE label END AS soft, (vec_id % 13) / 13.0 AS p FROM embeddings) SELECT count(*) AS rows, round(avg((hard = soft)::INT), 6) AS agreement, count(*) FILTER (hard = -1 AND soft >= 0) AS reassigned, count(*) FILTER (soft = -1) AS noise, round(avg(p) FILTER (soft >= 0), 6) AS confidence FROM s")
def hdbscan_soft_summary(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    keep = lambda k: F.when(F.col("id") % k == 0, F.lit(-1)).otherwise(F.col("label"))
    out = analysis.soft_summary(docs.select(keep(10).alias("hard"), keep(20).alias("soft"), ((F.col("id") % 13) / 13.0).alias("probability")))
    return out.select("rows", F.round("agreement", 6).alias("agreement"), "reassigned", "noise", F.round("confidence", 6).alias("confidence"))


@_query("history_retention", "SELECT event_id AS generation, 'b' || event_id AS batch_id FROM events ORDER BY event_id DESC LIMIT 256")
def history_retention(spark, sf_dir):
    return analysis.retained(T.read(spark, sf_dir, "events").select(F.col("event_id").alias("generation"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("batch_id")))


@_query("batch_id_resolution", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'auto:' || md5(text) WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN lang ELSE source END AS name FROM documents")
def batch_id_resolution(spark, sf_dir):
    given = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "   ").when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), "lang", F.lit(" "))).otherwise(F.col("source"))
    return T.read(spark, sf_dir, "documents").select("doc_id", analysis.batch_name(given, F.md5("text")).alias("name"))


@_query("truthiness", "SELECT c_custkey, c_custkey % 5 IN (0, 1, 2) AS yes FROM customer")
def truthiness(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in ("TRUE", " yes ", "1", "no", "")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return T.read(spark, sf_dir, "customer").select("c_custkey", analysis.truthy(said).alias("yes"))


@_query("pipeline_file_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS name FROM part")
def pipeline_file_names(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", analysis.file_name(F.col("p_name")).alias("name"))


@_query("candidate_validity", "SELECT label::BIGINT AS k, count(*) AS smallest FROM embeddings WHERE label >= 2 GROUP BY label HAVING count(*) >= 45")
def candidate_validity(spark, sf_dir):
    sizes = T.embeddings(spark, sf_dir).groupBy(F.col("label").alias("k")).agg(F.count(F.lit(1)).alias("smallest"))
    full = sizes.withColumn("valid_restarts", F.lit(1)).withColumn("xb", F.when(F.col("k") == 1, F.lit(float("nan"))).otherwise(0.5)).withColumn("silhouette", F.lit(0.1)).withColumn("separation", F.lit(0.5))
    return analysis.valid_candidates(full, 45).select("k", "smallest")


@_query("label_compaction", "WITH l AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label * 7 END AS c FROM embeddings) SELECT id, CASE WHEN c < 0 THEN -1 ELSE (SELECT count(DISTINCT o.c) FROM l o WHERE o.c >= 0 AND o.c < l.c) END AS cluster FROM l")
def label_compaction(spark, sf_dir):
    raw = T.embeddings(spark, sf_dir).select("id", F.when(F.col("id") % 9 == 0, F.lit(-1)).otherwise(F.col("label") * 7).cast("long").alias("cluster"))
    return analysis.compact_labels(raw).select("id", "cluster")


@_query("rows_by_id", "SELECT vec_id AS id, label::BIGINT AS label, 100 - vec_id AS place FROM embeddings WHERE vec_id BETWEEN 10 AND 60")
def rows_by_id(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    return analysis.select_rows(docs.select("id", "label"), docs.where("id between 10 and 60").select("id", (100 - F.col("id")).alias("place")))


@_query("colour_table")
def colour_table(spark, sf_dir):
    return spark.createDataFrame(analysis.colours(4, 3), "top long, child long, colour string")


@_query("synthetic_collections")
def synthetic_collections(spark, sf_dir):
    """Rows and width of every synthetic collection."""
    made = {"blobs": synthetic.blobs(spark, 200), "tagged": synthetic.tagged(spark, 80).withColumnRenamed("content", "x")} | {k: synthetic.adversarial(spark, k) for k in synthetic.CASES}
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("x")).alias("dims")).withColumn("name", F.lit(k)) for k, df in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
