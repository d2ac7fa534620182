"""Queries over records, joins, soft clusters and labels, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import sources
from ..functions import vectors as V
from ..operators import metrics, soft
from . import tables as T
from .clustering import BASE, SCORED, scored

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return add


@_query("record_defaults", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'r' || doc_id END, doc_id::VARCHAR) AS id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 5 = 0 THEN source END, 'Document_' || doc_id) AS tag FROM documents")
def record_defaults(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    records = d.select("doc_id", F.col("doc_id").alias("pos"), F.lit(None).cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("r"), F.col("doc_id").cast("string"))).alias("resource"), F.lit(None).cast("string").alias("tag"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("class_hierarchy"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).alias("class"))
    return sources.with_defaults(records).select("doc_id", "id", "tag")


@_query("exact_sample", "SELECT vec_id AS id, label::BIGINT AS label FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id LIMIT 100")
def exact_sample(spark, sf_dir):
    return sources.exact_sample(T.embeddings(spark, sf_dir), 100, 42).select("id", "label")


@_query("nested_sample", "WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id) AS p FROM embeddings) SELECT size::BIGINT AS size, count(*) AS n, sum(id)::BIGINT AS id_sum FROM r, (VALUES (50), (100), (200)) s(size) WHERE p <= size GROUP BY size")
def nested_sample(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    parts = [sources.exact_sample(docs, n, 42).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")).withColumn("size", F.lit(n).cast("long")) for n in (50, 100, 200)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("size", "n", "id_sum")


@_query("text_builder", r"WITH t AS (SELECT doc_id, trim(regexp_replace(lang || '. ' || text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) <= 800 THEN t ELSE regexp_replace(substring(t, 1, 800), ' [^ ]*$', '') END) AS digest FROM t")
def text_builder(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", F.md5(sources.embedding_text(F.col("lang"), F.col("text"), 800)).alias("digest"))


@_query("dedupe_stratified_plan", "WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents), g AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS m FROM f WHERE n = 1) SELECT doc_id, source FROM g WHERE m <= 10")
def dedupe_stratified_plan(spark, sf_dir):
    return sources.stratified(T.read(spark, sf_dir, "documents"), 10, "source", "text", "doc_id").select("doc_id", "source")


@_query("hierarchy_parse", "SELECT DISTINCT label::BIGINT AS label, (label % 3)::VARCHAR AS top, label::VARCHAR AS leaf FROM embeddings")
def hierarchy_parse(spark, sf_dir):
    """Hierarchies written in two notations, one row for each label."""
    top, leaf = (F.col("label") % 3).cast("string"), F.col("label").cast("string")
    raw = F.when(F.col("label") % 2 == 0, F.concat(F.lit('["'), top, F.lit('", "'), leaf, F.lit('"]'))).otherwise(F.concat(F.lit("['"), top, F.lit("', '"), leaf, F.lit("']")))
    parsed = T.embeddings(spark, sf_dir).select("label", sources.parse_hierarchy(raw).alias("h"))
    return sources.unique_labels(parsed, "label", "h").select("label", F.get("h", F.lit(0)).alias("top"), F.get("h", F.lit(1)).alias("leaf"))


@_query("metadata_align_join", "SELECT vec_id AS id, e.label::BIGINT AS label, l.toxic::BIGINT AS toxic, d.lang FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id LEFT JOIN documents d ON d.doc_id = e.vec_id")
def metadata_align_join(spark, sf_dir):
    e = T.embeddings(spark, sf_dir).select(F.col("id").cast("string").alias("key"), "id", "label")
    labels = T.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.col("toxic").cast("long").alias("toxic"))
    docs = T.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang")
    return e.join(labels, "key", "left").join(docs, "key", "left").select("id", "label", "toxic", "lang")


_TAGS = BASE + ", tags AS (SELECT label, x AS t FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1)"


def _tags(docs):
    return docs.withColumn("first", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("first = 1").select("label", "x")


@_query("tag_join_concat", _TAGS + ", j AS (SELECT id, list_concat(x, list_transform(t, lambda v: v * 2)) AS y FROM n JOIN tags USING (label)) SELECT id, len(y) AS dims, round(list_sum(y), 6) AS total, round(sqrt(list_dot_product(y, y)), 6) AS length FROM j")
def tag_join_concat(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    return soft.concat_tags(docs, _tags(docs), "label", 2.0).select("id", F.size("x").cast("long").alias("dims"), F.round(V.total("x"), 6).alias("total"), F.round(V.norm("x"), 6).alias("length"))


@_query("additive_fusion", _TAGS + ", j AS (SELECT id, list_transform(list_zip(x, t), lambda p: p[1] + 0.5 * p[2]) AS y FROM n JOIN tags USING (label)) SELECT id, round(list_sum(y) / sqrt(list_dot_product(y, y)), 6) AS total, round(y[1] / sqrt(list_dot_product(y, y)), 6) AS first FROM j")
def additive_fusion(spark, sf_dir):
    docs = T.embeddings(spark, sf_dir)
    fused = docs.join(_tags(docs).withColumnRenamed("x", "t"), "label").select("id", soft.additive_fusion("x", "t", 0.5).alias("y"))
    return fused.select("id", F.round(V.total("y"), 6).alias("total"), F.round(F.get("y", F.lit(0)), 6).alias("first"))


_SOFT = BASE + """, l AS (SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE label END AS cluster, x FROM n), p AS (SELECT a.cluster, a.id, round(avg(1 - list_dot_product(a.x, b.x)), 12) AS m FROM l a JOIN l b USING (cluster) WHERE a.cluster >= 0 GROUP BY ALL),
md AS (SELECT cluster, id AS medoid FROM p QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY m, id) = 1), mc AS (SELECT md.cluster, medoid, x AS c FROM md JOIN l ON l.id = medoid),
mr AS (SELECT l.cluster, any_value(medoid) AS medoid, any_value(c) AS c, greatest(quantile_cont(1 - list_dot_product(l.x, mc.c), 0.9), 1e-12) AS radius FROM l JOIN mc USING (cluster) GROUP BY l.cluster)"""


def _soft_labels(spark, sf_dir):
    return T.embeddings(spark, sf_dir).withColumn("cluster", F.when(F.col("id") % 10 == 0, F.lit(-1)).otherwise(F.col("label")))


@_query("medoids_radii", _SOFT + " SELECT cluster, medoid, round(radius, 6) AS radius FROM mr")
def medoids_radii(spark, sf_dir):
    return soft.medoids(_soft_labels(spark, sf_dir)).select("cluster", "medoid", F.round("radius", 6).alias("radius"))


@_query("hdbscan_soft_members", _SOFT + """, q AS (SELECT l.id, mr.cluster, exp(-(1 - list_dot_product(l.x, mr.c)) / radius) AS w FROM l, mr WHERE l.cluster = -1), z AS (SELECT id, cluster, w / sum(w) OVER (PARTITION BY id) AS u FROM q)
SELECT id, round(u, 6) AS probability, CASE WHEN u >= 0.115 THEN cluster ELSE -1 END AS cluster FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY u DESC, cluster) = 1""")
def hdbscan_soft_members(spark, sf_dir):
    labels = _soft_labels(spark, sf_dir)
    return soft.soft_reassignment(labels.where("cluster = -1"), soft.medoids(labels), 0.115).select("id", F.round("probability", 6).alias("probability"), "cluster")


@_query("nearest_members", _SOFT + ", q AS (SELECT a.id, b.cluster, 1 - list_dot_product(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.id, b.cluster ORDER BY 1 - list_dot_product(a.x, b.x), b.id) AS r FROM l a, l b WHERE a.cluster = -1 AND b.cluster >= 0) SELECT id, cluster, round(avg(d), 6) AS distance, count(*) AS used FROM q WHERE r <= 5 GROUP BY ALL")
def nearest_members(spark, sf_dir):
    labels = _soft_labels(spark, sf_dir)
    return soft.nearest_members(labels.where("cluster = -1"), labels.where("cluster >= 0")).select("id", "cluster", F.round("distance", 6).alias("distance"), "used")


_PAIR = SCORED + """, ww AS (SELECT id, k, u AS q, (u + CASE WHEN k = label THEN 1 ELSE 0 END) / 2 AS p FROM u), r AS (SELECT id, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js, avg(abs(p - q)) AS mae, avg((p - q) ** 2) AS mse, sum(p * q) / sqrt(sum(p * p) * sum(q * q)) AS cosine, (arg_max(k, p) = arg_max(k, q))::INT AS dominant FROM ww GROUP BY id)"""


@_query("soft_membership_metrics", _PAIR + ", b AS (SELECT r.*, top1 < 0.9 AS edge FROM r JOIN a USING (id)) SELECT round(avg(js), 6) AS js, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse, round(avg(cosine), 6) AS cosine, round(avg(dominant), 6) AS dominant, round(avg(js) FILTER (edge), 6) AS boundary_js FROM b")
def soft_membership_metrics(spark, sf_dir):
    s, _, _ = scored(spark, sf_dir)
    p = F.expr("transform(u, (x, k) -> (x + IF(k = label, 1D, 0D)) / 2)")
    rows = s.select(p.alias("p"), F.col("u").alias("q"), (V.top("u", 1) < 0.9).alias("is_boundary"))
    return metrics.soft_metrics(rows).select(*[F.round(c, 6).alias(c) for c in ("js", "mae", "mse", "cosine", "dominant", "boundary_js")])


@_query("display_labels", "SELECT vec_id AS id, CASE WHEN label = 9 THEN CASE WHEN vec_id % 5 = 0 THEN 'noise' ELSE 'root' END ELSE (label % 3 + 1) || '-' || (label + 1) || CASE WHEN vec_id % 5 = 0 THEN '-noise' ELSE '' END END AS shown FROM embeddings")
def display_labels(spark, sf_dir):
    noise = F.col("id") % 5 == 0
    path = F.when(F.col("label") == 9, F.when(noise, "noise").otherwise("root")).otherwise(F.concat((F.col("label") % 3).cast("string"), F.lit("/"), F.col("label").cast("string"), F.when(noise, "/noise").otherwise("")))
    return T.embeddings(spark, sf_dir).select("id", soft.display_label(F.when(path == "root", "").otherwise(path), noise).alias("shown"))


@_query("natural_label_order", "WITH s AS (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN 'noise' WHEN l_linenumber > 4 THEN 'x' || l_linenumber ELSE l_linenumber::VARCHAR END AS label FROM lineitem) SELECT label, row_number() OVER (ORDER BY label LIKE '%noise', NOT regexp_matches(label, '^[0-9]+$'), try_cast(label AS BIGINT), label) AS place FROM s")
def natural_label_order(spark, sf_dir):
    n = F.col("l_linenumber")
    labels = T.read(spark, sf_dir, "lineitem").select(F.when(n == 7, "noise").when(n > 4, F.concat(F.lit("x"), n.cast("string"))).otherwise(n.cast("string")).alias("label")).distinct()
    return labels.withColumn("place", F.row_number().over(Window.orderBy(*soft.natural_order("label"))).cast("long"))


@_query("cache_position_read", "SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE vec_id BETWEEN 100 AND 149")
def cache_position_read(spark, sf_dir):
    """A range of positions, pushed down to the Parquet scan."""
    return T.read(spark, sf_dir, "embeddings").where(F.col("vec_id").between(100, 149)).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))


@_query("schema_union_append", "SELECT vec_id AS id, label::BIGINT AS label, NULL::VARCHAR AS lang FROM embeddings UNION ALL SELECT doc_id, NULL, lang FROM documents")
def schema_union_append(spark, sf_dir):
    e = T.embeddings(spark, sf_dir).select("id", "label")
    return e.unionByName(T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), allowMissingColumns=True)


@_query("key_set_difference", "SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM labels")
def key_set_difference(spark, sf_dir):
    return T.embeddings(spark, sf_dir).select("id").subtract(T.read(spark, sf_dir, "labels").select("doc_id"))


@_query("whitespace_collapse", r"SELECT doc_id, length(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS n FROM documents")
def whitespace_collapse(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("n"))
