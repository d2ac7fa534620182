"""Queries over candidate tables and benchmark summaries, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import metrics, selection
from . import tables as T

QUERIES: dict = {}
ORACLES: dict = {}

_C = T.values_sql(T.CANDIDATES, "k, xb, silhouette, stability, mpc, objective")
_W = T.values_sql(T.WIDTHS, "dim, preservation")
_P = T.values_sql(T.PIPELINES, "pipeline, nmi, ari, fragmentation, silhouette, noise, clusters, runtime")
_G = T.values_sql(T.MERGES, "step, distance, clusters")
_V = T.values_sql(T.VOTES, "scout, k")
_WIDTH = "dim long, preservation double"


def _query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return add


def _desirable(x: str, direction: str) -> str:
    return f"1 - (rank() OVER (ORDER BY {x} {direction}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 - 1) / (count(*) OVER () - 1)"


_SCORE = f"SELECT k::BIGINT AS k, round(0.25 * ({_desirable('xb', 'ASC')}) + 0.45 * ({_desirable('silhouette', 'DESC')}) + 0.20 * ({_desirable('stability', 'DESC')}) + 0.10 * ({_desirable('mpc', 'DESC')}), 6)::DOUBLE AS score FROM {_C}"


@_query("multi_metric_score", _SCORE)
def multi_metric_score(spark, sf_dir):
    return selection.multi_metric_score(T.candidates(spark)).select("k", F.round("score", 6).alias("score"))


@_query("xb_relative_improvement", f"SELECT k::BIGINT AS k, round((lag(xb) OVER (ORDER BY k) - xb) / lag(xb) OVER (ORDER BY k), 6)::DOUBLE AS improvement FROM {_C}")
def xb_relative_improvement(spark, sf_dir):
    return T.candidates(spark).select("k", F.round(selection.xb_improvement(), 6).alias("improvement"))


@_query("xb_worsening_stop", f"WITH t AS (SELECT k, xb, lag(xb) OVER (ORDER BY k) AS b FROM {_C}) SELECT k::BIGINT AS k, xb::DOUBLE AS xb FROM t WHERE k <= (SELECT min(k) FROM t WHERE xb > b) + 1")
def xb_worsening_stop(spark, sf_dir):
    return selection.stop_after_worsening(T.candidates(spark), 1).select("k", "xb")


@_query("plateau_choice", f"WITH t AS (SELECT dim, lag(dim) OVER (ORDER BY dim) AS b, preservation - lag(preservation) OVER (ORDER BY dim) AS g FROM {_W}) SELECT coalesce((SELECT b FROM t WHERE g < 0.05 ORDER BY dim LIMIT 1), max(dim))::BIGINT AS dim FROM t")
def plateau_choice(spark, sf_dir):
    return selection.plateau(spark.createDataFrame(T.WIDTHS, _WIDTH), 0.05)


@_query("global_knee", f"SELECT dim::BIGINT AS dim FROM {_W} ORDER BY round((preservation - 0.5) / (0.79 - 0.5) - (dim - 8) / 32.0, 9) DESC, dim LIMIT 1")
def global_knee(spark, sf_dir):
    return selection.global_knee(spark.createDataFrame(T.WIDTHS, _WIDTH))


@_query("objective_knee", f"SELECT k::BIGINT AS k FROM {_C} ORDER BY round(abs(1 - (k - 2) / 5.0 - (objective - 3.7) / 6.3), 9) DESC, k LIMIT 1")
def objective_knee(spark, sf_dir):
    return selection.objective_knee(T.candidates(spark))


@_query("scout_topk", f"WITH s AS ({_SCORE}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rank FROM s) SELECT k, score, rank FROM r WHERE rank = 1 OR (rank <= 3 AND (SELECT max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) FROM r) < 0.15)")
def scout_topk(spark, sf_dir):
    return selection.scout_top(multi_metric_score(spark, sf_dir)).select("k", "score", "rank")


@_query("best_pipeline", f"SELECT pipeline FROM {_P} ORDER BY nmi DESC NULLS LAST, ari DESC NULLS LAST, fragmentation NULLS LAST, silhouette DESC NULLS LAST, pipeline LIMIT 1")
def best_pipeline(spark, sf_dir):
    runs = spark.createDataFrame(T.PIPELINES, "pipeline string, nmi double, ari double, fragmentation double, silhouette double, noise double, clusters long, runtime double")
    return selection.best_pipeline(runs).select("pipeline")


@_query("consensus_votes", f"SELECT k::BIGINT AS k, count(*) AS votes FROM {_V} GROUP BY k HAVING count(*) >= 3")
def consensus_votes(spark, sf_dir):
    return selection.consensus(spark.createDataFrame(T.VOTES, "scout long, k long"))


@_query("merge_gaps", f"WITH t AS (SELECT step, clusters, lead(distance) OVER (ORDER BY step) - distance AS gap FROM {_G}) SELECT step::BIGINT AS step, clusters::BIGINT AS clusters, round(gap, 6)::DOUBLE AS gap FROM t WHERE gap IS NOT NULL ORDER BY gap DESC, clusters DESC LIMIT 5")
def merge_gaps(spark, sf_dir):
    return selection.merge_gaps(spark.createDataFrame(T.MERGES, "step long, distance double, clusters long")).select("step", "clusters", F.round("gap", 6).alias("gap"))


@_query("spearman", f"WITH r AS (SELECT rank() OVER (ORDER BY xb) + (count(*) OVER (PARTITION BY xb) - 1) / 2.0 AS a, rank() OVER (ORDER BY mpc) + (count(*) OVER (PARTITION BY mpc) - 1) / 2.0 AS b FROM {_C}) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, sf_dir):
    ranked = T.candidates(spark).select(metrics.average_rank("xb").alias("a"), metrics.average_rank("mpc").alias("b"))
    return ranked.agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@_query("bench_summary", "WITH o AS (SELECT o_orderpriority AS variant, o_totalprice AS v FROM orders), g AS (SELECT variant, count(*) AS runs, avg(v) AS mean, median(v) AS middle, stddev_pop(v) AS spread, avg((v > 100000)::INT) AS success FROM o GROUP BY variant) SELECT g.variant, g.runs, round(g.mean, 4) AS mean, round(g.middle, 4) AS median, round(g.spread, 4) AS std, round(g.success, 6) AS success_rate, round(b.mean / g.mean, 6) AS speedup FROM g, (SELECT mean FROM g WHERE variant = '1-URGENT') b")
def bench_summary(spark, sf_dir):
    """Group statistics and the ratio to a baseline group."""
    runs = T.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), F.col("o_totalprice").cast("double").alias("v"))
    g = runs.groupBy("variant").agg(F.count(F.lit(1)).alias("runs"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.avg((F.col("v") > 100000).cast("double")).alias("success_rate"))
    base = F.max(F.when(F.col("variant") == "1-URGENT", F.col("mean"))).over(Window.partitionBy(F.lit(0)))  # over one row for each group
    return g.withColumn("base", base).select("variant", "runs", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")], F.round("success_rate", 6).alias("success_rate"), F.round(F.col("base") / F.col("mean"), 6).alias("speedup"))


@_query("noise_prf", "WITH l AS (SELECT (toxic = 1) AS t, (quality = 0) OR doc_id % 9 = 0 AS p FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM l) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def noise_prf(spark, sf_dir):
    marked = T.read(spark, sf_dir, "labels").where("toxic is not null and quality is not null").select((F.col("toxic") == 1).alias("t"), ((F.col("quality") == 0) | (F.col("doc_id") % 9 == 0)).alias("p"))
    return metrics.noise_prf(marked, "t", "p").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
