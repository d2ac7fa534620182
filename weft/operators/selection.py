"""Choosing a cluster count, a projection width or a pipeline from tables of candidates, as windows.

Candidate tables have one row for each candidate, so the windows here are over a few rows whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Weights of the combined score: xie_beni (lower is better), silhouette, stability, modified partition coefficient.
WEIGHTS = {"xb": 0.25, "silhouette": 0.45, "stability": 0.20, "mpc": 0.10}


def _all():
    """One window over all candidates."""
    return Window.partitionBy(F.lit(0))


def desirability(x: str, higher: bool = True) -> Column:
    """1 for the best candidate, 0 for the worst, ties (within 1e-12) averaged; 1 if there is one."""
    rounded = F.round(F.col(x), 12)
    order = _all().orderBy(rounded.desc() if higher else rounded.asc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(rounded))
    n = F.count(F.lit(1)).over(_all())
    return F.when(n == 1, 1.0).otherwise(1 - (F.rank().over(order) + (ties - 1) / 2 - 1) / (n - 1))


def multi_metric_score(df: DataFrame) -> DataFrame:
    """Adds ``score``, the weighted sum of the desirabilities."""
    total = sum((w * desirability(c, c != "xb") for c, w in WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("score", total)


def xb_improvement(k: str = "k", xb: str = "xb") -> Column:
    """Relative improvement over the previous candidate; null for the first."""
    before = F.lag(xb).over(_all().orderBy(k))
    return (before - F.col(xb)) / F.greatest(F.abs(before), F.lit(1e-12))


def stop_after_worsening(df: DataFrame, patience: int = 2) -> DataFrame:
    """Candidates up to ``patience`` beyond the first worsening of the index."""
    order = _all().orderBy("k")
    worse = F.when(F.col("xb") > F.lag("xb").over(order), F.row_number().over(order))
    marked = df.withColumn("position", F.row_number().over(order)).withColumn("worse", worse)
    marked = marked.withColumn("first", F.min("worse").over(_all()))
    return marked.where(F.col("first").isNull() | (F.col("position") <= F.col("first") + patience)).drop("worse", "first", "position")


def plateau(df: DataFrame, min_gain: float) -> DataFrame:
    """The width before the first gain below ``min_gain``; the last width if there is none."""
    order = _all().orderBy("dim")
    gains = df.withColumn("gain", F.col("preservation") - F.lag("preservation").over(order)).withColumn("before", F.lag("dim").over(order))
    return gains.agg(F.coalesce(F.min_by("before", F.when(F.col("gain") < min_gain, F.col("dim"))), F.max("dim")).alias("dim"))


def global_knee(df: DataFrame) -> DataFrame:
    """The width where the rising, normalised curve lies farthest above its diagonal; the first with two or fewer or no rise."""
    order = _all().orderBy("dim")
    curve = df.withColumn("y", F.max("preservation").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.min("y").over(_all()), F.max("y").over(_all())
    a, z = F.min("dim").over(_all()), F.max("dim").over(_all())
    flat = (F.count(F.lit(1)).over(_all()) <= 2) | (high <= low)
    above = F.when(flat, F.lit(0.0)).otherwise((F.col("y") - low) / F.greatest(high - low, F.lit(1e-12)) - (F.col("dim") - a) / (z - a))
    return curve.withColumn("above", F.round(above, 12)).agg(F.max_by("dim", F.struct("above", -F.col("dim"))).alias("dim"))


def objective_knee(df: DataFrame) -> DataFrame:
    """The k farthest from the chord between the first and last objective, the first on ties."""
    order = _all().orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x1, x2, y1, y2 = (f(c).over(order) for c in ("k", "objective") for f in (F.first, F.last))
    x, y = (F.col("k") - x1) / F.greatest(x2 - x1, F.lit(1e-12)), (F.col("objective") - F.least(y1, y2)) / F.greatest(F.abs(y2 - y1), F.lit(1e-12))
    start, end = (y1 - F.least(y1, y2)) / F.greatest(F.abs(y2 - y1), F.lit(1e-12)), (y2 - F.least(y1, y2)) / F.greatest(F.abs(y2 - y1), F.lit(1e-12))
    away = F.abs((end - start) * x - y + start) / F.sqrt((end - start) * (end - start) + 1)
    return df.withColumn("away", F.round(away, 12)).agg(F.max_by("k", F.struct("away", -F.col("k"))).alias("k"))


def scout_top(df: DataFrame, top_k: int = 3, margin: float = 0.15) -> DataFrame:
    """The best ``top_k`` candidates by score, or only the first if it leads by ``margin``."""
    order = _all().orderBy(F.desc("score"), "k")
    ranked = df.withColumn("rank", F.row_number().over(order).cast("long"))
    lead = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(_all()) - F.max(F.when(F.col("rank") == 2, F.col("score"))).over(_all())
    return ranked.withColumn("lead", lead).where((F.col("rank") == 1) | ((F.col("rank") <= top_k) & (F.col("lead") < margin))).drop("lead")


def best_pipeline(df: DataFrame) -> DataFrame:
    """The best run: by nmi, ari, fragmentation and silhouette, nulls last."""
    order = _all().orderBy(F.desc_nulls_last("nmi"), F.desc_nulls_last("ari"), F.asc_nulls_last("fragmentation"), F.desc_nulls_last("silhouette"), "pipeline")
    return df.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def consensus(votes: DataFrame, needed: int = 3) -> DataFrame:
    """The cluster count with a strict majority of the scouts' votes, or no row."""
    return votes.groupBy("k").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= needed)


def merge_gaps(df: DataFrame, top: int = 5) -> DataFrame:
    """Largest jumps between successive merge distances."""
    gaps = df.withColumn("gap", F.lead("distance").over(_all().orderBy("step")) - F.col("distance")).where("gap is not null")
    return gaps.withColumn("gap", F.round("gap", 12)).orderBy(F.desc("gap"), F.desc("clusters")).limit(top)
