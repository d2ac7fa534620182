"""Document types, noise scores, forced noise and assignment tables, as column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from . import ranks

MIN_MEMBERSHIP, MAX_GAP = 0.40, 0.05


def boundary(u: str = "u", min_membership: float = MIN_MEMBERSHIP, max_gap: float = MAX_GAP) -> Column:
    """Whether the largest membership and its lead are both strictly below their limits; a single cluster has no boundary."""
    return F.when(F.size(u) < 2, F.lit(False)).otherwise((V.top(u, 1) < min_membership) & (V.gap(u) < max_gap))


def document_type(distance: Column, threshold: Column, u: str = "u", min_membership: float = MIN_MEMBERSHIP, max_gap: float = MAX_GAP) -> Column:
    """noise is at the boundary and strictly beyond the threshold, boundary is at the boundary only, the rest is core."""
    edge = boundary(u, min_membership, max_gap)
    return F.when(edge & (distance > threshold), "noise").when(edge, "boundary").otherwise("core")


def noise_scores(df: DataFrame, distance: str = "distance", cluster: str = "cluster", u: str = "u") -> DataFrame:
    """Adds noise_score: the cube root of three percentile ranks (1 - top membership, 1 - gap, distance in the cluster)."""
    held = df.withColumn("__top", F.round(1 - V.top(u, 1), 12)).withColumn("__gap", F.round(1 - V.gap(u), 12)).withColumn("__far", F.round(F.col(distance), 12))
    held = ranks.percentile_ranks(ranks.percentile_ranks(ranks.percentile_ranks(held, "__top", "__r1"), "__gap", "__r2"), "__far", "__r3", cluster)
    score = F.when(F.size(u) < 2, 0.0).otherwise(F.cbrt(F.col("__r1") * F.col("__r2") * F.col("__r3")))
    return held.withColumn("noise_score", score).select(*df.columns, "noise_score")


def forced_noise(df: DataFrame, ratio: float, score: str = "noise_score", id_: str = "id") -> DataFrame:
    """Adds is_forced_noise for the ceil(n * ratio) highest scores; ties go to the smaller id as text.

    The cut is a top-k report whose size is a share of the rows. The score at the cut comes from running counts over
    distinct scores, and the cut among the rows tied there from running counts over their ids.
    """
    n = df.count()
    k = -(-n * round(ratio * 1_000_000) // 1_000_000)
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    reached = ranks.running_counts(counts, [F.desc("s")]).where(F.col("upto") >= k)
    at = reached.agg(F.min(F.struct("upto", "s", "n")).alias("at")).first()["at"] if k else None
    if at is None:
        return df.withColumn("is_forced_noise", F.lit(False))
    tied = df.where(F.col(score) == at["s"]).groupBy(F.col(id_).cast("string").alias("__tied")).agg(F.count(F.lit(1)).alias("n"))
    chosen = ranks.running_counts(tied, [F.col("__tied")]).where(F.col("upto") <= k - (at["upto"] - at["n"])).select("__tied")
    marked = df.join(chosen, (F.col(score) == at["s"]) & (F.col(id_).cast("string") == F.col("__tied")), "left")
    return marked.withColumn("is_forced_noise", F.coalesce(F.col(score) > at["s"], F.lit(False)) | F.col("__tied").isNotNull()).drop("__tied")


def keep_large_clusters(df: DataFrame, cluster: str, min_size: int) -> DataFrame:
    """Drops noise and clusters below ``min_size``; the others are renumbered from 0."""
    sizes = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    numbered = sizes.withColumn("number", (F.dense_rank().over(Window.orderBy(cluster)) - 1).cast("long"))
    return df.join(F.broadcast(numbered), cluster).withColumn(cluster, F.col("number")).drop("number")


def assignments(df: DataFrame, levels: list[str], natural: str = "is_natural_noise", forced: str = "is_forced_noise") -> DataFrame:
    """Leaf cluster, path, leaf level and noise flags from one label column for each level (-1: none)."""
    labels = F.array(*[F.col(c).cast("long") for c in levels])
    live = F.filter(labels, lambda x: x >= 0)
    noise = F.col(natural) | F.col(forced)
    reached = F.array_join(F.transform(live, lambda x: x.cast("string")), "/")
    path = F.when(noise & (F.size(live) > 0), F.concat(reached, F.lit("/noise"))).when(noise, F.lit("noise")).when(F.size(live) == 0, F.lit("root")).otherwise(reached)
    return df.withColumn("cluster", F.when(noise, F.lit(-1)).otherwise(F.coalesce(F.get(live, F.size(live) - 1), F.lit(-1))).cast("long")).withColumn("cluster_path", path).withColumn("leaf_level", F.size(live).cast("long")).withColumn("is_noise", noise)


def flatten_memberships(df: DataFrame, column: str = "u", k: int = 0, prefix: str = "membership") -> DataFrame:
    """One column for each entry of a membership array, for CSV sinks."""
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).alias(f"{prefix}_{i}") for i in range(k)])


def collect_memberships(df: DataFrame, prefix: str = "membership") -> DataFrame:
    """The array of the columns prefix_0, prefix_1 and so on."""
    import re

    found = sorted((int(m[1]), c) for c in df.columns if (m := re.fullmatch(rf"{prefix}_(\d+)", c)))
    return df.withColumn("u", F.array(*[F.col(c).cast("double") for _, c in found])).drop(*[c for _, c in found])
