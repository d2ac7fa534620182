"""Ranks, percentile ranks, medians and quantiles over any number of rows: no window holds a whole table or a whole group.

Rows are first counted by distinct value, so that ties meet as one row. The counts are dealt by range; totals run within
each range and start from the sum of the ranges before it, of which there are as many as shuffle partitions. NaN sorts
last, as Spark sorts it; null values are left out by ``medians`` and ``quantiles`` and rank first otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def running_counts(counts: DataFrame, order: list[Column], by: tuple[str, ...] = (), n: str = "n") -> DataFrame:
    """``counts`` with ``upto``: the sum of ``n`` up to each row in ``order``, alone or within each ``by``."""
    held = materialize(counts.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = held.groupBy("__range", *by).agg(F.sum(n).alias("__total"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.coalesce(F.sum("__total").over(earlier), F.lit(0))).drop("__total")
    return held.withColumn("__inside", F.sum(n).over(inside)).join(before, ["__range", *by]).withColumn("upto", F.col("__inside") + F.col("__before")).drop("__range", "__inside", "__before")


def percentile_ranks(df: DataFrame, x: str, name: str, *by: str) -> DataFrame:
    """``df`` with ``name``: the rank of ``x`` with ties averaged, over the number of rows, alone or within each ``by``."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    upto = running_counts(counts, [F.col(x)], by)
    size = counts.groupBy(*by).agg(F.sum("n").alias("__size"))
    upto = upto.join(size, list(by)) if by else upto.crossJoin(F.broadcast(size))
    ranks = upto.select(*by, x, ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("__size")).alias(name))
    return df.join(ranks, [*by, x])


def medians(df: DataFrame, x: str, by: str, name: str = "median") -> DataFrame:
    """(by, name, n): the exact median and the number of values of each ``by``."""
    counts = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count(F.lit(1)).alias("n"))
    upto = running_counts(counts, [F.col(x)], (by,))
    size = counts.groupBy(by).agg(F.sum("n").alias("__size"))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col(x)))
    both = upto.join(size, by).groupBy(by)
    return both.agg(((at(F.floor((F.col("__size") + 1) / 2)) + at(F.ceil((F.col("__size") + 1) / 2))) / 2).alias(name), F.sum("n").alias("n"))


def quantiles(df: DataFrame, x: str, by: str, q: float, name: str = "quantile") -> DataFrame:
    """(by, name): the exact ``q`` quantile of each ``by``, interpolated between its two neighbours."""
    counts = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count(F.lit(1)).alias("n"))
    upto = running_counts(counts, [F.col(x)], (by,))
    size = counts.groupBy(by).agg(F.sum("n").alias("__size"))
    place = (F.col("__size") - 1) * q
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(x)))
    ends = upto.join(size, by).groupBy(by).agg(at(F.floor(place)).alias("__low"), at(F.ceil(place)).alias("__high"), F.max(place - F.floor(place)).alias("__part"))
    return ends.select(by, (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias(name))
