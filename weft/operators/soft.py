"""Soft clusters around medoids, tag fusion and display labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..session import materialize
from . import ranks
from .fcm import group_sums


def medoids(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, medoid, center, radius) by cosine distance over all members: the one nearest to all others in the mean,
    the smaller id on ties at 12 digits, and the exact 90th percentile of the distances to it.

    The mean distance of a unit vector to all members is 1 - its product with their mean, so no pair is made.
    """
    live = df.where(F.col(cluster) >= 0)
    means = [(k, [float(v) for v in total / n]) for k, (n, total) in group_sums(live, cluster, unit=False).items()]
    middle = df.sparkSession.createDataFrame(means, f"{cluster} long, middle array<double>")
    far = live.join(F.broadcast(middle), cluster).select(cluster, "id", "x", F.round(1 - V.dot("x", "middle"), 12).alias("mean"))
    best = far.groupBy(cluster).agg(F.min_by(F.struct("id", "x"), F.struct("mean", "id")).alias("m")).select(cluster, F.col("m.id").alias("medoid"), F.col("m.x").alias("center"))
    best = materialize(best)  # used twice, one row for each cluster
    radius = ranks.quantiles(live.join(F.broadcast(best), cluster).select(cluster, V.cosine_distance("x", "center").alias("d")), "d", cluster, 0.9, "radius")
    return best.join(radius, cluster).withColumn("radius", F.greatest("radius", F.lit(1e-12)))


def soft_reassignment(noise: DataFrame, centers: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Softmax memberships of rows over medoids at distance / radius; the best one takes a row from ``threshold`` on.

    ``centers`` has one row for each cluster of the model. The probability is not rounded, so that a caller rounds it once.
    """
    far = noise.select("id", "x").join(F.broadcast(centers), F.lit(True)).select("id", "cluster", (V.cosine_distance("x", "center") / F.col("radius")).alias("d"))
    grouped = far.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cluster", "d"))).alias("all"))
    u = V.softmax_negative(F.transform("all", lambda s: s["d"]))
    return grouped.select("id", "all", u.alias("u")).select("id", V.top("u", 1).alias("probability"), F.when(V.top("u", 1) >= threshold, F.get(F.transform("all", lambda s: s["cluster"]), V.argmax("u").cast("int"))).otherwise(F.lit(-1)).cast("long").alias("cluster"))


def nearest_members(queries: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """(id, cluster, mean distance of the k nearest members) from blockwise exact neighbours within each cluster."""
    from .neighbors import knn

    parts = []
    for row in members.select("cluster").distinct().orderBy("cluster").collect():  # clusters of a model
        mine = members.where(F.col("cluster") == row["cluster"])
        parts.append(knn(queries, mine, k).groupBy("id").agg(F.avg("distance").alias("distance"), F.count(F.lit(1)).alias("used")).withColumn("cluster", F.lit(row["cluster"]).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "cluster", "distance", "used")


def concat_tags(content: DataFrame, tags: DataFrame, key: str, weight: float) -> DataFrame:
    """Unit content vectors with weighted unit tag vectors behind; keys must match on both sides."""
    if weight <= 0:
        raise ValueError("the tag weight must be positive")
    missing = content.join(tags, key, "left_anti").limit(1).count(), tags.join(content, key, "left_anti").limit(1).count()
    if any(missing):
        raise ValueError("content and tags do not have the same keys")
    joined = content.join(tags.select(key, F.col("x").alias("t")), key)
    return joined.withColumn("x", F.concat(V.unit("x"), V.scale(V.unit("t"), weight))).drop("t")


def additive_fusion(content: Column | str, tag: Column | str, weight: float) -> Column:
    """The unit vector of unit content plus the weighted tag direction; a zero tag adds nothing."""
    return V.unit(V.add(V.unit(content), V.scale(V.unit(tag, "keep"), weight)))


def display_label(path: Column | str, noise: Column | str) -> Column:
    """'1-2' for path 0/1, with -noise behind, or root or noise."""
    path, noise = V.col(path), V.col(noise)
    live = F.filter(F.split(F.regexp_replace(path, "/?noise$", ""), "/"), lambda s: s != "")
    shown = F.array_join(F.transform(live, lambda s: (s.cast("int") + 1).cast("string")), "-")
    return F.when(F.size(live) == 0, F.when(noise, "noise").otherwise("root")).when(noise, F.concat(shown, F.lit("-noise"))).otherwise(shown)


def natural_order(label: Column | str) -> list[Column]:
    """Sort keys: noise last, digits by value, then text."""
    label = V.col(label)
    return [label.endswith("noise"), ~label.rlike("^[0-9]+$"), F.when(label.rlike("^[0-9]+$"), label.cast("long")), label]
