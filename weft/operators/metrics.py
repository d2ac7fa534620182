"""Quality metrics: internal, fuzzy, external and soft, as aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from ..session import materialize
from . import ranks


def objective(scored: DataFrame, m: float) -> Column:
    """Mean over rows of sum u^m d2, as an aggregate over (u, d2)."""
    return F.avg(V.total(F.zip_with("u", "d2", lambda u, d: F.pow(u, F.lit(m)) * d)))


def min_separation(centers: np.ndarray) -> float:
    """Smallest squared distance of two centers."""
    d = ((centers[:, None] - centers[None]) ** 2).sum(2)
    return float(d[~np.eye(len(centers), dtype=bool)].min()) if len(centers) > 1 else 0.0


def xie_beni(m: float, separation: float) -> Column:
    """Compactness over separation."""
    return objective(None, m) / max(separation, 1e-12)


def partition_coefficient() -> Column:
    return F.avg(V.total(F.transform("u", lambda x: x * x)))


def modified_partition_coefficient(k: int) -> Column:
    return (partition_coefficient() - 1.0 / k) / (1 - 1.0 / k) if k > 1 else F.lit(1.0)


def partition_entropy() -> Column:
    return -F.avg(V.total(F.transform("u", lambda x: x * F.log(F.greatest(x, F.lit(1e-12))))))


def fuzzy_silhouette_proxy() -> Column:
    """Weighted mean of (nearest other - own) / max over rows (u, d2, cluster), weighted by the membership gap."""
    own = F.sqrt(F.get("d2", F.col("cluster").cast("int")))
    other = F.sqrt(F.array_min(F.filter("d2", lambda x, i: i != F.col("cluster"))))
    width = (other - own) / F.greatest(own, other, F.lit(1e-12))
    weight = F.greatest(V.gap("u"), F.lit(1e-12))
    return F.sum(width * weight) / F.sum(weight)


def extractor_silhouette() -> Column:
    """Mean of (b - a) / max(a, b): a is the u^2-weighted distance, b the second smallest distance."""
    d = F.transform("d2", lambda x: F.sqrt(x))
    a = V.total(F.zip_with("u", "d2", lambda u, x: u * u * F.sqrt(x))) / V.total(F.transform("u", lambda u: u * u))
    b = F.get(F.sort_array(d), F.lit(1))
    return F.avg((b - a) / F.greatest(a, b))


def contingency(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of every pair of labels."""
    return df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def external_metrics(table: DataFrame) -> DataFrame:
    """One row: ari, nmi, homogeneity, completeness and v_measure of a contingency table (t, p, n)."""
    rows = table.groupBy("t").agg(F.sum("n").alias("n"))
    columns = table.groupBy("p").agg(F.sum("n").alias("n"))
    pairs = lambda name: F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias(name)
    plogp = lambda name: F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias(name)
    joined = table.agg(pairs("both"), plogp("h_both"), F.sum("n").cast("double").alias("n")).crossJoin(rows.agg(pairs("mine"), plogp("h_t"))).crossJoin(columns.agg(pairs("theirs"), plogp("h_p")))
    n = F.col("n")
    entropy = lambda name: F.greatest(F.log(n) - F.col(name) / n, F.lit(0.0))
    joined = joined.select("*", entropy("h_t").alias("ht"), entropy("h_p").alias("hp"), entropy("h_both").alias("hb")).withColumn("mi", F.greatest(F.col("ht") + F.col("hp") - F.col("hb"), F.lit(0.0)))
    expected = F.col("mine") * F.col("theirs") / (n * (n - 1) / 2)
    highest = (F.col("mine") + F.col("theirs")) / 2
    ari = F.when(highest == expected, 1.0).otherwise((F.col("both") - expected) / (highest - expected))
    share = lambda of: F.when(F.col(of) > 0, F.col("mi") / F.col(of)).otherwise(1.0)
    mean = (F.col("ht") + F.col("hp")) / 2
    joined = joined.select(ari.alias("ari"), F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("nmi"), share("ht").alias("homogeneity"), share("hp").alias("completeness"))
    v = F.when(F.col("homogeneity") + F.col("completeness") > 0, 2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))).otherwise(0.0)
    return joined.withColumn("v_measure", v)


def tag_fragmentation(df: DataFrame, tag: str, cluster: str) -> DataFrame:
    """Mean over tags of their distinct clusters, noise (-1) left out."""
    return df.where(F.col(cluster) != -1).groupBy(tag).agg(F.countDistinct(cluster).alias("k")).agg(F.avg("k").alias("fragmentation"))


def silhouette(df: DataFrame, id_: str = "id", vector: str = "x", cluster: str = "cluster", block: int = 2000) -> DataFrame:
    """(id, a, b, s) of every row by exact Euclidean distances, noise (-1) left out.

    The rows are the stated query set, compared with all rows in blocks: each block of vectors is sent to the tasks, which
    add up distances by cluster; nothing quadratic is emitted, one row for each (id, cluster) and block.
    """
    import pyarrow as pa

    from .fcm import matrix

    live = df.where(F.col(cluster) != -1).select(F.col(id_).alias("id"), F.col(cluster).cast("long").alias("cluster"), F.col(vector).alias("x"))
    count = live.count()
    blocks = max(1, -(-count // block))
    parts = []
    for b in range(blocks):
        held = live.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("cluster", "x").toArrow()
        if not held.num_rows:
            continue
        other, labels = matrix(held.column("x")), held.column("cluster").to_numpy()
        keys = np.unique(labels)
        member = (labels[:, None] == keys[None]).astype(float)

        def run(batches, other=other, keys=keys, member=member):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(2))
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (other * other).sum(1)[None] - 2 * x @ other.T, 0))
                sums = d @ member
                n, k = sums.shape
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), batch.column(1).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(keys, n)), pa.array(sums.ravel()), pa.array(np.tile(member.sum(0), n))], ["id", "cluster", "other", "d", "n"])

        parts.append(live.mapInArrow(run, f"id {live.schema['id'].dataType.simpleString()}, cluster long, other long, d double, n double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = out.groupBy("id", "cluster", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("cluster") == F.col("other")
    row = by.groupBy("id", "cluster").agg(F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12)))
    return row.select("id", "cluster", "a", "b", s.alias("s"))


def average_rank(x: str) -> Column:
    """Rank with ties averaged, over a table of a few candidates; ``ranks`` has the one for documents."""
    return F.rank().over(Window.partitionBy(F.lit(0)).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(x)) - 1) / 2


def robust_thresholds(df: DataFrame, cluster: str, distance: str, z: float = 3.0) -> DataFrame:
    """median + z * 1.4826 * MAD of each cluster's distances; infinite below 4 rows or without spread."""
    held = df.select(cluster, F.col(distance).alias("__d"))
    middle = materialize(ranks.medians(held, "__d", cluster))  # used twice, one row for each cluster
    far = held.join(middle.drop("n"), cluster).select(cluster, F.abs(F.col("__d") - F.col("median")).alias("__far"))
    spread = middle.join(ranks.medians(far, "__far", cluster, "mad").drop("n"), cluster)
    return spread.select(cluster, "n", "median", "mad", F.when((F.col("n") < 4) | (F.col("mad") <= 1e-12), F.lit(float("inf"))).otherwise(F.col("median") + z * 1.4826 * F.col("mad")).alias("threshold"))


def soft_metrics(df: DataFrame, truth: str = "p", predicted: str = "q", boundary: str = "is_boundary") -> DataFrame:
    """Divergence and errors of two membership arrays, over all rows and over boundary rows."""
    p, q = F.col(truth), F.col(predicted)
    half = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    kl = lambda a, b: V.total(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)))
    df = df.select(
        F.col(boundary).alias("edge"),
        ((kl(p, half) + kl(q, half)) / 2).alias("js"),
        (V.total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / F.size(p)).alias("mae"),
        (V.squared_euclid(p, q) / F.size(p)).alias("mse"),
        (V.dot(p, q) / (V.norm(p) * V.norm(q))).alias("cosine"),
        (V.argmax(p) == V.argmax(q)).cast("double").alias("dominant"),
        (F.get(q, V.argmax(p).cast("int")) >= V.top(q, 2)).cast("double").alias("top2"),
    )
    names = ("js", "mae", "mse", "cosine", "dominant", "top2")
    return df.agg(*[F.avg(c).alias(c) for c in names], *[F.avg(F.when(F.col("edge"), F.col(c))).alias(f"boundary_{c}") for c in names])


def noise_prf(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of a boolean prediction; 0 where undefined."""
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    t, p = F.col(truth), F.col(predicted)
    held = df.agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return held.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
