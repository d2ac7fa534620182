"""Metrics of saved assignments without a fit, and loaders of the features that go with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..sources import read_json
from . import classify, fcm, incremental, metrics

LEVELS = ("leaf", "top", "subtopic")
EXTERNAL = ("nmi", "ari", "homogeneity", "completeness", "v_measure")
FUZZY = ("partition_coefficient", "modified_partition_coefficient", "partition_entropy", "normalized_partition_entropy")
INTERNAL = ("silhouette", "xie_beni", "fuzzy_silhouette")
SCHEMA = ", ".join(
    ["source string", "samples long", "clusters long", "noise_ratio double", "features_available boolean", "memberships_available boolean", "membership_clusters long"]
    + [f"{c} double" for c in ("nmi", "ari", "tag_fragmentation", *(f"{c}_{level}" for level in LEVELS for c in EXTERNAL), *FUZZY, *INTERNAL)]
)


def positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """``df`` with the place of each row from 0, in the order of the input; one count for each partition reaches the driver."""
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    counts = {r["p"]: r["n"] for r in marked.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts, default=-1) + 1))])
    start = F.get(F.array(*[F.lit(int(s)) for s in starts]), F.shiftright("__at", 33).cast("int"))
    return marked.withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + start).drop("__at")


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """(pos, x) of a feature file, by its suffix: .csv, .json(.gz), .npy or .npz (``features`` or ``arr_0``).

    Arrays are read by ranges in the tasks, from a folder that the driver and all executors see; an .npz is read by one.
    Numbers that are not finite, a row of length 0, differing widths or no rows are errors.
    """
    if path.endswith(".csv"):
        table = spark.read.option("header", True).csv(path)
        rows = positions(table.select(F.array(*[F.col(f"`{c}`").cast("double") for c in table.columns]).alias("x")))
    elif path.endswith((".json", ".json.gz")):
        rows = read_json(spark, path).select(F.col("pos").cast("long").alias("pos"), F.col("embedding").alias("x"))
    elif path.endswith((".npy", ".npz")):
        local, packed = path.removeprefix("file://"), path.endswith(".npz")

        def array() -> np.ndarray:
            if not packed:
                return np.load(local, mmap_mode="r", allow_pickle=False)
            with np.load(local, allow_pickle=False) as held:
                if not {"features", "arr_0"} & set(held):
                    raise ValueError(f"neither 'features' nor 'arr_0' is in {path}")
                return held["features" if "features" in held else "arr_0"]

        shape = array().shape
        if len(shape) != 2:
            raise ValueError(f"{path} is not a matrix")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = array()
            for batch in batches:
                at = batch.column(0).to_numpy()
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(whole[at], float).tolist(), pa.list_(pa.float64()))], ["pos", "x"])

        slices = 1 if packed else max(1, min(1024, shape[0] * shape[1] // 4_000_000 + 1))
        rows = spark.range(0, shape[0], 1, slices).mapInArrow(run, "pos long, x array<double>")
    else:
        raise ValueError(f"unknown suffix: {path}")
    return validated(rows)


def validated(rows: DataFrame, vector: str = "x") -> DataFrame:
    """``rows``, after one pass that checks their vectors."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"), F.min(V.norm(vector)).alias("least")).first()
    if not seen["n"] or seen["low"] != seen["high"] or seen["low"] < 1 or seen["bad"] or seen["least"] <= 1e-12:
        raise ValueError(f"{seen['n']} rows, widths {seen['low']} to {seen['high']}, {seen['bad']} not finite, least length {seen['least']}")
    return rows


def _targets(df: DataFrame) -> dict:
    """The target column of each level that all rows have."""
    found = {}
    if "class" in df.columns:
        if df.where("class is null").limit(1).count():
            raise ValueError("a class is missing")
        found["leaf"] = F.col("class").cast("string")
    if "class_hierarchy" in df.columns:
        h = F.col("class_hierarchy")
        least = df.agg(F.min(F.coalesce(F.size(F.when(h.isNotNull(), h)), F.lit(0)))).first()[0]
        if least and least > 0:
            found.setdefault("leaf", F.element_at(h, -1))
            found["top"] = F.get(h, F.lit(0))
            if least > 1:
                found["subtopic"] = F.get(h, F.lit(1))
    return found


def _internal(df: DataFrame, u: str | None, centers: np.ndarray | None) -> dict:
    """Silhouette of the labels, Xie-Beni and fuzzy silhouette with squared memberships; None where undefined."""
    unit = df.withColumn("x", V.unit("x"))
    labels = sorted(r[0] for r in unit.where("cluster <> -1").select("cluster").distinct().collect())  # the model's clusters
    out: dict = dict.fromkeys(INTERNAL)
    if len(labels) < 2:
        return out
    if unit.where("cluster <> -1").limit(3).count() == 3:
        out["silhouette"] = metrics.silhouette(unit).agg(F.avg("s")).first()[0]
    if u is None:
        unit = unit.withColumn("u", F.array(*[(F.col("cluster") == k).cast("double") for k in labels]))
    if centers is None:
        cells = incremental.statistics(incremental.contributions(unit, 2.0)).collect()  # the model's sums
        found = np.zeros((1 + max(c["k"] for c in cells), 1 + max(c["dim"] for c in cells)))
        for c in cells:
            found[c["k"], c["dim"]] = c["value"]
        centers = found
    if len(centers) < 2 or np.linalg.norm(centers, axis=1).min() <= 1e-12:
        return out
    centers = fcm.unit_rows(np.asarray(centers, float))
    scored = fcm.e_step(unit.select("x", F.col("u").alias("given")), centers, 2.0).select("d2", F.col("given").alias("u")).where(V.total("u") > 0)
    separation, rows = metrics.min_separation(centers), df.count()
    got = scored.agg(F.sum(V.total(F.zip_with("u", "d2", lambda w, d: w * w * d))).alias("sum"), metrics.extractor_silhouette().alias("fuzzy")).first()
    out["fuzzy_silhouette"] = got["fuzzy"]
    if separation > 1e-12 and got["sum"] is not None:
        out["xie_beni"] = got["sum"] / (rows * separation)
    return out


def extract_metrics(df: DataFrame, source: str = "", centers: np.ndarray | None = None) -> DataFrame:
    """One row (``SCHEMA``) of all metrics that assignments give without a fit.

    ``df`` has id and cluster (-1: noise) and may have class, class_hierarchy, memberships (``u``, or columns
    membership_0 and so on) and features (``x``). Without ``centers``, they follow from the squared memberships, or from the
    labels; rows without any membership, as noise has then, count in Xie-Beni's row number only. A metric whose columns are
    missing, or that is undefined, is null; an empty table has 0 samples and nulls.
    """
    if "cluster" not in df.columns:
        raise ValueError("assignments need a column 'cluster'")
    if "u" not in df.columns and "membership_0" in df.columns:
        df = classify.collect_memberships(df)
    df = df.withColumn("cluster", F.col("cluster").cast("long"))
    has_u, has_x = "u" in df.columns, "x" in df.columns
    if has_u:
        bad = F.exists("u", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < -1e-12))
        failed = F.raise_error(F.lit("memberships must be finite, not negative, and have a sum")).cast("array<double>")
        df = df.withColumn("u", V.normalized_rows(F.when(bad | (V.total("u") <= 1e-12), failed).otherwise(F.col("u"))))
    live = F.col("cluster") != -1
    out = df.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct(F.when(live, F.col("cluster"))).alias("clusters"), F.avg((~live).cast("double")).alias("noise_ratio")).first().asDict()
    out |= {"source": source, "features_available": has_x, "memberships_available": has_u}
    if out["samples"]:
        for level, target in _targets(df).items():
            marked = df.withColumn("__t", target)
            got = metrics.external_metrics(metrics.contingency(marked, "__t", "cluster")).first().asDict()
            out |= {f"{c}_{level}": got[c] for c in EXTERNAL}
            if level == "leaf":
                out |= {"nmi": got["nmi"], "ari": got["ari"], "tag_fragmentation": metrics.tag_fragmentation(marked, "__t", "cluster").first()[0]}
        if has_u:
            got = df.agg(F.max(F.size("u")).alias("k"), metrics.partition_coefficient().alias("pc"), metrics.partition_entropy().alias("pe")).first()
            k = got["k"]
            out |= {"membership_clusters": k, "partition_coefficient": got["pc"], "partition_entropy": got["pe"], "modified_partition_coefficient": (got["pc"] - 1 / k) / (1 - 1 / k) if k > 1 else 1.0, "normalized_partition_entropy": got["pe"] / float(np.log(k)) if k > 1 else 0.0}
        if has_x:
            out |= _internal(validated(df), "u" if has_u else None, centers)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return df.sparkSession.createDataFrame([tuple(out.get(c) for c in names)], SCHEMA)
