"""The driver's tables in the shapes that the operators take, and small fixed candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x) with unit vectors of doubles."""
    raw = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), V.doubles("embedding").alias("x"))
    return raw.withColumn("x", V.unit("x"))


#: Candidate cluster counts with their scores: k, xie_beni, silhouette, stability, modified partition coefficient, objective.
CANDIDATES = [(2, 0.50, 0.31, 0.90, 0.40, 10.0), (3, 0.30, 0.42, 0.95, 0.55, 6.0), (4, 0.29, 0.44, 0.80, 0.58, 4.5), (5, 0.33, 0.40, 0.70, 0.58, 4.0), (6, 0.10, 0.35, 0.60, 0.50, 3.8), (7, 0.45, 0.20, 0.55, 0.45, 3.7)]
#: Projection widths with their neighbour preservation.
WIDTHS = [(8, 0.50), (16, 0.54), (24, 0.70), (32, 0.78), (40, 0.79)]
#: Pipelines: name, nmi, ari, fragmentation, silhouette, noise, clusters, runtime.
PIPELINES = [("2_auto_pca_fcm", 0.71, 0.44, 1.5, 0.2, 0.05, 10, 3.0), ("2_pca256_fcm", 0.71, 0.44, 1.2, 0.1, 0.02, 12, 2.0), ("hdbscan", None, None, 2.0, 0.3, 0.10, 24, 9.0)]
#: Merge distances of a dendrogram: step, distance, clusters left.
MERGES = [(1, 0.02, 7), (2, 0.03, 6), (3, 0.05, 5), (4, 0.30, 4), (5, 0.34, 3), (6, 0.60, 2), (7, 0.95, 1)]
#: Votes of the consensus scouts: scout, selected k.
VOTES = [(1, 4), (2, 5), (3, 4), (4, 6), (5, 4)]


def candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATES, "k long, xb double, silhouette double, stability double, mpc double, objective double")


def values_sql(rows: list, names: str) -> str:
    """The same rows as a SQL VALUES list."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(text(v) for v in r) + ')' for r in rows)}) AS t({names})"
