"""Session construction and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def build_session(app: str = "weft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults that the engine is tuned for; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a temporary folder takes its place in a session of one machine; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weft-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized frame once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/weft-" in f}:
        root = name[: name.index("/weft-") + len("/weft-") + 32]
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM drop what no frame refers to any more, so that Spark deletes its shuffle files at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row by all its columns; a null counts by the column it is in."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(c), F.col(c).isNull())])
