"""Readers and writers of embedding collections."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import vectors as V

RECORD = "id string, resource string, tag string, class string, class_hierarchy array<string>, text string, embedding array<double>"

_FIELDS = ", ".join(":".join(x.split(" ", 1)) for x in RECORD.split(", "))


def with_defaults(records: DataFrame, position: str = "pos", offset: int = 0) -> DataFrame:
    """id and tag of records that lack them: the resource or the position, and the first class or the position."""
    place = (F.col(position) + offset).cast("string")
    tag = F.coalesce("tag", F.get("class_hierarchy", F.lit(0)), "class", F.concat(F.lit("Document_"), place))
    return records.withColumn("id", F.coalesce("id", "resource", place)).withColumn("tag", tag)


def validate(records: DataFrame, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """The records, after one pass that checks unique ids, one width, and finite numbers."""
    bad = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    seen = records.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_).alias("ids"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad")).first()
    if not seen["n"]:
        raise ValueError("no records")
    if seen["ids"] != seen["n"] or seen["low"] != seen["high"] or seen["low"] < 1 or seen["bad"]:
        raise ValueError(f"{seen['n']} records with {seen['ids']} ids, widths {seen['low']} to {seen['high']}, {seen['bad']} with numbers that are not finite")
    return records


def read_json(spark: SparkSession, path: str, start: int = 0, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Records of a JSON or JSON.gz file: a list, or an object with the list ``records``; malformed files fail."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"{RECORD}, records array<struct<{_FIELDS}>>").json(path)
    whole = raw.where("records is not null").select(F.posexplode("records").alias("pos", "r")).select("pos", "r.*")
    listed = raw.where("records is null").withColumn("__at", F.monotonically_increasing_id()).withColumn("pos", (F.row_number().over(Window.orderBy("__at")) - 1).cast("int")).select("pos", *[x.split(" ")[0] for x in RECORD.split(", ")])
    records = listed.unionByName(whole)
    records = records.where(F.col("pos") >= start) if limit is None else records.where(F.col("pos").between(start, start + limit - 1))
    return with_defaults(records, offset=offset)


def build_cache(records: DataFrame, path: str) -> dict:
    """Write records as Parquet with a manifest of counts and a checksum; an existing target is an error."""
    checked = validate(records)
    checked.withColumn("embedding", F.col("embedding").cast("array<float>")).repartitionByRange("pos").sortWithinPartitions("pos").write.mode("errorifexists").parquet(f"{path}/records")
    held = records.sparkSession.read.parquet(f"{path}/records")
    manifest = {"version": 1, "count": held.count(), "width": held.select(F.size("embedding")).first()[0], "checksum": fingerprint(held)}
    records.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def read_cache(spark: SparkSession, path: str, start: int = 0, limit: int | None = None, verify: bool = False) -> DataFrame:
    """Records of a cache by position; row groups outside the range are pruned by their statistics."""
    held = spark.read.parquet(f"{path}/records")
    if verify:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if fingerprint(held) != manifest["checksum"]:
            raise ValueError("the cache differs from its manifest")
    return held.where(F.col("pos") >= start) if limit is None else held.where(F.col("pos").between(start, start + limit - 1))


def fingerprint(df: DataFrame) -> str:
    """A checksum of the rows that does not depend on their order or partitions."""
    columns = sorted(df.columns)
    digest = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(digest[0]).alias("x"), F.sum(F.shiftright(digest[1], 16)).alias("s")).first()
    return hashlib.sha256(f"{columns}|{seen['n']}|{seen['x']}|{seen['s']}".encode()).hexdigest()


def sample_key(id_: Column | str, seed: int) -> Column:
    """A text that orders rows at random for a seed, alike in every engine."""
    return F.md5(F.concat(V.col(id_).cast("string"), F.lit(f":{seed}")))


def exact_sample(df: DataFrame, n: int, seed: int, id_: str = "id") -> DataFrame:
    """n rows without replacement; a smaller n gives a subset of a larger one."""
    return df.orderBy(sample_key(id_, seed), F.col(id_)).limit(n)


def embedding_text(label: Column, abstract: Column, most: int = 8000) -> Column:
    """'label. abstract' with collapsed white space, cut at the last space within ``most`` characters."""
    text = F.trim(F.regexp_replace(F.concat(label, F.lit(". "), abstract), r"\s+", " "))
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", ""))


def parse_hierarchy(text: Column) -> Column:
    """A list of classes written as JSON or with single quotes."""
    return F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>"))


def stratified(df: DataFrame, per_class: int, class_: str, unique: str, id_: str) -> DataFrame:
    """Up to ``per_class`` rows of each class; a value of ``unique`` serves its first class only."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(unique).orderBy(class_, id_))).where("__n = 1")
    return first.withColumn("__n", F.row_number().over(Window.partitionBy(class_).orderBy(F.md5(F.col(id_).cast("string")), id_))).where(F.col("__n") <= per_class).drop("__n")


def unique_labels(df: DataFrame, label: str = "class", hierarchy: str = "class_hierarchy") -> DataFrame:
    """Each label with its hierarchy; a label with two hierarchies is an error."""
    grouped = df.groupBy(label).agg(F.collect_set(hierarchy).alias("h"))
    clash = F.raise_error(F.concat(F.lit("more than one hierarchy: "), F.col(label))).cast(df.schema[hierarchy].dataType)
    return grouped.select(label, F.when(F.size("h") == 1, F.get("h", F.lit(0))).otherwise(clash).alias(hierarchy))


def write_assignments(df: DataFrame, path: str, gzip: bool = True) -> None:
    """Assignments as CSV; arrays become JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path, compression="gzip" if gzip else "none")
