"""Comparisons of runs, sweeps against a baseline, histories, and colours of labels."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from . import metrics

# Hues of top clusters in degrees, lightness of children, grey of noise.
HUES = (210, 30, 120, 0, 270, 50, 330, 180, 90, 300)
LIGHT, DARK, NOISE = 0.74, 0.36, "#9e9e9e"


def baseline_delta(runs: DataFrame, variant: str, baseline: str, keys: list[str], value: str) -> DataFrame:
    """Each run's difference to the baseline variant with the same keys; null where there is none."""
    base = runs.where(F.col(variant) == baseline).select(*keys, F.col(value).alias("base"))
    return runs.join(base, keys, "left").withColumn("delta", F.col(value) - F.col("base"))


def compare_runs(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """Rows in both, share of equal paths, and ARI of the paths."""
    both = a.select("id", F.col(path).alias("t")).join(b.select("id", F.col(path).alias("p")), "id")
    exact = both.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("t") == F.col("p")).cast("double")).alias("equal"))
    return exact.crossJoin(metrics.external_metrics(metrics.contingency(both, "t", "p")).select("ari"))  # two single rows


def soft_summary(df: DataFrame) -> DataFrame:
    """Agreement, confidence and reassignment of soft labels (hard, soft, probability)."""
    was, now = F.col("hard"), F.col("soft")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg((was == now).cast("double")).alias("agreement"), F.sum(((was == -1) & (now >= 0)).cast("long")).alias("reassigned"), F.sum((now == -1).cast("long")).alias("noise"), F.avg(F.when(now >= 0, F.col("probability"))).alias("confidence"))


def retained(history: DataFrame, keep: int = 256) -> DataFrame:
    """The newest batches of a history (batch_id, generation)."""
    newest = Window.orderBy(F.desc("generation"), "batch_id")
    return history.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= keep).drop("place")


def batch_name(batch_id: Column, fingerprint: Column) -> Column:
    """A batch's name: its own, stripped, or one from its content; an empty or too long one is null."""
    name = F.trim(batch_id)
    return F.when(batch_id.isNull(), F.concat(F.lit("auto:"), fingerprint)).when(F.length(name).between(1, 512), name)


def truthy(text: Column) -> Column:
    """Whether a text says yes."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y", "t"), F.lit(False))


def file_name(name: Column) -> Column:
    """A name for files: runs of other characters become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_|_$", "")


def valid_candidates(df: DataFrame, min_size: int = 2, min_separation: float = 1e-3) -> DataFrame:
    """Candidates (k, smallest, valid_restarts, xb, silhouette, separation) that may win."""
    ok = (F.col("k") >= 2) & (F.col("smallest") >= min_size) & (F.col("valid_restarts") >= 1) & (F.col("separation") >= min_separation)
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(ok & number("xb") & number("silhouette"))


def compact_labels(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Labels renumbered from 0 in order, noise kept."""
    numbers = df.where(F.col(cluster) >= 0).select(cluster).distinct().withColumn("number", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long"))
    return df.join(F.broadcast(numbers), cluster, "left").withColumn(cluster, F.coalesce("number", F.lit(-1))).drop("number")  # one row for each cluster


def select_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids (id, place), in their order."""
    return df.join(ids, "id").orderBy("place")


def colours(tops: int, children: int) -> list[tuple[int, int, str]]:
    """(top, child, colour): a hue for each top cluster, lighter to darker for its children."""
    out = []
    for top in range(tops):
        for child in range(children):
            light = LIGHT - (LIGHT - DARK) * (child / max(1, children - 1))
            rgb = colorsys.hls_to_rgb(HUES[top % len(HUES)] / 360, light, 0.6)
            out.append((top, child, "#" + "".join(f"{round(255 * c):02x}" for c in rgb)))
    return out


def json_safe(x: Column) -> Column:
    """A number that JSON can hold: NaN and the infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def projection_outlier(support: Column, threshold: Column) -> Column:
    """Whether a document's support in a projection is below a threshold that is set (above 0)."""
    return (threshold > 0) & (support < threshold)


def sample_size(rows: Column, min_clusters: int = 2, ratio: float = 0.2, size: int | None = None, floor: int = 2) -> Column:
    """Rows of a scout's sample: ``size``, or a share of the rows, enough for the fewest clusters of ``floor`` rows."""
    asked = F.lit(size) if size is not None else F.ceil(rows * ratio)
    return F.least(rows, F.greatest(F.lit(min_clusters * floor), asked)).cast("long")


def scaled_min_size(min_size: int, rows: Column, sample: Column, floor: int = 2) -> Column:
    """The least cluster size of a sample, in proportion to that of all rows."""
    return F.greatest(F.lit(floor), F.ceil(min_size * sample / rows)).cast("long")


def hierarchy_problems(leaves: DataFrame, tops: int = 6, fewest: int = 3, most: int = 4) -> DataFrame:
    """(problem, name) of all that is wrong with a hierarchy (top, sub, leaf); no row if it is valid."""
    unnamed = leaves.where("top is null or trim(top) = '' or sub is null or trim(sub) = '' or leaf is null or trim(leaf) = ''").select(F.lit("empty name").alias("problem"), F.coalesce("leaf", "sub", "top").alias("name"))
    subs = leaves.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
    wide = subs.where(~F.col("n").between(fewest, most)).select(F.lit("number of subtopics").alias("problem"), F.col("top").alias("name"))
    number = subs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != tops).select(F.lit("number of tops").alias("problem"), F.col("n").cast("string").alias("name"))
    twice = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("leaf used twice").alias("problem"), F.col("leaf").alias("name"))
    return unnamed.unionByName(wide).unionByName(number).unionByName(twice)


def hierarchy_signature(leaves: DataFrame) -> DataFrame:
    """SHA-256 of a hierarchy (top, sub, leaf) as JSON with sorted keys; a hierarchy is a small configuration."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"'))
    pair = lambda a, b: F.concat(a, F.lit(": "), b)
    listed = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(c)), ", "), F.lit("}"))
    by_top = leaves.groupBy("top").agg(listed(pair(quoted("sub"), quoted("leaf"))).alias("held"))
    return by_top.agg(F.sha2(listed(pair(quoted("top"), F.col("held"))), 256).alias("signature"))


def align_metadata(df: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with the metadata of its keys, which are compared as text; a key that is missing or held twice is an error."""
    keyed = metadata.withColumn("__key", F.col(key).cast("string")).drop(key)
    counted = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    found = df.withColumn("__key", F.col(key).cast("string")).join(counted, "__key", "left")
    problem = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit("no metadata for "), F.col("__key")))).when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("metadata twice for "), F.col("__key"))))
    checked = found.withColumn("__n", F.coalesce(problem.cast("long"), F.col("__n"))).where("__n = 1")
    return checked.join(keyed, "__key").drop("__key", "__n")


def add_targets(df: DataFrame, metadata: DataFrame, key: str = "id", targets: tuple[str, ...] = ("class", "class_hierarchy")) -> DataFrame:
    """``df`` with those of the target columns that it lacks and the metadata has."""
    missing = [c for c in targets if c not in df.columns and c in metadata.columns]
    return align_metadata(df, metadata.select(key, *missing), key) if missing else df


def supervision(df: DataFrame, memberships: str, label: str) -> tuple[DataFrame, str]:
    """``df`` with ``target`` and the target's kind: memberships at length 1, or else codes of the labels, or else none."""
    norm = V.norm(memberships)
    sound = F.forall(memberships, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (norm > 1e-12) & (F.size(memberships) >= 2)
    facts = df.agg(F.min(sound.cast("int")).alias("sound"), F.min(memberships).alias("low"), F.max(memberships).alias("high"), F.countDistinct(label).alias("labels")).first()
    if facts["sound"] and facts["low"] != facts["high"]:
        return df.withColumn("target", F.transform(memberships, lambda x: x / norm)), "memberships"
    if facts["labels"] < 2:
        return df.withColumn("target", F.lit(None).cast("long")), "none"
    codes = df.select(label).distinct().withColumn("target", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))  # one row for each label
    return df.join(codes, label), "labels"
