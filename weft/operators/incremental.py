"""Incremental maintenance: upserts, contributions, delta centers, drift, refresh and change measures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from ..session import materialize
from . import ranks
from .fcm import matrix


@dataclass(frozen=True)
class DriftPolicy:
    """Limits of the drift detector."""

    enter: float = 0.05
    release: float | None = None
    alpha: float = 0.30
    min_samples: int = 20
    cooldown: int = 3

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1 or not 0 <= self.enter <= 1 or self.min_samples < 1 or self.cooldown < 0:
            raise ValueError("drift limits are out of range")

    @property
    def leave(self) -> float:
        return self.enter / 2 if self.release is None else self.release


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Replace matched rows in place, append the others behind; columns of either side are kept, missing ones null."""
    start = old.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("start")).first()["start"]
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    held = old.select(F.col(key), F.struct(*old.columns).alias("o"))
    sent = new.select(F.col(key), F.struct(*new.columns).alias("n"))
    both = held.join(sent, key, "full")

    def pick(c: str) -> Column:
        o = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        n = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == order and c in new.columns and c in old.columns:
            return F.when(F.col("o").isNotNull(), o).otherwise(n + start).alias(c)
        return F.when(F.col("n").isNotNull() & F.lit(c in new.columns), n).otherwise(o).alias(c)

    return both.select(*[F.col(key) if c == key else pick(c) for c in columns])


def split_batch(old: DataFrame, new: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` that replace and that append."""
    keys = old.select(key)
    return new.join(keys, key, "left_semi"), new.join(keys, key, "left_anti")


def contributions(scored: DataFrame, m: float, path: Column | None = None) -> DataFrame:
    """(id, path, x, w): each document's weights u^m at the node whose centers scored it."""
    return scored.select("id", (F.lit("") if path is None else path).alias("path"), "x", F.transform("u", lambda u: F.pow(u, F.lit(m))).alias("w"))


def statistics(contrib: DataFrame, sign: int = 1) -> DataFrame:
    """(path, k, dim, value, weight): weighted sums of the contributions, signed; one partial sum for each path, center and
    partition leaves the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, every = batch.column(0).to_pylist(), matrix(batch.column(1))
            widths = np.array(batch.column(2).value_lengths())
            for path, width in sorted({(p, int(n)) for p, n in zip(paths, widths, strict=True)}):
                mine = np.flatnonzero([p == path and n == width for p, n in zip(paths, widths, strict=True)])
                w = matrix(batch.column(2).take(pa.array(mine)))
                total, weight = held.get(path, (0.0, 0.0))
                held[path] = (total + w.T @ every[mine], weight + w.sum(0))
        rows = [(path, k, total[k].tolist(), float(weight[k])) for path, (total, weight) in held.items() for k in range(len(weight))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.float64()), strict=True)], ["path", "k", "sums", "weight"])

    parts = contrib.select("path", "x", "w").mapInArrow(run, "path string, k long, sums array<double>, weight double")
    cells = parts.select("path", "k", "weight", F.posexplode("sums").alias("dim", "v"))
    return cells.groupBy("path", "k", F.col("dim").cast("long").alias("dim")).agg((sign * F.sum("v")).alias("value"), (sign * F.sum("weight")).alias("weight"))


def apply_delta(stats: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Statistics after taking old contributions out and putting new ones in; tiny remainders become 0."""
    total = stats.unionByName(statistics(removed, -1)).unionByName(statistics(added)).groupBy("path", "k", "dim").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
    snap = lambda c: F.when(F.abs(c) < 1e-14, 0.0).otherwise(F.col(c))
    failed = F.raise_error(F.lit("a center's weight fell below zero")).cast("double")
    return total.select("path", "k", "dim", snap("value").alias("value"), F.when(F.col("weight") < -1e-10, failed).otherwise(snap("weight")).alias("weight"))


def centers_from_statistics(stats: DataFrame, old: DataFrame) -> DataFrame:
    """(path, k, center): unit directions of the statistics; the old center stays where nothing weighs on it."""
    rows = stats.groupBy("path", "k").agg(F.max("weight").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("sum"))
    joined = old.withColumnRenamed("center", "old").join(rows, ["path", "k"], "left")
    moved = (F.col("weight") > 1e-12) & (V.norm("sum") > 1e-12)
    return joined.select("path", "k", F.when(moved, F.transform("sum", lambda x: x / V.norm("sum"))).otherwise(F.col("old")).alias("center"))


def center_movement(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, k, movement) between two sets of centers."""
    joined = old.withColumnRenamed("center", "old").join(new.withColumnRenamed("center", "new"), ["path", "k"])
    return joined.select("path", "k", F.sqrt(V.squared_euclid("old", "new")).alias("movement"))


def affected_ids(contrib: DataFrame, movement: DataFrame, min_movement: float = 0.01, min_influence: float = 0.05) -> DataFrame:
    """Documents whose largest weight times movement reaches the limit, on nodes that moved enough."""
    cells = contrib.select("id", "path", F.posexplode("w").alias("k", "w")).withColumn("k", F.col("k").cast("long"))
    moved = F.broadcast(movement.where(F.col("movement") >= min_movement))  # one row for each center of the model
    return cells.join(moved, ["path", "k"]).groupBy("id").agg(F.max(F.col("w") * F.col("movement")).alias("influence")).where(F.col("influence") >= min_influence)


def occupancy_change(before: DataFrame, after: DataFrame, path: str = "cluster_path") -> DataFrame:
    """Half the total variation between the shares of documents on each path."""

    def share(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(path).agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).select(path, name)

    both = share(before, "p").join(share(after, "q"), path, "full")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def change_rate(before: DataFrame, after: DataFrame, path: str = "cluster_path", key: str = "id") -> DataFrame:
    """Share of common documents whose path changed."""
    both = before.select(key, F.col(path).alias("p")).join(after.select(key, F.col(path).alias("q")), key)
    return both.agg(F.avg((~F.col("p").eqNullSafe(F.col("q"))).cast("double")).alias("rate"))


def drift(batches: DataFrame, policy: DriftPolicy = DriftPolicy(), order: str = "batch") -> DataFrame:
    """The detector's state after every batch (batch, noise, n): a fold over the ordered batches.

    The input has one row for each batch, not for each document; batches below min_samples accumulate, the noise share is
    smoothed, the alarm has hysteresis, and a re-clustering starts a cool-down that suppresses further ones.
    """
    start = "named_struct('noise', 0D, 'n', 0D, 'ewma', cast(null as double), 'alarm', false, 'cool', 0, 'out', cast(array() as array<struct<batch:string,evaluated:boolean,ratio:double,ewma:double,alarm:boolean,recluster:boolean>>))"
    p = policy
    step = f"""(s, b) -> named_struct(
      'noise', IF(s.n + b.n >= {p.min_samples}, 0D, s.noise + b.noise), 'n', IF(s.n + b.n >= {p.min_samples}, 0D, s.n + b.n),
      'ewma', EWMA, 'alarm', ALARM, 'cool', IF(FIRE, {p.cooldown}, IF(s.cool > 0, s.cool - 1, 0)),
      'out', array_append(s.out, named_struct('batch', b.batch, 'evaluated', s.n + b.n >= {p.min_samples}, 'ratio', IF(s.n + b.n >= {p.min_samples}, (s.noise + b.noise) / (s.n + b.n), null), 'ewma', EWMA, 'alarm', ALARM, 'recluster', FIRE)))"""
    ewma = f"IF(s.n + b.n >= {p.min_samples}, IF(s.ewma IS NULL, (s.noise + b.noise) / (s.n + b.n), {p.alpha}D * (s.noise + b.noise) / (s.n + b.n) + {1 - p.alpha!r}D * s.ewma), s.ewma)"
    alarm = f"IF(s.n + b.n >= {p.min_samples}, IF(s.alarm, NOT ({ewma} <= {p.leave}D), {ewma} > {p.enter}D), s.alarm)"
    fire = f"(s.n + b.n >= {p.min_samples} AND {alarm} AND s.cool = 0)"
    step = step.replace("EWMA", ewma).replace("ALARM", alarm).replace("FIRE", fire)
    ordered = batches.select(F.col(order).cast("string").alias("batch"), F.col(order).alias("o"), F.col("noise").cast("double").alias("noise"), F.col("n").cast("double").alias("n"))
    folded = ordered.agg(F.array_sort(F.collect_list(F.struct("o", "batch", "noise", "n"))).alias("b")).select(F.explode(F.expr(f"aggregate(b, {start}, {step}, s -> s.out)")).alias("r"))
    return folded.select("r.*")


def refreshed_thresholds(scored: DataFrame, old: DataFrame, z: float = 3.5) -> DataFrame:
    """(path, k, threshold) of ``old`` with the robust limit of the distances in ``scored`` (path, k, distance).

    A cluster of fewer than 4 documents keeps its threshold; one without spread has none (infinite).
    """
    keyed = scored.select(F.struct("path", "k").alias("c"), F.col("distance").alias("d"))
    middle = materialize(ranks.medians(keyed, "d", "c"))  # used twice, one row for each cluster
    far = keyed.join(middle.drop("n"), "c").select("c", F.abs(F.col("d") - F.col("median")).alias("far"))
    both = middle.join(ranks.medians(far, "far", "c", "mad").drop("n"), "c").select("c.path", "c.k", "n", "median", "mad")
    new = F.when(F.col("mad") <= 1e-12, F.lit(float("inf"))).otherwise(F.col("median") + z * 1.4826 * F.col("mad"))
    return old.join(both, ["path", "k"], "left").select("path", "k", F.when(F.coalesce(F.col("n"), F.lit(0)) < 4, F.col("threshold")).otherwise(new).alias("threshold"))


def xie_beni_degraded(current: Column, base: Column, limit: float = 0.05) -> Column:
    """Whether the index has grown by at least ``limit`` of its base."""
    return (current - base) / F.greatest(F.abs(base), F.lit(1e-12)) >= limit


def held_out_split(docs: DataFrame, ratio: float, noise: float = 0.05, seed: int = 42, id_: str = "id", vector: str = "x") -> DataFrame:
    """``docs`` with ``operation``: about ``ratio`` of the rows, half of them ``new`` (left out of the first fit) and half
    ``modified``, which appear as ``initial`` too and once more with unit noise of ``noise`` times their length added.

    Rows are chosen by a hash of their id, so the choice needs no order and repeats; the noise follows from id, place and
    seed.
    """
    if not 0 < ratio < 1 or noise < 0:
        raise ValueError("ratio must lie between 0 and 1, and noise must not be negative")
    draw = F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(1_000_000)) / 1e6
    kind = F.when(draw < ratio / 2, "new").when(draw < ratio, "modified").otherwise("initial")
    marked = docs.withColumn("operation", kind)
    part = lambda k, salt: (F.pmod(F.xxhash64(F.col(id_), k, F.lit(seed + salt)), F.lit(999_983)) + 1) / 999_984
    # Box-Muller from two hashes of the place
    step = F.transform(vector, lambda _, k: F.sqrt(-2 * F.log(part(k, 1))) * F.cos(6.283185307179586 * part(k, 2)))
    moved = marked.where("operation = 'modified'").withColumn("__n", step)
    scale = noise * V.norm(vector) / F.greatest(V.norm("__n"), F.lit(1e-12))
    moved = moved.withColumn(vector, F.zip_with(vector, F.transform("__n", lambda x: x * scale), lambda a, b: a + b)).drop("__n")
    return marked.withColumn("operation", F.when(F.col("operation") == "modified", "initial").otherwise(F.col("operation"))).unionByName(moved)
