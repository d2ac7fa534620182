"""Spherical fuzzy C-means on DataFrames: E-step, M-step and objective as Arrow kernels with partial sums.

Centers are a model: K vectors on the driver, sent to the tasks with the closure. Documents never leave the executors;
an M-step shuffles K sums for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

EXACT, FLOOR = 1e-12, 1e-12


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal widths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay zero."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > EXACT)


class Spherical:
    """Unit vectors, squared chord distance, centers on the sphere."""

    name = "spherical"

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return unit_rows(x)

    def distances(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.maximum(2 - 2 * (x @ v.T), 0)

    def centers(self, sums: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return unit_rows(sums)


class Euclidean(Spherical):
    """Raw vectors, squared distance, centers are weighted means."""

    name = "euclidean"

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return x

    def distances(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * (x @ v.T), 0)

    def centers(self, sums: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return sums / np.maximum(weight, FLOOR)[:, None]


class CosineRaw(Euclidean):
    """Raw vectors, 1 - cosine to centers that are weighted means."""

    name = "cosine_raw"

    def distances(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.maximum(1 - np.clip(unit_rows(x) @ unit_rows(v).T, -1, 1), 0)


class CosineNormalized(CosineRaw):
    """Unit vectors, 1 - cosine, centers are weighted means of unit vectors."""

    name = "cosine_normalized"

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return unit_rows(x)


GEOMETRIES = {g.name: g for g in (Spherical(), Euclidean(), CosineRaw(), CosineNormalized())}


def memberships(d2: np.ndarray, m: float) -> np.ndarray:
    """Fuzzy memberships of rows of squared distances."""
    least = d2.min(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = (d2 / least) ** (-1.0 / (m - 1))
    exact = least[:, 0] <= EXACT
    if exact.any():
        u[exact] = d2[exact] <= EXACT
    return u / u.sum(1, keepdims=True)


def e_step(docs: DataFrame, centers: np.ndarray, m: float, geometry: str = "spherical", vector: str = "x") -> DataFrame:
    """``docs`` with d2, u (arrays over centers) and cluster (first largest u)."""
    v, g = np.asarray(centers, float), GEOMETRIES[geometry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d2 = g.distances(g.prepare(matrix(batch.column(batch.schema.get_field_index(vector)))), v)
            u = memberships(d2, m)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel())) for a in (d2, u)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(u.argmax(1))], [*batch.schema.names, "d2", "u", "cluster"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{types}, d2 array<double>, u array<double>, cluster long")


def _sum_rows(partial: DataFrame) -> dict:
    """Add up (k, weight, sums array) rows; returns k -> (weight, sums)."""
    width = partial.select("k", "weight", F.posexplode("sums").alias("dim", "value"))
    summed = width.groupBy("k", "dim").agg(F.sum("value").alias("value"), F.sum(F.when(F.col("dim") == 0, F.col("weight"))).alias("weight"))
    rows = summed.groupBy("k").agg(F.max("weight").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("sums")).collect()
    return {r["k"]: (r["weight"], np.array(r["sums"])) for r in rows}


def group_sums(docs: DataFrame, group: str, vector: str = "x", unit: bool = True) -> dict:
    """Row count and vector sum of every value of ``group``, with one partial sum for each partition and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            x = unit_rows(x) if unit else x
            keys, inverse = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            for i, key in enumerate(keys.tolist()):
                mine = inverse == i
                n, s = held.get(key, (0.0, 0.0))
                held[key] = (n + float(mine.sum()), s + x[mine].sum(0))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()]), pa.array([s.tolist() for _, s in held.values()])], ["k", "weight", "sums"])

    return _sum_rows(docs.select(F.col(group).cast("long"), vector).mapInArrow(run, "k long, weight double, sums array<double>"))


def label_centers(docs: DataFrame, group: str = "label", vector: str = "x") -> tuple[list, np.ndarray]:
    """Values of ``group`` in order, and the unit mean direction of each."""
    sums = group_sums(docs, group, vector)
    keys = sorted(sums)
    return keys, unit_rows(np.array([sums[k][1] for k in keys])) if keys else np.zeros((0, 0))


def m_step(docs: DataFrame, centers: np.ndarray, m: float, geometry: str = "spherical", vector: str = "x", power: float | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """One E- and M-step in one pass: new centers, their weights, the objective of the old ones, and the rows."""
    v, g = np.asarray(centers, float), GEOMETRIES[geometry]
    exponent = m if power is None else power

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight, objective, n = np.zeros_like(v), np.zeros(len(v)), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = g.prepare(matrix(batch.column(0)))
            d2 = g.distances(x, v)
            w = memberships(d2, m) ** exponent
            sums, weight, objective, n = sums + w.T @ x, weight + w.sum(0), objective + float((w * d2).sum()), n + len(x)
        if n:
            keys = [*range(len(v)), -1]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*weight, float(n)]), pa.array([*sums.tolist(), [objective]])], ["k", "weight", "sums"])

    held = _sum_rows(docs.select(vector).mapInArrow(run, "k long, weight double, sums array<double>"))
    n, objective = held.pop(-1, (0.0, np.zeros(1)))
    sums, weight = np.array([held[k][1] for k in range(len(v))]), np.array([held[k][0] for k in range(len(v))])
    return g.centers(sums, weight), weight, float(objective[0]) / max(n, 1), int(n)


def centers_frame(spark, centers: np.ndarray, keys: list | None = None) -> DataFrame:
    """(k, center) of a model."""
    return spark.createDataFrame([(int(k), [float(x) for x in c]) for k, c in zip(keys or range(len(centers)), centers, strict=True)], "k long, center array<double>")
