"""Principal components of unit vectors, projections by prefix, and the choice of the width by kept neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fcm, neighbors, selection


@dataclass
class Projection:
    """Mean, components (rows) and explained variance ratios."""

    mean: np.ndarray
    components: np.ndarray
    ratios: np.ndarray


def fit(docs: DataFrame, width: int, vector: str = "x") -> Projection:
    """Fit on L2-normalised rows from one pass of second moments: d rows of d sums for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            if batch.num_rows:
                x = fcm.unit_rows(fcm.matrix(batch.column(0)))
                x = np.hstack([x, np.ones((len(x), 1))])
                gram = x.T @ x + (0 if gram is None else gram)
        if gram is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gram))), pa.array(gram.tolist())], ["i", "row"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([fcm.matrix(table.column("row")).sum(0).tolist()])], ["i", "row"])

    rows = docs.select(vector).mapInArrow(run, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").collect()
    gram = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    n = gram[-1, -1]
    mean = gram[-1, :-1] / n
    cov = (gram[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(width, int(n), len(values))]
    components = vectors[:, order].T
    # each component's largest entry is positive, so that signs do not depend on the solver
    components *= np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])[:, None]
    return Projection(mean, components, values[order] / max(values.sum(), 1e-300))


def project(docs: DataFrame, p: Projection, dims: int | None = None, normalise: bool = True, vector: str = "x") -> DataFrame:
    """``docs`` with ``projected`` (first ``dims`` components, at unit length if asked) and ``support``, the share of a row's length kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = fcm.unit_rows(fcm.matrix(batch.column(batch.schema.get_field_index(vector)))) - p.mean
            y = x @ p.components[:dims].T
            support = np.clip(np.linalg.norm(y, axis=1) / np.maximum(np.linalg.norm(x, axis=1), 1e-12), 0, 1)
            y = fcm.unit_rows(y) if normalise else y
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(support)], [*batch.schema.names, "projected", "support"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{types}, projected array<double>, support double")


def support_threshold(scored: DataFrame, width: int, full: int, z: float = 3.0) -> float:
    """A limit between the support of random directions and of the fitted rows; 0 if they are not apart."""
    middle = scored.agg(F.median("support")).first()[0]
    mad = scored.agg(F.median(F.abs(F.col("support") - middle))).first()[0]
    random, low = float(np.sqrt(width / full)), middle - z * 1.4826 * mad
    return random + 0.4 * (low - random) if low > random else 0.0


def choose_width(docs: DataFrame, widths: list[int], k: int = 15, min_gain: float = 0.05) -> tuple[int, DataFrame]:
    """The width by kept neighbours and the curve; one fit at the largest width, smaller ones are prefixes.

    Neighbours are exact, for every row against all rows.
    """
    p = fit(docs, max(widths))
    projected = project(docs, p, normalise=False).select("id", "x", F.col("projected").alias("y")).persist()
    reference = neighbors.knn(projected, projected, k).persist()
    rows = [(w, neighbors.preservation(reference, neighbors.knn(projected, projected, k, vector="y", dims=w), k).first()[0]) for w in sorted({min(w, len(p.components)) for w in widths})]
    curve = docs.sparkSession.createDataFrame([(int(w), float(v)) for w, v in rows], "dim long, preservation double")
    local, knee = selection.plateau(curve, min_gain).first()["dim"], selection.global_knee(curve).first()["dim"]
    projected.unpersist()
    reference.unpersist()
    return int(max(local, knee) if local < max(widths) else local), curve
