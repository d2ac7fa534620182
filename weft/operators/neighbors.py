"""Exact k nearest neighbours in blocks, and what the density operators build on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .fcm import matrix, unit_rows


def knn(queries: DataFrame, base: DataFrame, k: int, id_: str = "id", vector: str = "x", dims: int | None = None, metric: str = "cosine", block: int = 4096, stripe: int = 1024) -> DataFrame:
    """(id, neighbor, distance, rank) of the k nearest other rows of ``base`` for every row of ``queries``.

    ``queries`` are the stated query set: blocks of them are sent to the tasks that read ``base``; each task keeps k rows for
    each query and partition, so the merge shuffles k rows for each query and task. ``stripe`` rows of ``base`` are compared at
    a time, which bounds a task's memory. Ties go to the smaller id.
    """

    def prepare(x: np.ndarray) -> np.ndarray:
        x = x[:, :dims] if dims else x
        return unit_rows(x) if metric == "cosine" else x

    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64(id_), F.lit(blocks)) == b).select(F.col(id_).cast("long").alias("id"), vector).toArrow()
        ids, points = held.column(0).to_numpy(), prepare(matrix(held.column(1)))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, points=points) -> Iterator[pa.RecordBatch]:
            best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in (b.slice(a, stripe) for b in batches for a in range(0, b.num_rows, stripe)):
                if not len(ids):
                    continue
                mine, x = batch.column(0).to_numpy(), prepare(matrix(batch.column(1)))
                if metric == "cosine":
                    d = 1 - np.clip(points @ x.T, -1, 1)
                else:
                    d = np.sqrt(np.maximum((points * points).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * points @ x.T, 0))
                d[ids[:, None] == mine[None]] = np.inf
                # only rows that are no farther than the k-th so far, ties included, are sorted
                limit = best_d[:, -1:]
                if d.shape[1] > k:
                    limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1 : k])
                q, at = np.nonzero((d <= limit) & np.isfinite(d))
                row, far, who = np.concatenate([np.repeat(np.arange(len(ids)), k), q]), np.concatenate([best_d.ravel(), d[q, at]]), np.concatenate([best_i.ravel(), mine[at]])
                order = np.lexsort((who, far, row))
                row = row[order]
                kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                best_d, best_i = far[kept].reshape(len(ids), k), who[kept].reshape(len(ids), k)
            near = np.isfinite(best_d)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], near.shape)[near]), pa.array(best_i[near]), pa.array(best_d[near])], ["id", "neighbor", "distance"])

        found = base.select(F.col(id_).cast("long"), vector).mapInArrow(run, "id long, neighbor long, distance double")
        out = found if out is None else out.unionByName(found)
    nearest = Window.partitionBy("id").orderBy("distance", "neighbor")
    return out.withColumn("rank", F.row_number().over(nearest).cast("long")).where(F.col("rank") <= k)


def preservation(reference: DataFrame, candidate: DataFrame, k: int) -> DataFrame:
    """Share of each row's reference neighbours that the candidate's first k keep, averaged."""
    both = reference.where(F.col("rank") <= k).join(candidate.where(F.col("rank") <= k).select("id", "neighbor", F.lit(1).alias("kept")), ["id", "neighbor"], "left")
    return both.agg((F.sum(F.coalesce("kept", F.lit(0))) / F.count(F.lit(1))).alias("preservation"))
