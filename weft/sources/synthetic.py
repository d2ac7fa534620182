"""Synthetic collections: blobs, content with noisy tags, and adversarial cases. Rows are made in the tasks from seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _rows(spark: SparkSession, n: int, schema: str, make, parts: int = 8) -> DataFrame:
    """``make(ids)`` gives the columns of a range of row numbers."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in make(batch.column(0).to_numpy())], names)

    return spark.range(0, n, 1, parts).mapInArrow(run, schema)


def _each(ids: np.ndarray, seed: int, draw) -> list:
    """One draw for each row, from a generator of its own, so that rows do not depend on the partitions."""
    return [draw(np.random.default_rng([seed, int(i)]), int(i)) for i in ids]


def blobs(spark: SparkSession, n: int, clusters: int = 4, latent: int = 8, dims: int = 64, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """(id, label, x): Gaussian blobs in a latent space, projected at random, with noise."""
    rng = np.random.default_rng(seed)
    centers, projection = rng.normal(0, 3, (clusters, latent)), rng.normal(size=(latent, dims)) / np.sqrt(latent)

    def make(ids: np.ndarray) -> list:
        x = _each(ids, seed, lambda r, i: ((centers[i % clusters] + r.normal(size=latent)) @ projection + noise * r.normal(size=dims)).tolist())
        return [ids, ids % clusters, x]

    return _rows(spark, n, "id long, label long, x array<double>", make)


def tagged(spark: SparkSession, n: int = 400, roots: int = 6, dims: int = 24, corruption: float = 0.5, content_noise: float = 0.1, seed: int = 7) -> DataFrame:
    """(id, p, content, tag, observed, missing, wrong, general, extra): soft memberships over roots, and tags that lose,
    swap, blur or gain parts with chances .15, .10, .20 and .25 times ``corruption``."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(dims, roots)))
    base = q.T
    mean = base.mean(0)
    mean = mean / np.linalg.norm(mean)

    def draw(r: np.random.Generator, i: int) -> tuple:
        p = np.zeros(roots)
        chosen = r.choice(roots, size=int(r.integers(2, min(4, roots + 1))), replace=False)
        p[chosen] = r.dirichlet(np.full(len(chosen), 0.9))
        tag = p @ base
        content = tag / np.linalg.norm(tag) + content_noise * r.normal(size=dims)
        missing, wrong, general, extra = r.random(4) < np.array([0.15, 0.10, 0.20, 0.25]) * corruption
        seen = base[int(r.integers(roots))] if wrong else mean if general else tag
        if extra:
            seen = seen + base[int(r.integers(roots))] / 2
        return p.tolist(), content.tolist(), tag.tolist(), (np.zeros(dims) if missing else seen).tolist(), bool(missing), bool(wrong), bool(general), bool(extra)

    def make(ids: np.ndarray) -> list:
        return [ids, *zip(*_each(ids, seed, draw), strict=True)]

    return _rows(spark, n, "id long, p array<double>, content array<double>, tag array<double>, observed array<double>, missing boolean, wrong boolean, general boolean, extra boolean", make)


# Names and sizes of the adversarial cases, and the seed below. Rows, width, clusters, spread, and what is
# odd about each case.
CASES = {
    "imbalanced_overlap": (400, 64, 4, 0.35, "sizes fall by half from cluster to cluster"),
    "duplicate_ties": (360, 64, 6, 0.10, "every row comes three times"),
    "boundary_and_noise": (400, 64, 4, 0.20, "a tenth lies between two centers, a tenth anywhere"),
    "rank_deficient_duplicates": (360, 96, 6, 0.10, "all rows lie in eight dimensions, each twice"),
    "tiny_clusters_high_k": (400, 64, 40, 0.08, "many clusters of a few rows"),
}


#: Fixed value.
SEED = 20260809


def adversarial(spark: SparkSession, name: str, seed: int = SEED) -> DataFrame:
    """(id, truth_label, truth_noise, x) of a case, at unit length."""
    n, dims, clusters, spread, _ = CASES[name]
    rng = np.random.default_rng([seed, n, dims, clusters])
    flat = 8 if name.startswith("rank") else dims
    centers = np.zeros((clusters, dims))
    centers[:, :flat] = rng.normal(size=(clusters, flat))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    copies = 3 if name == "duplicate_ties" else 2 if name.startswith("rank") else 1

    def draw(r: np.random.Generator, i: int) -> tuple:
        i //= copies
        r = np.random.default_rng([seed, i])
        label = min(clusters - 1, int(np.floor(-np.log2(1 - i * copies / n)))) if name.startswith("imbalanced") else i % clusters
        x = centers[label].copy()
        x[:flat] += spread * r.normal(size=flat) / np.sqrt(flat) * 2
        noise = False
        if name == "boundary_and_noise" and i % 10 == 0:
            x = centers[label] + centers[(label + 1) % clusters]
        if name == "boundary_and_noise" and i % 10 == 5:
            x, noise = r.normal(size=dims), True
        return label, noise, (x / np.linalg.norm(x)).tolist()

    def make(ids: np.ndarray) -> list:
        return [ids, *zip(*_each(ids, seed, draw), strict=True)]

    return _rows(spark, n, "id long, truth_label long, truth_noise boolean, x array<double>", make)
