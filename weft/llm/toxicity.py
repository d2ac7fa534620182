"""Operator 4, toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions over hashed words and word beginnings; the
probability of each earlier category is a feature of every later model. Those features are out-of-fold predictions
while training, so that a later model never sees a probability that was fitted on the row itself. The first category is
low quality, the label ``quality`` reversed, where it is known; the next three are weakly labelled: toxic rows whose words
are in the category's list; the last is the label ``toxic``.

The models are fitted on a bounded sample: of the labelled documents the MAX_TRAIN rows with the smallest hash of their
doc_id, as far as their texts fit into MAX_TRAIN_BYTES, rows that are equal counted once. Every document is scored whole,
in one pass without a shuffle. Null and empty texts have no features and score the intercepts. Without labels of both
kinds every probability is the share of toxic labels, or 0. Labels that are null, or whose ``toxic`` is, are left out; a
missing ``quality`` is unknown. Repeated rows give repeated results; empty tables give an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import tokens as tk

#: Most labelled rows in training, and bytes of their texts; features that a model keeps; rows that a feature must be in; folds; ridge penalty.
MAX_TRAIN, MAX_TRAIN_BYTES, MAX_FEATURES, MIN_ROWS, FOLDS, PENALTY = 8000, 64 << 20, 8192, 5, 5, 0.1
THRESHOLD = 0.4
#: Bytes of the word beginnings that are features beside the whole words.
PREFIXES = (4, 5, 6, 7, 8)

# Words that mark a category in rows labelled toxic.
CATEGORIES = {
    "insult": "idiot idiots moron morons stupid clown fool loser dumb imbecile",
    "contempt": "worthless pathetic disgusting trash scum garbage vermin useless",
    "threat": "kill hurt destroy murder beat die shoot burn",
}
CHAIN = ("low_quality", *CATEGORIES, "toxic")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and word beginning of the rows of a slice."""
    low = tk.LOWER[data]
    starts, ends, bounds = tk.words(low, offsets, tk.ALNUM)
    prefix = tk.prefix_hash(low)
    row = tk.row_of(bounds)
    rows, hashes = [row], [tk.word_hashes(low, starts, ends)]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        rows.append(row[long])
        hashes.append(tk.mix(tk.range_hash(prefix, starts[long], starts[long] + k) + np.uint64(k << 32)))
    return np.concatenate(rows), np.concatenate(hashes)


def _word_hash(word: str) -> np.uint64:
    data, offsets = tk.text_bytes(pa.array([word]))
    return features(data, offsets)[1][0]


@dataclass
class Linear:
    """Weights of the features and of the earlier categories' probabilities."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


@dataclass
class Chain:
    """One linear model for each category, over shared features."""

    hashes: np.ndarray
    models: list[Linear]

    def predict(self, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n, categories) of rows with the given feature hashes."""
        seen = np.zeros(1 << 16, bool)
        seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        found = self.hashes[at] == hashes[maybe] if len(self.hashes) else np.zeros(0, bool)
        cell = np.unique(rows[maybe][found] * max(1, len(self.hashes)) + at[found])
        row, col = np.divmod(cell, max(1, len(self.hashes)))
        out = np.zeros((n, len(self.models)))
        for k, m in enumerate(self.models):
            score = m.intercept + np.bincount(row, m.weights[col], n) + out[:, :k] @ m.earlier
            out[:, k] = _sigmoid(score)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(row: np.ndarray, col: np.ndarray, n_cols: int, earlier: np.ndarray, y: np.ndarray, penalty: float) -> Linear:
    """Ridge logistic regression by L-BFGS; ``row`` and ``col`` are the cells that are 1."""
    n, k = len(y), earlier.shape[1]
    size = n_cols + k + 1
    ridge = np.full(size, penalty)
    ridge[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        score = np.bincount(row, w[col], n) + earlier @ w[n_cols : n_cols + k] + w[-1]
        gap = _sigmoid(score) - y
        grad = np.concatenate([np.bincount(col, gap[row], n_cols), earlier.T @ gap, [gap.sum()]]) + ridge * w
        return float(np.sum(np.logaddexp(0, score) - y * score) + 0.5 * np.sum(ridge * w * w)), grad

    w = np.zeros(size)
    share = np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < n:
        value, grad = loss(w)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(60):
            step = -grad
            kept = []
            for s, d in reversed(past):
                a = s @ step / (s @ d)
                step = step - a * d
                kept.append(a)
            if past:
                step = step * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
            for (s, d), a in zip(past, reversed(kept), strict=True):
                step = step + s * (a - d @ step / (s @ d))
            rate = 1.0 if past else 1.0 / max(1.0, np.abs(grad).sum())
            slope = grad @ step
            while True:
                new, new_grad = loss(w + rate * step)
                if new <= value + 1e-4 * rate * slope or rate < 1e-10:
                    break
                rate /= 2
            s, d = rate * step, new_grad - grad
            done = abs(value - new) < 1e-7 * max(1.0, abs(value))
            w, value, grad = w + s, new, new_grad
            if s @ d > 1e-12:
                past = [*past[-7:], (s, d)]
            if done:
                break
    return Linear(w[:n_cols], w[n_cols : n_cols + k], float(w[-1]))


def train(rows: np.ndarray, hashes: np.ndarray, toxic: np.ndarray, low_quality: np.ndarray, fold: np.ndarray, max_features: int = MAX_FEATURES, penalty: float = PENALTY) -> Chain:
    """Fit the chain on rows numbered from 0 with the labels ``toxic`` and ``low_quality`` (NaN where unknown); ``rows`` and
    ``hashes`` list their distinct features."""
    n = len(toxic)
    # features of too few rows go first: most hashes are in one row only
    held = np.sort(hashes)
    often = held[MIN_ROWS - 1 :][held[MIN_ROWS - 1 :] == held[: max(0, len(held) - MIN_ROWS + 1)]] if len(held) else held
    marks = {k: rows[np.isin(hashes, np.array([_word_hash(w) for w in v.split()], np.uint64))] for k, v in CATEGORIES.items()}
    del held
    names = np.unique(often)
    at = np.searchsorted(names, hashes)
    at[at == len(names)] = 0
    kept = names[at] == hashes if len(names) else np.zeros(len(hashes), bool)
    rows, inverse = rows[kept], at[kept]
    del hashes, at, kept
    with_toxic = np.bincount(inverse, toxic[rows].astype(float), len(names)) if len(rows) else np.zeros(0)
    df = np.bincount(inverse, minlength=len(names))
    share = toxic.mean() if n else 0.0
    expected = df * share
    strength = (with_toxic - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    strength[df < MIN_ROWS] = -1
    best = np.sort(np.argsort(-strength, kind="stable")[:max_features])
    best = best[strength[best] >= 0]
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    col = place[inverse] if len(rows) else np.zeros(0, np.int64)
    row, col = rows[col >= 0], col[col >= 0]
    earlier = np.zeros((n, 0))
    models = []
    for name in CHAIN:
        known = np.ones(n, bool)
        if name == "toxic":
            y = toxic.astype(float)
        elif name == "low_quality":
            known = ~np.isnan(low_quality)
            y = np.where(known, low_quality, 0.0)
        else:
            y = np.zeros(n)
            y[marks[name]] = 1
            y *= toxic

        def fit(some: np.ndarray, y: np.ndarray = y, earlier: np.ndarray = earlier) -> Linear:
            back = np.cumsum(some) - 1
            inside = some[row]
            return _fit(back[row[inside]], col[inside], len(best), earlier[some], y[some], penalty)

        out_of_fold = np.zeros(n)
        if name != CHAIN[-1]:
            for k in range(FOLDS):
                held = fold == k
                m = fit(known & ~held)
                score = m.intercept + np.bincount(row, m.weights[col], n) + earlier @ m.earlier
                out_of_fold[held] = _sigmoid(score)[held]
        models.append(fit(known))
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(names[best], models)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """fold, the labels and the distinct features (packed) of the sampled labelled documents."""
    quality = F.col("quality").cast("int") if "quality" in labels.columns else F.lit(None).cast("int")
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), quality.alias("quality"))
    near = F.xxhash64("doc_id")
    chosen = known.distinct().orderBy(near, "doc_id", "toxic", "quality").limit(max_train)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    joined = joined.withColumn("place", F.xxhash64("doc_id", "text"))
    # a doc_id may have many rows: the bounds hold for what the join gives
    order = [near, F.col("doc_id"), F.col("place"), F.col("toxic"), F.col("quality")]
    first = joined.select("doc_id", "place", "toxic", "quality", F.octet_length("text").alias("bytes")).distinct().orderBy(*order).limit(max_train)
    running = F.sum(F.coalesce("bytes", F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    first = materialize(first.withColumn("running", running).where(F.col("running") <= max_bytes).select("doc_id", "place", "toxic", F.coalesce("quality", F.lit(-1)).alias("quality")))
    joined = joined.withColumn("quality", F.coalesce("quality", F.lit(-1))).join(F.broadcast(first), ["doc_id", "place", "toxic", "quality"], "left_semi")
    joined = joined.groupBy("place", "toxic", "quality", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")).agg(F.first("text").alias("text"))
    joined = joined.select("fold", "toxic", "quality", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.slices(batch):
                rows, hashes = features(data, offsets)
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                fresh = np.ones(len(rows), bool)
                fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                rows, hashes = rows[fresh], hashes[fresh]
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["fold", "toxic", "quality", "place", "features"])

    tk.batch_conf(docs.sparkSession)
    return joined.mapInArrow(run, "fold int, toxic int, quality int, place long, features binary")


def fit_chain(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Chain:
    """Fit the chain on the driver; at most ``max_train`` rows of ``max_bytes`` of text reach it."""
    table = training_rows(docs, labels, max_train, max_bytes).toArrow()
    # in an order of its own, whatever the tasks' order, so that reruns agree
    order = np.lexsort((table.column("quality").to_numpy(), table.column("toxic").to_numpy(), table.column("place").to_numpy()))
    table = table.take(pa.array(order)).combine_chunks()
    packed = table.column("features").combine_chunks() if table.num_rows else None
    sizes = np.array([len(v) // 8 for v in packed.to_pylist()] if packed is not None else [], np.int64)
    hashes = np.frombuffer(b"".join(packed.to_pylist()), np.uint64) if packed is not None else np.zeros(0, np.uint64)
    fold, toxic = table.column("fold").to_numpy(), table.column("toxic").to_numpy() > 0
    quality = table.column("quality").to_numpy()
    low_quality = np.where(quality < 0, np.nan, quality == 0)
    del table, packed
    return train(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), hashes, toxic, low_quality, fold)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category, and the verdict of each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in CHAIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.slices(batch):
                p = np.round(sent.value.predict(*features(data, offsets), part.num_rows), 9)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "toxic"])

    tk.batch_conf(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{n} double' for n in names)}, toxic boolean")
