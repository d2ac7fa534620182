"""Operator 8, benchmark decontamination by spaced-seed hashing.

A seed mask keeps some positions of a window of successive words and ignores the others, so that a window still hits
after substitutions at ignored positions. The hashes of all masked windows of the benchmark are joined with those of
every document; each hit fixes a diagonal (document position minus benchmark position), along which the two word
sequences are compared in full, and the best ungapped segment, scored +1 for an equal word and -MISMATCH for another,
must hold MIN_MATCHED equal words. Words are lower-cased ASCII letters and digits and everything outside ASCII, so that
punctuation and case do not matter.

Seed hashes of documents and benchmark meet in a join. Before it, a Bloom filter of the benchmark's hashes, of at most
2**FILTER_BITS bits whatever the benchmark's size, keeps back the documents' other hashes, so that only documents with a
hit leave their partition, and none is shuffled whole. Null or empty texts and documents or items with fewer words than
MIN_MATCHED give no row. Texts are compared whole. Repeated rows give repeated results, one row for each document row
and item row. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, row_hash
from . import tokens as tk

#: Fixed masks: 1 compares a word, 0 ignores it.
MASKS = ("11101011", "1100101011", "110010100111", "1011000100111")
MIN_MATCHED, MISMATCH = 10, 2
#: Most bits of the filter, as a power of two: 16 MB.
FILTER_BITS = 27

SCHEMA = "doc_id long, item_id long, matched_words long, overlap_words long, item_words long, doc_start long, item_start long, seed_hits long"


def _seeds(hashes: np.ndarray, row: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the masked windows that stay within their row."""
    span = len(mask)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k, factor in enumerate(tk.powers(span + 1)[1:]):
        if mask[k] == "1":
            out += hashes[k : k + n] * factor
    at = np.flatnonzero(row[:n] == row[span - 1 :])
    return at, tk.mix(out[at])


def _tokenize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tk.LOWER[data]
    starts, ends, bounds = tk.words(low, offsets, tk.ALNUM)
    return tk.word_hashes(low, starts, ends), bounds


class Filter:
    """Bloom filter of fixed size: which hashes may be among those of the benchmark."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(bits: int, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(bits - 1)
        return [(hashes & mask).astype(np.int64), (hashes >> np.uint64(20) & mask).astype(np.int64), (tk.mix(hashes) & mask).astype(np.int64)]

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that pass."""
        live = np.arange(len(hashes))
        for place in self.places(self.bits, hashes):
            at = place[live]
            live = live[(self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
        return live


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Slices of a partition: (number of the first row, rows, word hashes, bounds); the numbers are unique in the table."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part, data, offsets in tk.slices(batch):
            yield base, part, *_tokenize(data, offsets)
            base += part.num_rows


def _word_lists(hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> pa.Array:
    held = hashes.tobytes()
    return pa.array([held[8 * bounds[r] : 8 * bounds[r + 1]] for r in rows], pa.binary())


_ITEM = "item long, item_id long, item_words long, theirs binary"
_ITEM_SEED = "hash long, item long, item_at long"
_DOC = "doc long, doc_id long, doc_key long, ours binary, hits array<struct<hash:long,doc_at:long>>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered benchmark items with the hashes of their words."""
    for base, part, hashes, bounds in _numbered(batches):
        rows = np.arange(part.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(base + rows), part.column(0), pa.array(np.diff(bounds)), _word_lists(hashes, bounds, rows)], [x.split()[0] for x in _ITEM.split(", ")])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column(1).to_pylist()
        hashes = np.frombuffer(b"".join(held), np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in held])])
        row = tk.row_of(bounds)
        number = batch.column(0).to_numpy()
        for salt, mask in enumerate(MASKS):
            at, found = _seeds(hashes, row, mask, salt)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(number[row[at]]), pa.array(at - bounds[row[at]])], ["hash", "item", "item_at"])


def _doc_hits(sent):
    """Documents with a masked window that may be in the benchmark, numbered, with the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value
        for base, part, hashes, bounds in _numbered(batches):
            row = tk.row_of(bounds)
            rows, places, keys = [], [], []
            for salt, mask in enumerate(MASKS):
                at, found = _seeds(hashes, row, mask, salt)
                hit = kept.may_hold(found)
                rows.append(row[at[hit]])
                places.append(at[hit] - bounds[row[at[hit]]])
                keys.append(found[hit])
            rows, places, keys = np.concatenate(rows), np.concatenate(places), np.concatenate(keys)
            if not len(rows):
                continue
            order = np.argsort(rows, kind="stable")
            rows, places, keys = rows[order], places[order], keys[order]
            docs = np.unique(rows)
            hits = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(places)], ["hash", "doc_at"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(rows, docs), len(rows)).astype(np.int32)), hits)
            yield pa.RecordBatch.from_arrays([pa.array(base + docs), part.column(0).take(pa.array(docs)), part.column(1).take(pa.array(docs)), _word_lists(hashes, bounds, docs), lists], ["doc", "doc_id", "doc_key", "ours", "hits"])

    return run


_SEGMENT = "doc long, item long, doc_id long, doc_key long, item_id long, item_words long, hits long, matched_words long, overlap_words long, doc_start long, item_start long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best segment of each diagonal, if it is long enough; ``ours`` are the document's words from ``doc_from`` on and
    ``theirs`` the item's from ``item_from`` on."""
    for batch in batches:
        held = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
        rows = []
        for k in range(batch.num_rows):
            ours, theirs = np.frombuffer(held["ours"][k], np.uint64), np.frombuffer(held["theirs"][k], np.uint64)
            equal = ours == theirs
            score = np.zeros(len(equal) + 1, np.int64)
            np.cumsum(np.where(equal, 1, -MISMATCH), out=score[1:])
            low = np.minimum.accumulate(score)
            end = int(np.argmax(score - low))
            begin = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
            matched = int(equal[begin:end].sum())
            if matched >= MIN_MATCHED:
                rows.append((*(held[c][k] for c in ("doc", "item", "doc_id", "doc_key", "item_id", "item_words", "hits")), matched, end - begin, held["doc_from"][k] + begin, held["item_from"][k] + begin))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [x.split()[0] for x in _SEGMENT.split(", ")])


def _filter(seeds: DataFrame) -> Filter:
    """The filter of the benchmark's seeds; at most FILTER_BITS, so that its broadcast is bounded whatever the benchmark."""
    bits = 1 << min(FILTER_BITS, max(16, (64 * max(1, seeds.count())).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            for place in Filter.places(bits, batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["at", "word"])

    set_ = seeds.select("hash").mapInArrow(run, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[set_.column("at").to_numpy()] = set_.column("word").to_numpy().view(np.uint64)
    return Filter(bits, words)


def _segments(source: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best segment of every document row and item row that overlap, from rows (doc_id, doc_key, text)."""
    spark = source.sparkSession
    tk.batch_conf(spark)
    items = materialize(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items, _ITEM).where(f"item_words >= {MIN_MATCHED}"))
    seeds = materialize(items.select("item", "theirs").mapInArrow(_item_seeds, _ITEM_SEED))
    sent = spark.sparkContext.broadcast(_filter(seeds))
    docs = materialize(source.mapInArrow(_doc_hits(sent), _DOC))
    hits = docs.select("doc", F.explode("hits").alias("hit")).select("doc", "hit.hash", "hit.doc_at")
    # copies combine before the shuffle; a hash that very many documents hold is split by adaptive execution
    diagonals = hits.join(seeds, "hash").groupBy("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.count(F.lit(1)).alias("hits"))
    item_from, doc_from = F.greatest(F.lit(0).cast("long"), -F.col("shift")), F.greatest(F.lit(0).cast("long"), F.col("shift"))
    both = diagonals.join(items, "item").join(docs.select("doc", "doc_id", "doc_key", "ours"), "doc")
    both = both.withColumn("item_from", item_from).withColumn("doc_from", doc_from)
    both = both.withColumn("n", F.least(F.col("item_words") - F.col("item_from"), F.octet_length("ours") / 8 - F.col("doc_from")).cast("int"))
    cut = lambda c, at: F.substring(F.col(c), (8 * F.col(at) + 1).cast("int"), 8 * F.col("n")).alias(c)
    both = both.select("doc", "item", "doc_id", "doc_key", "item_id", "item_words", "hits", "doc_from", "item_from", cut("ours", "doc_from"), cut("theirs", "item_from"))
    best = F.max(F.struct("matched_words", "overlap_words", "doc_start", "item_start")).alias("best")
    found = both.mapInArrow(_verify, _SEGMENT).groupBy("doc", "item").agg(*[F.first(c).alias(c) for c in ("doc_id", "doc_key", "item_id", "item_words")], F.sum("hits").alias("seed_hits"), best)
    return materialize(found.select("doc_id", "doc_key", "item_id", "best.matched_words", "best.overlap_words", "item_words", "best.doc_start", "best.item_start", "seed_hits"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and benchmark item row that overlap, with the best segment."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("doc_key"), "text")
    return _segments(source, benchmark).drop("doc_key")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns."""
    keyed = docs.withColumn("__key", row_hash(docs)).withColumn("__id", F.col("doc_id").cast("long"))
    found = _segments(keyed.select(F.col("__id").alias("doc_id"), F.col("__key").alias("doc_key"), "text"), benchmark)
    bad = found.select(F.col("doc_key").alias("__bad"), F.col("doc_id").alias("__bad_id")).distinct()
    return keyed.join(bad, (F.col("__key") == F.col("__bad")) & F.col("__id").eqNullSafe(F.col("__bad_id")), "left_anti").select(docs.columns)
