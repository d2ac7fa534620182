"""Operator 9, quality rules: repeated substrings found with a suffix array over words.

Each text is a string of words. Texts in which ``min_repeat`` successive words come twice get a suffix array by prefix
doubling; neighbours' longest common prefixes give the LCP intervals, whose maximal repeats are marked, united, and
limited by the covered fraction of the words and by the longest repeat. Texts never meet each other, so the operator is
one pass without a shuffle.

Null and empty texts have no words and fail the word-count rule. A text of any length is handled whole. Repeated rows
give repeated results. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as tk

#: Shortest repeat in words; largest fraction of words in repeats; longest repeat in words.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.4, 150
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _seen_again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and for each place of it whether its key equals the one before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    held = keys[order]
    same[1:] = held[1:] == held[:-1]
    return order, same


def suffix_array(hashes: np.ndarray, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of the rows in which a string of ``depth`` words repeats, and each one's LCP with the next."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none
    valid = np.flatnonzero(row[: n - depth + 1] == row[depth - 1 :])
    keys = tk.window_hashes(hashes, depth)[valid] + tk.mix(row[valid].astype(np.uint64))
    order, same = _seen_again(keys)
    again = same.copy()
    again[:-1] |= same[1:]
    touched = np.unique(row[valid[order[again]]])
    if not len(touched):
        return none, none
    live = np.flatnonzero(np.isin(row, touched))
    m = len(live)
    _, rank = np.unique(hashes[live], return_inverse=True)
    rank = row[live] * (m + 1) + rank
    step = 0
    while True:
        if step:
            tail = np.zeros(m, np.int64)
            inside = row[live[: m - step]] == row[live[step:]] if step < m else np.zeros(0, bool)
            tail[: len(inside)] = np.where(inside, rank[step:] + 1, 0)
            rank = rank * (m + 2) + tail
        order = np.argsort(rank, kind="stable")
        held = rank[order]
        fresh = np.zeros(m, bool)
        fresh[1:] = held[1:] != held[:-1]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh[1:].all() or step > m:
            break
        step = max(1, 2 * step)
    live = live[order]
    rolling = tk.Rolling(hashes)
    ends = np.searchsorted(row, row[live], "right")
    low, high = np.zeros(len(live) - 1, np.int64), np.minimum(ends[:-1] - live[:-1], ends[1:] - live[1:])
    high = np.where(row[live[1:]] == row[live[:-1]], high, 0)
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = rolling.ranges(live[:-1], live[:-1] + np.minimum(middle, n - live[:-1])) == rolling.ranges(live[1:], live[1:] + np.minimum(middle, n - live[1:]))
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return live, low


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of the rows of one slice."""
    rows = len(offsets) - 1
    starts, ends, bounds = tk.words(data, offsets)
    n_words = np.diff(bounds)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    inside = tk.SPACED[data] & ((data & 0xC0) != 0x80)
    hashes = tk.word_hashes(data, starts, ends)
    row = tk.row_of(bounds)

    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets[:-1]] = True
    breaks[1:][data == 0x0A] = True
    breaks[len(data)] = False
    line_at = np.flatnonzero(breaks)
    line_to = np.append(line_at[1:], len(data)) if len(line_at) else line_at
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=held[1:])
    with_word = held[line_to] > held[line_at]
    line_at, line_to = line_at[with_word], line_to[with_word]
    line_to = line_to - (data[line_to - 1] == 0x0A)
    line_row = np.searchsorted(offsets, line_at, "right") - 1
    line_key = tk.run_hashes(data, line_at, line_to) + tk.mix(line_row.astype(np.uint64))
    order, same = _seen_again(line_key)
    n_dup_lines = np.bincount(line_row[order[same]], minlength=rows)

    repeat = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        whole = np.flatnonzero(row[:-2] == row[2:])
        order, same = _seen_again(tk.window_hashes(hashes, 3)[whole] + tk.mix(row[whole].astype(np.uint64)))
        same[:-1] |= same[1:]
        found = whole[order[same]]
        for k in range(3):
            repeat[found + k] = True
    n_repeat_words = np.bincount(row[repeat], minlength=rows)

    live, lcp = suffix_array(hashes, row, min_repeat)
    longest = np.zeros(rows, np.int64)
    cover = np.zeros(len(hashes) + 1, np.int64)
    if len(live):
        reach = np.zeros(len(live), np.int64)
        reach[:-1] = lcp
        reach[1:] = np.maximum(reach[1:], lcp)
        live, reach = live[reach >= min_repeat], reach[reach >= min_repeat]
        np.maximum.at(longest, row[live], reach)
        np.add.at(cover, live, 1)
        np.add.at(cover, live + reach, -1)
    covered = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows) if len(hashes) else np.zeros(rows, np.int64)
    return {"n_words": n_words, "word_chars": per_row(inside), "n_symbols": per_row(_SYMBOL[data]), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "covered": covered, "longest_repeat": longest}


def _verdict(m: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the base rules fail, whether the row is kept, and the covered fraction."""
    n = m["n_words"]
    failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    fraction = m["covered"] / np.maximum(n, 1)
    return failed, ~failed & (fraction <= max_covered) & (m["longest_repeat"] <= max_longest), fraction


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row of counts and the verdict for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.slices(batch):
                m = measure(data, offsets, min_repeat)
                failed, kept, fraction = _verdict(m, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(fraction), pa.array(m["longest_repeat"])],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_fraction", "longest_repeat"],
                )

    tk.batch_conf(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def quality_filter(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.slices(batch):
                yield part.filter(pa.array(_verdict(measure(data, offsets, min_repeat), max_covered, max_longest)[1]))

    tk.batch_conf(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
