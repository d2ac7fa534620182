"""Operator 5, chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a role or a text every byte ``<``, ``[`` and ``\\`` gets a
backslash before it, and inside a role the line feed too, so that no control string of this or of other common
templates survives and the escape can be undone exactly. For each Arrow batch the segment lengths, their cumulative
offsets and the scatter indices are computed in numpy, and headers and contents are copied into one preallocated
buffer, which becomes the Arrow column.

The turns of a conversation are ordered by (turn, role, text), nulls first; null roles and texts are empty, a null
conv_id is a conversation of its own. Repeated rows are repeated turns. Empty tables give empty results. Other columns
are not read. A conversation of any size streams through its task batch by batch; nothing gathers it in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens as tk

# The template.
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
ESCAPE = 0x5C

_TEXT_MARKS = np.zeros(256, bool)
_TEXT_MARKS[[0x3C, 0x5B, ESCAPE]] = True
_ROLE_MARKS = _TEXT_MARKS.copy()
_ROLE_MARKS[0x0A] = True

FORMATTED = "conv_id long, turn long, formatted string, loss_start int, loss_end int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put a backslash before each marked byte."""
    marked = marks[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marked, out=before[1:])
    out = np.full(len(data) + before[-1], ESCAPE, np.uint8)
    out[np.arange(len(data)) + before[1:]] = data
    return out, offsets + before[offsets]


def escapes(data: np.ndarray) -> np.ndarray:
    """Which bytes are escapes: in a run of backslashes the first, third and so on."""
    is_escape = data == ESCAPE
    place = np.arange(len(data))
    start = np.where(is_escape, -1, place)
    run = place - np.maximum.accumulate(start) if len(data) else place
    return is_escape & (run % 2 == 1)


def assemble(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copy parts, each a constant or (data, offsets) by row, side by side into one buffer; also gives each part's start."""
    rows = next(len(p[1]) - 1 for p in parts if not isinstance(p, bytes))
    lengths = np.empty((rows, len(parts)), np.int64)
    for k, p in enumerate(parts):
        lengths[:, k] = len(p) if isinstance(p, bytes) else np.diff(p[1])
    begin = np.zeros(rows * len(parts) + 1, np.int64)
    np.cumsum(lengths.ravel(), out=begin[1:])
    at = begin[:-1].reshape(rows, len(parts))
    out = np.empty(begin[-1], np.uint8)
    for k, p in enumerate(parts):
        if isinstance(p, bytes):
            out[(at[:, k, None] + np.arange(len(p))).ravel()] = np.tile(np.frombuffer(p, np.uint8), rows)
        else:
            data, offsets = p
            out[np.arange(len(data)) + np.repeat(at[:, k] - offsets[:-1], np.diff(offsets))] = data
    return out, np.append(at[:, 0], begin[-1]), at


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _format_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    role_data, role_offsets = tk.text_bytes(batch.column(2))
    trained = np.array([r == "assistant" for r in batch.column(2).to_pylist()], bool)
    text = escape(*tk.text_bytes(batch.column(3)), _TEXT_MARKS)
    out, offsets, at = assemble([START, escape(role_data, role_offsets, _ROLE_MARKS), MIDDLE, text, END])
    loss = [pa.array(x.astype(np.int32), mask=~trained) for x in (at[:, 3] - at[:, 0], at[:, 4] - at[:, 0])]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _strings(out, offsets), *loss], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One formatted row per turn, in order within its conversation and partition.

    loss_start and loss_end bound the bytes of an assistant text in ``formatted``, and are null for other roles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in tk.slices(batch):
                yield _format_batch(part)

    tk.batch_conf(turns.sparkSession)
    ordered = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple, tuple, np.ndarray]:
    """Roles and texts, unescaped as (data, offsets), of formatted turns; and which bytes of the turns are kept."""
    skipped = escapes(data)
    literal = np.zeros(len(data), bool)
    literal[1:] = skipped[:-1]
    opens = np.flatnonzero((data == START[0]) & ~literal & ~skipped)
    opens = opens.reshape(-1, 2)
    breaks = np.flatnonzero((data == MIDDLE[0]) & ~literal)
    role_from = opens[:, 0] + len(START)
    role_to = breaks[np.searchsorted(breaks, role_from)]
    text_from, text_to = role_to + 1, opens[:, 1]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~skipped, out=before[1:])
    plain = data[~skipped]
    return (plain, before[role_from], before[role_to]), (plain, before[text_from], before[text_to]), before


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the output of format_conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            data, offsets = tk.text_bytes(batch.column(2))
            if not batch.num_rows:
                continue
            (plain, role_from, role_to), (_, text_from, text_to), before = parse(data, offsets)
            held = plain.tobytes()
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            chars = np.diff(points[offsets]).tolist()
            plain_points = np.zeros(len(plain) + 1, np.int64)
            np.cumsum((plain & 0xC0) != 0x80, out=plain_points[1:])
            loss_start = batch.column(3).to_pylist()
            loss_end = batch.column(4).to_pylist()
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(b"%b\n%b\n" % (held[role_from[k] : role_to[k]], held[text_from[k] : text_to[k]]))
                if loss_start[k] is not None:
                    a, b = before[offsets[k] + loss_start[k]], before[offsets[k] + loss_end[k]]
                    state[3] += int(plain_points[b] - plain_points[a])
                    state[4].update(held[a:b])
                state[5] += chars[k]
            if len(done) >= 1000:
                yield _digests(done)
                done = []
        if state is not None:
            yield _digests([*done, state])

    return formatted.mapInArrow(run, DIGEST)


def _digests(states: list) -> pa.RecordBatch:
    rows = [(c, n, t.hexdigest(), lc, ls.hexdigest(), f) for c, n, t, lc, ls, f in states]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose two texts hold control strings of a common template."""
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
