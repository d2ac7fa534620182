"""Anchors of all fixed-length windows of bytes or of words of a text, for operator 10."""

from __future__ import annotations

import hashlib

import numpy as np

from . import tokens as tk

_U = np.uint64
#: Bytes of the grams whose smallest hash anchors a window; window starts handled at once.
GRAM, CHUNK = 64, 1 << 19
#: Words of the grams that anchor a window of words.
GRAM_WORDS = 8
_PLACE = _U((1 << 24) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows with a common anchor: row, first window start in its row, number of windows, anchor's place in
    the run's segment, hash of the anchor's gram, and 128-bit digest of the segment (all bytes of the run's windows, and
    the anchor's place in them) as two numbers."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "first", "count", "place", "gram", "segment")}
    held = data.tobytes()
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        piece = data[base : base + CHUNK + length - 1]
        prefix = tk.prefix_hash(piece)
        at = np.arange(len(piece) - GRAM + 1)
        gram = tk.mix(tk.range_hash(prefix, at, at + GRAM))
        best = sliding_min((gram & ~_PLACE) | at.astype(np.uint64), length - GRAM + 1)
        owner = (best & _PLACE).astype(np.int64)
        start = np.arange(len(owner))
        inside = np.clip(offsets, base, base + len(owner))
        valid = start + base <= np.repeat(offsets[1:] - length, np.diff(inside))
        start, owner = start[valid], owner[valid]
        if not len(start):
            continue
        row = np.searchsorted(offsets, start + base, "right") - 1
        fresh = np.ones(len(start), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(fresh)
        count = np.diff(np.append(head, len(start)))
        first, anchor, row = start[head], owner[head], row[head]
        end = first + count - 1 + length
        out["row"].append(row)
        out["first"].append(first + base - offsets[row])
        out["count"].append(count)
        out["place"].append(anchor - first)
        out["gram"].append(gram[anchor])
        out["segment"].append(digests(held, first + base, end + base, anchor - first))
    return {k: np.concatenate(v) if v else np.zeros((0, 2) if k == "segment" else 0, np.uint64 if k == "gram" else np.int64) for k, v in out.items()}


def passages(data: np.ndarray, offsets: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The same for windows of ``size`` words, anchored at their gram of GRAM_WORDS words of smallest hash: also the first
    word's place in its row, and the byte range of the run's segment in its row."""
    starts, ends, bounds = tk.words(data, offsets)
    hashes = tk.word_hashes(data, starts, ends)
    row_of = tk.row_of(bounds)
    held, grams = hashes.tobytes(), tk.window_hashes(hashes, GRAM_WORDS)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "word", "first", "stop", "count", "place", "gram", "segment")}
    for base in range(0, max(0, len(hashes) - size + 1), CHUNK):
        gram = grams[base : base + CHUNK + size - GRAM_WORDS]
        best = sliding_min((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), size - GRAM_WORDS + 1)
        start = np.arange(len(best))
        start = start[row_of[start + base] == row_of[start + base + size - 1]]
        if not len(start):
            continue
        owner, row = (best[start] & _PLACE).astype(np.int64), row_of[start + base]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(fresh)
        count = np.diff(np.append(head, len(start)))
        first, anchor, row = start[head] + base, owner[head] + base, row[head]
        last = first + count - 2 + size
        out["row"].append(row)
        out["word"].append(first - bounds[row])
        out["first"].append(starts[first] - offsets[row])
        out["stop"].append(ends[last] - offsets[row])
        out["count"].append(count)
        out["place"].append(anchor - first)
        out["gram"].append(tk.mix(grams[anchor] + _U(1)))
        out["segment"].append(digests(held, 8 * first, 8 * (last + 1), anchor - first))
    return {k: np.concatenate(v) if v else np.zeros((0, 2) if k == "segment" else 0, np.uint64 if k == "gram" else np.int64) for k, v in out.items()}


def digests(held: bytes, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
    """128-bit digest of each byte range together with a number; equal digests stand for equal bytes."""
    out = bytearray(16 * len(starts))
    view = memoryview(held)
    for k, (a, z, p) in enumerate(zip(starts.tolist(), ends.tolist(), place.tolist(), strict=True)):
        out[16 * k : 16 * k + 16] = hashlib.blake2b(view[a:z], digest_size=16, salt=p.to_bytes(8, "little", signed=True)).digest()
    return np.frombuffer(bytes(out), np.int64).reshape(-1, 2)
