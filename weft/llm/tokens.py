"""Vectorised tokenisation of Arrow text columns: word boundaries and hashes without a Python loop per word.

Null texts count as empty. Words and lines have multilinear hashes: each byte is multiplied by a random number of its
place, so that no structure of the text makes two of them equal. Where the hashes of all substrings are needed, ``Rolling``
has two polynomials with independent bases modulo 2**31 - 1. ``prefix_hash``, modulo 2**64, is faster and only finds
candidates: strings such as Thue-Morse words collide in it, so its equalities decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most bytes of text that are handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MIX_A, _MIX_B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_tables: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words separated by the six ASCII white-space characters.
SPACED = ~SPACE
#: Words of ASCII letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> _U(30))) * _MIX_A
    x = (x ^ (x >> _U(27))) * _MIX_B
    return x ^ (x >> _U(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base or of its inverse, modulo 2**64."""
    name = "inverse" if inverse else "base"
    have = _tables.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, np.uint64)
        out[0] = 1
        _tables[name] = have = np.multiply.accumulate(out)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of at most ``most`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the n + 1 bounds of each row's words. No word crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Cumulative polynomial hash; range_hash turns it into the hash of any range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, independent of where it stands."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts]


def _places(n: int) -> np.ndarray:
    """Random odd multipliers of the first n places of a run."""
    have = _tables.get("places")
    if have is None or len(have) < n:
        _tables["places"] = have = mix(np.arange(max(n, 1 << 16), dtype=np.uint64) + _U(_BASE)) | _U(1)
    return have[:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each byte range that is not empty; ranges must not overlap much, all their bytes are read."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    total = np.cumsum(length)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # about SLICE_BYTES at a time, or one range
        before = total[at] - length[at]
        to = max(at + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right")))
        some, head = length[at:to], total[at:to] - length[at:to] - before
        place = np.arange(int(some.sum())) - np.repeat(head, some)
        value = _BYTE_CODES[data[place + np.repeat(starts[at:to], some)]] * _places(int(some.max()))[place]
        out[at:to] = np.add.reduceat(value, head)
        at = to
    return mix(out + length.astype(np.uint64))


#: The name by which words are hashed.
word_hashes = run_hashes

_PRIME = _U((1 << 31) - 1)
_ROLLING_BASES = (1298374651, 1874520397)


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues modulo 2**31 - 1 of numbers below 2**63."""
    x = (x & _PRIME) + (x >> _U(31))
    x = (x & _PRIME) + (x >> _U(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _prime_powers(which: int, n: int, inverse: bool) -> np.ndarray:
    """The first n powers of a rolling base, or of its inverse, modulo 2**31 - 1."""
    name = f"prime{which}{inverse}"
    have = _tables.get(name)
    if have is None or len(have) < n:
        base = pow(_ROLLING_BASES[which], -1, int(_PRIME)) if inverse else _ROLLING_BASES[which]
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, _mod(have * _U(pow(base, len(have), int(_PRIME))))])
        _tables[name] = have
    return have[:n]


class Rolling:
    """Hashes of all ranges of a sequence: two polynomials modulo 2**31 - 1, side by side in 62 bits."""

    def __init__(self, values: np.ndarray):
        """``values``: 64-bit numbers that stand for the items, random enough in all their bits."""
        self.sums = []
        for which, shift in enumerate((0, 32)):
            out = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(_mod(_mod(values >> _U(shift) & _U((1 << 32) - 1)) * _prime_powers(which, len(values), False)), out=out[1:])
            self.sums.append(_mod(out))
        self.inverse = [_prime_powers(which, len(values) + 1, True) for which in (0, 1)]

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Rolling:
        """Hashes of all byte ranges."""
        return cls(_BYTE_CODES[data])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each range, independent of where it stands; compare ranges of one length only."""
        low, high = (_mod((held[ends] + _PRIME - held[starts]) * inverse[starts]) for held, inverse in zip(self.sums, self.inverse, strict=True))
        return (high << _U(31)) | low


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of each window of ``size`` successive word hashes; windows may cross rows."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(powers(size + 1)[1:]):
        out += hashes[k : k + n] * factor
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of every item, from the bounds of the rows."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def batch_conf(spark, rows: int = 2000, size: str = "8m") -> None:
    """Keep the Arrow batches that reach Python small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
