"""Hash-compared suffix sort: a vectorised bottom-up mergesort whose comparisons find the common extension of two
suffixes by binary search over prefix polynomial hashes, and so cost the logarithm of the compared length."""

from __future__ import annotations

import numpy as np

from . import tokens as tk


class SuffixSorter:
    """Sorts suffixes of one byte array."""

    def __init__(self, data: np.ndarray, longest: int = 1 << 62):
        """``longest``: the most bytes that are compared. Below 1,024 no structure makes strings collide modulo 2**64."""
        self.data = data
        self.rolling = tk.Rolling.of_bytes(data) if longest >= 1024 else None
        if self.rolling is None:
            self.prefix, self.inverse = tk.prefix_hash(data), tk.powers(len(data) + 1, True)

    def _hash(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self.rolling is None:
            return (self.prefix[at + length] - self.prefix[at]) * self.inverse[at]
        return self.rolling.ranges(at, at + length)

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to ``most`` bytes, which both must have."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) // 2
            equal = self._hash(a, middle) == self._hash(b, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, np.maximum(low, middle - 1))
        return low

    def _before(self, a: np.ndarray, b: np.ndarray, most: int, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a sorts before that at b; equal ones count as ``ties``."""
        lcp = self.common(a, b, most)
        same = lcp == most
        step = np.where(same, 0, lcp)
        return np.where(same, ties, self.data[a + step] < self.data[b + step])

    def sort(self, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
        """The order that sorts suffixes by group, and within it by their first ``most`` bytes."""
        order = np.argsort(group, kind="stable")
        held = group[order]
        n = len(order)
        edge = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(edge, n))
        begin, size = np.repeat(edge, sizes), np.repeat(sizes, sizes)
        width = 1
        while n and width < sizes.max():
            place = np.arange(n)
            live = place[size > width]
            inside = live - begin[live]
            run = inside // width
            left = run % 2 == 0
            other = begin[live] + np.where(left, run + 1, run - 1) * width
            stop = np.minimum(other + width, begin[live] + size[live])
            stop = np.maximum(stop, other)
            low, high = other.copy(), stop.copy()
            low, high = np.minimum(low, n), np.minimum(high, n)
            first = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                mine, theirs = at[order[live[open_]]], at[order[middle]]
                # from the left run equal elements of the right stay behind, from the right run those of the left go first
                ahead = self._before(theirs, mine, most, ~left[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            pair = begin[live] + (run // 2) * 2 * width
            target = pair + (inside % width) + (low - first)
            merged = order.copy()
            merged[target] = order[live]
            order = merged
            width *= 2
        return order

    def repeated(self, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
        """Which suffixes share their first ``length`` bytes with another suffix of their group."""
        out = np.zeros(len(at), bool)
        if len(at) < 2:
            return out
        order = self.sort(at, group, length)
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(group[a] == group[b])
        a, b = a[near], b[near]
        same = self.common(at[a], at[b], length) == length
        a, b = a[same], b[same]
        true = self._verified(at[a], at[b], length)
        if not true.all():  # a collision of hashes: compare the bytes themselves
            return self._by_bytes(at, group, length)
        out[a] = out[b] = True
        return out

    def _verified(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        out = np.ones(len(a), bool)
        step = max(1, (4 << 20) // length)
        span = np.arange(length)
        for k in range(0, len(a), step):
            out[k : k + step] = (self.data[a[k : k + step, None] + span] == self.data[b[k : k + step, None] + span]).all(1)
        return out

    def _by_bytes(self, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
        seen: dict[tuple, list[int]] = {}
        held = self.data.tobytes()
        for k, (p, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)):
            seen.setdefault((g, held[p : p + length]), []).append(k)
        out = np.zeros(len(at), bool)
        for places in seen.values():
            if len(places) > 1:
                out[places] = True
        return out
