"""Density clustering, linkage of leaf centers, and optimal matching of clusters.

``hdbscan`` holds all pairs of at most MAX_ROWS rows in memory. ``spanning_tree`` builds the same tree for any number of rows
in tasks: pairs are compared in blocks and never held. The compared vectors, NEAR neighbours of each row and the tree (one
edge a row) are on the driver; the work grows with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

MAX_ROWS = 5000
#: Neighbours kept for each row of a spanning tree, rows of a task's block and columns compared at a time.
NEAR, BLOCK, STRIPE = 16, 512, 2048


def mutual_reachability_tree(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges (a, b, distance) of a minimum spanning tree of mutual reachability, by Prim's algorithm, in order."""
    n = len(x)
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    core = np.sort(d, 1)[:, min(min_samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, best, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    inside[0] = True
    for _ in range(n - 1):
        closer = (reach[at] < best) & ~inside
        best[closer], parent[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((parent[at], at, best[at]))
        inside[at] = True
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1])), float).reshape(-1, 3)


def _wide(x: np.ndarray, base: bool) -> np.ndarray:
    """Rows whose products with those of the other kind are squared distances."""
    square, one = (x * x).sum(1)[:, None], np.ones((len(x), 1))
    return np.hstack([-2 * x, one, square]) if base else np.hstack([x, square, one])


def _nearest(wide: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and numbers of the k nearest other rows, in order."""
    mine = _wide(x[rows], False)
    best_d, best_i = np.zeros((len(rows), 0)), np.zeros((len(rows), 0), np.int64)
    for a in range(0, len(wide), STRIPE):
        d = mine @ wide[a : a + STRIPE].T
        inside = np.flatnonzero((rows >= a) & (rows < a + d.shape[1]))
        d[inside, rows[inside] - a] = np.inf
        i = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        d, i = np.hstack([best_d, np.take_along_axis(d, i, 1)]), np.hstack([best_i, i + a])
        order = np.lexsort((i, d), axis=1)[:, :k]
        best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    return np.maximum(best_d, 0), best_i


def _outside(wide: np.ndarray, rows: np.ndarray, x: np.ndarray, core: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared mutual reachability and number of the nearest row of another part."""
    mine, own = _wide(x[rows], False), part[rows]
    best_d, best_i = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
    for a in range(0, len(wide), STRIPE):
        d = mine @ wide[a : a + STRIPE].T
        np.maximum(d, core[a : a + STRIPE], out=d)
        d[own[:, None] == part[a : a + STRIPE]] = np.inf
        at = d.argmin(1)
        found = d[np.arange(len(rows)), at]
        closer = found < best_d
        best_d[closer], best_i[closer] = found[closer], at[closer] + a
    return np.maximum(best_d, core[rows]), best_i


def _in_tasks(spark: SparkSession, rows: np.ndarray, work, sent) -> tuple[np.ndarray, np.ndarray]:
    """``work`` (distances, numbers) on blocks of rows, in tasks, put together in the sequence of ``rows``."""
    blocks = -(-len(rows) // BLOCK)
    picked = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        wide = _wide(held[0], True)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                d, i = work(wide, picked.value[b * BLOCK : (b + 1) * BLOCK], *held)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([d.astype(float).tobytes()]), pa.array([i.astype(np.int64).tobytes()])], ["block", "d", "i"])

    tasks = min(blocks, 4 * spark.sparkContext.defaultParallelism)
    out = spark.range(0, blocks, 1, tasks).mapInArrow(run, "block long, d binary, i binary").collect()
    out.sort(key=lambda r: r["block"])
    picked.destroy()
    return np.frombuffer(b"".join(r["d"] for r in out)), np.frombuffer(b"".join(r["i"] for r in out), np.int64)


def spanning_tree(spark: SparkSession, x: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges as of mutual_reachability_tree, by Boruvka's algorithm: each round joins every part but the largest to its nearest other.

    A row's kept neighbours settle its nearest outside row while that is no farther than the last of them. Only rows that could
    still improve on what their part has are compared with all rows.
    """
    n = len(x)
    k = min(max(NEAR, min_samples), n - 1)
    sent = spark.sparkContext.broadcast((x, k))
    d, near = (v.reshape(n, k) for v in _in_tasks(spark, np.arange(n), lambda wide, rows, x, k: _nearest(wide, rows, x, k), sent))
    sent.destroy()
    core = d[:, min(min_samples, n - 1) - 1].copy()
    bound = d[:, -1].copy()  # no row beyond the kept ones is nearer
    reach = np.maximum(np.maximum(d, core[:, None]), core[near])
    part, edges, every = np.arange(n), [], np.arange(n)
    while len(edges) < n - 1:
        open_ = np.where(part[near] != part[:, None], reach, np.inf)
        at = open_.argmin(1)
        least, to = open_[every, at], near[every, at]
        best = np.full(n, np.inf)
        np.minimum.at(best, part, least)
        largest = np.bincount(part).argmax()
        rows = np.flatnonzero((bound < best[part]) & (part != largest))
        if len(rows):
            sent = spark.sparkContext.broadcast((x, core, part))
            least[rows], to[rows] = _in_tasks(spark, rows, _outside, sent)
            sent.destroy()
            bound[rows] = least[rows]
        order = np.lexsort((np.maximum(every, to), np.minimum(every, to), least))
        order = order[part[order] != largest]
        _, first = np.unique(part[order], return_index=True)
        root = np.arange(n)

        def find(a: int, root=root) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for i in order[np.sort(first)].tolist():  # by distance, so that equal ones close no circle
            a, b = find(part[i]), find(part[to[i]])
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((i, int(to[i]), float(np.sqrt(least[i]))))
        while (root != root[root]).any():
            root = root[root]
        part = root[part]
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1])), float).reshape(-1, 3)


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None, method: str = "eom", spark: SparkSession | None = None) -> np.ndarray:
    """Labels (-1: noise) by excess of mass or by leaves; with a session the tree is built in tasks, over any number of rows."""
    n = len(x)
    if n > MAX_ROWS and spark is None:
        raise ValueError(f"{n} rows, at most {MAX_ROWS} without a session")
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    edges = spanning_tree(spark, x, min_samples or min_cluster_size) if spark else mutual_reachability_tree(x, min_samples or min_cluster_size)
    # single linkage: node n + i joins two nodes at edges[i]
    top, left, right, size = list(range(n)), {}, {}, {i: 1 for i in range(n)}
    root_of = list(range(n))

    def find(a: int) -> int:
        while root_of[a] != a:
            root_of[a] = root_of[root_of[a]]
            a = root_of[a]
        return a

    for i, (a, b, _) in enumerate(edges):
        ra, rb, node = find(int(a)), find(int(b)), n + i
        left[node], right[node] = top[ra], top[rb]
        size[node] = size[top[ra]] + size[top[rb]]
        root_of[rb] = ra
        top[ra] = node
    height = {n + i: edges[i, 2] for i in range(len(edges))}

    def members(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += [left[v], right[v]]
        return out

    # condense: a cluster lives until it splits into two of at least the least size
    clusters, todo = [], [(n + len(edges) - 1, 0.0, -1)]
    while todo:
        node, birth, parent = todo.pop()
        index = len(clusters)
        c = {"parent": parent, "birth": birth, "points": [], "children": []}
        clusters.append(c)
        if parent >= 0:
            clusters[parent]["children"].append(index)
        while node >= n:
            level = 1 / max(height[node], 1e-12)
            a, b = left[node], right[node]
            if size[a] >= min_cluster_size and size[b] >= min_cluster_size:
                c["points"] += [(p, level) for p in members(node)]
                todo += [(b, level, index), (a, level, index)]
                break
            big, small = (a, b) if size[a] >= size[b] else (b, a)
            c["points"] += [(p, level) for p in members(small)]
            if size[big] < min_cluster_size:
                c["points"] += [(p, level) for p in members(big)]
                break
            node = big
    mass = [sum(level - c["birth"] for _, level in c["points"]) for c in clusters]
    chosen = [False] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        kids = clusters[i]["children"]
        inner = sum(mass[k] for k in kids)
        if not kids:
            chosen[i] = i > 0
        elif method == "eom" and i > 0 and mass[i] >= inner:
            chosen[i] = True
            stack = list(kids)
            while stack:
                k = stack.pop()
                chosen[k] = False
                stack += clusters[k]["children"]
        else:
            mass[i] = inner
    labels, number = np.full(n, -1), 0
    for i, keep in enumerate(chosen):
        if keep:
            stack, points = [i], []
            while stack:
                k = stack.pop()
                points += [p for p, _ in clusters[k]["points"]]
                stack += clusters[k]["children"]
            labels[points] = number
            number += 1
    order = {old: new for new, old in enumerate(dict.fromkeys(labels[labels >= 0].tolist()))}
    return np.array([order.get(v, -1) for v in labels.tolist()])


@dataclass
class Merge:
    """One step of a dendrogram."""

    node: int
    left: int
    right: int
    distance: float
    mass: float
    leaves: list[int]


def soft_centers(x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit centers of soft clusters and their masses."""
    from .fcm import unit_rows

    mass = u.sum(0)
    return unit_rows(u.T @ x / np.maximum(mass, 1e-12)[:, None]), mass


def linkage(centers: np.ndarray, mass: np.ndarray) -> list[Merge]:
    """Weighted average linkage by cosine distance; equal distances merge the smaller node numbers first."""
    k = len(centers)
    far = 1 - np.clip(centers @ centers.T, -1, 1)
    d = {(i, j): float(far[i, j]) for i in range(k) for j in range(i + 1, k)}
    weight, leaves, live, steps = {i: float(mass[i]) for i in range(k)}, {i: [i] for i in range(k)}, set(range(k)), []
    while len(live) > 1:
        (a, b), distance = min(((p, v) for p, v in d.items() if p[0] in live and p[1] in live), key=lambda e: (e[1], e[0]))
        new = k + len(steps)
        total = weight[a] + weight[b]
        for c in live - {a, b}:
            ac, bc = d[min(a, c), max(a, c)], d[min(b, c), max(b, c)]
            d[c, new] = (weight[a] * ac + weight[b] * bc) / total if total > 0 else (ac + bc) / 2
        live = (live - {a, b}) | {new}
        weight[new], leaves[new] = total, sorted(leaves[a] + leaves[b])
        steps.append(Merge(new, a, b, distance, total, leaves[new]))
    return steps


def cut(steps: list[Merge], leaves: int, groups: int) -> list[int]:
    """Group of each leaf after cutting to exactly ``groups``; groups are numbered by their smallest leaf."""
    held = {i: [i] for i in range(leaves)}
    for s in steps[: leaves - groups]:
        held[s.node] = s.leaves
        del held[s.left], held[s.right]
    out = [0] * leaves
    for number, members in enumerate(sorted(held.values(), key=min)):
        for leaf in members:
            out[leaf] = number
    return out


def lift(labels: np.ndarray, mapping: list[int]) -> np.ndarray:
    """Leaf labels as groups, noise kept."""
    return np.where(labels >= 0, np.array(mapping)[np.maximum(labels, 0)], -1)


def match(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in match(cost.T))
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j, least, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = cost[p[j] - 1] - u[p[j]] - v[1:]
            better = ~used[1:] & (row < least[1:])
            least[1:][better], way[1:][better] = row[better], j
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            u[p[used]] += step
            v[used] -= step
            least[1:][~used[1:]] -= step
            j = nxt
            if p[j] == 0:
                break
        while j:
            p[j] = p[way[j]]
            j = way[j]
    return sorted((int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j])
