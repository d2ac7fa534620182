"""Training of fuzzy C-means: many fits at once as lanes of the same pass, selection of K and of the fuzzifier, hierarchies.

A lane is one fit: a node of the hierarchy, a K, a seed and a fuzzifier. Memberships follow from the centers, so a pass over the
documents takes all lanes one iteration further and returns K sums for each lane and partition; the number of jobs is that
of the iterations, whatever the number of fits. The model (centers of all lanes) is on the driver, documents are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fcm, selection

#: Rows from which starting centers are drawn; a bound on what reaches the driver.
SEED_ROWS = 4096
#: Rows times width up to which a fit runs in one task on a copy of the rows.
LOCAL_CELLS = 4_000_000
MIN_SEPARATION = 1e-3


#: Rows of terms that reach the driver for each lane; with more partitions, they are added up in the cluster first.
ADD_PARTITIONS = 16


@dataclass
class Lane:
    """One fit and its state."""

    node: int
    k: int
    seed: int
    m: float
    centers: np.ndarray | None = None
    previous: np.ndarray | None = None
    objective: float = float("inf")
    iterations: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pc: float = 0.0
    proxy: float = 0.0
    rows: int = 0
    done: bool = False
    geometry: str = "spherical"

    @property
    def space(self) -> fcm.Spherical:
        return fcm.GEOMETRIES[self.geometry]

    @property
    def separation(self) -> float:
        if self.geometry == "spherical":
            d = ((self.centers[:, None] - self.centers[None]) ** 2).sum(2)
        else:
            d = self.space.distances(self.centers, self.centers)
        return float(np.sqrt(d[~np.eye(self.k, dtype=bool)].min())) if self.k > 1 else 0.0

    def valid(self, min_size: int) -> bool:
        return bool(len(self.sizes) == self.k and self.sizes.min() >= min_size and self.separation >= MIN_SEPARATION)


def seed_rows(docs: DataFrame, most: int = SEED_ROWS) -> dict[int, np.ndarray]:
    """Up to ``most`` rows of every node, those with the smallest hash of their id."""
    from pyspark.sql import Window

    # a hash limit keeps all but a few more than ``most`` rows of a node where they are; it is widened until enough pass
    held = docs.withColumn("__h", F.xxhash64("id"))
    sizes = {r["node"]: r["n"] for r in docs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {node: min(1.0, (most + 6 * most**0.5 + 20) / n) for node, n in sizes.items()}
    while True:
        limits = [(node, -(1 << 63) + int(part * ((1 << 64) - 1))) for node, part in share.items()]
        limit = F.coalesce(*[F.when(F.col("node") == node, F.lit(at)) for node, at in limits if at < (1 << 63) - 1], F.lit((1 << 63) - 1))
        few = held.where(F.col("__h") <= limit)
        got = {r["node"]: r["n"] for r in few.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()} if min(share.values(), default=1) < 1 else sizes
        short = [node for node, n in sizes.items() if got.get(node, 0) < min(n, most)]
        if not short:
            break
        share |= {node: min(1.0, 2 * share[node]) for node in short}
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy("node").orderBy("__h", "id"))).where(F.col("__r") <= most).select("node", "x").toArrow()
    node = ranked.column(0).to_numpy()
    x = fcm.matrix(ranked.column(1))
    return {int(n): x[node == n] for n in np.unique(node)}


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, space: fcm.Spherical = fcm.GEOMETRIES["spherical"]) -> np.ndarray:
    """k starting centers by squared-distance sampling among prepared rows."""
    chosen = [int(rng.integers(len(x)))]
    d = space.distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        total = d.sum()
        pick = int(rng.choice(len(x), p=d / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(pick)
        d = np.minimum(d, space.distances(x, x[[pick]])[:, 0])
    return x[chosen].copy()


def _terms(x: np.ndarray, v: np.ndarray, before: np.ndarray | None, m: float, final: bool, space: fcm.Spherical) -> list[np.ndarray]:
    """Weighted sums, weights, (objective, rows, largest change, squared memberships, proxy terms) and sizes of a lane on rows x."""
    d2 = space.distances(x, v)
    u = fcm.memberships(d2, m)
    w = u**m
    stats, sizes = np.zeros(6), np.zeros(len(v))
    stats[0], stats[1] = (w * d2).sum(), len(x)
    if before is not None:
        stats[2] = np.abs(u - fcm.memberships(space.distances(x, before), m)).max()
    if final:
        label = u.argmax(1)
        sizes = np.bincount(label, minlength=len(v)).astype(float)
        stats[3] = (u * u).sum()
        if len(v) > 1:
            d = np.sqrt(d2)
            own = d[np.arange(len(x)), label]
            d[np.arange(len(x)), label] = np.inf
            other = d.min(1)
            top = np.sort(u, 1)
            gap = np.maximum(top[:, -1] - top[:, -2], 1e-12)
            stats[4] = ((other - own) / np.maximum(np.maximum(own, other), 1e-12) * gap).sum()
            stats[5] = gap.sum()
    return [w.T @ x, w.sum(0), stats, sizes]


def _add(old: list[np.ndarray] | None, new: list[np.ndarray]) -> list[np.ndarray]:
    if old is None:
        return new
    change = max(old[2][2], new[2][2])
    out = [a + b for a, b in zip(old, new, strict=True)]
    out[2][2] = change
    return out


def _advance(lane: Lane, terms: list[np.ndarray], start: np.ndarray, turn: int, tol: float) -> None:
    """New centers of a lane from the terms of a pass."""
    total, weight, stats, _ = terms
    new = lane.space.centers(total.reshape(lane.k, -1), weight)
    empty = weight <= 1e-12
    if lane.geometry == "spherical":
        empty |= np.abs(new).sum(1) == 0
    if empty.any():
        new[empty] = plus_plus(lane.space.prepare(start), int(empty.sum()), np.random.default_rng(lane.seed + turn + 1), lane.space)
    lane.iterations, lane.objective = turn + 1, stats[0] / max(stats[1], 1)
    stable = lane.previous is not None and stats[2] < tol
    lane.previous, lane.centers = lane.centers, new
    # a fit whose centers have met cannot become valid again
    lane.done = stable or (turn >= 5 and lane.k > 1 and lane.separation < MIN_SEPARATION)


def _finish(lane: Lane, terms: list[np.ndarray]) -> None:
    _, _, stats, sizes = terms
    n = max(stats[1], 1)
    lane.objective, lane.rows, lane.sizes, lane.pc = stats[0] / n, int(stats[1]), sizes, stats[3] / n
    lane.proxy = stats[4] / stats[5] if stats[5] else 0.0


def _pass(docs: DataFrame, lanes: list[tuple[int, Lane]], final: bool) -> dict[int, list[np.ndarray]]:
    """The terms of every lane over all documents."""
    sent = [(i, lane.node, lane.centers, lane.previous, lane.m, lane.geometry) for i, lane in lanes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            node, raw = batch.column(0).to_numpy(), fcm.matrix(batch.column(1))
            ready = {g: fcm.GEOMETRIES[g].prepare(raw) for g in {e[5] for e in sent}}
            for i, n, v, before, m, g in sent:
                x = ready[g][node == n]
                if len(x):
                    held[i] = _add(held.get(i), _terms(x, v, before, m, final, fcm.GEOMETRIES[g]))
        rows = [(i, *(a.ravel().tolist() for a in h)) for i, h in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lane", "sums", "weight", "stats", "sizes"])

    terms = "lane long, sums array<double>, weight array<double>, stats array<double>, sizes array<double>"
    found = docs.select("node", "x").mapInArrow(run, terms)
    if docs.rdd.getNumPartitions() > ADD_PARTITIONS:  # rows of K x d numbers are added up in the cluster first
        found = found.groupBy("lane", F.pmod(F.spark_partition_id(), F.lit(ADD_PARTITIONS))).applyInArrow(_add_rows, terms)
    out: dict[int, list[np.ndarray]] = {}
    for r in found.collect():
        out[r["lane"]] = _add(out.get(r["lane"]), [np.array(r[c]) for c in ("sums", "weight", "stats", "sizes")])
    return out


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of terms for all rows of a lane."""
    lane, held = None, None
    for batch in batches:
        for r in batch.to_pylist():
            lane, held = r["lane"], _add(held, [np.array(r[c]) for c in ("sums", "weight", "stats", "sizes")])
    yield pa.RecordBatch.from_arrays([pa.array([lane]), *(pa.array([a.tolist()]) for a in held)], ["lane", "sums", "weight", "stats", "sizes"])


def _fit_small(docs: DataFrame, lanes: list[Lane], starts: dict[int, np.ndarray], max_iter: int, tol: float) -> None:
    """Fit each lane in a task of its own on a copy of all rows, which are bounded by LOCAL_CELLS: one job in all."""
    held = docs.select("node", "x").toArrow()
    node, x = held.column(0).to_numpy(), fcm.matrix(held.column(1))
    sent = docs.sparkSession.sparkContext.broadcast((node, x, starts, lanes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        node, x, starts, lanes = sent.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                lane = lanes[i]
                mine = lane.space.prepare(x[node == lane.node])
                for turn in range(max_iter):
                    if lane.done:
                        break
                    _advance(lane, _terms(mine, lane.centers, lane.previous, lane.m, False, lane.space), starts[lane.node], turn, tol)
                if len(lane.centers) == lane.k:
                    _finish(lane, _terms(mine, lane.centers, None, lane.m, True, lane.space))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(lane)])], ["id", "lane"])

    import pickle

    ids = docs.sparkSession.range(0, len(lanes), 1, min(len(lanes), 64))
    for r in ids.mapInArrow(run, "id long, lane binary").collect():
        lanes[r["id"]].__dict__.update(pickle.loads(bytes(r["lane"])).__dict__)


def fit_lanes(docs: DataFrame, lanes: list[Lane], max_iter: int = 60, tol: float = 1e-4, local_cells: int = LOCAL_CELLS) -> list[Lane]:
    """Fit all lanes over ``docs`` (id, node, x); x need not be normalised.

    Up to ``local_cells`` numbers every lane runs in one task; beyond, all lanes advance together, one job an iteration.
    """
    docs = docs.select("id", "node", "x").persist()
    starts = seed_rows(docs)
    for lane in lanes:
        x = starts.get(lane.node, np.zeros((0, 1)))
        if len(x) < lane.k:
            lane.done, lane.centers = True, lane.space.prepare(x[:1]) if len(x) else np.zeros((1, 1))
        else:
            lane.centers = plus_plus(lane.space.prepare(x), lane.k, np.random.default_rng(lane.seed), lane.space)
    cells = docs.agg(F.sum(F.size("x"))).first()[0] or 0
    if cells <= local_cells:
        _fit_small(docs, lanes, starts, max_iter, tol)
        docs.unpersist()
        return lanes
    for turn in range(max_iter):
        active = [(i, lane) for i, lane in enumerate(lanes) if not lane.done]
        if not active:
            break
        terms = _pass(docs, active, False)
        for i, lane in active:
            _advance(lane, terms[i], starts[lane.node], turn, tol)
    final = [(i, lane) for i, lane in enumerate(lanes) if len(lane.centers) == lane.k]
    for i, terms in (_pass(docs, final, True) if final else {}).items():
        _finish(lanes[i], terms)
    docs.unpersist()
    return lanes


def best_of(lanes: list[Lane], min_size: int) -> Lane | None:
    """The valid attempt of least objective, then largest separation; all attempts compete if none is valid."""
    pool = [x for x in lanes if x.valid(min_size)] or [x for x in lanes if len(x.sizes) == x.k]
    return min(pool, key=lambda x: (x.objective, -x.separation)) if pool else None


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index of two labelings."""
    _, x = np.unique(a, return_inverse=True)
    _, y = np.unique(b, return_inverse=True)
    table = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(table, (x, y), 1)
    return _table_rand(table)


def _table_rand(table: np.ndarray) -> float:
    """Adjusted Rand index from the counts of label pairs."""
    pairs = lambda t: (t * (t - 1) / 2).sum()
    both, mine, theirs, every = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum(keepdims=True))
    expected, highest = mine * theirs / max(every, 1), (mine + theirs) / 2
    return 1.0 if highest == expected else float((both - expected) / (highest - expected))


def stability(docs: DataFrame, groups: list[list[Lane]]) -> list[float]:
    """Mean pairwise agreement of the fits of each group on all rows of their node; 0 below two fits.

    One pass for all groups: K x K counts for each pair of fits and partition reach the driver.
    """
    sent = [(g, lanes[0].node, [x.centers for x in lanes], lanes[0].geometry) for g, lanes in enumerate(groups) if len(lanes) > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            node, raw = batch.column(0).to_numpy(), fcm.matrix(batch.column(1))
            ready = {name: fcm.GEOMETRIES[name].prepare(raw) for name in {e[3] for e in sent}}
            for g, n, centers, name in sent:
                x = ready[name][node == n]
                labels = [fcm.GEOMETRIES[name].distances(x, v).argmin(1) for v in centers]
                for i, a in enumerate(labels):
                    for j in range(i + 1, len(labels)):
                        found = np.bincount(a * len(centers[j]) + labels[j], minlength=len(centers[i]) * len(centers[j]))
                        held[g, i, j] = held.get((g, i, j), 0) + found
        if held:
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*held, strict=True)), pa.array([t.tolist() for t in held.values()])], ["g", "i", "j", "counts"])

    tables: dict[tuple[int, int, int], np.ndarray] = {}
    if sent:
        for r in docs.select("node", "x").mapInArrow(run, "g long, i long, j long, counts array<long>").collect():
            key = r["g"], r["i"], r["j"]
            tables[key] = tables.get(key, 0) + np.array(r["counts"], float)
    out: list[list[float]] = [[] for _ in groups]
    for (g, i, _), t in sorted(tables.items()):
        out[g].append(_table_rand(t.reshape(groups[g][i].k, -1)))
    return [float(np.mean(x)) if x else 0.0 for x in out]


@dataclass
class Attempts:
    """The fits made so far of one node, K and fuzzifier; attempt i starts from ``seed + 1009 i``."""

    node: int
    k: int
    m: float
    seed: int
    geometry: str = "spherical"
    lanes: list[Lane] = field(default_factory=list)
    wanted: int = 0

    def valid(self, min_size: int) -> list[Lane]:
        return [x for x in self.lanes if x.valid(min_size)]

    def hopeless(self) -> bool:
        """Whether the node has fewer rows than centers."""
        return any(len(x.centers) != x.k for x in self.lanes)


def extend(docs: DataFrame, groups: list[Attempts], n_init: int, min_size: int, max_attempts: int | None = None, max_iter: int = 60, tol: float = 1e-4) -> None:
    """Make attempts for every group until ``n_init`` of them are valid, ``max_attempts`` at most (three times as many).

    A round makes as many attempts for each group as are still missing, so no more are made than one after the other would
    take; all groups advance in the same passes.
    """
    most = 3 * n_init if max_attempts is None else max_attempts
    if most < n_init:
        raise ValueError("fewer attempts are allowed than are wanted")
    while True:
        new: list[Lane] = []
        for g in groups:
            g.wanted = n_init
            missing = min(n_init - len(g.valid(min_size)), most - len(g.lanes))
            if missing > 0 and not g.hopeless():
                made = [Lane(g.node, g.k, g.seed + 1009 * (len(g.lanes) + i), g.m, geometry=g.geometry) for i in range(missing)]
                g.lanes += made
                new += made
        if not new:
            return
        fit_lanes(docs, new, max_iter, tol)


SCORES = "node long, k long, xb double, silhouette double, stability double, mpc double, objective double, valid boolean, valid_restarts long, attempts long"


def scores(docs: DataFrame, groups: list[Attempts], min_size: int) -> tuple[DataFrame, dict[int, dict[int, Lane]]]:
    """A candidate row of each group, and the chosen fit of each node and K.

    A candidate is valid if an attempt is, and if all its scores are finite.
    """
    agreed = stability(docs, [g.valid(min_size) for g in groups])
    rows, chosen = [], {}
    for g, agreement in zip(groups, agreed, strict=True):
        best = best_of(g.lanes, min_size)
        if best is None:
            continue
        chosen.setdefault(g.node, {})[g.k] = best
        xb, mpc = best.objective / max(best.separation**2, 1e-12), (best.pc - 1 / g.k) / (1 - 1 / g.k) if g.k > 1 else 1.0
        row = [float(v) for v in (xb, best.proxy, agreement, mpc, best.objective)]
        rows.append((g.node, g.k, *row, bool(g.valid(min_size)) and bool(np.isfinite(row).all()), len(g.valid(min_size)), len(g.lanes)))
    return docs.sparkSession.createDataFrame(rows, SCORES), chosen


def candidates(docs: DataFrame, ks: list[int], m: float = 1.2, n_init: int = 3, seed: int = 42, min_size: int = 2, max_iter: int = 60, tol: float = 1e-4, max_attempts: int | None = None, geometry: str = "spherical") -> tuple[DataFrame, dict[int, dict[int, Lane]]]:
    """Candidate rows (``SCORES``) and the chosen fit of each node and K."""
    nodes = [r["node"] for r in docs.select("node").distinct().collect()]  # nodes of the model
    groups = [Attempts(int(n), k, m, seed + 1009 * k, geometry) for n in nodes for k in ks]
    extend(docs, groups, n_init, min_size, max_attempts, max_iter, tol)
    return scores(docs, groups, min_size)


def _choose(live: DataFrame, method: str, patience: int, xb_gain: float) -> int | None:
    """K by ``method`` among the valid candidates of one node; None without any."""
    spark = live.sparkSession
    rows = selection.multi_metric_score(selection.stop_after_worsening(live, patience)).withColumn("improvement", selection.xb_improvement()).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["k"])
    if method == "silhouette":
        return max(rows, key=lambda r: (r["silhouette"], -r["k"]))["k"]
    if method == "xie_beni":
        # the smallest K from which the index improves by less than the gain
        best = min(rows, key=lambda r: (r["xb"], r["k"]))
        for a, b in zip(rows, rows[1:], strict=False):
            if b["improvement"] is not None and b["improvement"] < xb_gain and a["k"] < best["k"]:
                return a["k"]
        return best["k"]
    if method == "knee":
        return selection.objective_knee(spark.createDataFrame([(r["k"], r["objective"]) for r in rows], "k long, objective double")).first()["k"]
    return max(rows, key=lambda r: (round(r["score"], 12), -r["xb"], r["stability"], r["silhouette"], -r["k"]))["k"]


def select_k(docs: DataFrame, ks: list[int], method: str = "multi_metric", patience: int = 2, xb_gain: float = 0.05, **fit) -> tuple[dict[int, Lane], DataFrame]:
    """The fit of the best K of each node, and all candidates with their scores. Nodes without a valid K are left out.

    ``geometry`` selects K in another geometry than the spherical one.
    """
    frame, fits = candidates(docs, ks, **fit)
    held = {}
    for n in fits:
        k = _choose(frame.where((F.col("node") == n) & F.col("valid")), method, patience, xb_gain)
        if k is not None:
            held[n] = fits[n][k]
    return held, frame


#: Fixed value: fuzzifiers in the order in which they are tried.
FUZZIFIERS = (1.2, 1.4, 1.6, 1.8, 2.0)


def stable_fuzzifier(docs: DataFrame, ms: tuple = FUZZIFIERS, n_init: int = 3, seed: int = 42, needed: float = 0.80, min_size: int = 2, max_attempts: int | None = None) -> float:
    """The first m whose two-way fits are valid and agree; the last one otherwise."""
    one = docs.withColumn("node", F.lit(0).cast("long"))
    groups = [Attempts(0, 2, m, seed + 10007 * i) for i, m in enumerate(ms)]
    extend(one, groups, n_init, min_size, max_attempts)
    good = [g.valid(min_size) for g in groups]
    for m, lanes, agreed in zip(ms, good, stability(one, good), strict=True):
        if len(lanes) >= n_init and agreed >= needed:
            return m
    return ms[-1]


def consensus_k(docs: DataFrame, ks: list[int], scouts: int = 5, needed: int = 3, ratio: float = 0.2, size: int | None = None, **fit) -> tuple[int | None, dict[int, int]]:
    """K by strict majority of scouts on samples (each a node of the same passes), and the votes.

    At most one K can reach a strict majority, so that stopping early would not change it; all scouts vote at once.
    """
    if 2 * needed <= scouts:
        raise ValueError("a strict majority of the scouts is needed")
    size = size or max(1, int(np.ceil(docs.count() * ratio)))
    from ..sources import exact_sample

    parts = [exact_sample(docs.select("id", "x"), size, 42 + s).withColumn("node", F.lit(s).cast("long")) for s in range(scouts)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    held, _ = select_k(every, ks, **fit)
    votes: dict[int, int] = {}
    for lane in held.values():
        votes[lane.k] = votes.get(lane.k, 0) + 1
    best = [k for k, v in votes.items() if v >= needed]
    return (best[0] if best else None), votes


def consensus_fit(docs: DataFrame, ks: list[int], scouts: int = 5, needed: int = 3, ratio: float = 0.2, min_size: int = 2, **fit) -> tuple[Lane | None, dict[int, int], str]:
    """The fit on all rows at the K that the scouts agree on, the votes, and how K was found.

    A sample has at least ``min_size`` rows for each of the fewest clusters, and the least size of its clusters shrinks with
    it. Without a majority, or where its K has no valid fit on all rows, K is selected on all rows (``fallback``); so it is
    where a sample would be the whole table (``direct``).
    """
    docs = docs.select("id", "x").withColumn("node", F.lit(0).cast("long"))
    n = docs.count()
    size = min(n, max(min(ks) * min_size, int(np.ceil(n * ratio))))
    if size >= n:
        return select_k(docs, ks, min_size=min_size, **fit)[0].get(0), {}, "direct"
    k, votes = consensus_k(docs, ks, scouts, needed, ratio, size, min_size=max(2, int(np.ceil(min_size * size / n))), **fit)
    if k is not None:
        held = select_k(docs, [k], min_size=min_size, **fit)[0]
        if 0 in held:
            return held[0], votes, "consensus"
    return select_k(docs, ks, min_size=min_size, **fit)[0].get(0), votes, "fallback"


@dataclass(frozen=True)
class FastPlan:
    """Bounds of the scout and of the refinement. The sample is the method's own, of a documented size."""

    sample: int = 1000
    scout_init: int = 2
    scout_attempts: int = 3
    scout_most: int = 8
    top_k: int = 2
    margin: float = 0.15
    refine_init: int = 3
    refine_attempts: int = 5
    refine_most: int = 10
    probe_stability: float = 0.80
    stability: float = 0.85
    ms: tuple = FUZZIFIERS

    def __post_init__(self) -> None:
        if self.sample < 2 or not 1 <= self.scout_init <= self.scout_attempts or not 1 <= self.refine_init <= min(self.refine_attempts, self.refine_most):
            raise ValueError("sizes and attempts of the fast selection are out of range")
        if not self.ms or min(self.ms) <= 1 or self.top_k < 1 or self.scout_most < 2 or not 0 <= self.margin <= 1:
            raise ValueError("limits of the fast selection are out of range")


def fast_k(docs: DataFrame, ks: list[int], plan: FastPlan = FastPlan(), m: float | None = None, method: str = "multi_metric", min_size: int = 2, seed: int = 42, max_iter: int = 100, tol: float = 1e-5) -> tuple[Lane | None, DataFrame]:
    """The fit of the best K, found on a sample and refined on all rows, and the candidates of the last step.

    The fuzzifier is ``m``, unless its scouts disagree, or else the first one of the plan with a stable two-way probe. The
    best few K of the scouts are fitted on all rows, with twice as many restarts until they agree; where no K has a valid
    fit, the next fuzzifier of the plan is taken.
    """
    from ..sources import exact_sample

    one = docs.select("id", "x").withColumn("node", F.lit(0).cast("long"))
    few = exact_sample(one, plan.sample, seed).persist()
    probe = lambda: stable_fuzzifier(few, plan.ms, plan.scout_init, seed, plan.probe_stability, min_size, plan.scout_attempts)
    scouted = sorted(k for k in ks if k <= plan.scout_most) or [min(ks)]

    def scout(m: float) -> tuple[int | None, DataFrame]:
        frame, _ = candidates(few, scouted, m, plan.scout_init, seed + 97, min_size, max_attempts=plan.scout_attempts)
        live = frame.where("valid")
        return _choose(live, method, len(scouted), 0.05), live

    used = probe() if m is None else m
    best, live = scout(used)
    if m is not None and (best is None or live.where(F.col("k") == best).first()["stability"] < plan.probe_stability):
        used = probe()
        best, live = scout(used)
    few.unpersist()
    if best is None:
        return None, live
    picked = [r["k"] for r in selection.scout_top(selection.multi_metric_score(live), plan.top_k, plan.margin).orderBy("rank").collect()] or [best]
    nearest = min(range(len(plan.ms)), key=lambda i: abs(plan.ms[i] - used))
    one = one.persist()
    for turn, trial in enumerate([used, *plan.ms[nearest + 1 :]]):
        groups = [Attempts(0, k, trial, seed + 1003 + 101_003 * turn + 11_009 * i) for i, k in enumerate(picked)]
        restarts, open_ = plan.refine_init, groups
        while open_:
            extend(one, open_, restarts, min_size, max(plan.refine_attempts, restarts), max_iter, tol)
            agreed = stability(one, [g.valid(min_size) for g in open_])
            open_ = [g for g, a in zip(open_, agreed, strict=True) if g.valid(min_size) and a < plan.stability and restarts < plan.refine_most]
            restarts = min(plan.refine_most, 2 * restarts)
        frame, fits = scores(one, groups, min_size)
        k = _choose(frame.where("valid"), method, len(picked), 0.05)
        if k is not None:
            one.unpersist()
            return fits[0][k], frame
    one.unpersist()
    return None, live


@dataclass
class Node:
    """A split of the hierarchy: centers of its children, distance thresholds, fuzzifier."""

    path: str
    depth: int
    centers: np.ndarray
    thresholds: np.ndarray
    m: float


def fit_hierarchy(docs: DataFrame, ks: list[int], max_depth: int = 2, min_node: int = 60, m: float = 1.2, z: float = 3.0, min_membership: float = 0.40, max_gap: float = 0.05, **fit) -> tuple[dict[str, Node], DataFrame]:
    """Nodes by path, and documents with level_1 .. level_D (-1: none), path, is_natural_noise and distance of the last level.

    All nodes of a level are fitted in the same passes.
    """
    from . import classify, metrics

    spark = docs.sparkSession
    state = docs.select("id", "x").withColumn("path", F.lit("")).withColumn("open", F.lit(True)).withColumn("is_natural_noise", F.lit(False))
    nodes: dict[str, Node] = {}
    for depth in range(1, max_depth + 1):
        sizes = {r["path"]: r["n"] for r in state.where("open").groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
        live = sorted(p for p, n in sizes.items() if n >= min_node)  # nodes of the model
        if not live:
            state = state.withColumn(f"level_{depth}", F.lit(-1).cast("long"))
            continue
        number = {p: i for i, p in enumerate(live)}
        table = F.broadcast(spark.createDataFrame([(p, i) for p, i in number.items()], "path string, node long"))
        inside = state.where("open").join(table, "path")
        held, _ = select_k(inside, ks, m=m, **fit)
        done = None
        for p, i in number.items():
            if i not in held:
                continue
            s = fcm.e_step(inside.where(F.col("node") == i), held[i].centers, m).withColumn("distance", F.sqrt(F.get("d2", F.col("cluster").cast("int"))))
            limits = {r["cluster"]: r["threshold"] for r in metrics.robust_thresholds(s, "cluster", "distance", z).collect()}
            nodes[p] = Node(p, depth, held[i].centers, np.array([limits.get(k, np.inf) for k in range(held[i].k)]), m)
            limit = F.get(F.array(*[F.lit(float(x)) for x in nodes[p].thresholds]), F.col("cluster").cast("int"))
            s = s.withColumn("noise", classify.document_type(F.col("distance"), limit, "u", min_membership, max_gap) == "noise").select("id", "cluster", "noise")
            done = s if done is None else done.unionByName(s)
        if done is None:
            state = state.withColumn(f"level_{depth}", F.lit(-1).cast("long")).withColumn("open", F.lit(False))
            continue
        state = state.join(done, "id", "left").withColumn(f"level_{depth}", F.when(F.coalesce("noise", F.lit(False)) | F.col("cluster").isNull(), F.lit(-1)).otherwise(F.col("cluster")).cast("long"))
        split = F.col("cluster").isNotNull() & ~F.coalesce("noise", F.lit(False))
        state = state.withColumn("path", F.when(split, F.when(F.col("path") == "", F.col("cluster").cast("string")).otherwise(F.concat_ws("/", "path", F.col("cluster").cast("string")))).otherwise(F.col("path")))
        state = state.withColumn("open", split).withColumn("is_natural_noise", F.col("is_natural_noise") | F.coalesce("noise", F.lit(False))).drop("cluster", "noise")
    return nodes, state


def assign_hierarchy(docs: DataFrame, nodes: dict[str, Node], max_depth: int = 2, min_membership: float = 0.40, max_gap: float = 0.05) -> DataFrame:
    """Documents assigned to a fixed hierarchy level by level; noise does not descend. The model is sent to the tasks."""
    held = {p: (n.centers, n.thresholds, n.m) for p, n in nodes.items()}
    levels = ", ".join(f"level_{d} long" for d in range(1, max_depth + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = fcm.unit_rows(fcm.matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 1))
            n = len(x)
            path, noise = np.full(n, "", object), np.zeros(n, bool)
            found = np.full((n, max_depth), -1)
            for depth in range(max_depth):
                for p in set(path[~noise]) & set(held):
                    if p.count("/") + (p != "") != depth:
                        continue
                    centers, limits, m = held[p]
                    mine = np.flatnonzero((path == p) & ~noise)
                    d2 = np.maximum(2 - 2 * x[mine] @ centers.T, 0)
                    u = fcm.memberships(d2, m)
                    label, top = u.argmax(1), np.sort(u, 1)
                    d = np.sqrt(d2[np.arange(len(mine)), label])
                    edge = (top[:, -1] < min_membership) & (top[:, -1] - top[:, -2] < max_gap) if u.shape[1] > 1 else np.zeros(len(mine), bool)
                    far = edge & (d > limits[label])
                    noise[mine[far]] = True
                    ok = mine[~far]
                    found[ok, depth] = label[~far]
                    path[ok] = [f"{p}/{k}" if p else str(k) for k in label[~far]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(path.tolist(), pa.string()), pa.array(noise), *(pa.array(found[:, d]) for d in range(max_depth))], ["id", "path", "is_natural_noise", *[f"level_{d + 1}" for d in range(max_depth)]])

    return docs.select("id", "x").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, path string, is_natural_noise boolean, {levels}")
