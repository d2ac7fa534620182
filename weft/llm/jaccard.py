"""Operator 6, n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Words are lower-cased (A-Z only) and separated by ASCII white space; a text's set holds its distinct 5-word shingles as
hashes (with fewer words the whole sequence). Two sets link when 100 * intersection >= 80 * union.

1. ``shared_sets`` counts every shingle's document frequency exactly and gives each document back the shingles that
   another one has too. Blocks of documents send packed hashes to lanes, ranges of the hash space; a lane adds up the
   frequencies and answers the blocks. A shingle that several documents of a block hold travels once, with a count, so
   that a passage of a third of all documents is one entry for each block. No message is empty and none grows with the
   number of documents: the volume is in proportion to the shingles, 8 bytes for each while a block has many for a lane,
   and that of single rows at most. A shingle of one document can link nothing and stays behind.
2. Equal sets, by a signature of 128 bits, form one class; classes are joined, copies are not expanded.
3. In the order rarest shingle first, linked sets share one of their first n - ceil(0.8 n) + 1 shingles. Classes meet at
   those; candidates pass the length filter, the positional filter at their first common shingle, and the suffix filter
   (a lower bound of the Hamming distance from the parities in SKETCH fixed parts of the hash space), all within the
   join, and each pair is verified once.
4. Components need no pair inside a component: round by round the classes at a shingle are compared with one pivot, and
   the components merged; shingles whose classes are all connected drop out. When a round settles little more, a last
   one compares all pairs of different components that still share a prefix shingle, in cells, so that no link between
   components is lost and no task gets a whole frequent shingle.

Null and empty texts have no shingles and link with nothing. Texts of any length are read whole. Repeated rows link with each other. A
null doc_id takes part but never names a component, unless it is alone. Empty tables give an empty result. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, materialize, release, row_hash
from . import tokens as tk

N_WORDS, PERCENT = 5, 80
#: Bytes of text in a block; shingles for a lane.
BLOCK_BYTES, LANE_SHINGLES = 4 << 20, 1 << 20
#: Parts of the hash space in the suffix filter, in words of 64.
SKETCH = 512
#: A round with pivots must leave at most this share of the components, or the last round begins; postings of a hash
#: that meet as one cell there.
SHRINK, CELL = 0.5, 128
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by both."""
    low = tk.LOWER[data]
    starts, ends, bounds = tk.words(low, offsets)
    hashes = tk.word_hashes(low, starts, ends)
    row = tk.row_of(bounds)
    rows, out = [], []
    if len(hashes) >= size:
        whole = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
        rows.append(row[whole])
        out.append(tk.window_hashes(hashes, size)[whole])
    counts = np.diff(bounds)
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        rows.append(np.array([r]))
        sequence = hashes[bounds[r] : bounds[r + 1]]
        out.append(tk.mix(np.array([np.sum(sequence * tk.powers(size + 1)[1 : len(sequence) + 1], dtype=np.uint64) + _U(len(sequence))], np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[fresh], key[fresh]


#: What a block sends a lane: the shingles that one document holds, with its place in the block, and those that several
#: hold, with their number. A header (sender below 0) passes through to its block.
_MESSAGE = "target long, sender long, hashes binary, places binary, several binary, counts binary"
#: What a lane answers a block: the shingles that are shared, and the frequencies of these and of those that several held.
_ANSWER = "target long, lane long, hashes binary, places binary, frequencies binary, several binary"
_SET = "rid long, doc_id long, tag long, n long, sign binary, prefix array<long>, offset int, sketch array<long>, packed binary"
#: A doc_id that is null.
_NULL = -(1 << 63)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    fresh = np.ones(len(sorted_keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    start = np.flatnonzero(fresh)
    return start, np.diff(np.append(start, len(sorted_keys)))


def _pack(hashes: np.ndarray) -> bytes:
    """The low six bytes of each hash."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(held: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 6)
    out = np.zeros((len(joined), 8), np.uint8)
    out[:, :6] = joined
    return out.view(np.uint64).ravel()


def _numbers(held: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(held), kind)


def _bits(lanes: int) -> tuple[int, int]:
    """Bits of a hash that name a lane, and bits that travel beside it: all 64 from 2**16 lanes on, else 48 and the lane's."""
    name = lanes.bit_length() - 1
    return name, min(48, 64 - name)


def _block_rows(block: int, ids: np.ndarray, tags: np.ndarray, row: np.ndarray, key: np.ndarray, lanes: int) -> pa.RecordBatch:
    """Messages of one block, none of them empty, and its header: ids, set sizes, signatures, and the members of the
    shingles that several of its documents hold."""
    n = len(ids)
    sizes = np.bincount(row, minlength=n)
    at = np.searchsorted(row, np.arange(n + 1))
    signs = np.empty((n, 2), np.uint64)
    for k, salt in enumerate((0, 0x5851F42D4C957F2D)):
        total = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(tk.mix(key ^ _U(salt)), out=total[1:])
        signs[:, k] = total[at[1:]] - total[at[:-1]]
    del total
    name, rest = _bits(lanes)
    key = key >> _U(64 - name - rest)
    order = np.argsort(key, kind="stable")
    by_hash = key[order]
    start, length = _runs(by_hash)
    many = length > 1
    member = np.repeat(many, length)
    several, counts = by_hash[start[many]], length[many].astype(np.uint32)
    header = pickle.dumps((ids, tags, sizes.astype(np.int64), signs, several, counts, row[order[member]].astype(np.uint16)), 5)
    alone = order[~member]
    del order, by_hash, start, length, member
    lane = (key[alone] >> _U(rest)).astype(np.int64)
    # by lane, and there by document, so that the places of a document lie together
    alone = alone[np.lexsort((row[alone], lane))]
    key, place = key[alone], row[alone].astype(np.uint16)
    lane = (key >> _U(rest)).astype(np.int64)
    several_lane = (several >> _U(rest)).astype(np.int64)
    to = np.union1d(lane, several_lane)
    a, z = np.searchsorted(lane, to), np.searchsorted(lane, to, "right")
    ha, hz = np.searchsorted(several_lane, to), np.searchsorted(several_lane, to, "right")
    beside = _U((1 << rest) - 1)
    rows = [(t, block, _pack(key[i:j] & beside), place[i:j].tobytes(), _pack(several[k:m] & beside), counts[k:m].tobytes()) for t, i, j, k, m in zip(to.tolist(), a, z, ha, hz, strict=True)]
    rows.append((block % lanes, -1 - block, header, None, None, None))
    types = [pa.int64()] * 2 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(_MESSAGE))


def _send(lanes: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        ids, tags, rows, keys, held = [], [], [], [], 0
        base = 0

        def flush() -> pa.RecordBatch:
            return _block_rows((part << 10) + count, np.concatenate(ids), np.concatenate(tags), np.concatenate(rows), np.concatenate(keys), lanes)

        for batch in batches:
            for piece, data, offsets in tk.slices(batch):
                row, key = shingle_sets(data, offsets)
                ids.append(pc.fill_null(piece.column(0), _NULL).to_numpy())
                tags.append(piece.column(1).to_numpy())
                rows.append(row + base)
                keys.append(key)
                base += piece.num_rows
                held += len(data)
                if held >= block_bytes or base >= 60000:
                    yield flush()
                    ids, tags, rows, keys, held, base, count = [], [], [], [], 0, 0, count + 1
        if base:
            yield flush()

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Add up the frequencies of one lane, and send every block those of its shingles that others share."""
    senders = table.column("sender").to_numpy()
    columns = [table.column(c).to_pylist() for c in ("hashes", "places", "several", "counts")]
    rows = [(-1 - s, -1, columns[0][k], None, None, None) for k, s in enumerate(senders.tolist()) if s < 0]
    from_blocks = np.flatnonzero(senders >= 0).tolist()
    hashes, places, several, counts = ([c[k] for k in from_blocks] for c in columns)
    del table, columns
    size, many = [len(x) // 6 for x in hashes], [len(x) // 6 for x in several]
    every = _unpack(hashes + several)
    weight = np.concatenate([np.ones(sum(size), np.uint32), _numbers(counts, np.uint32)])
    order = np.argsort(every, kind="stable")
    start, length = _runs(every[order])
    df = np.empty(len(every), np.uint16)
    df[order] = np.repeat(np.minimum(np.add.reduceat(weight[order].astype(np.int64), start) if len(start) else start, 65535), length)
    del order, weight
    at, many_at = 0, sum(size)
    for k, block in enumerate(senders[from_blocks].tolist()):
        mine, theirs = df[at : at + size[k]], df[many_at : many_at + many[k]]
        shared = mine >= 2
        if many[k] or shared.any():
            rows.append((block, key[0].as_py(), _pack(every[at : at + size[k]][shared]), np.frombuffer(places[k], np.uint16)[shared].tobytes(), mine[shared].tobytes(), theirs.tobytes()))
        at, many_at = at + size[k], many_at + many[k]
    types = [pa.int64()] * 2 + [pa.binary()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)], _names(_ANSWER))


def _binaries(data: np.ndarray, at: np.ndarray, mask: np.ndarray) -> pa.Array:
    """Binary values from one array of 64-bit numbers and the n + 1 bounds of the rows in it; null where masked."""
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(data)])
    return pc.if_else(pa.array(mask), pa.scalar(None, pa.large_binary()), held).cast(pa.binary())


def _gather(n_lanes: int, key: tuple, table: pa.Table) -> pa.Table:
    """Put the shared shingles of one block together: every document's, rarest first."""
    lanes = table.column("lane").to_numpy()
    order = np.argsort(lanes, kind="stable").tolist()
    hashes, places, frequencies, theirs = ([c[k] for k in order] for c in (table.column(c).to_pylist() for c in ("hashes", "places", "frequencies", "several")))
    lanes = lanes[order]
    del table
    # the header comes first, then the lanes in order, so that the frequencies of ``several`` lie in the order of their hashes
    ids, tags, sizes, signs, several, counts, members = pickle.loads(hashes[0])  # noqa: S301
    n = len(ids)
    rest = _bits(n_lanes)[1]
    alone_keys = _unpack(hashes[1:]) + np.repeat(lanes[1:].astype(np.uint64) << _U(rest), [len(x) // 6 for x in hashes[1:]])
    row = np.concatenate([_numbers(places[1:], np.uint16), members]).astype(np.int64)
    keys = np.concatenate([alone_keys, np.repeat(several, counts)])
    df = np.concatenate([_numbers(frequencies[1:], np.uint16), np.repeat(_numbers(theirs[1:], np.uint16), counts)])
    del hashes, places, frequencies, theirs, members, alone_keys
    order = np.lexsort((keys, df, row))
    row, keys = row[order], keys[order]
    del order, df
    at = np.searchsorted(row, np.arange(n + 1))
    part = (tk.mix(keys) >> _U(32)).astype(np.int64) % SKETCH
    sketch = np.zeros((n, SKETCH // 64), np.uint64)
    np.bitwise_xor.at(sketch, (row, part // 64), _U(1) << (part % 64).astype(np.uint64))
    shared = np.diff(at)
    need = sizes - (PERCENT * sizes + 99) // 100 + 1  # length of the prefix in the order of all shingles
    alone = sizes - shared
    taken = np.where(sizes > 0, np.clip(np.minimum(need - alone, shared), 0, None), 0)
    none = taken == 0
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(taken, out=begin[1:])
    prefix = keys[np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], taken)].view(np.int64)
    in_order = keys[np.lexsort((keys, row))]
    lists = lambda values, bounds: pc.if_else(pa.array(none), pa.scalar(None, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values)))
    columns = [
        pa.array((key[0].as_py() << 16) + np.arange(n)),
        pa.array(ids, mask=ids == _NULL),
        pa.array(tags),
        pa.array(sizes),
        _binaries(signs.ravel(), np.arange(n + 1) * 2, sizes == 0),
        lists(prefix, begin),
        pa.array(alone.astype(np.int32)),
        lists(sketch.view(np.int64).ravel(), np.arange(n + 1) * (SKETCH // 64)),
        _binaries(in_order, at, none),
    ]
    return pa.table(columns, ["rid", "doc_id", "tag", "n", "sign", "prefix", "offset", "sketch", "packed"])


def shared_sets(docs: DataFrame, block_bytes: int | None = None, lane_shingles: int | None = None) -> DataFrame:
    """A row number, doc_id, tag, set size n, signature of the set, and for those that can link the prefix and the packed
    shared shingles, of rows (doc_id, tag, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tag").cast("long").alias("tag"), "text")
    tk.batch_conf(docs.sparkSession)
    letters = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lanes = 1 << max(4, int(np.ceil(np.log2(max(1, letters / 6 / (lane_shingles or LANE_SHINGLES))))))
    sent = source.mapInArrow(_send(lanes, block_bytes or BLOCK_BYTES), _MESSAGE)
    answered = sent.groupBy("target").applyInArrow(_answer, _ANSWER)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        return _gather(lanes, key, table)

    return answered.groupBy("target").applyInArrow(gather, _SET)


def _need(a: Column, b: Column) -> Column:
    """The least intersection of linked sets of sizes a and b: 100 i >= PERCENT (a + b - i)."""
    return F.ceil((a + b) * PERCENT / F.lit(100.0 + PERCENT) - 1e-9)


def _passes(d: str, p: str) -> Column:
    """Length, positional and suffix filter of a pair, from the columns n_, at_, alone_ and sketch_ of both sides.

    At the first common shingle of a linked pair the positional filter passes; at later ones it may not, so a pair is a
    candidate if it passes anywhere.
    """
    c = F.col
    size = lambda x: c(f"n_{x}")
    need = _need(size(d), size(p))
    length = 100 * F.least(size(d), size(p)) >= PERCENT * F.greatest(size(d), size(p))
    position = F.least(size(d) - c(f"at_{d}"), size(p) - c(f"at_{p}")) >= need
    odd = sum((F.bit_count(F.get(f"sketch_{d}", F.lit(k)).bitwiseXOR(F.get(f"sketch_{p}", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
    apart = c(f"alone_{d}") + c(f"alone_{p}") + odd
    return length & position & (apart <= size(d) + size(p) - 2 * need)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(d, p, linked) of pairs (d, p), by intersecting the shared shingles of both."""
    mine = sets.select(F.col("node").alias("d"), F.col("n").alias("n_d"), F.col("packed").alias("set_d"))
    theirs = sets.select(F.col("node").alias("p"), F.col("n").alias("n_p"), F.col("packed").alias("set_p"))
    both = pairs.select("d", "p").join(mine, "d").join(theirs, "p").select("d", "p", "n_d", "n_p", "set_d", "set_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, p, n_d, n_p, set_d, set_p = batch.columns
            linked = []
            for a, b, x, y in zip(n_d.to_pylist(), n_p.to_pylist(), set_d, set_p, strict=True):
                common = len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True))
                linked.append(100 * common >= PERCENT * (a + b - common))
            yield pa.RecordBatch.from_arrays([d, p, pa.array(linked, pa.bool_())], ["d", "p", "linked"])

    return both.mapInArrow(run, "d long, p long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``edges`` (u, v), by label propagation with shortcuts."""
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("comp").alias("jump"))
        new = materialize(lower.join(jump, "lower", "left").select("node", F.least("lower", F.coalesce("jump", "lower")).alias("comp"), (F.least("lower", F.coalesce("jump", "lower")) < F.col("comp")).alias("moved")))
        discard(labels)
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            discard(both)
            return labels


def _merge(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links (d, p) between nodes."""
    if comps is None:
        return components(links.select(F.col("d").alias("u"), F.col("p").alias("v")))
    at = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
    lifted = links.join(at("d"), "d", "left").join(at("p"), "p", "left").select(F.coalesce("c_d", "d").alias("u"), F.coalesce("c_p", "p").alias("v")).where("u != v")
    new = components(lifted).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = comps.join(new, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = new.select(F.col("comp").alias("node"), F.col("to").alias("comp")).join(comps, "node", "left_anti")
    return materialize(old.unionByName(fresh))


def linked_components(sets: DataFrame) -> DataFrame | None:
    """(node, comp) of every class of ``sets`` (node, n, prefix, offset, sketch, packed) that links with another."""
    prefixes = sets.where(F.size("prefix") > 0)
    shared = prefixes.select(F.explode("prefix").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("hash")
    postings = prefixes.select("node", "n", "offset", "sketch", F.posexplode("prefix").alias("pos", "hash")).select("hash", "node", "n", (F.col("offset") + F.col("pos")).alias("at"), F.col("offset").alias("alone"), "sketch")
    held = materialize(postings.join(shared, "hash", "left_semi").withColumn("comp", F.col("node")))
    side = lambda x: [F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}"), F.col("alone").alias(f"alone_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("comp").alias(f"comp_{x}")]
    comps, tried, apart, turn, last = None, None, held.select("node").distinct().count(), 0, False
    while apart and not last:
        if turn:
            left = _alive(held, comps)
            discard(held)
            held, before = left, apart
            apart = held.select("comp").distinct().count()
            # the last round begins when a round with pivots joins few more components
            last = apart > SHRINK * before
        if not last:
            # the class with the smallest share of shingles of its own is the likeliest to be near to all; later rounds stray
            stray = F.pmod(F.xxhash64("node", "hash", F.lit(turn)), F.lit(1000)) * F.lit(1e-4 * turn)
            pivot = F.min(F.struct((F.col("alone") / F.col("n") + stray).alias("order"), F.col("node"), *side("p"))).alias("pivot")
            runs = held.groupBy("hash").agg(pivot).select(F.col("hash").alias("hash_p"), "pivot.*")
            met = held.select("hash", *side("d")).join(runs, (F.col("hash") == F.col("hash_p")) & (F.col("comp_d") != F.col("comp_p")) & _passes("d", "p"))
        else:
            met = _all_pairs(held, side)
        pairs = met.select("d", "p").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("d", "p"), ["d", "p"], "left_anti").join(tried.select(F.col("p").alias("d"), F.col("d").alias("p")), ["d", "p"], "left_anti")
        verified = materialize(_verify(pairs, sets))
        links = verified.where("linked").select("d", "p")
        if not links.isEmpty():
            comps = _merge(comps, links)
        tried = verified if tried is None else tried.unionByName(verified)
        turn += 1
    return comps


def _alive(held: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The postings at hashes whose classes are not all in one component, with their components."""
    now = held if comps is None else held.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    active = now.groupBy("hash").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("hash")
    return materialize(now.join(active, "hash", "left_semi"))


def _all_pairs(held: DataFrame, side) -> DataFrame:
    """Pairs of different components that meet at a hash and pass the filters.

    A hash with many postings is cut into cells of about CELL; a posting is sent once for each cell that its own meets,
    so that no task gets all postings of a hash.
    """
    sizes = held.groupBy("hash").agg(F.count(F.lit(1)).alias("held")).select("hash", F.ceil(F.col("held") / CELL).alias("cells"))
    celled = materialize(held.join(sizes, "hash").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells"))))
    # cell a meets cell b in the task of (hash, a, b), a <= b
    left = celled.select(F.col("hash").alias("hash_d"), F.col("cell").alias("a_d"), F.explode(F.sequence(F.col("cell"), F.col("cells") - 1)).alias("b_d"), *side("d"))
    right = celled.select(F.col("hash").alias("hash_p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cell"))).alias("a_p"), F.col("cell").alias("b_p"), *side("p"))
    meet = (F.col("hash_d") == F.col("hash_p")) & (F.col("a_d") == F.col("a_p")) & (F.col("b_d") == F.col("b_p"))
    once = (F.col("a_d") < F.col("b_d")) | (F.col("d") < F.col("p"))
    met = left.join(right, meet & once & (F.col("comp_d") != F.col("comp_p")) & _passes("d", "p"))
    return met.select(F.least("d", "p").alias("d"), F.greatest("d", "p").alias("p"))


def _named(docs: DataFrame, *named_by: str) -> DataFrame:
    """doc_id, tag, n, and the smallest of ``named_by`` in the component of each row of ``docs`` (doc_id, tag, text)."""
    rows = materialize(shared_sets(docs))
    release(docs.sparkSession)
    # only these can equal or link with another: the others hold too many shingles of their own
    can = rows.where("prefix is not null")
    name = F.struct(F.col("doc_id").isNull().alias("none"), *named_by).alias("name")
    sets = materialize(can.groupBy("sign").agg(F.min("rid").alias("node"), F.min(name).alias("name"), *[F.first(c).alias(c) for c in ("n", "offset", "sketch", "prefix", "packed")]))
    comps = linked_components(sets)
    classes = sets.select("sign", "node", "name")
    classes = classes.withColumn("comp", F.col("node")) if comps is None else classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = classes.groupBy("comp").agg(F.min("name").alias("name"))
    classes = classes.drop("name").join(least, "comp").select("sign", "name")
    lone = rows.where("prefix is null").select("doc_id", "tag", "n", name)
    return can.select("sign", "doc_id", "tag", "n").join(classes, "sign").select("doc_id", "tag", "n", "name").unionByName(lone)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text)."""
    named = _named(docs.select("doc_id", F.lit(0).alias("tag"), "text"), "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.col("name.doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, with all its columns.

    Rows that are equal in every column are one row. A row is known by its doc_id and the hash of all its columns.
    """
    keyed = docs.withColumn("__key", row_hash(docs)).withColumn("__id", F.col("doc_id").cast("long"))
    chosen = _named(keyed.select("doc_id", F.col("__key").alias("tag"), "text"), "doc_id", "tag")
    # the first row of a component names it
    first = chosen.where(F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("tag") == F.col("name.tag"))).select(F.col("doc_id").alias("__first"), F.col("tag").alias("__tag")).distinct()
    kept = keyed.join(first, (F.col("__key") == F.col("__tag")) & F.col("__id").eqNullSafe(F.col("__first")), "left_semi")
    return kept.dropDuplicates(["__key", "__id"]).select(docs.columns)
