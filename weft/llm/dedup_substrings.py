"""Operator 10, suffix-array dedup: remove every byte that a repeated LENGTH-byte string covers.

A window of LENGTH bytes is anchored at its 64-byte gram of smallest hash, so equal windows have equal anchors at the
same place. Windows of one document with a common anchor form a segment; one row of hashes stands for about 170 windows.

1. Anchors that occur once in the corpus match nothing and are dropped.
2. Segments with equal bytes (equal 128-bit digests) are repeated in full; classes of equal segments are counted, not
   expanded.
3. Where different segments share an anchor, one segment of each class is fetched and the suffixes at its windows are
   sorted against the others' by hash-compared mergesort (suffix_sort): first at the part that all windows of a block
   of BLOCK have in common, where a suffix without a partner rules out the block, then at the whole block, where a
   partner settles it, then window by window. Neighbours in the order that agree are verified byte by byte.
4. One task sorts at most GROUP segments of an anchor. A hot anchor with more (a passage that very many documents share,
   each with surroundings of its own) is first split by content, so that every task stays small however hot it is: by
   the bytes that the windows of a block have in common, then by the block's, then, where blocks differ, by each
   window's, by 128-bit digests throughout. It is the order of comparisons of step 3, with Spark's shuffle for the sort.

Beside the strings of LENGTH bytes, passages of more than 50 words that another document holds too (words between white
space, whatever their bytes) are found by the same steps 1, 2 and 4 with windows of PASSAGE words, in blocks of PART, and
counted: their strings may be shorter than LENGTH, so nothing is removed for them.

The spans of each document are united and cut. Null and empty texts and those below LENGTH bytes lose nothing. Repeated
rows repeat each other. Texts are handled whole, in pieces with overlap if they are very long. Empty tables give an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize, release
from . import substrings, tokens as tk
from .suffix_sort import SuffixSorter

LENGTH, BLOCK, GROUP, PASSAGE = 400, 32, 1000, 51
#: Windows of words in a block; a segment has at most 44, of which few blocks lie across an end of what it shares.
PART = 4
#: Bytes of segments that are sorted together.
SORT_BYTES = 256 << 10

_ANCHOR = "gram long, segment long, check long, key long, size long, first long, stop long, word long, windows int, place int, words boolean"
_PIECE = "gram long, key long, size long, first long, word long, windows int, place int, lone boolean, words boolean, large boolean, piece binary"
_SPAN = "key long, size long, start long, stop long, words boolean"
_CELL = "core long, core_check long, whole long, whole_check long, key long, size long, start long, windows int, lone boolean, before binary, after binary"
_PASSAGE = "core long, whole long, key long, size long, start long, lone boolean, names array<long>"
_WINDOW = "core long, core_check long, window long, window_check long, lone boolean, key long, size long, start long, stop long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _find_anchors(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.slices(batch):
                key, size = part.column(0).to_numpy(zero_copy_only=False), np.diff(offsets)
                for words in (False, True):
                    a = substrings.passages(data, offsets, passage) if words else substrings.anchors(data, offsets, length)
                    n = len(a["row"])
                    stop = a["stop"] if words else a["first"] + a["count"] - 1 + length
                    columns = [a["gram"].view(np.int64), *(np.ascontiguousarray(c) for c in a["segment"].T), key[a["row"]], size[a["row"]], a["first"], stop, a["word"] if words else np.zeros(n, np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(a["count"].astype(np.int32)), pa.array(a["place"].astype(np.int32)), pa.array(np.full(n, words))], _names(_ANCHOR))

    return run


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each document that are wanted."""
    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_()] * 3 + [pa.binary()]
    for batch in batches:
        for part, data, offsets in tk.slices(batch):
            key, size, wanted = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
            held = data.tobytes()
            rows = [(w["gram"], key[r], size[r], w["first"], w["word"], w["windows"], w["place"], w["lone"], w["words"], w["large"], held[offsets[r] + w["first"] : offsets[r] + w["stop"]]) for r in range(part.num_rows) for w in wanted[r]]
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), types, strict=True)], _names(_PIECE))


def repeated_windows(data: np.ndarray, at: np.ndarray, windows: np.ndarray, place: np.ndarray, group: np.ndarray, length: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and window of every window that a segment of the same group repeats at the same place from the anchor.

    Segment k starts at ``at[k]`` and has ``windows[k]`` windows; its anchor is ``place[k]`` bytes after its first window.
    """
    sorter = SuffixSorter(data, length + block)
    # a window's distance to its anchor names it within the group; blocks are cut at multiples of ``block``
    segment = np.repeat(np.arange(len(at)), windows)
    window = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    distance = place[segment] - window
    cell = distance // block
    fresh = np.ones(len(segment), bool)
    fresh[1:] = (segment[1:] != segment[:-1]) | (cell[1:] != cell[:-1])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(segment)))
    block_of = np.repeat(np.arange(len(head)), count)
    first, group_of = at[segment[head]] + window[head], group[segment[head]]
    _, name = np.unique(np.stack([group_of, cell[head]], 1), axis=0, return_inverse=True)
    name = name.ravel()

    # the bytes that every window of a full block holds; a partner at the same distance holds them too
    core_at = at[segment[head]] + place[segment[head]] - cell[head] * block
    core = sorter.repeated(core_at, name, length - block + 1) if length > block else np.ones(len(head), bool)
    whole = core & (count == block)
    settled = np.zeros(len(head), bool)
    some = np.flatnonzero(whole)
    settled[some] = sorter.repeated(first[some], name[some], length + block - 1)
    open_ = core & ~settled
    chosen = np.flatnonzero(open_[block_of])
    _, each = np.unique(np.stack([group[segment[chosen]], distance[chosen]], 1), axis=0, return_inverse=True)
    hit = sorter.repeated(at[segment[chosen]] + window[chosen], each.ravel(), length)
    # a settled block is a partner of the open ones of its group as well
    found = settled[block_of]
    found[chosen[hit]] = True
    rest = np.flatnonzero(open_[block_of] & ~found)
    if len(rest) and settled.any():
        mates = np.isin(name[block_of], np.unique(name[block_of[rest]])) & settled[block_of]
        both = np.concatenate([rest, np.flatnonzero(mates)])
        _, each = np.unique(np.stack([group[segment[both]], distance[both]], 1), axis=0, return_inverse=True)
        hit = sorter.repeated(at[segment[both]] + window[both], each.ravel(), length)[: len(rest)]
        found[rest[hit]] = True
    place_found = np.flatnonzero(found)
    return segment[place_found], window[place_found]


def _bytes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of the column ``piece``, and the bounds of the rows in them."""
    column = table.column("piece").combine_chunks().cast(pa.large_binary())
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _passage_words(data: np.ndarray, offsets: np.ndarray, windows: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the pieces, and the place of each piece's first word in them."""
    starts, ends, _ = tk.words(data, offsets)
    return tk.word_hashes(data, starts, ends), np.cumsum(windows - 1 + passage) - (windows - 1 + passage)


def _passage_windows(hashes: np.ndarray, first_word: np.ndarray, windows: np.ndarray, gram: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, place in it, and hash (with the anchor's) of every window of words of the pieces."""
    piece = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    every = tk.window_hashes(hashes, passage)[first_word[piece] + place]
    return piece, place, tk.mix(every + tk.mix(gram.view(np.uint64))[piece])


def _spans(table: pa.Table, piece: np.ndarray, window: np.ndarray, column: str, length: int) -> list[pa.Array]:
    """Successive windows of a piece, found repeated, as spans from the piece's place ``column``."""
    number = lambda c: table.column(c).to_numpy()
    lone = np.array(table.column("lone").to_pylist(), bool)[piece]
    piece, window = piece[lone], window[lone]
    fresh = np.ones(len(piece), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(piece)) - 1 if len(begin) else begin
    s = piece[begin]
    start = number(column)[s] + window[begin]
    stop = number(column)[s] + window[end] + length if len(begin) else start
    return [pa.array(number("key")[s]), pa.array(number("size")[s]), pa.array(start), pa.array(stop)]


def _sort_pieces(length: int, block: int, passage: int):
    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        for words in (False, True):
            table = whole.filter(pc.equal(whole.column("words"), words)).combine_chunks()
            if not table.num_rows:
                continue
            data, offsets = _bytes_of(table)
            gram, windows = table.column("gram").to_numpy(), table.column("windows").to_numpy().astype(np.int64)
            if words:
                piece, window, name = _passage_windows(*_passage_words(data, offsets, windows, passage), windows, gram, passage)
                key = table.column("key").to_numpy()[piece]
                order = np.lexsort((key, name))
                fresh = np.ones(len(order), bool)
                fresh[1:] = name[order][1:] != name[order][:-1]
                head = np.flatnonzero(fresh)
                count = np.diff(np.append(head, len(order)))
                several = key[order][head] != key[order][head + count - 1]
                several |= np.logical_or.reduceat(~np.array(table.column("lone").to_pylist(), bool)[piece][order], head)  # stands for several documents
                found = np.sort(order[np.repeat(several, count)])
                spans = _spans(table, piece[found], window[found], "word", passage)
            else:
                _, group = np.unique(gram, return_inverse=True)
                spans = _spans(table, *repeated_windows(data, offsets[:-1], windows, table.column("place").to_numpy().astype(np.int64), group, length, block), "first", length)
            yield pa.RecordBatch.from_arrays([*spans, pa.array(np.full(len(spans[0]), words))], _names(_SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                weight = sum(b.column(10).nbytes for b in held)
                if weight >= SORT_BYTES:  # only cut between groups
                    gram = held[-1].column(0)[-1].as_py()
                    mine = batch.column(0).to_numpy()
                    other = np.flatnonzero(mine != gram)
                    cut = int(other[0]) if len(other) else batch.num_rows
                    if cut:
                        held.append(batch.slice(0, cut))
                        batch = batch.slice(cut)
                        if not batch.num_rows:
                            break
                    yield from solve(held)
                    held = []
                held.append(batch)
                break
        if held:
            yield from solve(held)

    return run


def _split_pieces(length: int, block: int):
    """Cut segments into blocks of windows: digests of the bytes that all windows of a block hold and of the whole block,
    and the bytes before and after the common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            gram, key, size, first, windows, place, lone, piece = (batch.column(c).to_pylist() for c in ("gram", "key", "size", "first", "windows", "place", "lone", "piece"))
            for k, held in enumerate(piece):
                at = 0
                while at < windows[k]:
                    distance = place[k] - at  # of the window to its anchor; blocks are cut at multiples of ``block``
                    count = min(distance % block + 1, windows[k] - at)
                    core_from = place[k] - distance // block * block  # the last window that the block can have
                    core_to = core_from - block + 1 + length
                    end = at + count - 1 + length
                    name = gram[k].to_bytes(8, "little", signed=True) + (distance // block).to_bytes(8, "little", signed=True)
                    core = hashlib.blake2b(held[core_from:core_to], digest_size=16, salt=name).digest()
                    whole = hashlib.blake2b(held[at:end], digest_size=16, salt=distance.to_bytes(8, "little", signed=True)).digest()
                    rows.append((*np.frombuffer(core + whole, np.int64).tolist(), key[k], size[k], first[k] + at, count, lone[k], held[at:core_from], held[core_to:end]))
                    at += count
            types = [pa.int64()] * 7 + [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), types, strict=True)], _names(_CELL))

    return run


def _split_cells(length: int, block: int):
    """Cut blocks into windows: a digest of each window's bytes before and after the common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            core, check, key, size, start, windows, lone, before, after = (batch.column(i).to_pylist() for i in range(9))
            for k in range(batch.num_rows):
                for w in range(windows[k]):
                    left = before[k][w:]
                    right = after[k][: max(0, block - 1 - len(left))]
                    name = np.frombuffer(hashlib.blake2b(left + right, digest_size=16, salt=len(left).to_bytes(8, "little")).digest(), np.int64).tolist()
                    rows.append((core[k], check[k], *name, lone[k], key[k], size[k], start[k] + w, start[k] + w + length))
            types = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 4
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), types, strict=True)], _names(_WINDOW))

    return run


def _split_passages(passage: int):
    """Cut pieces into blocks of windows of words: hashes of the words that all windows of a block hold, of the whole block,
    and of each window."""
    part = min(PART, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                table = pa.Table.from_batches([batch.slice(k, 500)]).combine_chunks()
                windows, gram, place = (table.column(c).to_numpy() for c in ("windows", "gram", "place"))
                windows, place = windows.astype(np.int64), place.astype(np.int64)
                hashes, first_word = _passage_words(*_bytes_of(table), windows, passage)
                piece, window, name = _passage_windows(hashes, first_word, windows, gram, passage)
                cell = (place[piece] - window) // part  # by the distance to the anchor, as in _split_pieces
                fresh = np.ones(len(piece), bool)
                fresh[1:] = (piece[1:] != piece[:-1]) | (cell[1:] != cell[:-1])
                head = np.flatnonzero(fresh)
                bounds = np.append(head, len(piece))
                one, cell = piece[head], cell[head]
                core = tk.window_hashes(hashes, passage - part + 1)[first_word[one] + place[one] - cell * part]
                core = tk.mix(core + tk.mix(tk.mix(gram.view(np.uint64))[one] + cell.astype(np.uint64)))
                whole = tk.mix(name[head] + tk.mix(name[bounds[1:] - 1] + np.diff(bounds).astype(np.uint64)))  # the two cover the block
                columns = [core.view(np.int64), whole.view(np.int64), *(table.column(c).to_numpy()[one] for c in ("key", "size")), table.column("word").to_numpy()[one] + window[head], np.array(table.column("lone").to_pylist(), bool)[one]]
                names = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(name.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), names], _names(_PASSAGE))

    return run


def _several(rows: DataFrame, *by: str) -> DataFrame:
    """The keys that more than one row has, as a table, so that joins with them can split a key with very many rows."""
    return materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by))


def _split_by_content(pieces: DataFrame, length: int, block: int) -> DataFrame:
    """Spans of the windows of hot anchors that are repeated."""
    core, whole = ["core", "core_check"], ["core", "core_check", "whole", "whole_check"]
    cells = materialize(pieces.mapInArrow(_split_pieces(length, block), _CELL))
    cells = materialize(cells.join(_several(cells, *core), core, "left_semi"))
    classes = materialize(cells.groupBy(*whole).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "size", "start", "windows", "lone", "before", "after")).alias("one")))
    equal = cells.where("lone").join(classes.where("n > 1").select(*whole), whole, "left_semi")
    spans = equal.select("key", "size", "start", (F.col("start") + F.col("windows") - 1 + length).alias("stop"))
    open_ = classes.join(_several(classes, *core), core, "left_semi").select(*core, "one.key", "one.size", "one.start", "one.windows", (F.col("one.lone") & (F.col("n") == 1)).alias("lone"), "one.before", "one.after")
    windows = materialize(open_.mapInArrow(_split_cells(length, block), _WINDOW))
    name = [*core, "window", "window_check"]
    again = windows.where("lone").join(_several(windows, *name), name, "left_semi").select("key", "size", "start", "stop")
    return spans.unionByName(again).withColumn("words", F.lit(False))


def _in_several(rows: DataFrame, *by: str) -> DataFrame:
    """The keys that more than one document holds, as a table; a row that is not lone stands for several."""
    held = rows.groupBy(*by).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.bool_and("lone").alias("lone"))
    return materialize(held.where("low < high or not lone").select(*by))


def _split_by_window(pieces: DataFrame, passage: int) -> DataFrame:
    """Spans of the windows of words at hot anchors that another document holds too."""
    whole, spot = ["core", "whole"], ["key", "size", "start", "names"]
    cells = materialize(pieces.mapInArrow(_split_passages(passage), _PASSAGE))
    cells = materialize(cells.join(_in_several(cells, "core"), "core", "left_semi"))
    equal = _in_several(cells, *whole)
    settled = cells.join(equal, whole, "left_semi")
    spans = settled.where("lone").select("key", "size", "start", (F.col("start") + F.size("names") - 1 + passage).alias("stop"))
    open_ = materialize(cells.join(equal, whole, "left_anti").select("core", *spot))
    # a settled block is a partner of the open ones beside it as well
    mates = settled.join(open_.select("core").distinct(), "core", "left_semi").groupBy(*whole).agg(F.min(F.struct(*spot)).alias("one"))
    both = open_.select(*spot, F.lit(True).alias("lone")).unionByName(mates.select("one.*", F.lit(False).alias("lone")))
    windows = materialize(both.select("key", "size", "lone", "start", F.posexplode("names").alias("at", "name")))
    again = windows.where("lone").join(_in_several(windows, "name"), "name", "left_semi")
    spans = spans.unionByName(again.select("key", "size", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + passage).alias("stop")))
    return spans.withColumn("words", F.lit(True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite each document's spans and remove them; count the words of its passages."""
    types = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for part, data, offsets in tk.slices(batch):
            held = memoryview(data.tobytes())
            for r, (doc, spans) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                text = held[offsets[r] : offsets[r + 1]]
                digest, at = hashlib.sha256(), 0
                removed = _united((x["start"], x["stop"]) for x in spans or () if not x["words"])
                for start, stop in removed:
                    digest.update(text[at:start])
                    at = stop
                digest.update(text[at:])
                passages = _united((x["start"], x["stop"]) for x in spans or () if x["words"])
                rows.append((doc, len(text), sum(z - a for a, z in removed), len(removed), digest.hexdigest(), sum(z - a for a, z in passages)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(RESULT))


def _united(spans) -> list[list[int]]:
    """Spans that overlap or touch made one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, group: int = GROUP, passage: int = PASSAGE) -> DataFrame:
    """(key, size, start, stop, words) of repeated spans of ``docs`` (key, size, text), of bytes or words; they may overlap."""
    block = min(block, length)
    found = materialize(docs.select("key", "text").mapInArrow(_find_anchors(length, passage), _ANCHOR))
    # a table of its own, so that the join can split a gram that very many documents hold
    anchors = materialize(found.join(_several(found, "gram"), "gram", "left_semi"))
    discard(found)
    release(docs.sparkSession)
    name, place = ["gram", "segment", "check"], ["key", "size", "first", "stop", "word", "windows", "place", "words"]
    classes = anchors.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.min(F.struct(*place)).alias("one"))
    # equal strings count wherever they are, equal passages in different documents only
    classes = materialize(classes.withColumn("equal", F.when(F.col("one.words"), F.col("low") < F.col("high")).otherwise(F.col("n") > 1)).drop("low", "high"))
    equal = anchors.join(classes.where("equal").select(*name), name, "left_semi")
    stop = F.when(F.col("words"), F.col("word") + F.col("windows") - 1 + passage).otherwise(F.col("stop"))
    spans = equal.select("key", "size", F.when(F.col("words"), F.col("word")).otherwise(F.col("first")).alias("start"), stop.alias("stop"), "words")
    mixed = materialize(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    largest = mixed.agg(F.max("kinds")).first()[0] or 0
    if not largest:
        return spans
    one = classes.join(mixed, "gram").select("gram", "segment", "check", "n", (F.col("kinds") > group).alias("large"), (~F.col("equal")).alias("lone"), "one")
    first = one.select("gram", "large", "lone", "one.*")
    # of a passage that one document holds several times, all places are looked at
    more = anchors.where("words").join(one.where("lone and n > 1").select(*name, "large", "lone", "one"), name).where(F.struct(*place) != F.col("one")).select("gram", "large", "lone", *place)
    wanted = first.unionByName(more).groupBy("key", "size").agg(F.collect_list(F.struct("gram", "first", "stop", "word", "windows", "place", "lone", "words", "large")).alias("wanted"))
    pieces = materialize(docs.join(wanted, ["key", "size"]).select("key", "size", "text", "wanted").mapInArrow(_cut_pieces, _PIECE))
    release(docs.sparkSession)
    gathered = pieces.where("not large").repartition("gram").sortWithinPartitions("gram")
    spans = spans.unionByName(gathered.mapInArrow(_sort_pieces(length, block, passage), _SPAN))
    if largest > group:
        spans = spans.unionByName(_split_by_content(pieces.where("large and not words"), length, block))
        spans = spans.unionByName(_split_by_window(pieces.where("large and words"), passage))
    spans = materialize(spans)
    release(docs.sparkSession)
    return spans


def dedup_substrings(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, group: int = GROUP, passage: int = PASSAGE) -> DataFrame:
    """Sizes, removed bytes, the digest of what is left, and the words in passages that other documents hold too, of each
    row of ``docs`` (doc_id, text)."""
    tk.batch_conf(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.octet_length("text").cast("long").alias("size"), "text")
    spans = repeated_spans(source, length, block, group, passage)
    by_doc = spans.groupBy("key", "size").agg(F.collect_list(F.struct("start", "stop", "words")).alias("spans"))
    return source.join(by_doc, ["key", "size"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, RESULT)
