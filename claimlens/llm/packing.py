"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become token ids (a task encodes each distinct word once), and only longer ones are cut.  The pieces are
dealt out by hash to leaves, so each leaf has a fair sample of all lengths, and every leaf packs its own pieces best fit,
longest first.  Nearly full bins are done.  The others go up a tree as items of their own: each node packs the
underfull bins of its children best fit once more, until one root is left.

Above the leaves, bins of one fill are alike, so a node works on the number of bins of each fill: at most ``capacity`` numbers for each
child, however many bins there are.  What it decides is a list of ranges (bins number lo to hi of that child and fill go to bins of that node at
that offset), and the ranges of all levels are composed by joins before the pieces meet them once.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, materialise

SLICE, LEAF, FAN = 8 << 20, 1 << 15, 16
PLAIN, MARK = K.lut([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]), K.lut(b".,;:!?")
_PLACED = pa.schema([("row", pa.int64()), ("leaf", pa.int64()), ("fill", pa.int32()), ("number", pa.int64()), ("at", pa.int32())])
_STEP = pa.schema([("child", pa.int64()), ("fill", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("node", pa.int64()), ("new_fill", pa.int32()), ("new_low", pa.int64()), ("shift", pa.int32())])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


K.CACHES.append(_tokenizer.cache_clear)


class Words:
    """Ids of the words that a task has met; begun anew once it has met very many."""

    def __init__(self, path: str, most: int = 400_000):
        self.path, self.most, self.known = path, most, {}
        self.ids, self.start, self.many = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, words: list[str], lot: int = 256) -> np.ndarray:
        """For each of these different words its place in ``start`` and ``many``."""
        if len(self.known) > self.most:
            self.__init__(self.path, self.most)
        fresh = [w for w in words if w not in self.known]
        ids, many = [self.ids], [self.many]
        lots = [fresh[i : i + lot] for i in range(0, len(fresh), lot)]  # words go to the tokenizer one on a line
        for at in range(0, len(lots), 64):
            for own, found in zip(lots[at : at + 64], _tokenizer(self.path).encode_batch(["\n".join(w) for w in lots[at : at + 64]], add_special_tokens=False)):
                end = np.cumsum([len(w) + 1 for w in own])
                first = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
                ids.append(np.array(found.ids, np.uint32))
                many.append(np.bincount(np.searchsorted(end, first, "right"), minlength=len(own)))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.ids, self.many = np.concatenate(ids), np.concatenate(many)
        self.start = np.cumsum(self.many) - self.many
        return np.array([self.known[w] for w in words], np.int64)


def token_ids(words: Words, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, ``end`` after each, and the offset of each text.

    White space never lies within a token nor changes what stands beside it, nor does the border between an ASCII letter or
    digit and one of ``.,;:!?``; so a text's ids are those of its words.  The case of ASCII letters counts for nothing in words without other letters
    (beside a combining mark it may).
    """
    data, off = K.flat(texts)
    plain, mark = PLAIN[data], MARK[data]
    cuts = np.union1d(off, np.flatnonzero((plain[:-1] & mark[1:]) | (mark[:-1] & plain[1:])) + 1)
    start, stop, first = K.words(data, cuts, K.SPACE)
    first = first[np.searchsorted(cuts, off)]
    size = stop - start
    border = np.concatenate(([0], np.cumsum(size)))
    letters = data[~K.SPACE[data]]
    if len(start):
        ascii_only = np.maximum.reduceat(letters, border[:-1]) < 0x80
        letters = np.where(np.repeat(ascii_only, size), K.LOWER[letters], letters)
    coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(border), pa.py_buffer(letters)]).dictionary_encode()
    code = words.codes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    count = words.many[code]
    total = np.concatenate(([0], np.cumsum(count)))[first]
    total = total + np.arange(len(total))  # an end after each text
    out = np.full(total[-1], end, np.uint32)
    kept = np.ones(len(out), bool)
    kept[total[1:] - 1] = False
    out[kept] = words.ids[K.ranges(words.start[code], count)]
    return out, total


def _pieces(path: str, capacity: int, with_ids: bool):
    @K.lean
    def run(batches):
        row, words = TaskContext.get().partitionId() << 33, Words(path)
        for batch in batches:
            for part in K.slices(batch, size=SLICE):
                ids, off = token_ids(words, part.column("text"))
                many = -(-np.diff(off) // capacity)
                doc = np.repeat(np.arange(part.num_rows), many)
                piece = K.ranges(np.zeros(len(many), np.int64), many)
                low = off[doc] + piece * capacity
                high = np.minimum(low + capacity, off[doc + 1])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist())]
                columns = [pa.array(np.arange(row, row + len(doc))), part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(high - low), pa.array(crc, pa.int64())]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:  # pieces lie back to back
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, off[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                row += len(doc)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def best_fit(sizes: list[int], counts: list[int], capacity: int):
    """Items of falling ``sizes``, ``counts`` of each, one by one to the fullest bin that has room.

    Gives moves ``(size, low, n, bin, at)`` (items number low to low + n of that size go to bins bin to bin + n, one each,
    at that offset) and bins ``(first, n, fill)``.  Bins of one fill are taken together, so the
    steps grow with the number of sizes and not of items.
    """
    room: list[int] = []  # rising
    bins: dict[int, list[tuple[int, int]]] = {}
    moves, used = [], 0

    def put(left: int, first: int, n: int):
        if left not in bins:
            bins[left] = []
            insort(room, left)
        bins[left].append((first, n))

    for size, count in zip(sizes, counts):
        low = 0
        while low < count:
            i = bisect_left(room, size)
            if i < len(room):
                left = room[i]
                first, n = bins[left].pop()
                if not bins[left]:
                    del bins[left], room[i]
            else:
                left, first, n = capacity, used, count
            each = min(left // size, count - low)
            n_now = min(n, (count - low) // each)
            for j in range(each):
                moves.append((size, low + j * n_now, n_now, first, capacity - left + j * size))
            low += each * n_now
            put(left - each * size, first, n_now)
            if first == used:
                used += n_now
            elif n > n_now:
                put(left, first + n_now, n - n_now)
    return moves, [(first, n, capacity - left) for left, own in bins.items() for first, n in own]


def _numbered(bins, total: int):
    """For each bin its fill and its number among the bins of that fill."""
    fill = np.zeros(total, np.int64)
    for first, n, f in bins:
        fill[first : first + n] = f
    order = np.argsort(fill, kind="stable")
    new = np.flatnonzero(K.group_starts(fill[order])) if total else np.zeros(0, np.int64)
    number = np.empty(total, np.int64)
    number[order] = np.arange(total) - np.repeat(new, np.diff(np.append(new, total)))
    return fill, number


def _pack_leaf(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        row, length = (table.column(c).to_numpy() for c in ("row", "length"))
        order = np.lexsort((row, -length))
        sizes, counts = (x[::-1] for x in np.unique(length, return_counts=True))
        begin = dict(zip(sizes.tolist(), (np.cumsum(counts) - counts).tolist()))
        moves, bins = best_fit(sizes.tolist(), counts.tolist(), capacity)
        of, at = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        for size, low, n, first, place in moves:
            mine = order[begin[size] + low : begin[size] + low + n]
            of[mine], at[mine] = np.arange(first, first + n), place
        fill, number = _numbered(bins, max((first + n for first, n, _ in bins), default=0))
        leaf = table.column("leaf").combine_chunks()
        return pa.Table.from_batches([K.table(_PLACED, pa.array(row), leaf, pa.array(fill[of], pa.int32()), pa.array(number[of]), pa.array(at, pa.int32()))])

    return run


def _merge(capacity: int):
    """One node: bins of its children, counted by child and fill, packed best fit; the ranges that move."""

    def run(table: pa.Table) -> pa.Table:
        child, fill, n = (table.column(c).to_numpy() for c in ("child", "fill", "n"))
        order = np.lexsort((child, -fill))
        child, fill, n = child[order], fill[order], n[order]
        new = np.flatnonzero(K.group_starts(fill))
        counts = np.add.reduceat(n, new)
        moves, bins = best_fit(fill[new].tolist(), counts.tolist(), capacity)
        begin = np.cumsum(n) - n - np.repeat(np.cumsum(counts) - counts, np.diff(np.append(new, len(fill))))  # first number of each child among its fill
        of_size = {int(f): slice(a, b) for f, a, b in zip(fill[new], new, np.append(new[1:], len(fill)))}
        shelf: dict[int, int] = {}
        place = []  # bins by their first number: fill, and number of the first among that fill
        for first, many, full in sorted(bins):
            place.append((first, full, shelf.get(full, 0)))
            shelf[full] = shelf.get(full, 0) + many
        firsts = [p[0] for p in place]
        out = []
        for size, low, many, first, at in moves:
            own = of_size[size]
            for c, b, m in zip(child[own].tolist(), begin[own].tolist(), n[own].tolist()):
                a, z = max(low, b), min(low + many, b + m)
                while a < z:  # the bins of a move may since have come to differ
                    i = bisect_left(firsts, first + a - low + 1) - 1
                    until = firsts[i + 1] if i + 1 < len(firsts) else math.inf
                    stop = int(min(z, until - first + low))
                    out.append((c, size, a - b, stop - b, place[i][1], place[i][2] + first + a - low - place[i][0], at))
                    a = stop
        columns = list(zip(*out))
        node = [table.column("node")[0].as_py()] * len(out)
        columns[4:4] = [node]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STEP)], schema=_STEP)

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, slack: int = 4, ids: bool = False, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row per piece of ``doc_id, text``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``.

    ``path`` is a tokenizer's file; a document is its ids and then id 0, so a null or empty text is one token.  Only documents of
    more than ``capacity`` tokens are cut, into pieces of that many, the last of what is left.  A bin with at most ``slack`` tokens of room is done.
    Pieces of one sequence lie back to back from offset 0.

    Every row is a document of its own, also where a doc_id repeats or is null.  No rows give no rows; other columns are ignored.  The
    result, a written table, depends on the order of the rows in the files but not on how tasks run.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    columns = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    pieces = materialise(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, ids), columns), "pieces")
    leaves = max(1, -(-pieces.count() // leaf))
    items = pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(leaves)).alias("leaf"))
    placed = materialise(items.groupBy("leaf").applyInArrow(_pack_leaf(capacity), "row long, leaf long, fill int, number long, at int"), "placed")
    plan, scrap = _tree(placed, leaves, capacity, slack, fan)
    most = placed.groupBy("leaf").count().agg(F.max("count")).first()[0] or 0  # a leaf has no more bins than pieces
    node_bits, bin_bits, fan_bits = leaves.bit_length(), int(most).bit_length(), (fan - 1).bit_length()
    width = node_bits + bin_bits + fan_bits  # of a bin's number within its level and fill: a node has fan times the bins of its children
    if (len(scrap) + 1) * (capacity + 1) << width >= 1 << 63:
        raise ValueError("too many bins for a long")
    mine = placed.join(plan, (F.col("leaf") == F.col("p_leaf")) & (F.col("fill") == F.col("p_fill")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")), "left")
    level, node, full = F.coalesce("level", F.lit(0)).cast("long"), F.coalesce("node", "leaf"), F.coalesce("new_fill", "fill").cast("long")
    number = F.coalesce(F.col("new_low") + F.col("number") - F.col("low"), F.col("number"))
    span = F.element_at(F.array(*[F.lit(1 << (bin_bits + fan_bits * t)) for t in range(len(scrap) + 1)]), (level + 1).cast("int"))
    sequence = (level * (capacity + 1) + full) * F.lit(1 << width) + node * span + number
    where = mine.select("row", sequence.alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * ids
    out = materialise(pieces.join(where, "row").select(*names), "packed")
    for table in (pieces, placed, *scrap):
        discard(table)
    return out


def _tree(placed: DataFrame, leaves: int, capacity: int, slack: int, fan: int):
    """Where the underfull bins of each leaf end: ranges of their numbers to ``level, node, new_fill, new_low`` and the offset there."""
    now = placed.groupBy(F.col("leaf").alias("node"), "fill").agg((F.max("number") + 1).alias("n")).where(F.col("fill") < capacity - slack)
    done, open_, scrap, level, nodes = [], None, [], 0, leaves
    while nodes > 1:
        nodes, level = -(-nodes // fan), level + 1
        up = now.select(F.expr(f"node div {fan}").alias("node"), F.col("node").alias("child"), "fill", F.col("n").cast("long").alias("n"))
        step = materialise(up.groupBy("node").applyInArrow(_merge(capacity), "child long, fill int, low long, high long, node long, new_fill int, new_low long, shift int"), "steps")
        scrap.append(step)
        if open_ is None:
            both = step.select(F.col("child").alias("p_leaf"), F.col("fill").alias("p_fill"), "low", "high", "node", "new_fill", "new_low", "shift")
        else:
            a, b = open_.alias("a"), step.alias("b")
            low, high = F.greatest("a.new_low", "b.low"), F.least(F.col("a.new_low") + F.col("a.high") - F.col("a.low"), F.col("b.high"))
            met = a.join(b, (F.col("a.node") == F.col("b.child")) & (F.col("a.new_fill") == F.col("b.fill")) & (low < high))
            back = F.col("a.low") - F.col("a.new_low")
            both = met.select("p_leaf", "p_fill", (low + back).alias("low"), (high + back).alias("high"), F.col("b.node").alias("node"), F.col("b.new_fill").alias("new_fill"), (F.col("b.new_low") + low - F.col("b.low")).alias("new_low"), (F.col("a.shift") + F.col("b.shift")).alias("shift"))
        both = both.withColumn("level", F.lit(level))
        rest = F.col("new_fill") < capacity - slack
        open_ = both.where(rest)
        done.append(both.where(~rest))
        now = step.where(rest).groupBy("node", F.col("new_fill").alias("fill")).agg(F.max(F.col("new_low") + F.col("high") - F.col("low")).alias("n"))
    if open_ is None:
        empty = "p_leaf long, p_fill int, low long, high long, node long, new_fill int, new_low long, shift int, level int"
        return placed.sparkSession.createDataFrame([], empty), scrap
    out = open_
    for part in done:
        out = out.union(part)
    return out, scrap


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of a result with ``ids``: ``sequence_id, ids`` and ``parts`` (doc_id, piece, offset, length), by offset."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))  # a sequence holds capacity tokens at most
    parts = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return whole.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), parts.alias("parts"))
