"""Suffix-array dedup over bytes: every byte inside a repeated string of ``length`` bytes goes.

A string of 200 bytes always contains the minimum of the hashes of its 32-byte grams, so
texts are cut into comparable places ("anchors") by content, about one in 85 bytes.
Anchors whose gram occurs once cannot lie in a repeated string.  The rest bring their
surroundings (at most 168 bytes to the left and 200 to the right) to the task that owns
the gram.  There the suffixes that start at the anchors, and the reversed prefixes that
end there, are sorted by a mergesort whose comparisons find the common extension of two
suffixes by binary search over prefix polynomial hashes.  The extensions of neighbours
are then checked byte by byte; if a hash has lied, the lot is sorted again by its bytes.
From the two orders follows, for each anchor, which of the strings around it repeat.

Copies of one surrounding within a task are settled there, and grams with more than
``hot`` occurrences are compared by the hash of each single string instead, again
settled per task first, so neither copies nor common lines gather in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import dealt, dealt_texts, join_hot, materialise, own_places, texts

GRAM = 32
LOT_ROWS = 5_000
SORT_ROWS = 2_000  # surroundings sorted at a time, unless one gram has more: some ten arrays of 8 bytes for each of their bytes
SHARED_ROWS = 1_000  # neighbours compared at a time: four arrays of 8 bytes for each of their bytes
SLICE_BYTES = 1 << 18  # of text at a time: a dozen arrays of 8 bytes for each of them stand beside it
ANCHOR_ROWS = 300_000  # settled at a time
MOST_HOT = 100_000  # hot grams that are broadcast: 2 MB
_ANCHOR = pa.schema([("key", pa.int64()), ("gram", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("many", pa.int32())])
_HIT = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
_AROUND = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("around", pa.binary()), ("known", pa.bool_())])
_AROUND_SQL = "key long, key2 long, doc_id long, pos int, left int, around binary, known boolean"
_SPAN = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out, span = pick(out[:-span], out[span:]), 2 * span
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each byte; computed like ``span_hashes`` of equal spans."""
    at = np.arange(max(0, len(data) - GRAM + 1))
    return K.span_hashes(data, at, at + GRAM)


def anchor_places(data: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Places whose gram hash is the least of some string of ``length`` bytes in one text."""
    width, n = length - GRAM + 1, len(data)
    if n < length:
        return np.zeros(0, np.int64)
    h = _gram_hashes(data)
    low = _sliding(h, width, np.minimum)  # one for each of the n - length + 1 strings
    inside = np.repeat(off[1:], np.diff(off))[: len(low)] - np.arange(len(low)) >= length
    low = np.where(inside, low, K.U64(0))
    pad = np.zeros(width - 1, K.U64)
    most = _sliding(np.concatenate((pad, low, pad)), width, np.maximum)
    return np.flatnonzero((most == h) & (most > 0))


def _anchors(length: int):
    def settle(columns, seed, counter):
        h, doc, pos = columns
        order = np.argsort(h)
        h, doc, pos = h[order], doc[order], pos[order]
        new = K.group_starts(h)
        key = K.spread(h, ~new, seed, counter)
        # the first of a run stands for all of it, the others are known to repeat
        return K.table(_ANCHOR, key, pa.array(h, pa.int64(), mask=key == h), doc, pos, np.where(new, K.run_lengths(new), 0).astype(np.int32))  # null: the gram is the key

    def run(batches):
        seed, counter, buffer = TaskContext.get().partitionId() + 1, 0, K.Buffer(3, ANCHOR_ROWS)
        for batch in batches:
            for part in K.slices(batch, size=SLICE_BYTES):
                data, off = K.flat(part.column("text"))
                at = anchor_places(data, off, length)
                row = np.searchsorted(off, at, "right") - 1
                h = K.span_hashes(data, at, at + GRAM).view(np.int64)
                if buffer.add(h, K.ints(part, "doc_id")[row], (at - off[row]).astype(np.int32)):
                    yield settle(buffer.take(), seed, counter)
                    counter += 4 * K.BUFFER_ROWS
        if (rest := buffer.take()) is not None:
            yield settle(rest, seed, counter)

    return run


def _repeated(hot: int):
    """Anchors whose gram occurs again, and a row without a place for each gram of more than ``hot`` occurrences."""

    def run(batches):
        named = (pa.RecordBatch.from_arrays([pc.coalesce(b.column("gram"), b.column("key")) if n == "gram" else b.column(n) for n in b.schema.names], names=b.schema.names) for b in batches)
        got = K.gather(named, ["key", "gram", "doc_id", "pos", "many"])
        if got is None:
            return
        key, gram, doc, pos, many = got
        order = np.argsort(key)
        new = K.group_starts(key[order])
        at = np.flatnonzero(new)
        crowded = gram[order[at[np.add.reduceat(many[order], at) > hot]]]
        order = order[(K.run_lengths(new) > 1) | (many[order] != 1)]
        yield K.table(_HIT, gram[order], doc[order], pos[order].astype(np.int32))
        if len(crowded):
            none = [None] * len(crowded)
            yield K.table(_HIT, crowded, pa.array(none, pa.int64()), pa.array(none, pa.int32()))

    return run


def _around(length: int):
    """Surroundings of the repeated anchors; single strings around those of hot grams
    (whose places come negative)."""
    reach = length - GRAM

    def empty(n):
        return pa.array([None] * n, pa.binary())

    def settle_around(columns, seed, counter):
        h, h2, gram, doc, pos, left, start, size = columns[:8]
        data = columns[8]
        order = np.lexsort((pos, doc, h2, h))
        order = order[K.group_starts(h[order], h2[order], doc[order], pos[order])]
        new = K.group_starts(h[order], h2[order])
        known = K.run_lengths(new) > 1
        lead = order[new]
        body = data[K.ranges(start[lead], size[lead])]
        offsets = np.concatenate(([0], np.cumsum(size[lead]))).astype(np.int32)
        around = pa.BinaryArray.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        yield K.table(_AROUND, gram[lead], np.zeros(len(lead), np.int64), doc[lead], pos[lead].astype(np.int32), left[lead].astype(np.int32), around, known[new])
        rest = order[~new]
        if len(rest):  # copies: all strings around them repeat; they only report their place
            yield K.table(_AROUND, K.random_keys(len(rest), seed, counter), np.zeros(len(rest), np.int64), doc[rest], (pos[rest] - left[rest]).astype(np.int32), size[rest].astype(np.int32), empty(len(rest)), np.ones(len(rest), bool))

    def settle_single(h, h2, doc, pos, seed, counter):
        order = np.lexsort((pos, doc, h2, h))
        order = order[K.group_starts(h[order], h2[order], doc[order], pos[order])]
        h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
        new = K.group_starts(h, h2)
        known = K.run_lengths(new) > 1
        return K.table(_AROUND, K.spread(h, known & ~new, seed, counter), h2, doc, pos.astype(np.int32), np.full(len(h), length, np.int32), empty(len(h)), known)

    def run(batches):
        seed, counter = TaskContext.get().partitionId() + 1, 0
        lots, rows = [], 0
        for batch in batches:
            for part in K.slices(batch, size=SLICE_BYTES):
                data, off = K.flat(part.column("text"))
                places, ids = part.column("anchors"), K.ints(part, "doc_id")
                row = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
                place = places.flatten().to_numpy().astype(np.int64)
                hot = place < 0
                at = np.where(hot, -place - 1, place) + off[row]
                start, end = np.maximum(at - reach, off[row]), np.minimum(at + length, off[row + 1])
                if hot.any():
                    many = np.maximum(0, end[hot] - length - start[hot] + 1)
                    many = np.minimum(many, reach + 1)
                    s = np.unique(K.ranges(start[hot], many))
                    values = data.astype(np.uint64) + K.U64(1)
                    h, h2 = (K.window_hashes(values, length, i)[s].view(np.int64) for i in (0, 1))
                    r = np.searchsorted(off, s, "right") - 1
                    yield settle_single(h, h2, ids[r], s - off[r], seed, counter)
                    counter += 4 * K.BUFFER_ROWS
                cold = ~hot & (end - start >= length)
                row, at, start, end = row[cold], at[cold], start[cold], end[cold]
                if not len(at):
                    continue
                size = end - start
                h = K.mix(K.span_hashes(data, start, end) ^ K.mix(at.astype(np.uint64) - start.astype(np.uint64)))
                h2 = K.span_hashes(255 - data, start, end)
                gram = K.span_hashes(data, at, at + GRAM).view(np.int64)
                body = data[K.ranges(start, size)]
                lots.append([h.view(np.int64), h2.view(np.int64), gram, ids[row], at - off[row], at - start, size, body])
                rows += len(at)
                if rows >= LOT_ROWS:
                    yield from settle_around(_stack(lots), seed, counter)
                    lots, rows, counter = [], 0, counter + 4 * K.BUFFER_ROWS
        if lots:
            yield from settle_around(_stack(lots), seed, counter)

    return run


def _stack(lots):
    h, h2, gram, doc, pos, left, size, body = (np.concatenate([x[i] for x in lots]) for i in range(8))
    return h, h2, gram, doc, pos, left, np.cumsum(size) - size, size, body


class _Prefixes:
    """Prefix polynomial hashes of a byte array: equality of two spans in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, self.down = K.powers(K._P, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, K.U64)
        np.cumsum(K._BYTE[data] * self.up[:-1], out=self.sums[1:])

    def same(self, x, y, size):
        return (self.sums[x + size] - self.sums[x]) * self.down[x] == (self.sums[y + size] - self.sums[y]) * self.down[y]

    def common(self, x, y, most):
        """Length of the common extension of the suffixes at x and y, at most ``most``."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.same(x, y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def suffix_order(rank: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, by_bytes: bool = False):
    """Sort the spans ``data[start : start + size]`` by (rank, bytes), a prefix before its
    extensions.  Returns the order and, for each place in it, the length shared with the
    span before it (0 where the rank differs), checked against the bytes."""
    n = len(start)
    if by_bytes:
        raw = data.tobytes()
        order = np.array(sorted(range(n), key=lambda i: (rank[i], raw[start[i] : start[i] + size[i]])), np.int64)
    else:
        order = _merge_sort(rank, _Prefixes(data), start, size)
    shared = np.zeros(n, np.int64)
    for lot in range(1, n, SHARED_ROWS):
        at = np.arange(lot, min(n, lot + SHARED_ROWS))
        x, y = order[at - 1], order[at]
        most = np.where(rank[x] == rank[y], np.minimum(size[x], size[y]), 0)
        width = int(most.max(initial=0))
        step = np.arange(width)
        last = max(0, len(data) - 1)
        same = data[np.minimum(start[x][:, None] + step, last)] == data[np.minimum(start[y][:, None] + step, last)]
        same &= step < most[:, None]
        shared[at] = np.where(same.all(axis=1), width, np.argmin(same, axis=1)) if width else 0
        if not by_bytes:  # neighbours must ascend by their bytes, else a hash has lied
            both = (rank[x] == rank[y]) & (shared[at] < most)
            i, m = np.flatnonzero(both), shared[at][both]
            wrong = data[start[x[i]] + m] > data[start[y[i]] + m]
            ended = (rank[x] == rank[y]) & (shared[at] == most) & (size[x] > size[y])
            if wrong.any() or ended.any():
                return suffix_order(rank, data, start, size, True)
    return order, shared


def _merge_sort(rank, prefixes: _Prefixes, start, size):
    """Bottom-up mergesort of all runs of a level at once.  Every element finds its place
    in the sibling run by binary search; each comparison is a common extension."""
    n, data = len(start), prefixes.data

    def after(x, y):
        """Elements x sort after elements y (of the same rank)."""
        most = np.minimum(size[x], size[y])
        m = prefixes.common(start[x], start[y], most)
        done = m == most
        i = np.minimum(m, np.maximum(most - 1, 0))
        ax = data[np.minimum(start[x] + i, len(data) - 1)]
        ay = data[np.minimum(start[y] + i, len(data) - 1)]
        return np.where(done, size[x] > size[y], ax > ay)

    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    group_low = np.searchsorted(ranked, ranked, "left")
    group_high = np.searchsorted(ranked, ranked, "right")
    width = 1
    while width < n:
        middle = np.arange(width, n, 2 * width)  # first element of each right run
        middle = middle[ranked[middle] == ranked[middle - 1]]
        middle = middle[after(order[middle - 1], order[middle])] if len(middle) else middle
        if len(middle):
            low = np.maximum(group_low[middle], middle - width)  # only one rank straddles a border
            high = np.minimum(group_high[middle], np.minimum(middle + width, n))
            place = K.ranges(low, high - low)
            mid, lo_, hi_ = (np.repeat(v, high - low) for v in (middle, low, high))
            right = place >= mid
            lo, hi = np.where(right, lo_, mid), np.where(right, mid, hi_)
            base = lo.copy()
            own = order[place]
            while (open_ := np.flatnonzero(lo < hi)).size:
                probe = (lo[open_] + hi[open_]) >> 1
                other, mine, is_right = order[probe], own[open_], right[open_]
                # a right element goes after equal left ones, a left one before equal right ones
                x, y = np.where(is_right, other, mine), np.where(is_right, mine, other)
                gt = after(x, y)
                further = np.where(is_right, ~gt, gt)
                lo[open_] = np.where(further, probe + 1, lo[open_])
                hi[open_] = np.where(further, hi[open_], probe)
            offset = place - np.where(right, mid, lo_)
            order[lo_ + offset + (lo - base)] = own
        width *= 2
    return order


def repeated_around(rank, data, off, left, length: int):
    """For each surrounding: the largest and the smallest number of bytes to the left of
    its anchor at which a string of ``length`` bytes starts that another surrounding of
    the same rank has at the same place; -1 and ``length`` where there is none."""
    n = len(rank)
    anchor, end = off[:-1] + left, off[1:]
    right = np.minimum(end - anchor, length)
    order_r, shared_r = suffix_order(rank, data, anchor, right)
    mirrored = data[np.repeat(anchor - 1, left) - (np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left))] if left.sum() else np.zeros(1, np.uint8)
    order_l, shared_l = suffix_order(rank, mirrored, np.cumsum(left) - left, left)
    most, least = np.full(n, -1, np.int64), np.full(n, length, np.int64)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    head_r, head_l = K.group_starts(rank[order_r]), K.group_starts(rank[order_l])
    for a in range(int(left.max(initial=0)) + 1):
        class_r[order_r] = np.cumsum((shared_r < length - a) | head_r)
        class_l[order_l] = np.cumsum((shared_l < a) | head_l)
        fits = np.flatnonzero((left >= a) & (right >= length - a))
        pair = class_r[fits] * (n + 1) + class_l[fits]
        by = np.argsort(pair)
        again = fits[by[K.run_lengths(K.group_starts(pair[by])) > 1]]
        most[again] = a
        least[again] = np.minimum(least[again], a)
    return most, least


def _spans(length: int):
    def run(batches):
        parts = []
        for batch in batches:
            if not batch.num_rows:
                continue
            around = batch.column("around")
            data, off = K.flat(around)
            full = ~around.is_null().to_numpy(zero_copy_only=False)
            parts.append([K.ints(batch, n) for n in ("key", "key2", "doc_id", "pos", "left")] + [batch.column("known").to_numpy(zero_copy_only=False), full, np.diff(off), data])
        if not parts:
            return
        key, key2, doc, pos, left, known, full, size, data = (np.concatenate([p[i] for p in parts]) for i in range(9))
        del parts
        start = np.cumsum(size) - size
        # single strings of hot grams, and places that a task has settled
        i = np.flatnonzero(~full)
        i = i[np.lexsort((key2[i], key[i]))]
        twice = K.run_lengths(K.group_starts(key[i], key2[i])) > 1
        i = i[twice | known[i]]
        yield K.table(_SPAN, doc[i], pos[i].astype(np.int32), (pos[i] + left[i]).astype(np.int32))
        rows = np.flatnonzero(full)
        rows = rows[np.lexsort((pos[rows], doc[rows], key[rows]))]
        rows = rows[K.group_starts(key[rows], doc[rows], pos[rows])]
        done = rows[known[rows]]
        yield K.table(_SPAN, doc[done], (pos[done] - left[done]).astype(np.int32), (pos[done] - left[done] + size[done]).astype(np.int32))
        border = np.flatnonzero(K.group_starts(key[rows]))
        at = 0
        while at < len(rows):
            cut = border[np.searchsorted(border, at + SORT_ROWS, "right") - 1] if at + SORT_ROWS < len(rows) else len(rows)
            cut = cut if cut > at else int(np.append(border, len(rows))[np.searchsorted(border, at, "right")])
            lot = rows[at:cut]
            at = cut
            bytes_ = data[K.ranges(start[lot], size[lot])]
            off = np.concatenate(([0], np.cumsum(size[lot])))
            rank = np.cumsum(K.group_starts(key[lot]))
            most, least = repeated_around(rank, bytes_, off, left[lot], length)
            hit = most >= 0
            yield K.table(_SPAN, doc[lot][hit], (pos[lot] - most)[hit].astype(np.int32), (pos[lot] + length - least)[hit].astype(np.int32))

    return run


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = 2_500) -> DataFrame:
    """Byte spans (``doc_id, start, end``; they may overlap) that together cover every
    string of ``length`` UTF-8 bytes that also starts anywhere else.

    Matches never cross documents; null and short texts have none.  Rows with a null
    doc_id take no part; rows that repeat a doc_id with the same text are one place.  Here each doc_id
    must have one text; ``dedup_substrings`` takes any.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _repeated_spans(dealt_texts(docs), docs, length, hot, int(size))


def _repeated_spans(placed: DataFrame, docs: DataFrame, length: int, hot: int, size: int) -> DataFrame:
    """All columns of ``placed`` go to the tasks: both joins then read one exchange.  ``size`` is the bytes of all texts: about
    an anchor of 32 bytes for each 16 of them, and at worst, if all repeats, ten bytes around for each."""
    scanned = texts(docs).where("doc_id is not null")
    anchors = scanned.mapInArrow(K.lean(_anchors(length)), "key long, gram long, doc_id long, pos int, many int")
    hits = materialise(dealt(anchors, "key", 2 * size).mapInArrow(K.lean(_repeated(hot)), "gram long, doc_id long, pos int"), "hits")
    crowd = hits.where("doc_id is null").select("gram", F.lit(True).alias("hot"))
    if crowd.count() <= MOST_HOT:
        marked = hits.where("doc_id is not null").join(F.broadcast(crowd), "gram", "left")
    else:
        marked = join_hot(hits, crowd, "gram", "left").where("doc_id is not null")
    marked = marked.select("doc_id", F.when(F.col("hot"), -F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"))
    near = placed.join(marked.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("anchors")), "doc_id").select(*placed.columns, "anchors")
    around = near.mapInArrow(K.lean(_around(length)), _AROUND_SQL)
    return dealt(around, "key", 10 * size, 256 << 20).mapInArrow(K.lean(_spans(length)), "doc_id long, start int, end int")


def _cut(carry):
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, size=SLICE_BYTES):
                data, off = K.flat(part.column("text"))
                raw, lists = data.tobytes(), (part.column("starts"), part.column("ends"))
                many = [np.diff(x.offsets.to_numpy()) for x in lists]
                first = np.cumsum(many[0]) - many[0]
                starts, ends = (x.flatten().to_numpy() for x in lists)
                texts, rows = [], []
                for i in range(part.num_rows):
                    text = raw[off[i] : off[i + 1]]
                    removed = spans = 0
                    if many[0][i]:
                        mask = np.zeros(len(text) + 1, np.int32)
                        mine = slice(first[i], first[i] + many[0][i])
                        np.add.at(mask, np.minimum(starts[mine], len(text)), 1)
                        np.add.at(mask, np.minimum(ends[mine], len(text)), -1)
                        gone = np.cumsum(mask[:-1]) > 0
                        removed = int(gone.sum())
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        text = data[off[i] : off[i + 1]][~gone].tobytes()
                    texts.append(text.decode("utf-8", "ignore"))
                    rows.append((int(off[i + 1] - off[i]), removed, spans, hashlib.sha256(text).hexdigest()))
                cut = K.table(out, part.column("doc_id"), texts, *map(list, zip(*rows)))
                yield pa.RecordBatch.from_arrays([*cut.columns, *[part.column(c) for c in carry]], names=[*out.names, *carry])

    return run


def dedup_substrings(docs: DataFrame, length: int = 200, hot: int = 2_500, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document without its repeated strings: ``doc_id``, ``text`` (what is left;
    characters cut in two at a border are dropped), ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept_sha256`` (of the bytes left, before that drop).

    A null text is empty; a null doc_id loses nothing.  The columns ``carry`` follow; others are
    ignored.  Every row comes back once.  Rows with one doc_id and one text are one place; different
    texts under one doc_id are places of their own, like different documents.
    """
    places, size = own_places(docs, carry)
    given = ("_given",) if "_given" in places.columns else ()
    out = _dedup(places, docs, length, hot, (*carry, *given), size)
    return out if not given else out.withColumn("doc_id", F.coalesce("_given", "doc_id")).drop("_given")


def _dedup(places: DataFrame, docs: DataFrame, length: int, hot: int, carry: tuple[str, ...], size: int) -> DataFrame:
    placed = dealt_texts(places, carry)
    found = _repeated_spans(placed, places, length, hot, size).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    none = F.array().cast("array<int>")
    joined = placed.join(found, "doc_id", "left").select("doc_id", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), *carry)
    own = [F.lit(None).cast("long").alias(c) if c == "_given" else F.col(c) for c in carry]
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text", none.alias("starts"), none.alias("ends"), *own)
    kind = "".join(f", {c} {places.schema[c].dataType.simpleString()}" for c in carry)
    return joined.union(nameless).mapInArrow(K.lean(_cut(carry)), f"doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kind}")
