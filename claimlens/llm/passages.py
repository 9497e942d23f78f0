"""Substring dedup over words: difference-cover anchors, then exact windows.

A passage of ``window`` words that starts earlier elsewhere is removed where it repeats.
Hashing every window would shuffle a row for each word, so windows of
``window - period + 1`` words are hashed only where the word number modulo ``period``
is in a difference cover: whatever the two alignments, two equal passages then have a
common anchor in their first ``period`` words.  Only the neighbourhood of anchors that
occur twice is hashed with full windows.

Each task first settles repeats among its own rows, so a key reaches the shuffle at
most once per task buffer however often it occurs: hot passages cost no skew.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import dealt_texts, own_places, texts

_PACKED = "part int, places binary"
_PLACE = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32())])


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences give every residue modulo ``period``
    (greedy; checked by the tests for every period up to 64)."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda c: len({(c - x) % period for x in cover} & missing | {(x - c) % period for x in cover} & missing)
        best = max((c for c in range(period) if c not in cover), key=gain)
        missing -= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
        cover.append(best)
    return sorted(cover)


def _word_values(batch: pa.RecordBatch):
    data, off = K.flat(batch.column("text"))
    start, end, first = K.words(data, off, K.SPACE)
    return K.span_hashes(data, start, end), first


def _anchors(window: int, period: int, parts: int):
    size, residues = window - period + 1, K.lut(difference_cover(period))[:period]

    def settle(columns, seed, counter):
        h, doc, pos = columns
        order = np.argsort(h)
        h, doc, pos = h[order], doc[order], pos[order]
        new = K.group_starts(h)
        known = K.run_lengths(new) > 1
        # the first of a run still looks for partners in other tasks, as they look for it
        return K.pack(K.spread(h, known & ~new, seed, counter), doc, pos, np.zeros(len(h), np.uint16), known, parts)

    def run(batches):
        seed, counter, buffer = TaskContext.get().partitionId() + 1, 0, K.Buffer(3)
        for batch in batches:
            for part in K.slices(batch):
                values, first = _word_values(part)
                ok = K.window_starts(first, size)
                inner = np.arange(len(values)) - np.repeat(first[:-1], np.diff(first))
                ok &= residues[inner[: len(ok)] % period]
                at = np.flatnonzero(ok)
                doc = np.repeat(K.ints(part, "doc_id"), np.diff(first))[at]
                if buffer.add(K.window_hashes(values, size)[at].view(np.int64), doc, inner[at].astype(np.int32)):
                    yield settle(buffer.take(), seed, counter)
                    counter += 4 * K.BUFFER_ROWS
        if (rest := buffer.take()) is not None:
            yield settle(rest, seed, counter)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Places of anchors whose key occurs twice, or that a task has found to repeat."""
    key, doc, pos, _, known = K.unpack(table.column("places"))
    order = np.argsort(key)
    keep = (K.run_lengths(K.group_starts(key[order])) > 1) | known[order]
    order = order[keep]
    return pa.Table.from_batches([K.table(_PLACE, doc[order], pos[order].astype(np.int32))])


def _windows(window: int, period: int, parts: int):
    def settle(columns, seed, counter):
        h, h2, doc, pos = columns
        order = np.lexsort((pos, doc, h2, h))
        order = order[K.group_starts(h[order], h2[order], doc[order], pos[order])]  # a place counts once
        h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
        known = ~K.group_starts(h, h2)
        return K.pack(K.spread(h, known, seed, counter), doc, pos, h2, known, parts)

    def run(batches):
        seed, counter, buffer = TaskContext.get().partitionId() + 1, 0, K.Buffer(4)
        for batch in batches:
            for part in K.slices(batch):
                values, first = _word_values(part)
                anchors = part.column("anchors")
                many = np.diff(anchors.offsets.to_numpy())
                at = anchors.flatten().to_numpy().astype(np.int64) + np.repeat(first[:-1], many)
                wanted = np.zeros(len(values) + 1, np.int32)
                low = np.maximum(at - period + 1, np.repeat(first[:-1], many))
                np.add.at(wanted, low, 1)
                np.add.at(wanted, at + 1, -1)
                ok = K.window_starts(first, window)
                ok &= np.cumsum(wanted[:-1])[: len(ok)] > 0
                at = np.flatnonzero(ok)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))[at]
                h = K.window_hashes(values, window)[at].view(np.int64)
                h2 = (K.window_hashes(values, window, 1)[at] >> K.U64(48)).astype(np.uint16)
                if buffer.add(h, h2, K.ints(part, "doc_id")[row], at - first[row]):
                    yield settle(buffer.take(), seed, counter)
                    counter += 4 * K.BUFFER_ROWS
        if (rest := buffer.take()) is not None:
            yield settle(rest, seed, counter)

    return run


def _later(table: pa.Table) -> pa.Table:
    """Places of windows with an earlier equal one."""
    key, doc, pos, check, known = K.unpack(table.column("places"))
    order = np.lexsort((pos, doc, check, key))
    new = K.group_starts(key[order], check[order])
    # the same place twice (repeated rows) is one occurrence
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (doc[order] == doc[order][head]) & (pos[order] == pos[order][head])
    order = order[~same | known[order]]
    return pa.Table.from_batches([K.table(_PLACE, doc[order], pos[order].astype(np.int32))])


def _parts(docs: DataFrame, size: int) -> int:
    """Ranges of keys: a few for each shuffle partition, and one for each 128 MB of text at least, as a group is
    held in memory."""
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 27)


def repeated_passages(docs: DataFrame, window: int = 20, period: int = 13) -> DataFrame:
    """Starts of the windows of ``window`` words that also start earlier (smaller doc_id,
    or the same document further left): columns ``doc_id`` and ``pos`` (word number).

    Texts that are null or shorter than a window have none.  Rows with a null doc_id
    cannot be ordered and take no part.  Rows that repeat a doc_id with the same text
    are the same place and do not count against each other.  Here each doc_id must have one text;
    ``dedup_passages`` takes any.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _repeated_passages(dealt_texts(docs), docs, window, period, size)


def _repeated_passages(dealt: DataFrame, docs: DataFrame, window: int, period: int, size: int) -> DataFrame:
    if not 1 <= period < window:
        raise ValueError("period must be at least 1 and less than window")
    parts, place = _parts(docs, size), "doc_id long, pos int"
    scanned = texts(docs).where("doc_id is not null")
    hits = scanned.mapInArrow(_anchors(window, period, parts), _PACKED).groupBy("part").applyInArrow(_repeated, place)
    near = dealt.join(hits.groupBy("doc_id").agg(F.collect_list("pos").alias("anchors")), "doc_id").select("doc_id", "text", "anchors")
    return near.mapInArrow(_windows(window, period, parts), _PACKED).groupBy("part").applyInArrow(_later, place)


def _cut(window: int, given: tuple[str, ...]):
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                data, off = K.flat(part.column("text"))
                raw, places = data.tobytes(), part.column("places").to_pylist()
                kept, total, removed = [], [], []
                for i, at in enumerate(places):
                    found = raw[off[i] : off[i + 1]].split()
                    total.append(len(found))
                    removed.append(0)
                    if at:
                        gone = np.zeros(len(found) + 1, np.int32)
                        at = np.unique(at)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                        keep = np.cumsum(gone[:-1]) == 0
                        removed[-1] = int(len(found) - keep.sum())
                        found = list(compress(found, keep.tolist()))
                    kept.append(b" ".join(found))
                yield K.table(out, part.column(given[0] if given else "doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), total, removed, [hashlib.sha256(x).hexdigest() for x in kept])

    return run


def dedup_passages(docs: DataFrame, window: int = 20, period: int = 13) -> DataFrame:
    """Every document without its repeated passages: ``doc_id``, ``text`` (kept words
    joined by one space), ``n_words``, ``n_removed`` and ``kept_sha256``.

    A null or blank text gives zero words and the hash of nothing; a null doc_id keeps
    all its words.  Rows with one doc_id and one text are one place; different texts under one doc_id
    are documents of their own, in the order of a hash of the text.  Other columns of ``docs``
    are ignored, whatever their names.
    """
    rows, size = own_places(docs)
    given = ("_given",) if "_given" in rows.columns else ()
    dealt = dealt_texts(rows, given)
    found = _repeated_passages(dealt, rows, window, period, size).groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    joined = dealt.join(found, "doc_id", "left").select("doc_id", "text", "places", *given)
    none = F.lit(None).cast("long")
    nameless = docs.where("doc_id is null").select(none.alias("doc_id"), "text", F.lit(None).cast("array<int>").alias("places"), *[none.alias(c) for c in given])
    return joined.union(nameless).mapInArrow(_cut(window, given), "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
