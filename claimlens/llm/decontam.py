"""Benchmark decontamination with one Aho-Corasick automaton.

The word windows of all benchmark items go into an automaton over normalised text
(ASCII lower-cased, words separated by one space).  Each document is normalised and
scanned once; the end of every match is mapped back to word numbers through the
offsets of the words, and from there to byte offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, in_small_batches, materialise

_KEEP = bytes(c if not K.NOT_ALNUM[c] else 0x20 for c in K.LOWER_TABLE)  # lower-cased, the rest a space
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of a-z, 0-9 and non-ASCII characters."""
    return (text or "").encode().translate(_KEEP).split()


def item_windows(items: list[tuple[object, str | None]], window: int) -> dict[bytes, list[int]]:
    """Each window of the items, as `` w1 w2 .. ``, with the numbers of its items."""
    out: dict[bytes, list[int]] = {}
    for number, (_, text) in enumerate(items):
        found = normal_words(text)
        for i in range(max(1, len(found) - window + 1) if found else 0):
            mine = out.setdefault(b" " + b" ".join(found[i : i + window]) + b" ", [])
            if not mine or mine[-1] != number:
                mine.append(number)
    return out


def build_automaton(windows: dict[bytes, list[int]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, numbers in windows.items():
        automaton.add_word(key.decode("latin-1"), (key.count(b" ") - 1, tuple(numbers)))
    automaton.make_automaton()
    return automaton


def scan(automaton, text: bytes):
    """Hit mask over the words of ``text``, their byte starts and ends, and the items found."""
    lowered = text.translate(_KEEP)
    found = lowered.split()
    hit, items = np.zeros(len(found) + 1, np.int32), set()
    if found and automaton is not None:
        joined = b" " + b" ".join(found) + b" "
        ends = None
        for at, (many, numbers) in automaton.iter(joined.decode("latin-1")):
            if ends is None:  # word number by the place of the space that ends it
                ends = np.cumsum(np.frombuffer(joined, np.uint8) == 0x20) - 1
            last = int(ends[at])
            hit[last - many] += 1
            hit[last] -= 1
            items.update(numbers)
    return np.cumsum(hit[:-1]) > 0, items


def _bounds(text: bytes, at: np.ndarray) -> list[list[int]]:
    """Byte ranges of the runs of the words ``at``."""
    if not len(at):
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(K.LOWER_TABLE))]
    breaks = np.flatnonzero(np.diff(at) > 1)
    return [[places[a][0], places[b][1]] for a, b in zip(at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]])]


def _scanner(items, window: int, spans: bool, row: bool = False):
    """``items`` is a broadcast list of (item_id, text)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("hits", pa.list_(pa.int32()))])

    names_out = [*out.names, "_row"] if row else out.names

    def run(batches):
        windows, names = item_windows(items.value, window), [None if i is None else str(i) for i, _ in items.value]
        automaton = build_automaton(windows) if windows else None
        for batch in batches:
            for part in K.slices(batch):
                data, off = K.flat(part.column("text"))
                raw = data.tobytes()
                rows = ([], [], [], [], [])
                for i in range(part.num_rows):
                    text = raw[off[i] : off[i + 1]]
                    mask, got = scan(automaton, text)
                    at = np.flatnonzero(mask)
                    bounds = _bounds(text, at) if spans else []
                    for column, value in zip(rows, (len(mask), len(at), sorted({names[x] for x in got} - {None}), bounds, at.tolist())):
                        column.append(value)
                found = K.table(out, part.column("doc_id"), *rows)
                yield pa.RecordBatch.from_arrays([*found.columns, *([part.column("_row")] if row else [])], names=names_out)

    return run


def _span_finder(batches):
    """Spans of the words ``hits``."""
    for batch in batches:
        bounds = [_bounds((t or "").encode(), np.array(h, np.int64)) for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())]
        columns = [batch.column("_row"), pa.array(bounds, pa.list_(pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "spans"])


def _blocks(benchmark: DataFrame, most_bytes: int):
    """The items in lots of bounded size, read one after the other."""
    lot, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        lot.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= most_bytes:
            yield lot
            lot, size = [], 0
    if lot or size == 0:
        yield lot


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, spans: bool = True, most_bytes: int = 8 << 20) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    Returns ``doc_id, n_words, n_hit, items`` (ids as sorted strings), ``spans`` (byte
    ranges of the original UTF-8 text, end exclusive) and ``hits`` (word numbers).

    The automaton of at most ``most_bytes`` of item text goes to the tasks; a larger
    benchmark is scanned in several passes.  Each pass is written as a table before the next lot is read, so the
    driver holds two lots at most, and passes are merged by a key of the row: every row comes
    back once, also where its doc_id repeats or is null.  Null or
    empty texts have no words and no hits; items without words match nothing; an empty
    benchmark hits nothing; repeated items count once per id; an item with a null id hits words but
    is not listed; other columns are ignored.
    """
    share = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    kind = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<bigint>>, hits array<int>"
    lots = _blocks(benchmark, most_bytes)
    lot, after = next(lots, []), next(lots, None)
    if after is None:
        return docs.mapInArrow(K.lean(_scanner(share(lot), window, spans)), kind)
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = []
    while lot is not None:
        sent = share(lot)
        found = rows.mapInArrow(K.lean(_scanner(sent, window, False, True)), f"{kind}, _row long")
        # the first pass names every row, the others add what they find
        parts.append(materialise((found.where("n_hit > 0") if parts else found).select("_row", "doc_id", "n_words", "items", "hits"), "pass"))
        sent.unpersist()
        lot, after = after, next(lots, None)
    merged = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    merged = merged.withColumn("n_hit", F.size("hits").cast("long"))
    none = F.array().cast("array<array<bigint>>")
    if spans:
        texts = rows.select("_row", "text").join(merged.where("n_hit > 0").select("_row", "hits"), "_row")
        merged = merged.join(texts.mapInArrow(K.lean(_span_finder), "_row long, spans array<array<bigint>>"), "_row", "left").withColumn("spans", F.coalesce("spans", none))
    else:
        merged = merged.withColumn("spans", none)
    return merged.select("doc_id", "n_words", "n_hit", "items", "spans", "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256`` (of the
    comma-joined sorted ids; of nothing where none is found) and ``contaminated``."""
    got = scan_documents(docs, benchmark, window, False, most_bytes)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean(items, window: int):
    def run(batches):
        windows = item_windows(items.value, window)
        automaton = build_automaton(windows) if windows else None
        for batch in batches:
            for part in K.slices(batch):
                data, off = K.flat(part.column("text"))
                raw = data.tobytes()
                yield part.filter(pa.array([not scan(automaton, raw[off[i] : off[i + 1]])[0].any() for i in range(part.num_rows)], pa.bool_()))

    return run


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no window of a benchmark item, with all their columns.

    Each row is judged by its own text, so a doc_id may repeat or be null.  A larger benchmark
    takes several passes; each but the last is written as a table before the next lot is read.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    passed = written = None
    for lot in _blocks(benchmark, most_bytes):
        if passed is not None:
            docs = materialise(passed, "clean")
            discard(written)
            written = docs
        passed = in_small_batches(docs).mapInArrow(K.lean(_clean(docs.sparkSession.sparkContext.broadcast(lot), window)), kind)
    return docs if passed is None else passed


def sha256_of(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
