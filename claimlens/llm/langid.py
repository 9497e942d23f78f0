"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  The letters of an n-gram are bound into one
vector by permuting each letter's vector by its place and multiplying; the n-gram
vectors of a text are bundled by adding them.  A language's prototype is the bundle of
its training texts, and a text belongs to the prototype with the largest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, in_small_batches, materialise

SLOTS = 256  # 0: space, 1-26: a-z, the rest: other letters by code point
MAX_LANGUAGES = 2_000  # prototypes that go to the tasks at once: 16 MB
_COLUMNS = 4_096
_SIZE = 512 << 10


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """Letter slot of every code point after lower-casing; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SLOTS - 27)
    return out


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int) -> np.ndarray:
    return (np.random.default_rng(7).integers(0, 2, (SLOTS, dimensions)) * 2 - 1).astype(np.int8)


def bind(codes: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """n-gram vectors: the product of the letters' vectors, each rolled by its place."""
    letters, out = letter_vectors(dimensions), None
    for place in range(n):
        slot = (codes // SLOTS ** (n - 1 - place)) % SLOTS
        rolled = np.roll(letters, n - 1 - place, axis=1)[slot]
        out = rolled if out is None else out * rolled
    return out.astype(np.float32)


def gram_counts(texts: pa.Array, n: int):
    """Rows (text number, n-gram code, count) of all texts, and how many letters each has.
    Runs of what is no letter count as one space; a text has a space at either end."""
    rows = [t or "" for t in texts.to_pylist()]
    data = np.frombuffer("\x00".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in rows], np.int64)
    slot = _slots()[data]
    row = np.repeat(np.arange(len(lengths)), lengths + 1)[: len(slot)]
    letters = np.bincount(row[slot > 0], minlength=len(lengths))
    keep = np.ones(len(slot), bool)
    keep[1:] = (slot[1:] > 0) | (slot[:-1] > 0)
    slot, row = slot[keep].astype(np.int64), row[keep]
    slot, row = np.concatenate(([0], slot, [0])), np.concatenate(([0], row, row[-1:])) if len(row) else np.zeros(2, np.int64)
    code = np.zeros(len(slot) - n + 1, np.int64)
    for place in range(n):
        code = code * SLOTS + slot[place : place + len(code)]
    # n-grams over the border of two texts go to the text of their middle letter
    owner = row[n // 2 : n // 2 + len(code)]
    inner = (row[: len(code)] == owner) | (slot[: len(code)] == 0)
    inner &= (row[n - 1 :][: len(code)] == owner) | (slot[n - 1 :][: len(code)] == 0)
    both, count = np.unique((owner[inner] << (8 * n)) | code[inner], return_counts=True)
    return both >> (8 * n), both & ((1 << (8 * n)) - 1), count, letters


def bundles(texts: pa.Array, n: int, dimensions: int):
    """Vector of every text (float64 sums) and its number of letters."""
    row, code, count, letters = gram_counts(texts, n)
    out = np.zeros((len(letters), dimensions), np.float64)
    known, column = np.unique(code, return_inverse=True)
    for low in range(0, len(known), _COLUMNS):
        mine = (column >= low) & (column < low + _COLUMNS)
        block = known[low : low + _COLUMNS]
        counts = np.zeros((len(letters), len(block)), np.float32)
        counts[row[mine], column[mine] - low] = count[mine]
        out += counts @ bind(block, n, dimensions)
    return out, letters


def _profiler(n: int, dimensions: int):
    out = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("total", pa.float64())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in K.slices(batch, size=_SIZE):
                vectors, _ = bundles(part.column("text"), n, dimensions)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    mine = vectors[langs == lang]
                    # texts weigh by the root of their length, so long ones do not drown the rest
                    norm = np.sqrt(np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-12))
                    sums[lang] = sums.get(lang, 0) + np.rint(mine / norm * 1024).sum(axis=0)
        for lang, total in sums.items():
            yield K.table(out, [lang] * dimensions, np.arange(dimensions, dtype=np.int32), total)

    return run


def _unit(rows) -> dict[str, np.ndarray]:
    """Unit vectors by name, in the order of the names."""
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted((r[0], np.array(r[1])) for r in rows)}


def language_prototypes(labelled: DataFrame, n: int = 3, dimensions: int = 1024, most: int = MAX_LANGUAGES) -> dict[str, np.ndarray] | DataFrame:
    """Unit prototype of each ``lang`` of ``labelled`` (columns ``text`` and ``lang``; rows
    with a null in either are skipped).  The sums are built per task and added in Spark;
    the driver gets one vector per language.  If there are more than ``most`` languages, the prototypes stay a
    written table (``lang``, ``v``), which ``predict_language`` works off in lots."""
    rows = in_small_batches(labelled).select("text", "lang").where("text is not null and lang is not null")
    summed = rows.mapInArrow(K.lean(_profiler(n, dimensions)), "lang string, place int, total double").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    vectors = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "total"))), lambda x: x["total"]).alias("v"))
    found = vectors.limit(most + 1).collect()
    return _unit(found) if len(found) <= most else materialise(vectors, "prototypes")


def _closest(texts: pa.Array, matrix: np.ndarray, n: int, dimensions: int):
    """For each text the number and cosine of the closest row of ``matrix``, and its letters."""
    vectors, letters = bundles(texts, n, dimensions)
    norm = np.linalg.norm(vectors, axis=1)
    if not len(matrix):
        return np.zeros(len(norm), int), np.zeros(len(norm)), letters
    cosine = np.round(vectors @ matrix.T / np.maximum(norm, 1e-12)[:, None], 12)
    best = np.argmax(cosine, axis=1)
    return best, cosine[np.arange(len(best)), best], letters


def _predictor(prototypes: dict[str, np.ndarray], n: int, dimensions: int, count_letters: bool):
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names]).reshape(len(names), dimensions)

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, size=_SIZE):
                best, cosine, letters = _closest(part.column("text"), matrix, n, dimensions)
                blank = (letters == 0) | (not names)
                lang = ["und" if b else names[i] for b, i in zip(blank, best)]
                columns = [pa.array(lang, pa.string()), pa.array(np.where(blank, 0.0, np.clip(cosine, 0, 1)))]
                kept = [part.column(i) for i in range(part.num_columns)]
                names_ = [*part.schema.names, "lang_pred", "lang_score"]
                if count_letters:
                    columns.append(pa.array(letters, pa.int64()))
                    names_.append("n_letters")
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=names_)

    return run


def _better(lot: dict[str, np.ndarray], n: int, dimensions: int):
    """The last three columns (name, cosine, letters) of each row, where the lot holds a closer prototype."""
    names, matrix = list(lot), np.array(list(lot.values()))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, size=_SIZE):
                best, cosine, letters = _closest(part.column("text"), matrix, n, dimensions)
                before = zip(part.column(part.num_columns - 3).to_pylist(), part.column(part.num_columns - 2).to_pylist())
                now = [min((-c, names[i]), (-d, name)) if name is not None else (-c, names[i]) for i, c, (name, d) in zip(best, cosine.tolist(), before)]
                columns = [pa.array([x[1] for x in now], pa.string()), pa.array([-x[0] for x in now], pa.float64()), pa.array(letters, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], *columns], names=part.schema.names)

    return run


def _predict_in_lots(docs: DataFrame, prototypes: DataFrame, n: int, count_letters: bool, most: int) -> DataFrame:
    """One pass over the documents for each lot of about ``most`` prototypes, written before the next lot is fetched."""
    lots = -(-prototypes.count() * 11 // (most * 10))  # a tenth more lots: hashes do not deal evenly
    # work columns of their own names, last: a carried column may be called like a result
    own = ["_lot_pred", "_lot_score", "_lot_letters"]
    while set(own) & set(docs.columns):
        own = [f"_{c}" for c in own]
    now = docs.select("*", F.lit(None).cast("string").alias(own[0]), F.lit(None).cast("double").alias(own[1]), F.lit(0).cast("long").alias(own[2]))
    before = None
    for i in range(lots):
        lot = _unit(prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(lots)) == i).collect())
        if lot:
            dimensions = len(next(iter(lot.values())))
            now = materialise(now.mapInArrow(K.lean(_better(lot, n, dimensions)), now.schema), "closest")
            discard(before)
            before = now
    pred, score, letters = map(F.col, own)
    found = [F.when(letters == 0, "und").otherwise(pred).alias("lang_pred"), F.when(letters == 0, 0.0).otherwise(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))).alias("lang_score")]
    return now.select(*docs.columns, *found, *[letters.alias("n_letters")] * count_letters)


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray] | DataFrame, n: int = 3, carry=("doc_id", "text"), count_letters: bool = False, most: int = MAX_LANGUAGES) -> DataFrame:
    """The columns ``carry`` of ``docs`` with ``lang_pred`` and ``lang_score`` (cosine, 0 to 1), and ``n_letters``
    where ``count_letters`` is set.  A carried column of one of these names gives way to the new one.

    Only ``text`` decides.  ``und`` with score 0 where the text is null or has no letter,
    or where nothing was learned.  Equal cosines go to the name that sorts first.  A table of ``prototypes`` is worked
    off in lots of about ``most``; the result is the same.
    """
    docs = in_small_batches(docs).select(*[c for c in carry if c not in ("lang_pred", "lang_score") and (c != "n_letters" or not count_letters)])
    if isinstance(prototypes, DataFrame):
        return _predict_in_lots(docs, prototypes, n, count_letters, most)
    dimensions = len(next(iter(prototypes.values()), np.zeros(1024)))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(K.lean(_predictor(prototypes, n, dimensions, count_letters)), f"{kind}, lang_pred string, lang_score double" + ", n_letters long" * count_letters)
