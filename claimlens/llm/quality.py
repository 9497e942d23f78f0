"""Quality scores: random Fourier features over document statistics, ridge, isotonic.

A few dozen statistics of each text are standardised and mapped to random Fourier
features, which approximate a Gaussian kernel.  Each task sums its part of the normal
equations; the summed system gives ridge weights.  Isotonic regression on labelled rows
that took no part in the fit turns the raw scores into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import materialise

STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "short_words", "upper", "digit", "punctuation",
    "symbol", "non_ascii", "space", "newline_rate", "mean_line", "distinct_words", "distinct_pairs",
    "top_word", "adjacent_repeats", "distinct_lines", "word_entropy", "byte_entropy", "ends_in_stop", "caps_words",
)
_UPPER, _DIGIT, _LETTER = K.lut(range(0x41, 0x5B)), K.lut(range(0x30, 0x3A)), K.lut([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_PUNCTUATION, _SYMBOL = K.lut(b".,;:!?'\"()-"), K.lut(b"#$%&*+/<=>@[\\]^_`{|}~")


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return run[off[1:]] - run[off[:-1]]


def _runs(row: np.ndarray, value: np.ndarray, n: int):
    """Per text: number of distinct values, largest count, and entropy in bits."""
    order = np.lexsort((value, row))
    new = K.group_starts(row[order], value[order])
    at = np.flatnonzero(new)
    size, owner = np.diff(np.append(at, len(order))), row[order][at]
    top = np.zeros(n)
    np.maximum.at(top, owner, size)
    total = np.bincount(owner, size, n)
    entropy = np.log2(np.maximum(total, 1)) - np.bincount(owner, size * np.log2(np.maximum(size, 1)), n) / np.maximum(total, 1)
    return np.bincount(owner, minlength=n), top, entropy


def text_statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; an empty or null text gives zeros."""
    data, off = K.flat(texts)
    n, size = len(texts), np.maximum(np.diff(off), 1).astype(np.float64)
    start, end, first = K.words(data, off, K.SPACE)
    many = np.diff(first)
    count, row, length = np.maximum(many, 1), np.repeat(np.arange(n), many), (end - start).astype(np.float64)
    h = K.span_hashes(data, start, end)
    share = lambda table: _per_text(table[data], off) / size
    distinct, top, entropy = _runs(row, h, n)
    pair = K.window_hashes(h, 2)
    inner = K.window_starts(first, 2)
    pairs, _, _ = _runs(row[: len(pair)][inner], pair[inner], n)
    same = np.bincount(row[: len(pair)][inner & (h[1:] == h[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    ls, le, lf = K.words(data, off, K.lut(b"\n"))
    lines = np.maximum(np.diff(lf), 1)
    line_distinct, _, _ = _runs(np.repeat(np.arange(n), np.diff(lf)), K.span_hashes(data, ls, le), n)
    _, _, byte_entropy = _runs(np.repeat(np.arange(n), np.diff(off)), data.astype(np.int64), n)
    last = np.zeros(n)
    some = np.diff(off) > 0
    last[some] = np.isin(data[off[1:][some] - 1], np.frombuffer(b".!?", np.uint8))
    by_word = lambda x: np.bincount(row, x, n) / count
    out = np.column_stack([
        np.log1p(size), np.log1p(many), by_word(length), by_word(length > 12), by_word(length < 3), share(_UPPER), share(_DIGIT), share(_PUNCTUATION),
        share(_SYMBOL), share(K.lut(range(0x80, 0x100))), share(K.SPACE), share(K.lut(b"\n")), np.log1p(size / lines), distinct / count, pairs / count,
        top / count, same / count, line_distinct / lines, entropy, byte_entropy, last, by_word(_UPPER[data[start]] if len(start) else np.zeros(0)),
    ])
    out[~some] = 0
    return out


def _describe(batches):
    for batch in batches:
        for part in K.slices(batch):
            rows = text_statistics(part.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "statistics"])


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``statistics`` (array of doubles) of each whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_describe, "doc_id long, statistics array<double>")


class FourierRidge:
    """Standardisation, random Fourier features and ridge weights."""

    def __init__(self, mean, scale, features: int, gamma: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.directions = rng.normal(0, np.sqrt(2 * gamma), (len(self.mean), features))
        self.phases, self.weights = rng.uniform(0, 2 * np.pi, features), None

    def transform(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        rff = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([np.ones(len(z)), z, rff])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.transform(rows) @ self.weights


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _equations(model: FourierRidge):
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = model.transform(_matrix(batch.column("statistics")))
                both = np.column_stack([x, batch.column("label").to_numpy(zero_copy_only=False)])
                total = both.T @ both if total is None else total + both.T @ both
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def fit_quality(labelled: DataFrame, most_rows: int = 200_000, features: int = 192, gamma: float = 0.02, ridge: float = 1.0):
    """Fit on ``doc_id, statistics, label`` (0 or 1), at most ``most_rows`` of them by the
    order of md5(doc_id): a bounded sample, which is what bounds the work of the driver.
    A fifth of the rows (by crc32) calibrates and stays out of the fit.

    Returns ``(model, x, y)``: the raw-score breakpoints and their probabilities.  With no
    rows the score is constantly 0.5; with one class only it is that class.
    """
    from pyspark.ml.regression import IsotonicRegression

    sample = labelled.where("label is not null").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most_rows)
    sample = materialise(sample.select("doc_id", "statistics", F.col("label").cast("double")).repartition(16, "doc_id"), "quality")
    width = len(STATISTICS)
    stats = sample.agg(F.count("*"), F.avg("label"), *[f(F.col("statistics")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    if not stats[0] or stats[1] in (0.0, 1.0):
        return None, [0.0], [stats[1] if stats[0] else 0.5]
    model = FourierRidge(stats[2::2], np.maximum(np.array(stats[3::2], float), 1e-6), features, gamma)
    fold = F.pmod(F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string"))), F.lit(5))
    train = sample.where(fold != 0)
    parts = train.select("statistics", "label").mapInArrow(_equations(model), "part binary").collect()  # at most 16 rows
    size = 2 + width + features
    total = sum(np.frombuffer(r[0]).reshape(size, size) for r in parts) if parts else np.zeros((size, size))
    model.weights = np.linalg.solve(total[:-1, :-1] + ridge * np.eye(size - 1), total[:-1, -1])

    def raw(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column("statistics")))), batch.column("label")], names=["raw", "label"])

    held = sample.where(fold == 0).select("statistics", "label").mapInArrow(raw, "raw double, label double")
    fitted = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held)
    x, y = list(fitted.boundaries.toArray()), list(fitted.predictions.toArray())
    return model, x or [0.0], y or [stats[1]]


def score_quality(described: DataFrame, fitted) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for each row of ``describe``'s result."""
    model, x, y = fitted

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column("statistics"))
            raw = model.raw(rows) if model is not None else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.interp(raw, x, y), 0, 1))], names=["doc_id", "score"])

    return described.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Score every row of ``docs`` by what ``labels`` (``doc_id``, ``quality``) teaches.

    Only ``text`` decides a score; a null text counts as empty.  Labels that are null, not
    0 or 1, or of unknown documents are skipped.  ``doc_id``s that repeat are scored row by
    row; contradicting labels of one document both count.
    """
    described = materialise(describe(docs), "statistics")
    rows = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)").distinct()
    return score_quality(described, fit_quality(described.join(rows, "doc_id"), **options))
