"""Corpus pipeline: ``documents`` to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept;
``run`` writes every stage's rows as Parquet into the shared folder and reads them back.  Every stage gives no rows for a table without
rows, and ignores columns other than those of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontam, jaccard, langid, pieces, suffix
from claimlens.llm.queries import default_model, held_out, read
from claimlens.llm.shared import discard, materialise, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_LANGUAGE_SCORE = 0.05
#: Texts of fewer letters cannot be judged; from so many on, three times the noise is asked for.
SHORT_LETTERS, LONG_LETTERS, LONG_LANGUAGE_SCORE = 32, 128, 0.1
MOST_SENT = 1_000_000  # ids that go to every task: some tens of MB


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those that no language's prototype resembles; row by row, so
    a doc_id may repeat or be null.

    The noise of a cosine in 1,024 dimensions is about 0.03, and few letters give few n-grams.  So texts of fewer
    than 32 letters are kept whatever their score, those of fewer than 128 need 0.05, all others 0.1.
    """
    prototypes = langid.language_prototypes(docs.where(~held_out()).select("text", "lang"))
    rest = docs.select(*COLUMNS)
    found = langid.predict_language(rest, prototypes, carry=COLUMNS, count_letters=True)
    limit = F.when(F.col("n_letters") < SHORT_LETTERS, 0.0).when(F.col("n_letters") < LONG_LETTERS, MIN_LANGUAGE_SCORE).otherwise(LONG_LANGUAGE_SCORE)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= limit)).select(*COLUMNS)


def _sent(ids: DataFrame) -> DataFrame:
    """``ids``, which go to every task unless they are many: the texts they are joined with then need no shuffle."""
    return F.broadcast(ids) if ids.limit(MOST_SENT + 1).count() <= MOST_SENT else ids


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Rows with one doc_id and one text are one document and leave one row (that with the least ``lang``,
    ``source`` and ``n_chars``); different texts under one doc_id stay or go together.  Rows with a null doc_id cannot
    be told apart and are all kept.
    """
    found = jaccard.jaccard_components(docs).where("doc_id is not null")
    each = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("_kept"), (F.count("*") > 1).alias("_again"))
    each = materialise(each.where("not _kept or _again"), "dropped")  # the fewer ids: most documents have no copy
    out = docs.join(_sent(each.select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)
    again = _sent(each.where("_kept and _again").select("doc_id"))
    if again.limit(1).count():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        once = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("m"))
        out = out.union(once.select("doc_id", "text", "m.*").select(*COLUMNS))
    return out


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that occur more than once; documents of which nothing is left go.

    Every row is cut for itself: rows that repeat come back as often as they came, and those with
    a null doc_id lose nothing.
    """
    cut = suffix.dedup_substrings(docs, carry=("lang", "source")).where("text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; each row is judged by its own text, also
    where its doc_id is null or repeats."""
    return decontam.clean_rows(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, also where its doc_id is null or repeats."""
    coded = pieces.encode(docs, default_model(spark))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:  # a stage leaves its result alone
            docs = keep(materialise(stage(spark, docs, sf_dir), name))
        discard(before)
        before = docs
    return docs


#: Language ID and the Viterbi search have no SQL form; tests/llm compares run() with a
#: brute-force version.
ORACLE_SQL = None
