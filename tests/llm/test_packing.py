"""Packing: token ids against the tokenizer over whole texts, and packed sequences against their rules and a best-fit loop."""

import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlens.llm import packing, queries

PATH = queries.default_tokenizer()


def whole_ids(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    return [e.ids + [0] for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def brute_bins(lengths, capacity):
    room = []
    for length in sorted(lengths, reverse=True):
        i = bisect_left(room, length)
        insort(room, (room.pop(i) if i < len(room) else capacity) - length)
    return len(room)


def check(rows, texts_by_id, capacity):
    """Every document once and whole, and gapless sequences within the capacity."""
    rows = [r.asDict() for r in rows]
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    found = []
    for key, texts in texts_by_id.items():
        expected = []
        for ids in whole_ids(texts):
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                expected.append((piece, start, len(part), zlib.crc32(array("I", part).tobytes())))
        got = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs.pop(key)]
        assert sorted(got) == sorted(expected)
        found += got
    assert not docs
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences), [r["length"] for r in rows]


def texts(n=300, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßIİ'") for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["don't", "42", "<|endoftext|>", "é", "ǅ", "x " * 3]
    return [rng.choice([" ", "\n", "\t ", " ", " "]).join(rng.choice(words) for _ in range(int(rng.paretovariate(0.8)) % 400)) for _ in range(n)]


def test_ids_are_those_of_whole_texts(sf_dir):
    import pyarrow.parquet as pq

    hard = [None, "", " \n", "word", "ä́ ̈x", "A B C\x85D\x1cE", "it's IT'S 'S 's", "<|endoftext|> <|startoftext|>x", "12 345", "日本語 のテキスト", "👍🏽👍 é", "İstanbul ΣΑΣ", "\x00 \x01a", "-- -- --a--", "x" * 5000]
    given = hard + texts(100) + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    rng = random.Random(8)
    given += ["".join(rng.choice("aJjTsK09.,;:!?'-| \u0301\u030c\u0307\u0331éİ日\n)") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    words = packing.Words(PATH, 1500)
    for again in range(3):  # with an empty memory of words, a full one, and one that begins anew
        ids, off = packing.token_ids(words, pa.array(given, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == whole_ids(given)
    assert packing.token_ids(words, pa.array([], pa.string()))[0].tolist() == []


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_the_loop_over_items(seed):
    rng = random.Random(seed)
    lengths = [min(100, 1 + int(rng.expovariate(1 / rng.choice([5, 30, 60])))) for _ in range(rng.choice([1, 50, 2000]))]
    sizes = sorted(set(lengths), reverse=True)
    moves, bins = packing.best_fit(sizes, [lengths.count(s) for s in sizes], 100)
    fill, seen = defaultdict(int), defaultdict(int)
    for size, low, n, first, at in moves:
        assert low == seen[size]
        seen[size] += n
        for b in range(first, first + n):
            assert fill[b] == at
            fill[b] += size
    assert seen == {s: lengths.count(s) for s in sizes}
    assert {b: f for first, n, f in bins for b in range(first, first + n)} == dict(fill)
    assert len(fill) == brute_bins(lengths, 100) and max(fill.values()) <= 100


@pytest.mark.parametrize("leaf,fan,slack", [(1 << 15, 16, 4), (40, 2, 0), (25, 3, 2), (7, 16, 0)])
def test_packing(spark, leaf, fan, slack):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumns({"row": F.lit("x"), "leaf": F.lit(1), "length": F.lit(None).cast("long"), "ids": F.lit(2)})
    out = packing.pack_documents(df.repartition(3), PATH, 64, slack, leaf=leaf, fan=fan)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    many, lengths = check(out.collect(), {i: [t] for i, t in enumerate(given)}, 64)
    assert -(-sum(lengths) // 64) <= many <= 1.02 * brute_bins(lengths, 64) + 1


def test_tree_merges_what_leaves_cannot(spark):
    """Leaves of two pieces: nearly all merging is left to the tree."""
    given = ["a " * n for n in [5, 3, 2, 7, 8, 1] * 60]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(4)
    many, lengths = check(packing.pack_documents(df, PATH, 16, 0, leaf=2, fan=2).collect(), {i: [t] for i, t in enumerate(given)}, 16)
    assert many <= 1.05 * brute_bins(lengths, 16)


def test_packing_edges(spark):
    schema = "doc_id long, text string"
    assert packing.pack_documents(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(1, None), (1, ""), (1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "word " * 9000), (3, "y" * 70000)]
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    check(packing.pack_documents(spark.createDataFrame(rows, schema), PATH).collect(), by_id, 2048)
    hot = [(i, "same text") for i in range(500)]  # equal lengths, and bins that nothing fits
    many, lengths = check(packing.pack_documents(spark.createDataFrame(hot, schema), PATH, 5, 0, leaf=30).collect(), {i: [t] for i, t in hot}, 5)
    assert many == 500


def test_sequences_hold_the_ids(spark):
    given = texts(80)
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    packed = packing.pack_documents(df, PATH, 64, ids=True)
    expected = whole_ids(given)
    for r in packing.sequences(packed).collect():
        built = []
        for p in r.parts:
            assert p.offset == len(built)
            built += expected[p.doc_id][64 * p.piece : 64 * p.piece + 64]
        assert r.ids == built


def test_the_folder_of_tokenizers_is_a_setting(spark):
    spark.conf.set("spark.claimlens.tokenizers", "/some/folder/")
    try:
        assert queries.default_tokenizer(spark) == "/some/folder/word_bpe_49k.json"
    finally:
        spark.conf.unset("spark.claimlens.tokenizers")
    assert queries.default_tokenizer(spark) == PATH


def test_query_packs_every_document(spark, sf_dir):
    out = queries.QUERIES["op11_best_fit_packing"](spark, sf_dir)
    docs = {r.doc_id: [r.text] for r in queries.read(spark, sf_dir, "documents").collect()}
    many, lengths = check(out.collect(), docs, 2048)
    assert many <= brute_bins(lengths, 2048) + 1
