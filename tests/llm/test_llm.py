"""Operators of claimlens.llm against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlens.llm import decontam, embed_dedup, jaccard, kernels, langid, licenses, passages, pieces, quality, queries, shared, suffix, urls

from ..helpers import assert_same


def corpus(seed=1, n=60, words=300):
    """Random texts with exact copies, near copies, a passage that many share, blanks and repeats."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé ß"[:7]) for _ in range(rng.randint(1, 7))).replace(" ", "x") for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        if i % 7 == 0:
            text[len(text) // 2 : len(text) // 2] = passage
        if i % 5 == 4:
            text = list(texts[-1])
            if text and i % 2:
                text[rng.randrange(len(text))] = "CHANGED"
        texts.append(text)
    out = [rng.choice([" ", "\n", "\t"]).join(t) for t in texts]
    return out + [None, "", " \n", "word", "Word", "a b c d", "A B c d", "laa " * 300, "laa " * 301]


def frame(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"n_words": F.lit("x"), "key": F.lit(None).cast("string"), "cls": F.lit(1)}) if extra else df


EMPTY = "doc_id long, text string"


def brute_passages(texts, window):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen, out = {}, []
    for d, w in enumerate(docs):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), (d, i))
    for d, w in enumerate(docs):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,period", [(20, 13), (8, 5), (6, 1)])
def test_passages(spark, window, period):
    texts = corpus()
    got = passages.dedup_passages(frame(spark, texts, True), window, period).drop("text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_passages(texts, window)


def test_passages_edges(spark):
    assert passages.dedup_passages(spark.createDataFrame([], EMPTY)).count() == 0
    text = "w " + " ".join(map(str, range(40)))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], EMPTY)
    got = {(r.doc_id, r.n_removed) for r in passages.dedup_passages(df).collect()}
    assert got == {(None, 0), (1, 0), (2, 41)}


def test_difference_covers():
    for period in range(1, 65):
        cover = passages.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_strings(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for x in raw:
        for i in range(len(x) - length + 1):
            count[x[i : i + length]] = count.get(x[i : i + length], 0) + 1
    out = []
    for d, x in enumerate(raw):
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        out.append((d, len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2500, 1])
def test_suffixes(spark, hot):
    texts = corpus(2, 40)
    got = suffix.dedup_substrings(frame(spark, texts, True), 100, hot).drop("text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_strings(texts, 100)


def test_suffixes_edges(spark):
    assert suffix.dedup_substrings(spark.createDataFrame([], EMPTY)).count() == 0
    df = spark.createDataFrame([(None, "x" * 300), (1, "ab" * 50), (1, "ab" * 50)], EMPTY)
    assert {(r.doc_id, r.n_removed) for r in suffix.dedup_substrings(df).collect()} == {(None, 0), (1, 0)}


CLASHING = [(1, "long"), (1, None), (1, "short text here"), (1, "other"), (1, "long"), (2, "long"), (2, "short text here"), (3, ""), (None, "long"), (None, "long"), (0, "other")]


def clashing(spark):
    """One doc_id with several texts, null ones and repeated rows."""
    words = {"long": " ".join(f"w{i} é" for i in range(80)), "other": "x " + " ".join(f"w{i} é" for i in range(30, 70))}
    return spark.createDataFrame([(i, words.get(t, t)) for i, t in CLASHING], EMPTY)


def test_strings_of_clashing_ids(spark):
    df = clashing(spark)
    texts = sorted({(r.doc_id, r.text or "") for r in df.collect() if r.doc_id is not None})
    brute = {t: r[1:] for t, r in zip(texts, brute_strings([t for _, t in texts], 200))}
    got = suffix.dedup_substrings(df.withColumn("tag", F.coalesce("text", F.lit(""))), carry=("tag",)).collect()
    assert len(got) == len(CLASHING) and any(b[1] for b in brute.values())
    for r in got:
        want = brute[r.doc_id, r.tag] if r.doc_id is not None else (len(r.tag.encode()), 0, 0, hashlib.sha256(r.tag.encode()).hexdigest())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want


def test_passages_of_clashing_ids(spark):
    df = clashing(spark)
    rows = {(r.doc_id, r.d, r.text or "") for r in df.withColumn("d", F.xxhash64(F.coalesce("text", F.lit("")))).collect() if r.doc_id is not None}
    rows = sorted(rows)
    brute = [(k[0], *b[1:]) for k, b in zip(rows, brute_passages([k[2] for k in rows], 20))]
    again = brute[[k[0] for k in rows].index(1) + sorted(k[1] for k in rows if k[0] == 1).index(next(k[1] for k in rows if k[0] == 1 and k[2].startswith("w0")))]
    blank = hashlib.sha256(" ".join(f"w{i} é" for i in range(80)).encode()).hexdigest()
    want = sorted(map(str, [*brute, again, (None, 160, 0, blank), (None, 160, 0, blank)]))
    assert sorted(str(tuple(r)) for r in passages.dedup_passages(df).drop("text").collect()) == want


def test_very_long_text(spark):
    """A text of 3 MB that repeats a part of itself and of another."""
    rng = random.Random(6)
    part = " ".join(str(rng.randrange(10**9)) for _ in range(30_000))
    rest = " ".join(str(rng.randrange(10**9)) for _ in range(250_000))
    df = frame(spark, [part, f"{rest} {part} end {part[:5000]}", "x"])
    got = suffix.dedup_substrings(df).orderBy("doc_id").collect()
    assert [r.n_removed >= n for r, n in zip(got, (len(part), len(part) + 5000, 0))] == [True] * 3 and got[1].n_bytes - got[1].n_removed <= len(rest) + 6
    assert [r.n_removed for r in passages.dedup_passages(df).orderBy("doc_id").collect()][:2] == [0, 30_000 + len(part[:5000].rsplit(" ", 1)[0].split())]


def test_suffix_order_sorts_like_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 400)
    size = rng.integers(0, 100, 400)
    rank = np.sort(rng.integers(0, 5, 400))
    order, common = suffix.suffix_order(rank, data, start, size)
    raw = data.tobytes()
    keys = [(rank[i], raw[start[i] : start[i] + size[i]]) for i in order]
    assert keys == sorted(keys)
    assert list(suffix.suffix_order(rank, data, start, size, True)[1]) == list(common)


def brute_components(texts, percent=75, size=5):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


def families():
    """Families whose lists are long: variants of two texts that share most words, and of a longer one."""
    rng = random.Random(8)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    long = [f"w{i}" for i in range(80)]
    out = [" ".join([*base, *base[:8], f"v{i % 11}", f"w{i % 3}"]) for i in range(40)]
    for i in range(60):
        text = list(long) if i % 2 else [*long[:66], *(f"x{j}" for j in range(14))]
        for _ in range(i % 5):
            text[rng.randrange(80)] = f"e{rng.randrange(30)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(
    "options",
    [{}, {"boundary": 64}, {"boundary": 12, "rare": 1}, {"rare": 2, "rounds": 0, "block": 4}, {"rare": 2, "rounds": 1, "block": 7}, {"rare": 3, "most_frequent": 4}, {"class_bits": 6, "rare": 4}],
    ids=str,
)
def test_jaccard(spark, options):
    texts = corpus(3, 70, 60) + families()
    got = jaccard.jaccard_components(frame(spark, texts, True), **options).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts)


def test_jaccard_compares_no_more_sets_when_not_all_frequent_tokens_are_known(spark, monkeypatch):
    """Texts that share a passage with a few others and a sentence with all: none of them may link."""
    texts = [" ".join(["every text ends with one sentence of ten words here", f"passage {i // 8} that only eight texts have", *(f"{i}w{j}" for j in range(100))]) for i in range(64)]
    linked, compared = jaccard._linked, []

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return linked(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "_linked", counted)
    for most in (1000, 2):
        assert [tuple(r) for r in jaccard.jaccard_components(frame(spark, texts), boundary=12, most_frequent=most, rounds=0).orderBy("doc_id").collect()] == brute_components(texts)
        assert compared.pop(0) == 0
        compared.clear()


def test_near_duplicates_shuffle_no_texts(spark):
    import corpus_pipeline

    docs = frame(spark, ["one text of some words", "one text of some words", "quite another text than that"]).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "1L AS n_chars")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, "")
        assert sorted(r.doc_id for r in out.collect()) == [0, 2]
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_jaccard_of_long_texts_that_share_a_shingle(spark):
    """Texts of 2,000 words: a frequent shingle in all, near copies of a few."""
    rng = random.Random(9)
    texts = [" ".join(["all of them say this", *(f"{i}w{j}" for j in range(1995))]) for i in range(40)]
    texts += [" ".join(["all of them say this", *(w if rng.random() > 0.02 else "z" for w in texts[i].split()[5:])]) for i in range(5)]
    got = jaccard.jaccard_components(frame(spark, texts), rare=4).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts) and got[40].component_id == 0


def test_hot_joins_keep_all_rows(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 9 == 0, None).otherwise(F.col("id")).alias("key"), F.col("id").alias("x")).cache()
    small = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "d")], "key long, y string")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "key", how).collect()))
        assert sorted(map(str, shared.join_hot(big, small, "key", how, 50).collect())) == want


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], EMPTY)).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (3, "A b c"), (3, "A b c"), (2, "a b c")], EMPTY)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_components(df).collect())
    assert got == [(-1, 1, -1), (2, 1, 2), (3, 1, 2), (3, 1, 2)]


def test_boundary_is_the_cheapest():
    assert jaccard.choose_boundary([(500, 1000)], 75) == 0
    assert jaccard.choose_boundary([(5, 100_000), (500, 10)], 75) >= 5


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (base[i] + rng.normal(0, 0.15, 16)).tolist()) for i in range(100)] + [(400 + i, base[3].tolist()) for i in range(5)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, None]), (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, leaf=32).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = {i: [] for i, _ in rows}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95:
                links[a].append(b)
    found, there = sum(v[0] for v in got.values()), sum(map(len, links.values()))
    assert set(got) == set(links) and 0.9 * there <= found <= there
    assert all(got[i] == (0, i, True) for i in (500, 501, 502, 503, 504, 505))
    assert got[404][1] == got[3][1] <= 3
    # leaves that are dealt out in blocks find the same
    blocks = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, leaf=32, most_leaf=8).collect()}
    assert blocks == {k: v[0] for k, v in got.items()}
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_embeddings_recall_in_deep_trees(spark):
    """Planted pairs near the threshold, dense groups, trees of depth 9: recall against all pairs."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    def near(v, cosine):
        w = rng.normal(size=v.shape)
        w -= (w * v).sum(axis=1, keepdims=True) * v
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        c = np.asarray(cosine)[:, None]
        return c * v + np.sqrt(1 - c * c) * w

    group = near(np.repeat(base[:3], 150, axis=0), rng.uniform(0.96, 0.999, 450))
    x = np.concatenate([base, near(base[500:2500], rng.uniform(0.945, 0.97, 2000)), group])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, leaf=12).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.95).sum(axis=1) - 1
    lone = np.arange(500, 2500)  # pairs outside the dense groups
    recall, pairs = sum(got.values()) / want.sum(), sum(got[i] for i in lone) / want[lone].sum()
    print(f"recall {recall:.4f} of {want.sum() // 2} pairs, {pairs:.4f} outside dense groups")
    assert 0.95 <= min(recall, pairs) and all(got[i] <= want[i] for i in got)


def test_embeddings_edges(spark):
    big = [(1, [1e200] * 4), (2, [2e200] * 4), (3, [1e-200] * 4), (4, [1.0] * 4), (5, [float("inf"), 1.0, 1.0, 1.0])]
    rows = [*big, (6, [1.0, 0.0, 0.0, 0.0]), (6, [0.0, 1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0, 0.1]), (8, [0.0, 1.0, 0.0, 0.1]), (None, [1.0] * 4), (None, None), (4, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cls": F.lit("x"), "size": F.lit(1), "vector": F.lit(None).cast("string")})
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=lambda r: r[0] or 0)
    assert got[0] == (None, 0, None, False) and got[1:5] == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False)]
    assert got[5] == (5, 0, 5, True) and got[6][1] == 1 and got[7][1] + got[8][1] == 1 and len(got) == 9


def test_embeddings_of_many_widths(spark):
    rows = [(3 * w + i, [1.0 * (w % 5), 1.0, *[float(i == 2)] * 9][: w + 1]) for w in range(1, 9) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    few, embed_dedup.MAX_WIDTHS = embed_dedup.MAX_WIDTHS, 3
    try:
        assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == want and any(r[1] for r in want)
    finally:
        embed_dedup.MAX_WIDTHS = few


def test_hot_classes_are_dealt_out(spark):
    """More than half of all vectors, texts and links hang on one."""
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 2600)] + [(3000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9999).collect()}
    assert len(found) == len(rows) and found[1234][0] >= 2599 and {found[i] for i in range(2600)} == {found[0]} and found[0][1] == 0
    texts = ["one two three four five six"] * 2300 + ["", None] + [f"w{i} a b c d e" for i in range(50)]
    out = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), EMPTY))
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: 0 if i < 2300 else i for i in range(len(texts))}
    star = spark.range(1, 2400).select(F.lit(9000).cast("long").alias("a"), F.col("id").alias("b"))
    assert {r.component for r in shared.components(star.union(star)).collect()} == {1}


def test_partitions_follow_the_bytes(spark):
    df, usual = spark.range(10), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shared.dealt(df, "id", 1 << 20).rdd.getNumPartitions() <= usual
    assert shared.dealt(df, "id", (usual + 3) << 26).rdd.getNumPartitions() == usual + 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (300, 200), (300, 250)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def test_decontamination(spark):
    items = [(1, "The quick, brown fox jumps over the lazy dog today again"), (2, "tiny one"), (3, None), (4, "..."), (10, "tiny one")]
    texts = ["x THE quick brown fox jumps over the lazy dog -- today y tiny. One!", "quick brown fox", None, "", "tiny tiny one one", "tinyone"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan_documents(frame(spark, texts), bench).orderBy("doc_id").collect()
    assert [r.n_hit for r in got] == [12, 0, 0, 0, 2, 0] and got[0]["items"] == ["1", "10", "2"]
    assert [texts[0].encode()[a:b] for a, b in got[0].spans] == [b"THE quick brown fox jumps over the lazy dog -- today", b"tiny. One"]
    split = decontam.scan_documents(frame(spark, texts), bench, most_bytes=1).orderBy("doc_id").collect()
    assert [(r.n_hit, r["items"]) for r in split] == [(r.n_hit, r["items"]) for r in got]
    out = decontam.decontaminate(frame(spark, texts), bench).orderBy("doc_id").first()
    assert out.items_sha256 == decontam.sha256_of([1, 2, 10])
    assert decontam.decontaminate(frame(spark, texts), bench.where("false")).where("contaminated").count() == 0


def test_pieces_round_trip_and_best_score(spark):
    path = queries.default_model()
    texts = [*corpus(5, 10, 40), "  two  spaces ", "emoji 😀 and ▁ mark", "\n\n tabs\t", "名前 x", "a" * 3000]
    coded = pieces.encode(frame(spark, texts, True), path)
    back = {r.doc_id: r.text for r in pieces.decode(coded, path).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    vocabulary = pieces.Vocabulary.load(path)
    score = dict(zip(vocabulary.pieces, vocabulary.scores))
    machine = pieces.automaton(vocabulary)
    for word in ("▁hello", "▁▁international", "▁größe", "▁naïve's"):
        raw = word.encode()
        best = [0.0] + [-np.inf] * len(raw)
        for end in range(1, len(raw) + 1):
            for begin in range(end):
                if raw[begin:end] in score:
                    best[end] = max(best[end], best[begin] + score[raw[begin:end]])
        number, many = pieces.viterbi(machine, np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), np.zeros(len(raw), bool))
        assert sum(vocabulary.scores[i] for i in number) == pytest.approx(best[-1])
        assert b"".join(vocabulary.pieces[i] for i in number) == raw
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first().text == ""


def test_sentencepiece_query_matches_brute_force(spark, sf_dir):
    """Every document of the query's table: the ids decode to the text and reach the largest total, word by word."""
    path = queries.default_model()
    vocabulary = pieces.Vocabulary.load(path)
    score, longest = dict(zip(vocabulary.pieces, vocabulary.scores)), max(map(len, vocabulary.pieces))
    ids, floor = dict(zip(vocabulary.ids, vocabulary.scores)), min(vocabulary.scores) - 10.0
    docs = queries.read(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in queries.op9_sentencepiece(spark, sf_dir).collect()}
    known = {}

    def best(word):
        if word not in known:
            raw, top = word.encode(), [0.0]
            starts = [i for i in range(len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
            for end in range(1, len(raw) + 1):
                options = [top[a] + score[raw[a:end]] for a in range(max(0, end - longest), end) if raw[a:end] in score]
                if end in starts:
                    options.append(top[starts[starts.index(end) - 1]] + floor)
                top.append(max(options, default=-np.inf))
            known[word] = top[-1]
        return known[word]

    coded = {r.doc_id: r for r in pieces.encode(docs.where("n_chars < 2500"), path).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        text = r.text or ""
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if r.doc_id in coded and "▁" not in text and text:
            mine = coded[r.doc_id].ids
            assert rows[r.doc_id].n_pieces == len(mine) and rows[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest()
            words = re.findall("▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁"))
            total = sum(ids[i] for i in mine if i in ids)
            odd = len({i for i in mine if i not in ids})
            assert odd or total == pytest.approx(sum(map(best, words)))


def test_long_words_are_cut_like_short_ones(spark):
    vocabulary = pieces.Vocabulary.load(queries.default_model())
    machine, rng = pieces.automaton(vocabulary), random.Random(2)
    for size in (1, 511, 1025, 4000):
        text = "".join(rng.choice("aàb ▁😀名thein\n1") for _ in range(size))
        data, _, plain = pieces._marked([text])
        whole = np.array([0]), np.array([len(data)])
        near, far = (pieces.viterbi(machine, data, *whole, plain, long=n)[0].tolist() for n in (1 << 40, 0))
        assert near == far
    texts = ["x" * 200_000, "名前" * 30_000, "short " * 3 + "y" * 600, None]
    coded = pieces.encode(frame(spark, texts), queries.default_model(), decoded=True).orderBy("doc_id").collect()
    assert [r.text for r in coded] == [t or "" for t in texts]
    assert pieces.encode(frame(spark, []), queries.default_model()).count() == 0


def test_languages(spark, sf_dir):
    docs = queries.read(spark, sf_dir, "documents")
    got = queries.op1_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    protos = langid.language_prototypes(docs.select("text", "lang"))
    rows = langid.predict_language(spark.createDataFrame([(1, None), (2, "123 ..."), (3, "é")], EMPTY), protos).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows][:2] == ["und", "und"] and rows[2].lang_pred != "und"
    assert langid.predict_language(spark.createDataFrame([(1, "abc")], EMPTY), {}).first().lang_pred == "und"


def test_languages_in_lots(spark, sf_dir):
    """More languages than go to the tasks at once: the same result, ties and blanks included."""
    docs = queries.read(spark, sf_dir, "documents")
    train = docs.select("text", "lang")
    train = train.union(train.where("lang = 'en'").withColumn("lang", F.lit("aa"))).union(train.where("lang = 'de'").withColumn("lang", F.lit("zz")))
    rows = docs.select("doc_id", "text").limit(60).union(spark.createDataFrame([(-1, None), (-2, "12 .."), (None, "x"), (None, "x")], EMPTY))
    rows = rows.withColumns({"lang_pred": F.lit(1), "n_letters": F.lit("q")})
    one, lots = langid.language_prototypes(train), langid.language_prototypes(train, most=2)
    assert isinstance(one, dict) and len(one) == lots.count() > 4
    get = lambda p: sorted(map(str, langid.predict_language(rows, p, carry=rows.columns, count_letters=True, most=2).collect()))
    assert get(lots) == get(one) and any("'aa'" in r for r in get(one)) and not any("'zz'" in r for r in get(one))
    assert langid.predict_language(rows.where("false"), lots, most=2).count() == 0
    clash = rows.withColumnsRenamed({"lang_pred": "_lot_pred"}).withColumns({"lang_score": F.lit("s"), "_lot_score": F.lit(2), "_lot_letters": F.lit("t")})
    plain = lambda p: sorted(map(str, langid.predict_language(clash, p, carry=clash.columns, most=2).collect()))
    assert plain(lots) == plain(one) and "n_letters='q'" in plain(lots)[0] and "_lot_letters='t'" in plain(lots)[0]


def brute_languages(train, texts, dimensions=1024):
    """Language and cosine of each text, gram by gram."""
    L = langid.letter_vectors(dimensions).astype(float)
    slots = langid._slots()

    def vector(text):
        codes = [0]
        for c in text or "":
            s = int(slots[ord(c)])
            if s or codes[-1]:
                codes.append(s)
        codes += [0] if codes[-1] else []
        out = np.zeros(dimensions)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            out += np.roll(L[a], 2) * np.roll(L[b], 1) * L[c]
        return out

    total = {}
    for text, lang in train:
        if text is not None and lang is not None:
            v = vector(text)
            total[lang] = total.get(lang, 0) + np.rint(v / np.sqrt(max(np.linalg.norm(v), 1e-12)) * 1024)
    unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in total.items()}
    out = []
    for text in texts:
        v = vector(text)
        if not any(slots[ord(c)] for c in text or ""):
            out.append(("und", 0.0))
        else:
            best = min((-round(float(v @ u) / max(np.linalg.norm(v), 1e-12), 12), k) for k, u in unit.items())
            out.append((best[1], min(1.0, max(0.0, -best[0]))))
    return out


def test_language_query_matches_brute_force(spark, tmp_path):
    """The query op1 on a small table with nulls, blanks, repeats, ties, a long text and clashing columns."""
    rng = random.Random(4)
    words = {"aa": "lorem dolor amet ipsum sit".split(), "bb": "größe straße für über weiß".split(), "cc": "kala talo mökki järvi".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 30))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(60))]
    rows += [(60, None, "aa"), (61, "", "bb"), (62, "12 ..", None), (63, "x", None), rows[0], rows[0], (64, "dolor größe " * 4000, None), (None, "lorem", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("zz"), "score": F.lit(9), "n_letters": F.lit("q")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op1_language_id(spark, str(tmp_path)).select("doc_id", "lang_pred", "score", "held_out").collect()), key=str)
    import zlib

    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5 == 0
    # a null doc_id is not known to be held out: it teaches nothing
    want = brute_languages([(t, k) for i, t, k in rows if held(i) is False], [t for _, t, _ in rows])
    want = sorted(((i, lang, pytest.approx(score, abs=1e-9), held(i)) for (i, _, _), (lang, score) in zip(rows, want)), key=lambda r: str((r[0], r[1], r[2].expected, r[3])))
    assert got == want and {g[1] for g in got} == {"aa", "bb", "cc", "und"}
    assert queries.op1_language_id(spark, str(tmp_path)).where("false").count() == 0


def test_bundles_add_bound_letters():
    import pyarrow as pa

    v, letters = langid.bundles(pa.array(["aB", "", None, "a b"]), 3, 64)
    assert list(letters) == [2, 0, 0, 2] and not v[1].any()
    L = langid.letter_vectors(64).astype(float)
    gram = lambda a, b, c: np.roll(L[a], 2) * np.roll(L[b], 1) * L[c]
    assert np.allclose(v[0], gram(0, 1, 2) + gram(1, 2, 0))
    assert np.allclose(v[3], gram(0, 1, 0) + gram(1, 0, 2) + gram(0, 2, 0))


def test_quality(spark, sf_dir):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest labels are all of one class
    got = queries.op6_quality(spark, sf_dir).join(queries.read(spark, sf_dir, "labels"), "doc_id").where("held_out")
    assert BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="quality").evaluate(got.withColumn("quality", F.col("quality").cast("double"))) > 0.85
    docs = spark.createDataFrame([(1, None), (2, "")], EMPTY)
    assert [r.score for r in quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()] == [0.5, 0.5]


def test_quality_query_matches_brute_force(spark, sf_dir):
    """The fitted score again from its parts: normal equations solved at once, pool-adjacent-violators by loops."""
    docs, labels = queries.read(spark, sf_dir, "documents"), queries.read(spark, sf_dir, "labels").where(~queries.held_out())
    rows = {r.doc_id: np.array(r.statistics) for r in quality.describe(docs).collect()}
    known = sorted((r.doc_id, r.quality) for r in labels.distinct().collect() if r.quality in (0, 1) and r.doc_id in rows)
    import zlib

    x = np.array([rows[i] for i, _ in known])
    y = np.array([v for _, v in known], float)
    fold = np.array([zlib.crc32(f"calibrate {i}".encode()) % 5 for i, _ in known])
    model = quality.FourierRidge(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), 192, 0.02)
    t = model.transform(x[fold != 0])
    model.weights = np.linalg.solve(t.T @ t + np.eye(t.shape[1]), t.T @ y[fold != 0])
    blocks = []  # mean, weight, first and last raw score
    for raw, label in sorted(zip(model.raw(x[fold == 0]), y[fold == 0])):
        blocks.append([label, 1, raw, raw])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    at, value = zip(*[(p, b[0]) for b in blocks for p in (b[2], b[3])])
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, sf_dir).collect()}
    want = dict(zip(rows, np.clip(np.interp(model.raw(np.array(list(rows.values()))), at, value), 0, 1)))
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_quality_edges(spark):
    texts = [(i, ("Good words stand here. " if i % 2 else "x# $ zz 9 ") * (1 + i % 7)) for i in range(120)]
    docs = spark.createDataFrame([*texts, texts[0], (200, None), (None, "Good words.")], EMPTY).withColumns({"label": F.lit("q"), "score": F.lit(3), "quality": F.lit(0)})
    marks = [(i, i % 2) for i in range(100)] + [(0, 1), (5, 5), (6, None), (999, 1), (7, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 123 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[119] > 0.5 > by[118] and quality.quality_scores(docs.where("false"), labels).count() == 0


def test_licenses(spark):
    texts = ["x\nreleased UNDER the MIT license\ny", "Released under the BSD license.", None, "", "\n".join(["Licensed under CC BY-NC 4.0."] * 2) + "\nLicensed under the Apache License, version 2.0"]
    got = [tuple(r)[1:] for r in licenses.scan_licenses(frame(spark, texts, True)).orderBy("doc_id").collect()]
    assert got == [(1, "MIT", 1.0), (0, "", 0.0), (0, "", 0.0), (0, "", 0.0), (3, "Apache-2.0,CC-BY-NC-4.0", 1.0)]


def test_licenses_wrapped_and_in_sentences(spark):
    """Notices over several lines and inside sentences; no line of them reaches the threshold."""
    by = {}
    for name, text in licenses.TEMPLATES:
        by[name] = max(by.get(name, ""), text, key=len)
    texts = ["Copyright 2020 X\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(by[n], 72)) + "\n\nmore words follow here" for n in sorted(by)]
    got = [tuple(r)[2:] for r in licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(n, 1.0) for n in sorted(by)]
    inside = ["This file is released under the MIT License.", "We wrote it last year. Released under the MIT License. Ask us about it.", "the mit license", "released under the old licence", "a", None]
    df = frame(spark, inside).union(spark.createDataFrame([(None, inside[0]), (1, inside[1])], EMPTY))
    got = [tuple(r)[1:] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == [(0, "", 0.0), (0, "MIT", 1.0), (0, "MIT", 1.0), (0, "MIT", 1.0), (0, "", 0.0), (0, "", 0.0), (0, "", 0.0), (0, "", 0.0)]
    dnl = "\n".join(f"dnl {x}" for x in textwrap.wrap(by["ISC"], 72))  # words of a comment mark stand in between
    assert [r.licenses for r in licenses.scan_licenses(frame(spark, [dnl])).collect()] == ["ISC"]


def test_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.com/en/1?x", None), (2, "http://example.com/en/77", ""), (3, "no scheme", None), (4, None, None), (5, "https://a.net/de/x#y", None),
        (6, "https://b.example.net/de/8", None), (7, "x://good.io/p", '<a href="https://bad.org/es/1">'), (8, "x://bad.org/es/2", ""), (9, "x://bad.org/fr/2", ""), (10, "http://bad.org/es/3", None), (11, "a://h?q", ""),
        (12, "x://far.io", '<a href="//good.io/z"><img src=\'http://else.io\'>'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: tuple(r)[1:5] for r in urls.judge_urls(df).collect()}
    assert got[1] == ("www.example.com", "/en/1", "com/en/", "block") and got[2][2:] == ("example.com/en/7", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("example.net/de/8", "block")
    assert got[9] == ("bad.org", "/fr/2", None, "block") and got[7][2:] == (None, "block") and got[12][2:] == (None, "allow") and got[11] == ("h", "", None, "allow")
    brute = {"bad.org": 2 / 3, "good.io": 0.0, "far.io": 0.0}
    for _ in range(10):  # against the links: good -> bad, far -> good, far -> else
        brute = {"bad.org": 0.15 * 2 / 3, "good.io": 0.85 * brute["bad.org"], "far.io": 0.85 * brute["good.io"]}
    score = {r.host: r.distrust for r in urls.judge_urls(df).select("host", "distrust").distinct().collect()}
    assert all(abs(score[h] - v) < 1e-9 for h, v in brute.items())
    assert urls.judge_urls(df.where("false")).count() == 0


def brute_verdicts(rows, rules, threshold=0.075, damping=0.85, rounds=10):
    """Verdict, trust and distrust of every page, by loops over dictionaries."""
    def split(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=(0, None, None))[1:]

    links, share = set(), {}
    for _, url, html in rows:
        host = split(url)[0]
        if host:
            share.setdefault(host, []).append(rule(*split(url))[1])
        for target in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)""", html or ""):
            to = split("http:" + target if target.startswith("//") else target)[0]
            if host and to and host != to:
                links.add((host, to))
    hosts = set(share) | {x for link in links for x in link}
    seed = {v: {h: (share.get(h, []).count(v) / len(share[h]) if h in share else 0.0) for h in hosts} for v in ("allow", "block")}
    score = {v: dict(seed[v]) for v in seed}
    for _ in range(rounds):
        new = {v: {h: (1 - damping) * seed[v][h] for h in hosts} for v in seed}
        for a, b in links:
            new["allow"][b] += damping * score["allow"][a] / sum(x == a for x, _ in links)
            new["block"][a] += damping * score["block"][b] / sum(y == b for _, y in links)
        score = new
    out = []
    for page, url, _ in rows:
        host, path = split(url)
        name, verdict = rule(host, path)
        good, bad = (score[v].get(host, 0.0) for v in ("allow", "block"))
        out.append((page, host, path, name, verdict or ("block" if bad >= threshold and bad > good else "allow"), round(good, 9), round(bad, 9)))
    return sorted(out)


def judged(df, **options):
    return sorted((*tuple(r)[:5], round(r.trust, 9), round(r.distrust, 9)) for r in urls.judge_urls(df, **options).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect())


@pytest.mark.parametrize("damping", [0.85, 0.95])
def test_urls_of_linked_hosts_match_brute_force(spark, damping):
    rng = random.Random(3)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org', 'io'])}" for i in range(25)]
    rows = []
    for i in range(300):
        html = " ".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/x">' for _ in range(rng.choice([0, 0, 1, 3])))
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 9)}?q", html))
    rows += [(300, None, html), (301, "no scheme", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = judged(df, damping=damping)
    assert got == brute_verdicts(rows, urls.RULES, damping=damping) and {g[4] for g in got if g[3] is None} == {"allow", "block"}
    # one link elsewhere changes nothing for the rest, as without any link
    alone = [(p, u, None) for p, u, _ in rows]
    other = [(900, "http://a.xyz/", '<a href="http://b.xyz/">')]
    want = brute_verdicts(alone, urls.RULES, damping=damping)
    assert judged(spark.createDataFrame(alone, df.schema), damping=damping) == want
    assert [r for r in judged(spark.createDataFrame(alone + other, df.schema), damping=damping) if r[0] != 900] == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(name, spark, sf_dir, duck):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    key, doc, pos = rng.integers(-(2**63), 2**63, 500), rng.integers(-5, 90, 500), rng.integers(0, 10**6, 500)
    check, known = rng.integers(0, 2**16, 500).astype(np.uint16), rng.random(500) < 0.5
    batch = kernels.pack(key, doc, pos, check, known, 7)
    back = sorted(zip(*(x.tolist() for x in kernels.unpack(batch.column("places")))))
    assert back == sorted(zip(key.tolist(), doc.tolist(), pos.tolist(), check.tolist(), known.tolist()))


def test_pipeline(spark, sf_dir):
    """run() against the same decisions by brute force."""
    import corpus_pipeline as P

    got = {r.doc_id: list(r.ids) for r in P.run(spark, sf_dir).collect()}
    docs = {r.doc_id: r for r in queries.read(spark, sf_dir, "documents").collect()}
    protos = langid.language_prototypes(queries.read(spark, sf_dir, "documents").where(~queries.held_out()).select("text", "lang"))
    kept = {r.doc_id for r in langid.predict_language(queries.read(spark, sf_dir, "documents"), protos).where(f"lang_pred <> 'und' and lang_score >= {P.MIN_LANGUAGE_SCORE}").collect()}
    ids = sorted(kept)
    groups = brute_components([docs[i].text for i in ids])
    ids = [i for k, i in enumerate(ids) if groups[k][2] == k]
    texts = {}
    for i, (_, _, n, _, _) in zip(ids, brute_strings([docs[i].text for i in ids], 200)):
        texts[i] = (docs[i].text, n)
    cut = {r.doc_id: r for r in suffix.dedup_substrings(queries.read(spark, sf_dir, "documents").where(F.col("doc_id").isin(ids))).collect()}
    assert {i: cut[i].n_removed for i in ids} == {i: n for i, (_, n) in texts.items()}
    windows = decontam.item_windows([(r.item_id, r.text) for r in queries.read(spark, sf_dir, "benchmark").collect()], 10)
    clean = [i for i in ids if cut[i].text and not any(w in b" " + b" ".join(decontam.normal_words(cut[i].text)) + b" " for w in windows)]
    assert sorted(got) == clean
    vocabulary = pieces.Vocabulary.load(queries.default_model())
    for i in clean:
        out = pieces.decode_ids(vocabulary, np.array(got[i], np.int64), np.array([0, len(got[i])]))
        assert out[0].decode() == cut[i].text


def test_pipeline_stages_keep_null_ids_and_drop_repeats_once(spark, sf_dir):
    import corpus_pipeline as P

    docs = queries.read(spark, sf_dir, "documents").select(*P.COLUMNS).where("lang = 'en' and n_chars between 300 and 3000").orderBy("doc_id").limit(12)
    one, two, three = docs.collect()[:3]
    bench = queries.read(spark, sf_dir, "benchmark").where("length(text) > 100").first().text
    nulls = [(None, "A wholly other text, told by nobody else in this table.", "en", "n", 0), (None, bench, "en", "n", 0)]
    rows = [*map(tuple, docs.collect()), tuple(one), tuple(one), (two.doc_id, two.text, "aa", "s", two.n_chars), *nulls]
    df = spark.createDataFrame(rows, docs.schema)
    count = lambda x, i: x.where(F.col("doc_id").eqNullSafe(F.lit(i))).count()
    assert P.language_id(spark, df, sf_dir).count() == len(rows)
    near = P.near_duplicates(spark, df, sf_dir)
    assert (count(near, one.doc_id), count(near, two.doc_id), count(near, three.doc_id), count(near, None)) == (1, 1, 1, 2)
    assert near.where(F.col("doc_id") == two.doc_id).first().lang == "aa"
    cut = P.repeated_strings(spark, df, sf_dir)
    assert (count(cut, one.doc_id), count(cut, two.doc_id), count(cut, None)) == (3, 2, 2)
    assert {r.text for r in cut.where("doc_id is null").collect()} == {n[1] for n in nulls}
    assert sorted((r.lang, r.source) for r in cut.where(F.col("doc_id") == two.doc_id).collect()) == sorted([("aa", "s"), (two.lang, two.source)])
    left = P.decontaminate(spark, df, sf_dir)
    assert (count(left, one.doc_id) in (0, 3), count(left, None)) == (True, 1)
    assert P.encode(spark, df, sf_dir).count() == len(rows)


def test_decontamination_passes_keep_rows_apart(spark):
    bench = spark.createDataFrame([(1, "tiny one"), (2, "one two"), (3, "third three")], "item_id long, text string")
    df = spark.createDataFrame([(None, "a tiny  one, two"), (None, "plain"), (1, "plain"), (1, "third three"), (1, "third three"), (None, None)], EMPTY)
    for spans in (True, False):
        one, many = (sorted(map(str, decontam.scan_documents(df, bench, spans=spans, most_bytes=most).collect())) for most in (8 << 20, 1))
        assert len(one) == 6 and one == many


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(None, "tiny one"), (2, "one two"), (2, "one two")], "item_id long, text string")
    assert decontam.decontaminate(spark.createDataFrame([], EMPTY), bench).count() == 0
    df = spark.createDataFrame([(1, "a tiny one two"), (1, "a tiny one two"), (None, "tiny one")], EMPTY).withColumn("items", F.lit(1)).withColumn("n_hit", F.lit("x"))
    for most in (1, 8 << 20):
        got = sorted((r.doc_id or 0, r.n_hit, r.n_items, r.items_sha256) for r in decontam.decontaminate(df, bench, most_bytes=most).collect())
        assert got == [(0, 2, 0, decontam.sha256_of([])), (1, 3, 1, decontam.sha256_of([2])), (1, 3, 1, decontam.sha256_of([2]))]


def test_clean_rows_in_several_passes(spark):
    items = [(1, "tiny one"), (2, "other two"), (3, "third three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(None, "a tiny one"), (None, "plain"), (1, "plain"), (1, "a third three"), (1, "plain")], EMPTY)
    for most in (1, 8 << 20):
        got = decontam.clean_rows(df, bench, most_bytes=most).collect()
        assert sorted(map(str, got)) == sorted(map(str, [df.collect()[i] for i in (1, 2, 4)]))


def test_short_documents_of_each_language_are_kept(spark, sf_dir):
    import corpus_pipeline as P

    docs = queries.read(spark, sf_dir, "documents").select(*P.COLUMNS)
    short = ["A.", "Avec.", "Y.", "Und.", "I", "à", "Erö.", "qzx kwv jjq", "A.\nAll rights reserved."]
    bad = [None, "", "12 34 !!", "Tämä on suomenkielinen lause, jossa puhutaan säästä ja kahvista. " * 5, "xkcd qqqq zzzz wvwv" * 20]
    more = spark.createDataFrame([(-1 - i, t, "en", "x", 0) for i, t in enumerate(short + bad)], docs.schema)
    # the added rows are all held out or few, so the prototypes are those of the table
    kept = {r.text for r in P.language_id(spark, docs.union(more), sf_dir).where("doc_id < 0").collect()}
    assert set(short) <= kept and not kept & set(bad[1:3]) and bad[4] not in kept


def test_pipeline_stages_of_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    docs = queries.read(spark, sf_dir, "documents").where("false").withColumn("n_letters", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name
        assert name == "encode" or out.columns == list(corpus_pipeline.COLUMNS)


def test_a_worker_lets_go_of_other_operators_caches():
    pieces.automaton(pieces.Vocabulary([b"a", b"ab"], [-1.0, -2.0], [3, 4], [-1] * 256, 0, {3: b"a", 4: b"ab"}))
    kernels.arrive("claimlens.llm.pieces")
    kernels.arrive("claimlens.llm.pieces")
    assert pieces.automaton.cache_info().currsize
    kernels.arrive("claimlens.llm.jaccard")
    assert not pieces.automaton.cache_info().currsize and not kernels._POWERS


def test_anchors_of_long_batches_take_little_memory(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from claimlens.llm import kernels, suffix

    monkeypatch.setattr(suffix, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, 4000, dtype=np.uint8)).decode() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    kernels._POWERS.clear()
    tracemalloc.start()
    rows = sum(b.num_rows for b in suffix._anchors(200)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 50_000 and peak < 48 << 20


def test_repeated_strings_memory_of_a_task():
    """A task that sorts 12,000 surroundings holds a few times their bytes, and leaves no table of powers in its idle worker."""
    import tracemalloc

    import pyarrow as pa

    rng, n, size = np.random.default_rng(5), 12_000, 368
    body = np.tile(rng.integers(97, 123, (n // 2, size), np.uint8), (2, 1))
    body[n // 2 :, 300:] = 65  # each shares 300 bytes with another
    key, zero = np.tile(np.arange(n // 2), 2), np.zeros(n, np.int64)
    around = pa.array([x.tobytes() for x in body], pa.binary())
    batch = kernels.table(suffix._AROUND, key, zero, np.arange(n), np.full(n, 168, np.int32), np.full(n, 168, np.int32), around, np.zeros(n, bool))
    kernels._POWERS.clear()
    tracemalloc.start()
    try:
        spans = list(kernels.lean(suffix._spans(200))(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = pa.Table.from_batches(spans).to_pandas().sort_values("doc_id")
    assert found["doc_id"].tolist() == list(range(n)) and set(found["start"]) == {0} and set(found["end"]) == {300}
    assert peak < 48 << 20 and not kernels._POWERS


@pytest.mark.parametrize("operator", [
    lambda docs: langid.predict_language(docs, {"en": np.ones(1024)}),
    lambda docs: decontam.clean_rows(docs, docs.limit(1).select(F.col("doc_id").alias("item_id"), F.lit("a b").alias("text"))),
    lambda docs: pieces.encode(docs, queries.default_model()),
    lambda docs: jaccard.jaccard_components(docs),
    lambda docs: suffix.repeated_spans(docs),
])
def test_texts_reach_tasks_in_small_batches(spark, operator):
    """Neither the JVM nor a Python worker holds thousands of long texts at once."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 4000).alias("text"))
    before = spark.conf.get(limit)
    spark.conf.unset(limit)
    try:
        operator(docs.limit(2))
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    finally:
        spark.conf.set(limit, before)
    assert sum(r.n for r in sizes) > 12_000_000 and max(r.n for r in sizes) < 5 << 20


def test_limit_of_batches_set_by_the_user_stays(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1m")
    try:
        shared.texts(spark.range(2).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.set(limit, before)
