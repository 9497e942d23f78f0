"""Phrase mining against plain loops over all phrases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimlens.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, depth=4, least=30, share=(80, 100), top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lower(text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            totals["und" if lang is None else lang] += len(w)
            counts.update(("und" if lang is None else lang, *w[i : i + k]) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, f in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                if share[1] * f >= share[0] * candidates[p[0], *p[i : i + k]]:
                    dropped.add((p[0], *p[i : i + k]))
    by_lang = {}
    for p, a in candidates.items():
        if p not in dropped:
            score, _, l, r = min((2000000 * a // (counts[p[: k + 1]] + counts[p[0], *p[k + 1 :]]), k, counts[p[: k + 1]], counts[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1))
            by_lang.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -score) for lang, own in by_lang.items() for i, (score, a, p, l, r) in enumerate(sorted(own)[:top]))


def corpus(seed=1, n=80):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "ß", "日本", "x'", "a-b", "\x00", "\x1c", " ", "ñu"] + [f"w{i}" for i in range(30)]
    line = "in the middle of Nowhere"
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary[: 3 + i % 40]) + rng.choice(["", "", "", ".", ",", "\n", ";x"]) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words[len(words) // 2 : 0] = [line] * (1 + i % 2)
        out.append((i, rng.choice([" ", "  ", "\t", " \t"]).join(words), rng.choice(["en", "en", "de", None, "und", ""])))
    return out + [(None, None, "en"), (900, "", None), (901, " .\n ", "fr"), (902, "word " * 400, "en"), (903, "a b a b " * 90, "xx"), (5, out[5][1], out[5][2])]


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "phrase": F.lit(1), "word": F.lit(None).cast("long")})
    plain = {k: v for k, v in options.items() if k != "budget"}
    found = phrases.mine_phrases(df.repartition(3), **options)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(rows, **plain)


@pytest.mark.parametrize("options", [{"least": 30}, {"least": 2}, {"least": 3, "budget": 40}, {"least": 2, "budget": 5}, {"least": 2, "depth": 2, "budget": 20}, {"least": 2, "depth": 5, "budget": 60}, {"least": 3, "top": 4}])
def test_phrases(spark, options):
    same(spark, corpus(), **options)


def test_a_word_of_half_the_corpus_is_split(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(x for _ in range(40) for x in ("the", f"w{rng.randint(0, 6)}")), "en") for i in range(50)]
    same(spark, rows, least=5, budget=150)


def test_phrases_edges(spark):
    for rows in ([], [(1, None, None)], [(1, "lonely words here", "en")], [(1, "x" * 100000, "en"), (2, "b c " * 30000, None)]):
        same(spark, rows)


def test_slices_keep_documents_apart(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 200)
    same(spark, corpus(7), least=4, budget=70)


def test_a_full_filter_only_costs_pruning(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    same(spark, corpus(9), least=6)
