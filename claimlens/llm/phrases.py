"""Phrase collocation mining by vertical partitioning of the suffixes.

Every word opens a suffix: itself and the words after it in its piece, ``depth`` at most.  A first scan counts words, which gives
how many suffixes each prefix of one word has.  A prefix with more than the memory budget is replaced by its extensions by one more
word, which another scan counts, and so on.  All prefixes within the budget are put together, in the order of their hash, to
groups of about the budget each.  The last scan sends every suffix to the group of its prefix, and each group builds the tree of
its suffixes to that depth by itself, level by level; the total of a node is the count of the phrase that leads to it.

Suffixes end before a word that is too rare to be part of any result, as far as a filter of bounded size tells.
Tasks settle equal suffixes among their own, so a phrase reaches its group at most once for each slice of
text, however often it occurs.  Counts belong to the words themselves; hashes only route.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, join_hot, materialise

SLICE, LEAST_BUDGET = 4 << 20, 1 << 17
MOST_BITS = 1 << 26  # of the filter: 8 MB
BREAK = K.lut([*b".,;:!?", *range(0x0A, 0x0E)])
BETWEEN = BREAK | K.lut([0x20, 0x09])
_COUNT = pa.schema([("lang", pa.large_string()), ("word", pa.large_string()), ("key", pa.int64()), ("n", pa.int64())])
_LEVEL = pa.schema([("above", pa.int64()), ("word", pa.large_string()), ("key", pa.int64()), ("n", pa.int64())])
_PHRASE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("a", pa.int64())])


class Slice:
    """Words of some texts as codes, with how many words follow each in its suffix."""

    def __init__(self, part: pa.RecordBatch, common: np.ndarray | None, depth: int):
        data, off = K.flat(part.column("text"))
        data = K.LOWER[data]
        start, end, first = K.words(data, off, BETWEEN)
        border = np.concatenate(([0], np.cumsum(end - start)))
        letters = data[~BETWEEN[data]]
        coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(border), pa.py_buffer(letters)]).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        lang = part.column("lang").cast(pa.large_string()).fill_null("und").dictionary_encode()
        self.langs = lang.dictionary
        self.lang = np.repeat(lang.indices.to_numpy(zero_copy_only=False), np.diff(first))
        self.size = len(self.words) + 1
        self.pairs, self.pair = np.unique(self.lang.astype(np.int64) * self.size + self.code, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        raw, at = K.flat(self.words)
        of_word = K.span_hashes(raw, at[:-1], at[1:])
        of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], K.U64)
        self.pair_key = K.mix(of_word[self.pairs % self.size] + of_lang[self.pairs // self.size]) if len(self.pairs) else np.zeros(0, K.U64)
        kept = np.ones(len(start), bool)
        if common is not None and len(start):
            bit = self.pair_key & K.U64(len(common) * 64 - 1)
            kept = ((common[(bit >> K.U64(6)).astype(np.int64)] >> (bit & K.U64(63))) & K.U64(1)).astype(bool)[self.pair]
        n = len(start)
        piece = np.cumsum(BREAK[data], dtype=np.int32)[start] if n else start
        link = (piece[1:] == piece[:-1]) & kept[1:]
        inner = first[(first > 0) & (first < n)]
        link[inner - 1] = False
        ends = np.append(np.flatnonzero(~link), n - 1)
        self.left = np.where(kept, ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1, 0) if n else start
        self.left = np.minimum(self.left, depth).astype(np.int16)

    def at(self, place: np.ndarray, ahead: int) -> np.ndarray:
        return self.code[place + ahead]

    def hashes(self, place: np.ndarray, depth: int) -> np.ndarray:
        """Hash of the first ``depth`` words from each place."""
        out = self.pair_key[self.pair[place]]
        for ahead in range(1, depth):
            out = K.mix(out * K.U64(K._P) + self.pair_key[self.pair[place + ahead]])
        return out


class Prefixes:
    """Prefixes with more suffixes than a group may have: of one word, of two, and so on."""

    def __init__(self):
        self.levels: list[tuple[list, list[str], list[int]]] = []  # above (language, or number in the level above), word, count

    def states(self, s: Slice) -> list[np.ndarray]:
        """For each level and place the number of the prefix that begins there, or -1."""
        out, state = [], s.lang.astype(np.int64)
        for ahead, (above, words, _) in enumerate(self.levels):
            code = pc.fill_null(pc.index_in(pa.array(words, pa.large_string()), value_set=s.words), -1).to_numpy().astype(np.int64)
            up = pc.fill_null(pc.index_in(pa.array(above, pa.large_string()), value_set=s.langs), -1).to_numpy().astype(np.int64) if ahead == 0 else np.array(above, np.int64)
            here = np.flatnonzero((code >= 0) & (up >= 0))
            key = up[here] * s.size + code[here]
            order = np.argsort(key)
            key, here = key[order], here[order]
            place = np.flatnonzero((state >= 0) & (s.left > ahead))
            found = np.full(len(state), -1, np.int64)
            if len(key):
                probe = state[place] * s.size + s.at(place, ahead)
                slot = np.minimum(np.searchsorted(key, probe), len(key) - 1)
                found[place] = np.where(key[slot] == probe, here[slot], -1)
            out.append(found)
            state = found
        return out

    def phrases(self):
        """(language, words, count) of all prefixes."""
        paths: list[tuple] = []
        for depth, (above, words, counts) in enumerate(self.levels):
            paths = [(up, [w]) if depth == 0 else (paths[up][0], paths[up][1] + [w]) for up, w in zip(above, words)]
            yield from ((lang, own, n) for (lang, own), n in zip(paths, counts))


def _slices(batches, common, depth, size):
    for batch in batches:
        for part in K.slices(batch, size=size):
            yield Slice(part, common, depth)


def _word_counts():
    @K.lean
    def run(batches):
        for s in _slices(batches, None, 1, 2 * SLICE):
            counts = np.bincount(s.pair, minlength=len(s.pairs))
            yield K.table(_COUNT, s.langs.take(pa.array(s.pairs // s.size)), s.words.take(pa.array(s.pairs % s.size)), s.pair_key.view(np.int64), counts)
            total = np.bincount(s.lang, minlength=len(s.langs))
            yield K.table(_COUNT, s.langs, pa.nulls(len(total), pa.large_string()), np.zeros(len(total), np.int64), total)

    return run


def _extension_counts(hot: Prefixes, common, depth):
    ahead = len(hot.levels)

    @K.lean
    def run(batches):
        for s in _slices(batches, common, depth, SLICE):
            state = hot.states(s)[-1]
            place = np.flatnonzero((state >= 0) & (s.left > ahead))
            found, at, counts = np.unique(state[place] * s.size + s.at(place, ahead), return_index=True, return_counts=True)
            key = s.hashes(place[at], ahead + 1).view(np.int64)
            yield K.table(_LEVEL, found // s.size, s.words.take(pa.array(found % s.size)), key, counts)

    return run


def _suffixes(hot: Prefixes, borders: np.ndarray, common, depth):
    """Suffixes of two words and more (single words are counted already), settled by slice and packed by group."""

    @K.lean
    def run(batches):
        for s in _slices(batches, common, depth, SLICE):
            known = np.zeros(len(s.code), np.int16)
            for state in hot.states(s):
                known += state >= 0
            place = np.flatnonzero((s.left > known) & (s.left > 1))
            known, left = known[place] + 1, s.left[place]
            group = np.empty(len(place), np.int64)
            for d in range(1, depth + 1):
                mine = np.flatnonzero(known == d)
                group[mine] = np.searchsorted(borders, s.hashes(place[mine], d), "right")
            columns = [np.where(left > d, s.code[np.minimum(place + d, len(s.code) - 1)] + 1, 0).astype(np.int32) for d in range(depth)]
            keys = [s.lang[place].astype(np.int64)]
            for c in columns:  # pairs of columns to one number each
                keys = keys[:-1] + [keys[-1] * s.size + c] if len(keys[-1]) and keys[-1].max() < (1 << 62) // s.size else [*keys, c.astype(np.int64)]
            order = np.lexsort((*keys[::-1], group))
            new = K.group_starts(group[order], *[k[order] for k in keys]) if len(order) else np.zeros(0, bool)
            n = np.diff(np.append(np.flatnonzero(new), len(order)))
            order = order[new]
            group = group[order]
            columns = [s.lang[place][order], known[order], n, *[c[order] for c in columns]]
            border = np.append(np.flatnonzero(K.group_starts(group)), len(group)) if len(group) else [0]
            rows = ([], [], [], [])
            for a, b in zip(border[:-1], border[1:]):
                own = [c[a:b] for c in columns]
                langs, own[0] = np.unique(own[0], return_inverse=True)
                words, which = np.unique(np.concatenate([[0], *own[3:]]), return_inverse=True)  # 0: the suffix has ended
                own[3:] = np.split(which[1:], depth)
                rows[0].append(int(group[a]))
                rows[1].append(s.langs.take(pa.array(langs)))
                rows[2].append(_squeezed("\n".join(s.words.take(pa.array(words[1:] - 1)).to_pylist()).encode()))  # no word holds a line break
                rows[3].append(_squeezed((b - a).item().to_bytes(8, "little") + b"".join(K._planes(c.astype("<u4")) for c in own)))
            langs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows[1])]), pa.int32()), pa.concat_arrays(rows[1] or [pa.array([], pa.large_string())]).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), langs, *[pa.array(r, pa.binary()) for r in rows[2:]]], names=["part", "langs", "words", "cells"])

    return run


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _released(blob: pa.BinaryScalar) -> bytes:
    raw = memoryview(blob.as_buffer())
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _gathered(table: pa.Table, depth: int):
    """Languages, words and columns of all packed suffixes of a group, under common codes."""
    langs = table.column("langs").combine_chunks()
    words = pc.split_pattern(pa.array([_released(w) for w in table.column("words")], pa.large_string()), "\n")
    of_lang, of_word = langs.flatten().dictionary_encode(), words.flatten().dictionary_encode()
    lang_code, word_code = (c.indices.to_numpy(zero_copy_only=False) for c in (of_lang, of_word))
    blobs = [_released(c) for c in table.column("cells")]
    sizes = np.array([int.from_bytes(c[:8], "little") for c in blobs], np.int64)
    columns = [np.empty(sizes.sum(), np.int64 if i == 2 else np.int32) for i in range(depth + 3)]
    starts = [np.cumsum(np.diff(x.offsets)) - np.diff(x.offsets) for x in (langs, words)]
    for raw, n, end, a, b in zip(map(memoryview, blobs), sizes.tolist(), np.cumsum(sizes).tolist(), *starts):
        for i, column in enumerate(columns):
            own = K._unplanes(raw[8 + 4 * n * i :], n, "<u4")
            if i == 0:
                own = lang_code[a + own]
            elif i > 2:
                own = np.where(own > 0, word_code[np.minimum(b + own.astype(np.int64) - 1, len(word_code) - 1)] + 1, 0)
            column[end - n : end] = own
    return of_lang.dictionary, of_word.dictionary, columns


def _subtree(least: int, depth: int):
    def run(table: pa.Table) -> pa.Table:
        """The tree of a group's suffixes, one level after the other; nodes with too small a total are cut with all below."""
        try:
            return grow(table)
        finally:
            K.give_back()

    def grow(table: pa.Table) -> pa.Table:
        langs, words, (node, known, n, *columns) = _gathered(table, depth)
        node, size, out = node.astype(np.int64), len(words) + 1, []
        alive = np.arange(len(node))
        for d in range(1, depth + 1):
            alive = alive[columns[d - 1][alive] > 0]
            key = node[alive] * size + columns[d - 1][alive]
            order = np.argsort(key, kind="stable")
            alive, key = alive[order], key[order]
            if not len(key):
                break
            new = K.group_starts(key)
            total = np.add.reduceat(n[alive], np.flatnonzero(new))
            which = np.cumsum(new) - 1
            node[alive] = which
            whole = known[alive] <= d  # else other groups hold a part of the node, and its count is known
            if d > 1:
                at = np.flatnonzero(new & whole & (total[which] >= least))
                path = [words.take(pa.array(columns[i][alive[at]] - 1)) for i in range(d)]
                lang = langs.take(pa.array(lang_of[alive[at]]))
                out.append(K.table(_PHRASE, lang, pc.binary_join_element_wise(*path, pa.scalar(" ", pa.large_string())).cast(pa.string()), pa.array(np.full(len(at), d), pa.int32()), total[which[at]]))
            else:
                lang_of = np.empty(len(node), np.int64)
                lang_of[alive] = key // size
            alive = alive[~whole | (total[which] >= least)]
        return pa.Table.from_batches(out, schema=_PHRASE)

    return run


def phrase_counts(docs: DataFrame, depth: int = 4, least: int = 30, budget: int = 1_500_000) -> tuple[DataFrame, DataFrame]:
    """Written tables: phrases of 1 to ``depth`` words that occur ``least`` times or more (``lang, phrase, n_words, a``), and
    the number of words of each language (``lang, n``).

    ``budget`` is how many suffixes a group may have.  It is less where all suffixes, shared out to the session's shuffle
    partitions, are fewer, so that all tasks have work.  The driver holds a few numbers for each group.
    """
    spark = docs.sparkSession
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_word_counts(), "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    words = materialise(counts.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    single = words.where("word is not null")
    many, total = single.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    budget = max(1, min(budget, max(LEAST_BUDGET, total // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    common = _filter(single, many)
    hot, loads = Prefixes(), [single.where(F.col("n") <= budget).select("key", "n")]
    found, scrap = single.select(F.col("lang").alias("above"), "word", "n"), []
    for ahead in range(1, depth):
        large = found.where(F.col("n") > budget).orderBy("above", "word").collect()  # fewer than the groups
        if not large:
            break
        hot.levels.append(([r[0] for r in large], [r[1] for r in large], [r[2] for r in large]))
        level = rows.mapInArrow(_extension_counts(hot, common, depth), "above long, word string, key long, n long").groupBy("above", "word", "key").agg(F.sum("n").alias("n"))
        scrap.append(materialise(level, "extensions"))
        found = scrap[-1].select("above", "word", "n")
        loads.append(scrap[-1].where((F.col("n") <= budget) | F.lit(ahead + 1 == depth)).select("key", "n"))
    borders = _borders(loads, max(1, -(-total // budget)), budget)
    packed = rows.mapInArrow(_suffixes(hot, borders, common, depth), "part int, langs array<string>, words binary, cells binary")
    tree = packed.groupBy("part").applyInArrow(_subtree(least, depth), "lang string, phrase string, n_words int, a long")
    known = [(lang, " ".join(w), len(w), n) for lang, w, n in hot.phrases() if len(w) > 1 and n >= least]
    out = tree.union(spark.createDataFrame(known, "lang string, phrase string, n_words int, a long"))
    out = materialise(out.union(single.select("lang", F.col("word").alias("phrase"), F.lit(1), F.col("n").alias("a"))), "phrases")
    totals = materialise(words.where("word is null").select("lang", "n"), "totals")
    for table in (words, *scrap):
        discard(table)
    return out, totals


def _filter(single: DataFrame, many: int) -> np.ndarray:
    """A bit for the key of each frequent word: sixteen bits a word, up to ``MOST_BITS`` in all."""
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * max(1, many) - 1).bit_length()))
    bit = F.col("key").bitwiseAND(F.lit(bits - 1))
    cells = single.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, K.U64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(K.U64)
    return out


def _borders(loads: list[DataFrame], groups: int, budget: int) -> np.ndarray:
    """Hashes at which groups begin: ranges of the hash are put together, in order, until the budget is full."""
    bits = min(40, (16 * groups).bit_length())
    key = loads[0]
    for part in loads[1:]:
        key = key.union(part)
    cell = F.shiftrightunsigned("key", 64 - bits)
    sums = sorted((r[0], int(r[1])) for r in key.groupBy(cell.alias("cell")).agg(F.sum("n")).collect())
    out, load = [], 0
    for cell, n in sums:
        if load and load + n > budget:
            out.append(cell << (64 - bits))
            load = 0
        load += n
    return np.array(out, K.U64)


def mine_phrases(docs: DataFrame, depth: int = 4, least: int = 30, share: tuple[int, int] = (80, 100), top: int = 2000, **options) -> DataFrame:
    """The first ``top`` phrases of each language of ``text, lang``: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and at blanks and tabs into words.  Candidates are
    phrases of 2 to ``depth`` words that occur ``a >= least`` times.  A cut leaves a first part that occurs l times and a rest that
    occurs r times, and scores floor(2000000 * a / (l + r)); the lowest score counts, then the shortest first part.  A candidate
    within a longer one that occurs at least ``share`` of its times is dropped.  Order: score and a from the largest, then
    the phrase by its bytes.

    A null text is empty, a null lang ``und``; languages without a candidate have no row.  Rows that repeat count each time; other
    columns are ignored.  ``options`` go to ``phrase_counts``.  The result is a written table.
    """
    counted, totals = phrase_counts(docs, depth, least, **options)
    candidates = counted.where("n_words > 1")
    words = F.split("phrase", " ")
    part = lambda low, many: F.array_join(F.slice(words, low, many), " ")
    name = lambda lang, phrase: F.concat(F.octet_length(lang).cast("string"), F.lit(":"), lang, F.lit(" "), phrase)
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("first"), part(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(False).alias("first"), part(k + 1, F.col("n_words") - k).alias("part")))))
    cut = candidates.select("lang", "phrase", "a", F.explode(sides).alias("s")).select("lang", "phrase", "a", "s.k", "s.first", name(F.col("lang"), F.col("s.part")).alias("name"))
    cut = materialise(cut, "cuts")
    met = join_hot(cut, counted.select(name(F.col("lang"), F.col("phrase")).alias("name"), F.col("a").alias("f")), "name")
    each = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) as long)")
    best = each.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("m")).groupBy("lang", "phrase", "a").agg(F.min("m").alias("m"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda many: F.transform(F.sequence(F.lit(1), F.col("n_words") - many + 1), lambda low: part(low, many))))
    longer = candidates.where("n_words > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    stays = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", share[1]) < wide("a", share[0])))
    stays = stays.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # a first choice by many tasks
    stays = stays.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    stays = stays.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = stays.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = materialise(out, "collocations")
    for table in (counted, totals, cut):
        discard(table)
    return out


ORACLE = r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k)) GROUP BY ALL
), totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS n_words, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT lang, phrase, n_words, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, n_words)) AS k FROM c)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.first JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cuts.k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, n_words - m + 2)) AS i FROM (SELECT *, unnest(range(2, n_words)) AS m FROM c WHERE n_words > 2))
  ) GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank, s.phrase, s.a, l, r, n, score::BIGINT AS score
FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
WHERE g.a IS NULL OR 100 * g.a < 80 * s.a
QUALIFY rank <= 2000
"""
