"""N-gram Jaccard join: size-aware, heavy and light sets apart.

Each text is a set of word shingles.  Two sets link when their Jaccard similarity reaches
``percent``.  In one global order of the tokens, rarest first, linked sets share tokens
early on: ``n - o + k`` first tokens of each must share ``k``, where ``o`` is the least
overlap a set of ``n`` needs with any partner.

* Light sets (at most ``boundary`` tokens) enumerate the pairs of their first tokens
  (``k = 2``) and meet under equal pairs.
* Heavy sets enter the inverted lists of their first tokens (``k = 1``), which are scanned
  for partners; light sets that are large enough for a heavy partner enter them too.

The boundary is the one with the least estimated cost over the sizes at hand.  What meets
is kept only if the shared first tokens leave room for the overlap, and is then verified
on whole sets.  Equal sets are one class from the start, so copies never form pairs.

Lists longer than the frequency bound hold large families and are worked off by pivots: all
members are compared with the most central one, linked members fall into one component, and
only members that can still link with another component stay.  A member knows the place of the
list's token in its own order.  If that token is the first that two sets share, they share no
more than what comes from there on, so each member has a largest partner size; few pairs pass
for both, and members without a partner leave the list before anything is joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import components, dealt, discard, in_small_batches, join_hot, materialise

RARE = 16  # tokens in more classes than this count as frequent
MAX_FREQUENT = 1_000_000  # frequent tokens sent to the tasks: 12 MB at most
RANGE_TOKENS = 3_000_000  # tokens that one counting group receives on average
FEW_CLASSES = 200_000  # classes sent to the tasks: a few MB
_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("cls2", pa.int64())])
_COUNTS = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])
_FREQUENT = pa.schema([("token", pa.int64()), ("df", pa.int64())])
_FIRST = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("size", pa.int64()), ("kind", pa.int64())])
_MET = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("shared", pa.int32()), ("room", pa.int32())])
_SET = pa.schema([("cls", pa.int64()), ("tokens", pa.binary())])
HEAVY, LIGHT_IN_LIST, SUBSET, LONG = 0, 1, 2, 4  # LONG: a bit more, for lists known to be long


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = K.flat(texts)
    data = K.LOWER[data]
    start, end, first = K.words(data, off, K.SPACE)
    h = K.span_hashes(data, start, end)
    windows = K.window_hashes(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            out.append(K.window_hashes(h[a:b], b - a))
        else:
            out.append(np.zeros(0, K.U64))
    return out


def _class_of(tokens: np.ndarray, naming: tuple[int, frozenset]) -> tuple[int, int]:
    """128 bits that name a set, in two halves.  The first half is the class, or the second where the
    first is one of ``clashing``, which different sets share."""
    bits, clashing = naming
    one, two = _halves(tokens)
    one >>= 64 - bits
    return (two if one in clashing else one), two


def _halves(tokens: np.ndarray) -> tuple[int, int]:
    one = K.mix(tokens, 1).sum(dtype=K.U64) if len(tokens) else K.U64(0)
    two = K.mix(tokens, 2).sum(dtype=K.U64) if len(tokens) else K.U64(0)
    return int(K.mix(np.array([one ^ K.U64(len(tokens))]))[0].view(np.int64)), int(K.mix(np.array([two]))[0].view(np.int64))


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def _signatures(size: int, naming):
    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                sets = shingle_sets(part.column("text"), size)
                classes = [_class_of(s, naming) for s in sets]
                yield K.table(_SIGNATURE, part.column("doc_id"), [len(s) for s in sets], [c[0] for c in classes], [c[1] for c in classes])

    return run


def _fresh_sets(batch, size: int, seen: set, naming):
    """(class, tokens) of the non-empty sets not in ``seen``, which is kept bounded."""
    if len(seen) > 200_000:
        seen.clear()
    for tokens in shingle_sets(batch.column("text"), size):
        if len(tokens):
            cls = _class_of(tokens, naming)[0]
            if cls not in seen:
                seen.add(cls)
                yield cls, tokens


def _token_counts(size: int, parts: int, naming):
    """Counts of token prefixes (40 bits) by range of the token, as packed differences."""

    def settle(tokens):
        every = np.concatenate(tokens)
        tokens.clear()
        every >>= K.U64(24)
        every.sort()
        at = np.flatnonzero(K.group_starts(every))
        short, count = every[at], np.diff(at, append=len(every))
        group = (short * K.U64(parts)) >> K.U64(40)
        border = np.searchsorted(group, np.arange(parts + 1, dtype=K.U64))
        rows = ([], [], [])
        for p in range(parts):
            mine, many = short[border[p] : border[p + 1]], count[border[p] : border[p + 1]]
            if len(mine):
                steps = np.diff(mine, prepend=K.U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows[0].append(p)
                rows[1].append(np.ascontiguousarray(steps.T).tobytes())  # equal bytes side by side compress
                rows[2].append(np.minimum(many, 255).astype(np.uint8).tobytes())
        return K.table(_COUNTS, *rows)

    def run(batches):
        seen, tokens, many = set(), [], 0
        for batch in batches:
            for part in K.slices(batch):
                for _, mine in _fresh_sets(part, size, seen, naming):
                    tokens.append(mine)
                    many += len(mine)
                if many >= 2 * K.BUFFER_ROWS:
                    yield settle(tokens)
                    many = 0
        if tokens:
            yield settle(tokens)

    return run


def _frequent(rare: int):
    def run(table: pa.Table) -> pa.Table:
        parts = []  # 40 bits of token and 8 bits of count in one number
        for steps, counts in zip(table.column("tokens"), table.column("counts")):
            n = np.frombuffer(counts.as_buffer(), np.uint8)
            wide = np.zeros((len(n), 8), np.uint8)
            wide[:, :5] = np.frombuffer(steps.as_buffer(), np.uint8).reshape(5, -1).T
            parts.append(np.cumsum(wide.view("<u8").ravel()) << K.U64(8) | n)
        both = np.concatenate(parts)
        parts.clear()
        both.sort()
        at = np.flatnonzero(K.group_starts(both >> K.U64(8)))
        token = both[at] >> K.U64(8)
        both &= K.U64(255)
        df = np.add.reduceat(both, at).astype(np.int64)
        keep = df > rare
        out = pa.Table.from_batches([K.table(_FREQUENT, token[keep].view(np.int64), df[keep])])
        K.give_back()
        return out

    return run


def frequent_tokens(docs: DataFrame, total: int, size: int, naming, rare: int = RARE, most: int = MAX_FREQUENT):
    """Tokens in more than ``rare`` classes, by prefix, with their counts; and whether that is all of
    them.  Counts cover all documents; if more than ``most`` tokens are frequent, the most
    frequent are kept.  The choice orders tokens, it drops none: lists of the others that turn out long are told by their length."""
    parts = max(1, -(-total // RANGE_TOKENS))
    counted = docs.mapInArrow(K.lean(_token_counts(size, parts, naming)), "part int, tokens binary, counts binary").groupBy("part").applyInArrow(_frequent(rare), "token long, df long")
    top = counted.orderBy(F.desc("df"), "token").limit(most + 1).toPandas()
    complete = len(top) <= most
    top = top.iloc[:most].sort_values("token")
    return top["token"].to_numpy(np.uint64), top["df"].to_numpy(np.int64), complete


def choose_boundary(sizes: list[tuple[int, int]], percent: int, most: int = 64) -> int:
    """The light sets' largest size: least number of keys to shuffle, where an entry of an
    inverted list counts ``scan`` times, as lists also bring partners that fail."""
    scan, best = 3.0, None
    for boundary in range(most + 1):
        cost = 0.0
        for n, many in sizes:
            first = n - least_overlap(n, percent) + 1
            if n <= boundary and n > 2:
                cost += many * (first + 1) * first / 2
            if n > boundary or 100 * n >= percent * (boundary + 1):
                cost += many * first * scan
        if best is None or cost < best[0]:
            best = (cost, boundary)
    return best[1]


def _first_tokens(size: int, percent: int, boundary: int, frequent, naming):
    """Keys under which sets meet: one row per key and class.  ``size`` holds the set's size and above
    32 bits the place of the key's (last) token in the order; ``kind`` holds the kind and above 3 bits
    the number of frequent first tokens."""

    def run(batches):
        known, df = frequent.value
        seen, rows = set(), K.Buffer(4)
        for batch in batches:
            for part in K.slices(batch):
                for cls, tokens in _fresh_sets(part, size, seen, naming):
                    n = len(tokens)
                    if n <= 2:
                        continue  # such a set links only with its equals
                    first = n - least_overlap(n, percent) + 1
                    short = tokens >> K.U64(24)
                    at = np.minimum(np.searchsorted(known, short), max(0, len(known) - 1))
                    often = np.where(known[at] == short, df[at], 0) if len(known) else np.zeros(n, np.int64)
                    if often.any():
                        order = np.argsort(often, kind="stable")
                        tokens, often = tokens[order], often[order]
                    many = int((often[:first] > 0).sum()) << 3
                    if n <= boundary:
                        ext = K.mix(tokens[: first + 1], 5)
                        i, j = np.triu_indices(len(ext), 1)
                        low, high = np.minimum(ext[i], ext[j]), np.maximum(ext[i], ext[j])
                        # of the first two common tokens one lies before the second's place
                        rows.add(K.mix(low + K.mix(high, 9), 11), np.full(len(i), cls), n + ((j - 1) << 32), many + np.where(often[i] > 0, SUBSET | LONG, SUBSET))
                    if n > boundary or 100 * n >= percent * (boundary + 1):
                        kind = HEAVY if n > boundary else LIGHT_IN_LIST
                        rows.add(tokens[:first], np.full(first, cls), n + (np.arange(first) << 32), many + np.where(often[:first] > 0, kind | LONG, kind))
                if rows.rows >= 200_000:
                    yield emit(rows.take())
        if (rest := rows.take()) is not None:
            yield emit(rest)

    def emit(columns):
        return K.table(_FIRST, columns[0].view(np.int64), *columns[1:])

    return run


def _meet(percent: int, longest: int, complete: bool):
    """Pairs under equal keys in lists of at most ``longest``; members of longer lists and of those known
    to be long as they are (``shared`` -1, ``b`` the kind, ``nb`` the place, ``room`` 1 for lists of a token).

    ``room`` of a pair is how many common tokens may stand elsewhere: beyond the first ones and, if all long lists were known, in those.  Otherwise ``_with_hidden`` adds what long lists may hold."""

    def run(batches):
        got = K.gather(batches, ["key", "cls", "size", "kind"])
        if got is None:
            return
        order = np.lexsort((got[1], got[0]))
        order = order[K.group_starts(got[0][order], got[1][order])]
        key, cls, size, kind = (x[order] for x in got)
        del got
        length = K.run_lengths(K.group_starts(key))
        n, place, frequent = size & (2**32 - 1), size >> 32, kind >> 3
        big = (length > longest) | (kind & LONG > 0)
        if big.any():
            none = np.zeros(int(big.sum()), np.int32)
            yield K.table(_MET, key[big], cls[big], np.where(kind[big] & 3 == LIGHT_IN_LIST, 1, 0), n[big].astype(np.int32), place[big].astype(np.int32), none - 1, none + (kind[big] & 3 != SUBSET))
        pick = ~big & (length > 1)
        key, cls, n, frequent, kind = (x[pick] for x in (key, cls, n, frequent, kind & 3))
        first = n - least_overlap(n, percent) + 1
        found = []
        for step in range(1, min(longest, len(key))):
            i = np.flatnonzero(key[step:] == key[:-step])
            if not len(i):
                break
            j = i + step
            ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((kind[i] != LIGHT_IN_LIST) | (kind[j] != LIGHT_IN_LIST))
            i, j = i[ok], j[ok]
            if len(i):
                room = np.maximum(n[i] - first[i], n[j] - first[j]) + (np.minimum(frequent[i], frequent[j]) if complete else 0)
                room = np.where(kind[i] == SUBSET, n[i] + n[j], room)
                found.append((cls[i], cls[j], n[i], n[j], room))
        if found:
            a, b, na, nb, room = (np.concatenate([f[k] for f in found]) for k in range(5))
            order = np.lexsort((b, a))
            a, b, na, nb, room = (x[order] for x in (a, b, na, nb, room))
            at = np.flatnonzero(K.group_starts(a, b))
            shared = np.diff(np.append(at, len(a)))
            yield K.table(_MET, np.zeros(len(at), np.int64), a[at], b[at], na[at].astype(np.int32), nb[at].astype(np.int32), shared.astype(np.int32), np.maximum.reduceat(room, at).astype(np.int32))

    return run


def _with_hidden(pairs: DataFrame, met: DataFrame) -> DataFrame:
    """``pairs`` with the common tokens in their ``room`` that may stand in long lists: as many as the set with fewer such first tokens has."""
    hidden = materialise(met.where("shared < 0 and room > 0").groupBy("a").agg(F.count("*").alias("ha")), "hidden")
    both = pairs.join(hidden, "a", "left").join(hidden.select(F.col("a").alias("b"), F.col("ha").alias("hb")), "b", "left")
    return both.withColumn("room", F.col("room") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))).drop("ha", "hb")


def _wanted_sets(size: int, bits, naming):
    def run(batches):
        wanted = bits.value
        seen = set()
        for batch in batches:
            for part in K.slices(batch):
                rows = ([], [])
                for cls, tokens in _fresh_sets(part, size, seen, naming):
                    top = (cls & (2**64 - 1)) >> 40
                    if (int(wanted[top >> 6]) >> (top & 63)) & 1:
                        rows[0].append(cls)
                        rows[1].append(tokens.tobytes())
                if rows[0]:
                    yield K.table(_SET, *rows)

    return run


def _bitmap(spark, classes: DataFrame):
    """A bitmap of 2 MB over the top bits of the wanted classes: it spares most others the
    way through the shuffle; the exact join after it decides."""
    top = F.shiftrightunsigned("cls", 40)
    words = classes.groupBy(F.shiftright(top, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(cls, 40) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << 18, np.uint64)
    got = words.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(out)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("tokens_a"), batch.column("tokens_b")
            keep = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x.as_buffer(), K.U64), np.frombuffer(y.as_buffer(), K.U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link.  A pivot ``b`` may have any number of partners.  Where few classes are in pairs, only their sets are shuffled."""
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    if ends.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES:
        sets = sets.join(F.broadcast(ends), "cls", "left_semi")
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tokens_b"))
    both = join_hot(pairs.select("a", "b"), right, "b").join(left, "a").select("a", "b", "tokens_a", "tokens_b")
    return both.mapInArrow(K.lean(_verify(percent)), "a long, b long")


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``cls, label`` after joining the components that ``edges`` (between labels) connect."""
    found = components(edges).withColumnRenamed("node", "label")
    merged = labels.join(found, "label", "left").select("cls", F.coalesce("component", "label").alias("label"))
    new = found.join(labels.select("cls", F.lit(True).alias("_has")), found.label == F.col("cls"), "left").where("_has is null").select(F.col("label").alias("cls"), F.col("component").alias("label"))
    return materialise(merged.union(new), "labels")


def _open_members(labelled: DataFrame) -> DataFrame:
    """Members of lists with several labels that some member of another label may link with, and ``main``
    (whether theirs is the most frequent label of the list).

    Two members pass for each other if neither's size exceeds the other's ``most``.  Sizes of a list
    go in bands of 3 %; a band keeps the least size and the largest ``most``, apart for the main
    label and the others, so at most some hundred numbers of a list meet its members.
    """
    counted = labelled.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("head"), F.count("*").alias("many")).where("many > 1").select("key", "head")
    marked = materialise(join_hot(labelled, counted, "key").withColumn("main", F.col("label") == F.col("head")).drop("head"), "marked")
    reach = marked.groupBy("key", "main", F.floor(F.log("n") / 0.03).alias("band")).agg(F.min("n").alias("least"), F.max("most").alias("top"))
    reach = reach.groupBy("key").agg(F.collect_list(F.struct("main", "least", "top")).alias("bands"))
    partner = F.exists("bands", lambda x: ~(x["main"] & F.col("main")) & (x["least"] <= F.col("most")) & (x["top"] >= F.col("n")))
    out = materialise(join_hot(marked, reach, "key").where(partner).drop("bands"), "open")
    discard(marked)
    return out


def _partner(a: str, b: str) -> Column:
    """Whether the members ``a`` and ``b`` of a list may link, if its token is the first they share."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (x("label") != y("label")) & (x("n") <= y("most")) & (y("n") <= x("most")) & ((x("light") == 0) | (y("light") == 0))


def _all_pairs(members: DataFrame, most_rows: int) -> DataFrame:
    """Pairs that may link.  Lists of more than ``most_rows`` are dealt out in blocks, and each two blocks meet
    under a key of their own."""
    shares = members.groupBy("key").agg(F.ceil(F.count("*") / most_rows).alias("shares"))
    parts = join_hot(members, shares, "key").withColumn("own", F.pmod(F.xxhash64("cls"), "shares"))
    parts = parts.select("key", F.struct("cls", "n", "light", "most", "label").alias("m"), "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("other"))
    parts = materialise(parts, "blocks")
    left = parts.where("own <= other").select("key", F.col("own").alias("i"), F.col("other").alias("j"), F.col("m").alias("a"))
    right = parts.where("other <= own").select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.col("m").alias("b"))
    return left.join(right, ["key", "i", "j"]).where(_partner("a", "b") & ((F.col("i") < F.col("j")) | (F.col("a.cls") < F.col("b.cls"))))


def _merge_families(lists: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, rounds: int, most_rows: int) -> DataFrame:
    """Work off the long lists (``key, cls, n, light, place``).

    In each round every list compares its most central member, whose token has the least place, with all
    others, and lets it go; from the second round on that member has not the main label and only
    members with a possible partner take part.  When few pairs can be left (or after
    ``rounds``), the open members of a list are compared with each other.  Links are edges between the labels so far.
    """
    lists = lists.withColumn("most", F.least(F.expr(f"100 * n div {percent}"), F.expr(f"{100 + percent} * (n - place) div {percent} - n")))
    lists = lists.where(F.col("most") >= F.ceil(F.col("n") * percent / 100))
    labelled = open_ = None
    for turn in range(rounds + 1):
        before = (labelled, open_)
        labelled = materialise(lists.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "lists")
        for table in before:
            discard(table)
        open_ = _open_members(labelled) if turn else labelled.withColumn("main", F.lit(False))
        size = open_.groupBy("key").agg(F.count("*").alias("m"), F.count_if("main").alias("g")).agg(F.sum("m"), F.sum(F.expr("double(m - g) * (m + g) / 2"))).first()
        if not size[0]:
            break
        last = turn == rounds or size[1] <= 4 * size[0]
        if last:
            met = _all_pairs(open_, most_rows)
        else:
            central = F.struct("main", "place", (-F.col("n")).alias("less"), F.xxhash64("cls").alias("tie"))
            pivots = materialise(open_.groupBy("key").agg(F.min_by(F.struct("cls", "n", "light", "most", "label"), central).alias("b")).where("b is not null"), "pivots")
            met = join_hot(open_.select("key", F.struct("cls", "n", "light", "most", "label").alias("a")), pivots, "key").where(_partner("a", "b"))
            lists = open_.join(pivots.select("key", F.col("b.cls").alias("cls")), ["key", "cls"], "left_anti").select(*lists.columns)
        met = met.groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).agg(F.first("a.label").alias("u"), F.first("b.label").alias("v"))
        met = materialise(met, "met")
        found = _linked(met, sets, percent).join(met, ["a", "b"]).select(F.col("u").alias("a"), F.col("v").alias("b"))
        labels = _merge(labels, found)
        if last:
            break
    return labels


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, rounds: int = 4, boundary: int | None = None, rare: int = RARE, most_frequent: int = MAX_FREQUENT, block: int = 1024, class_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest
    doc_id that links reach.

    Words are runs of non-space bytes, A-Z lower-cased; a text of fewer than ``size`` words is
    one shingle, and one without words (or null) is empty and links with nothing.  Tokens
    are 64-bit hashes, sets are told apart by 128 bits.  Rows with a null doc_id take no part and come
    back with a null component; repeated rows come back as often as they came.  Columns
    other than ``doc_id`` and ``text`` are ignored.

    None of the other parameters changes the result.  ``boundary`` overrides the cost model, ``rare`` and
    ``most_frequent`` bound the tokens that order the sets, ``rounds`` the pivots of a list and ``block``
    the members of it that are compared in one place.  ``class_bits`` is the width of the first half of a set's name; sets
    that share it (of 10^10, about three do) go by the second half, so the driver holds only those that do.
    """
    spark = docs.sparkSession
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    signed = materialise(docs.mapInArrow(K.lean(_signatures(size, (class_bits, frozenset()))), "doc_id long, n long, cls long, cls2 long"), "signatures")
    docs = docs.where("doc_id is not null")

    def named_classes() -> DataFrame:
        return materialise(signed.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("cls2").alias("lo"), F.max("cls2").alias("hi")), "classes")

    classes = named_classes()
    clashing = frozenset(r[0] for r in classes.where("lo <> hi").select("cls").collect())
    if clashing:
        signed = signed.withColumn("cls", F.when(F.col("cls").isin(*clashing), F.col("cls2")).otherwise(F.col("cls")))
        classes = named_classes()
    naming = (class_bits, clashing)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if boundary is None:
        small = classes.where("n between 3 and 96").groupBy("n").count().collect()  # at most 94 rows
        boundary = choose_boundary([(r[0], r[1]) for r in small], percent)
    token, df, complete = frequent_tokens(docs, int(total), size, naming, rare, most_frequent)
    frequent = spark.sparkContext.broadcast((token, df))
    keyed = docs.mapInArrow(K.lean(_first_tokens(size, percent, boundary, frequent, naming)), "key long, cls long, size long, kind long")
    # members of lists that are known to be long meet nobody here: they are dealt out by their class
    # 32 bytes for about the share of a set's tokens that a partner may lack, and its subsets
    keyed = dealt(keyed, F.when(F.col("kind").bitwiseAND(LONG) > 0, F.col("cls")).otherwise(F.col("key")), 32 * int(total) * (100 - percent) // 100)
    met = materialise(keyed.mapInArrow(K.lean(_meet(percent, rare, complete)), "key long, a long, b long, na int, nb int, shared int, room int"), "met")
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100.0 + percent) - 1e-9)
    pairs = met.where("shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("room").alias("room"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    if not complete:
        pairs = _with_hidden(pairs, met)
    pairs = materialise(pairs.where(F.col("shared") + F.col("room") >= needed).select("a", "b"), "pairs")
    lists = met.where("shared < 0").select("key", F.col("a").alias("cls"), F.col("na").alias("n"), F.col("b").alias("light"), F.col("nb").alias("place"))
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(lists.select("cls")).distinct()
    sets = docs.mapInArrow(K.lean(_wanted_sets(size, _bitmap(spark, wanted), naming)), "cls long, tokens binary")
    sets = materialise(sets.groupBy("cls").agg(F.first("tokens").alias("tokens")).join(wanted, "cls", "left_semi"), "sets")
    labels = materialise(components(_linked(pairs, sets, percent)).select(F.col("node").alias("cls"), F.col("component").alias("label")), "labels")
    if lists.limit(1).count():
        labels = _merge_families(lists, labels, sets, percent, rounds, block)
    ends = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = ends.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = ends.join(lowest, "label").select("cls", "component_id")
    out = join_hot(signed, named, "cls", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
