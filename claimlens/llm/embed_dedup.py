"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits unit vectors by random directions at sample medians.  Vectors within a
margin of a split go to both sides (spill), so close vectors seldom part, and several
trees find what one has parted.  Vectors meet in leaves, are compared there by cosine in
double precision, and the pairs of all trees are united.

Equal vectors are one class from the start.  A leaf that grows too large for one task is
dealt out as blocks of it, each pair of blocks to a task of its own: nothing is left out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import components, dealt, discard, join_hot, materialise

_VECTOR = pa.schema([("vec_id", pa.int64()), ("cls", pa.int64()), ("cls2", pa.int64()), ("size", pa.int32()), ("vector", pa.binary())])
_LEAF = pa.schema([("leaf", pa.int64()), ("vec_id", pa.int64()), ("vector", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MAX_WIDTHS = 16


def _vectors(batches):
    """Usable vectors as bytes of doubles with a 128-bit class; others with a null vector."""
    for batch in batches:
        lists = batch.column("embedding")
        rows = []
        for value in lists:
            values = value.values if value.is_valid else None
            raw = None
            if values is not None and len(values) and not values.null_count:
                v = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
                raw = v.tobytes() if np.isfinite(v).all() and v.any() else None
            rows.append(raw)
        present = [r for r in rows if r is not None]
        data = np.frombuffer(b"".join(present), np.uint8)
        size = np.array([len(r) for r in present], np.int64)
        start = np.cumsum(size) - size
        one, two = K.span_hashes(data, start, start + size), K.span_hashes(255 - data, start, start + size)
        at = np.cumsum([r is not None for r in rows]) - 1
        pick = lambda h: [int(h[i].view(np.int64)) if r is not None else None for i, r in zip(at, rows)]
        yield K.table(_VECTOR, batch.column("vec_id"), pick(one), pick(two), [len(r) // 8 if r is not None else 0 for r in rows], rows)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Split directions and thresholds of all trees for vectors of one width."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, margin: float, seed: int):
        width = sample.shape[1]
        rng = np.random.default_rng([seed, width])
        self.directions = rng.normal(size=(trees, depth, width))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.margin, self.depth, self.trees = margin, depth, trees
        self.thresholds: list[list[dict[int, float]]] = []
        self.fallback = np.zeros((trees, depth))
        for t in range(trees):
            node, levels = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                value = sample @ self.directions[t, level]
                self.fallback[t, level] = np.median(value) if len(value) else 0.0
                order = np.argsort(node, kind="stable")
                at = np.flatnonzero(K.group_starts(node[order])) if len(order) else np.zeros(0, int)
                found = {}
                for a, b in zip(at, np.append(at[1:], len(order))):
                    if b - a >= 16:
                        found[int(node[order[a]])] = float(np.median(value[order[a:b]]))
                levels.append(found)
                node = 2 * node + (value > self._cut(levels, t, level, node))
            self.thresholds.append(levels)

    def _cut(self, levels, t, level, node):
        known, inverse = np.unique(node, return_inverse=True)
        cuts = np.array([levels[level].get(int(k), self.fallback[t, level]) for k in known])
        return cuts[inverse] if len(known) else np.zeros(0)

    def leaves(self, x: np.ndarray):
        """(row, leaf) of every vector in every tree; more than one leaf where it spills."""
        rows, keys = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                value = (x @ self.directions[t, level])[row] - self._cut(self.thresholds[t], t, level, node)
                low, high = value <= self.margin, value >= -self.margin
                row = np.concatenate((row[low], row[high]))
                node = np.concatenate((2 * node[low], 2 * node[high] + 1))
            rows.append(row)
            keys.append(K.mix(node.astype(K.U64) + K.U64(t << 48), x.shape[1]).view(np.int64))
        return np.concatenate(rows), np.concatenate(keys)


def _assign(forests, carry: bool):
    def run(batches):
        for batch in batches:
            raw, ids = batch.column("vector").to_pylist(), batch.column("vec_id").to_numpy()
            sizes = np.array([len(r) for r in raw]) // 8
            for width in np.unique(sizes):
                mine = np.flatnonzero(sizes == width)
                for lot in range(0, len(mine), 4096):
                    at = mine[lot : lot + 4096]
                    row, leaf = forests[int(width)].leaves(_unit([raw[i] for i in at]))
                    vectors = [raw[at[i]] for i in row] if carry else [None] * len(row)
                    yield K.table(_LEAF, leaf, ids[at[row]], pa.array(vectors, pa.binary()))

    return run


def _compare(threshold: float, most_rows: int = 2048):
    """Pairs at or above the threshold among the rows of each leaf; a partition holds whole leaves."""

    def run(batches):
        leaf, ids, raw = [], [], []
        for batch in batches:
            leaf.append(K.ints(batch, "leaf"))
            ids.append(K.ints(batch, "vec_id"))
            raw += batch.column("vector").to_pylist()
        if not raw:
            return
        leaf, ids = np.concatenate(leaf), np.concatenate(ids)
        order = np.lexsort((ids, leaf))
        order = order[K.group_starts(leaf[order], ids[order])]
        border = np.flatnonzero(K.group_starts(leaf[order]))
        seen: list[np.ndarray] = []
        for low, high in zip(border, np.append(border[1:], len(order))):
            mine = order[low:high]
            if len(mine) < 2:
                continue
            x = np.frombuffer(b"".join(raw[i] for i in mine)).reshape(len(mine), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
            norm = np.linalg.norm(x, axis=1)
            for a in range(0, len(mine), most_rows):
                for b in range(a, len(mine), most_rows):
                    cosine = x[a : a + most_rows] @ x[b : b + most_rows].T / norm[a : a + most_rows, None] / norm[None, b : b + most_rows]
                    i, j = np.nonzero(cosine >= threshold)
                    ok = i + a < j + b
                    seen.append(np.column_stack([ids[mine[i[ok] + a]], ids[mine[j[ok] + b]]]))
            if sum(map(len, seen)) > 1_000_000:
                yield _pairs(seen)
                seen = []
        if seen:
            yield _pairs(seen)

    return run


def _pairs(seen):
    both = np.concatenate(seen)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    both = both[K.group_starts(both[:, 0], both[:, 1])]
    return K.table(_PAIR, both[:, 0], both[:, 1])


def near_pairs(vectors: DataFrame, threshold: float = 0.95, trees: int = 6, leaf: int = 256, spill: float = 0.5, sample: int = 20_000, most_leaf: int = 4096, seed: int = 5) -> DataFrame:
    """Pairs ``a < b`` of ``vec_id`` (columns ``vec_id, size, vector``) with a cosine of at
    least ``threshold``, as far as the trees find them; none below it.

    Thresholds come from at most ``sample`` vectors (smallest md5 of the id), which bounds
    what the driver holds; every vector is assigned.  ``spill`` is the margin in standard
    deviations of a difference at the threshold, along a random direction.  Widths are worked off in
    groups of ``MAX_WIDTHS``, each with its own forests, as vectors of different width never pair.
    """
    widths = sorted(r[0] for r in vectors.groupBy("size").count().collect())
    found = []
    for at in range(0, max(1, len(widths)), MAX_WIDTHS):
        part = widths[at : at + MAX_WIDTHS]
        mine = vectors if len(widths) <= MAX_WIDTHS else vectors.where(F.col("size").isin(part))
        found.append(_near_pairs(mine, part, threshold, trees, leaf, spill, sample, most_leaf, seed))
        if len(widths) > MAX_WIDTHS:
            found[-1] = materialise(found[-1], "width-pairs")
    return reduce(DataFrame.union, found)


def _near_pairs(vectors, widths, threshold, trees, leaf, spill, sample, most_leaf, seed) -> DataFrame:
    forests = {}
    for width in widths:
        mine = vectors.where(F.col("size") == width)
        many = mine.count()
        rows = mine.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(sample).select("vector").collect()
        depth = max(0, math.ceil(math.log2(max(1, many / leaf))))
        margin = spill * math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(width)
        forests[width] = Forest(_unit([bytes(r[0]) for r in rows]), trees, depth, margin, seed)
    leaves = materialise(vectors.mapInArrow(_assign(forests, False), "leaf long, vec_id long, vector binary").groupBy("leaf").count(), "leaves")
    crowded = leaves.where(F.col("count") > most_leaf)
    copies = F.when(F.col("count") > most_leaf, F.ceil(F.col("count") / (most_leaf / 2))).otherwise(1)
    size = int(leaves.agg(F.coalesce(F.sum(F.col("count") * copies), F.lit(0))).first()[0]) * 8 * max(widths, default=0)
    placed = vectors.mapInArrow(_assign(forests, True), "leaf long, vec_id long, vector binary").join(crowded, "leaf", "left")
    blocks = F.ceil(F.coalesce("count", F.lit(0)) / (most_leaf / 2))
    own = F.pmod(F.xxhash64("vec_id"), F.greatest(blocks, F.lit(1)))
    other = F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    placed = placed.withColumn("own", own).withColumn("other", other)
    key = F.when(F.col("count").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")))
    met = dealt(placed.select(key.alias("leaf"), "vec_id", "vector"), "leaf", size)
    return met.mapInArrow(_compare(threshold), "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, **options) -> DataFrame:
    """One row per vector of ``vec_id, embedding``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing; vectors of different width never link.  Equal vectors link with each other.
    Rows with a null vec_id come back as one, with zero links, null component and kept false;
    repeated rows of one vec_id are one vector, and of several vectors under one vec_id that with
    the least hash counts.  Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    kind = "vec_id long, cls long, cls2 long, size int, vector binary"
    found = materialise(rows.mapInArrow(_vectors, kind), "vectors")
    ids = found.where("vector is not null and vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("cls", "cls2")).alias("m")).select("vec_id", "m.*")
    ids = materialise(ids, "ids")
    classes = ids.groupBy("cls", F.col("cls2").alias("_cls2")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    member = join_hot(ids, classes, "cls").where("cls2 = _cls2").select("vec_id", "cls", "cls2", "rep", "many")  # a vector may have very many copies
    member = materialise(member, "members")
    discard(ids)
    leads = member.where("vec_id = rep").select("vec_id", "cls", "cls2", "many")
    reps = materialise(found.join(leads.select("vec_id", "cls", "cls2"), ["vec_id", "cls", "cls2"], "left_semi").where("vector is not null").dropDuplicates(["vec_id"]).select("vec_id", "size", "vector"), "representatives")
    pairs = materialise(near_pairs(reps, threshold, **options), "pairs")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = join_hot(both, leads.select(F.col("vec_id").alias("b"), "many"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("many").alias("others"))
    graph = components(pairs)
    per_class = leads.select(F.col("vec_id").alias("rep")).join(links, "rep", "left").join(graph.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = join_hot(member, per_class, "rep").select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = found.select("vec_id").distinct().join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
