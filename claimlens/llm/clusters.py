"""Centroid clustering: Lloyd's rounds over integer vectors, sharded by dimension.

Vectors are cut into lots of at most ``LOT`` rows, and each lot into tiles of a few columns.  A tile is
worked on by itself and knows only its own slice of the centroids: it gives the exact partial
squared distances of its rows to all centroids.  The tiles' distances are added by lot, where each row takes its
nearest centroid; then every tile adds up its own columns for each cluster, which moves its slice.

All arithmetic is exact: doubles hold integers below 2^53, and larger ones become Python's integers.  A lot has a bounded number of
rows whatever they hold, so equal vectors never meet in one task.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise

LOT, LIMB = 4096, 40
_LONG = 2**63 - 1
_TILE = pa.schema([("lot", pa.int64()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("cells", pa.binary())])
_PART = pa.schema([("lot", pa.int64()), ("cells", pa.binary())])
_NEAREST = pa.schema([("lot", pa.int64()), ("labels", pa.binary()), ("distances", pa.binary())])
_SUM = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("amount", pa.int64())])
_ROW = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def to_bytes(cells: np.ndarray) -> bytes:
    """Integers in as few bytes each as the largest needs, after two bytes that tell how many."""
    most = max((abs(int(x)) for x in (cells.min(), cells.max())), default=0) if cells.size else 0
    width = next((w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1)), most.bit_length() // 8 + 1)
    head = width.to_bytes(2, "little")
    if width <= 8:
        return head + cells.astype(f"<i{width}").tobytes()
    return head + b"".join(int(x).to_bytes(width, "little", signed=True) for x in cells.ravel())


def from_bytes(raw: bytes, columns: int) -> np.ndarray:
    width = int.from_bytes(raw[:2], "little")
    if width <= 8:
        flat = np.frombuffer(raw, f"<i{width}", offset=2).astype(np.int64)
    else:
        flat = np.array([int.from_bytes(raw[i : i + width], "little", signed=True) for i in range(2, len(raw), width)], object)
    return flat.reshape(-1, columns)


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly."""
    if not values.size or np.abs(values).max() < 2**53 / scale:
        return np.floor(scale * values).astype(np.int64)
    return np.array([math.floor(scale * Fraction(x)) for x in values.ravel().tolist()], object).reshape(values.shape)


def _usable(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows with ``width`` finite components and no null among them, and the rows as doubles."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False))
    cells = lists.take(pa.array(at)).flatten() if len(at) else pa.array([], pa.float64())
    x = cells.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null becomes not a number
    fine = np.isfinite(x).all(axis=1)
    return at[fine], x[fine]


def _tiles(width: int, shard: int, scale: int):
    def run(batches):
        task, counter = TaskContext.get().partitionId(), 0
        for batch in batches:
            at, x = _usable(batch.column("embedding"), width)
            ids = batch.column("vec_id").take(pa.array(at))
            for low in range(0, len(at), LOT):
                cells, lot = scaled(x[low : low + LOT], scale), (task << 32) + counter
                counter += 1
                for block, left in enumerate(range(0, width, shard)):
                    own = ids.slice(low, LOT).to_pylist() if block == 0 else None
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([lot], [block], [own], [to_bytes(cells[:, left : left + shard])]), _TILE)], schema=_TILE)

    return run


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    most = max((abs(int(v)) for a in (x, centroids) if a.size for v in (a.min(), a.max())), default=0)
    kind = np.float64 if x.shape[1] * (2 * most) ** 2 < 2**53 else object
    x, c = x.astype(kind), centroids.astype(kind)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return out.astype(np.int64) if kind is np.float64 else out


def _partial(slices: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            for lot, block, cells in zip(batch.column("lot"), batch.column("block"), batch.column("cells")):
                mine = slices[block.as_py()]
                found = squared_distances(from_bytes(cells.as_py(), mine.shape[1]), mine)
                yield pa.RecordBatch.from_arrays([pa.array([lot.as_py()], pa.int64()), pa.array([to_bytes(found)], pa.binary())], schema=_PART)

    return run


def _add_and_choose(k: int):
    def run(table: pa.Table) -> pa.Table:
        total = sum(from_bytes(cells.as_py(), k) for cells in table.column("cells"))
        label = total.argmin(axis=1)  # the first of equals
        nearest = total[np.arange(len(total)), label]
        columns = [[table.column("lot")[0].as_py()], [to_bytes(label)], [to_bytes(nearest)]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _NEAREST)], schema=_NEAREST)

    return run


def _limbs(number: int):
    """(place, amount) of the digits to base 2^40; only the highest is signed."""
    place = 0
    while not -(1 << LIMB) < number < 1 << LIMB:
        yield place, number & ((1 << LIMB) - 1)
        number >>= LIMB
        place += 1
    yield place, number


def _sums(k: int, shard: int, width: int):
    """For each cluster the sum of each column of the task's tiles, and the rows as column -1."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        many = np.zeros(k, np.int64)
        for batch in batches:
            for block, cells, labels in zip(batch.column("block"), batch.column("cells"), batch.column("labels")):
                block = block.as_py()
                x, label = from_bytes(cells.as_py(), min(shard, width - block * shard)), from_bytes(labels.as_py(), 1)[:, 0]
                kind = np.float64 if x.dtype != object and np.abs(x).max(initial=0) < 2**40 else object  # LOT rows stay below 2^53
                own = (label[None, :] == np.arange(k)[:, None]).astype(kind) @ x.astype(kind)
                own = np.array([int(v) for v in own.ravel()], object).reshape(own.shape)
                total[block] = total[block] + own if block in total else own
                if block == 0:
                    many += np.bincount(label, minlength=k)
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(many) if n]
        rows += [(c, block * shard + j, place, v) for block, sums in total.items() for (c, j), s in np.ndenumerate(sums) if s for place, v in _limbs(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUM)], schema=_SUM)

    return run


def _rows(batches):
    for batch in batches:
        for ids, labels, distances in zip(batch.column("ids"), batch.column("labels"), batch.column("distances")):
            far = [min(int(d), _LONG) for d in from_bytes(distances.as_py(), 1)[:, 0]]
            columns = [ids.values, pa.array(from_bytes(labels.as_py(), 1)[:, 0].astype(np.int32)), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROW)


def _first_centroids(vectors: DataFrame, k: int, width: int, scale: int, seed: int) -> np.ndarray:
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where((F.size("embedding") == width) & finite & F.col("vec_id").isNotNull())
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order, F.col("embedding")).limit(k).select("embedding").collect()
    return scaled(np.array([r[0] for r in first], np.float64).reshape(-1, width), scale)


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, shard: int = 16, seed: int = 1) -> DataFrame:
    """One row per usable vector of ``vec_id, embedding``: ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256``.

    Usable are vectors of exactly ``width`` components, none null or non-finite; other rows do not come back.  A component x
    counts as floor(``scale`` * x).  The first ``k`` centroids are the vectors with the smallest sha256 of ``seed:vec_id``;
    fewer vectors give fewer centroids, and none an empty table.  Each of ``rounds`` assigns every vector to the nearest centroid (ties: the smaller number)
    and moves the non-empty centroids to the floor of their means.

    Rows are vectors of their own, also where a vec_id or vector repeats; a null vec_id is assigned like any other but is no
    first centroid, and rows with null ids alone give an empty table.  ``distance`` and the inertias are exact and stop at the largest long.  The driver holds ``k * width``
    numbers.  Other columns are ignored.  The result is a written table.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    tiles = materialise(rows.mapInArrow(_tiles(width, shard, scale), _sql(_TILE)), "tiles")
    centroids = _first_centroids(rows, k, width, scale, seed)
    k = len(centroids)
    if not k:
        discard(tiles)
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    nearest = None
    for done in range(rounds + 1):
        slices = [centroids[:, left : left + shard] for left in range(0, width, shard)]
        parts = tiles.select("lot", "block", "cells").mapInArrow(_partial(slices), _sql(_PART))
        nearest = materialise(parts.groupBy("lot").applyInArrow(_add_and_choose(k), _sql(_NEAREST)), "nearest")
        if done < rounds:
            centroids = _moved(tiles, nearest, centroids, shard)
            discard(nearest)
    found = tiles.where("block = 0").select("lot", "ids").join(nearest, "lot").select("ids", "labels", "distances").mapInArrow(_rows, _sql(_ROW))
    found = materialise(found, "clustered")
    each = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    known = [(c, min(each[c], _LONG), min(sum(each.values()), _LONG), digest[c]) for c in each]
    per_cluster = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = materialise(found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    for table in (tiles, nearest, found):
        discard(table)
    return out


def _moved(tiles: DataFrame, nearest: DataFrame, centroids: np.ndarray, shard: int) -> np.ndarray:
    """Floors of the clusters' means; an empty cluster keeps its centroid."""
    k, width = centroids.shape
    met = tiles.select("lot", "block", "cells").join(nearest.select("lot", "labels"), "lot").select("block", "cells", "labels")
    sums = met.mapInArrow(_sums(k, shard, width), _sql(_SUM)).groupBy("cluster", "dim", "limb").agg(F.sum(F.col("amount").cast("decimal(20,0)")).alias("amount"))
    total: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        total[r.cluster, r.dim] = total.get((r.cluster, r.dim), 0) + (int(r.amount) << (LIMB * r.limb))
    out = centroids.astype(object)
    for c in range(k):
        if many := total.get((c, -1), 0):
            out[c] = [total.get((c, j), 0) // many for j in range(width)]
    fits = all(abs(int(v)) < 1 << 62 for v in out.ravel())
    return out.astype(np.int64) if fits else out


def oracle(k: int = 16, rounds: int = 3) -> str:
    """The rounds as steps of one DuckDB statement (components small enough for exact doubles)."""
    near = "list_dot_product(e, e) - 2 * list_dot_product(e, c) + list_dot_product(c, c)"
    steps = ""
    for i in range(rounds + 1):
        steps += f""", a{i} AS (SELECT vec_id, e, k, ({near})::BIGINT AS d FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {near}, k) = 1)"""
        if i < rounds:
            steps += f""", s{i} AS (SELECT k, i, sum(x::HUGEINT) AS s, count(*) AS n FROM (SELECT k, unnest(e)::BIGINT AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY k, i)
, m{i} AS (SELECT k, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY i) AS c FROM s{i} GROUP BY k)
, c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.k = c{i}.k)"""
    last = f"a{rounds}"
    return f"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, e AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {k}
){steps}
SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([x::BIGINT FOR x IN c], ',')) AS centroid_sha256
FROM {last} a JOIN c{rounds} c ON c.k = a.k
"""
