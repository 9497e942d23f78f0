"""Centroid clustering against plain loops over Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import clusters

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, rounds, width, scale=64):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = {n: hashlib.sha256(f"1:{i}".encode()).hexdigest() for n, (i, _) in enumerate(kept) if i is not None}
    centroids = [kept[n][1] for n in sorted(key, key=lambda n: (key[n], kept[n][1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for done in range(rounds + 1):
        label = [min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c)) for _, v in kept]
        if done < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), x in zip(kept, label) if x == c]
                centroids[c] = [sum(col) // len(own) for col in zip(*own)] if own else centroids[c]
    far = [square(v, centroids[c]) for (_, v), c in zip(kept, label)]
    top, out = 2**63 - 1, []
    for (i, _), c, d in zip(kept, label, far):
        own = sum(x for x, y in zip(far, label) if y == c)
        out.append((i, c, min(d, top), min(own, top), min(sum(far), top), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
    return out


def same(spark, rows, **options):
    given = {"k": 4, "rounds": 3, "width": 6} | options
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cluster": F.lit("x"), "lot": F.lit(1), "inertia": F.lit(None).cast("long")})
    found = clusters.lloyd(df.repartition(3), shard=given.pop("shard", 4), **given)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(brute(rows, **given), key=order)


def vectors(n=200, width=6, seed=3, spread=2.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 5, spread) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"shard": 1}, {"shard": 6}, {"rounds": 0}, {"k": 1}, {"k": 300}])
def test_lloyd(spark, options):
    same(spark, vectors(), **options)


def test_lloyd_edges(spark):
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [None] + [1.0] * 5), (905, [float("nan")] + [1.0] * 5), (906, [float("-inf")] + [1.0] * 5)]
    same(spark, vectors(40) + bad)
    same(spark, vectors(40) + [(None, [1.0] * 6), (7, vectors(40)[7][1]), (7, [0.5] * 6)])  # a null id, a repeat, a second vector
    same(spark, [(i, [1.0] * 6) for i in range(50)])  # all equal: ties go to centroid 0, the others stay empty
    same(spark, [(i, [-(1 / 64) * (i % 2)] * 6) for i in range(9)], k=2)  # floors of negative means
    same(spark, [(1, [0.0] * 6)], k=4)
    same(spark, [], k=4)
    same(spark, bad)
    assert clusters.lloyd(spark.createDataFrame([(None, [1.0] * 6)], SCHEMA), width=6).count() == 0


@pytest.mark.parametrize("most", [1e5, 1e12, 1e30, 1.7e308])
def test_lloyd_of_large_components(spark, most):
    rng = random.Random(int(math.log10(most)))
    same(spark, vectors(30) + [(100 + i, [rng.uniform(-most, most) for _ in range(6)]) for i in range(20)] + [(200, [most, -most, 0.0, -0.0, 5e-324, 2.0**52 + 0.5])])


def test_floats_and_lots_and_hot_vectors(spark, monkeypatch):
    rows = vectors(60) + [(1000 + i, [2.5] * 6) for i in range(60)]
    monkeypatch.setattr(clusters, "LOT", 7)
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, clusters.lloyd(df, k=4, width=6).collect())) == sorted(brute(exact, 4, 3, 6))


def test_integers_round_trip():
    for values in ([0], [127, -128], [128], [-129], [2**31, -5], [2**63 - 1, -(2**62)], [2**63], [-(2**2000), 5], []):
        array = np.array(values, object if any(abs(v) >= 2**63 for v in values) else np.int64)
        assert clusters.from_bytes(clusters.to_bytes(array), 1)[:, 0].tolist() == values
    for v in (0, 1, -1, 2**40, -(2**40), 2**200 + 17, -(2**200) - 17):
        assert sum(a << (clusters.LIMB * p) for p, a in clusters._limbs(v)) == v
