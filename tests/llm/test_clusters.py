"""Bit-plane clustering against plain whole-number arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=16, rounds=3, scale=64, dim=64):
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(Fraction(x) * scale) for x in v]))
    code = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    start = sorted(((i is None, code(i), v) for i, v in kept), key=lambda r: r[:2])[:k]
    points = [v for *_, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for c in range(len(points)):
            mine = [v for (_, v), f in zip(kept, found) if f == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in final)
    by = [sum(d for d, c in final if c == i) for i in range(len(points))]
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, by[c], total, digest[c]) for (i, _), (d, c) in zip(kept, final)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, clusters.cluster(df, **kw).collect()), key=str)


def test_planes_are_two_complements():
    rng = random.Random(1)
    rows = [[rng.randrange(-(1 << b), 1 << b) for _ in range(64)] for b in (0, 1, 3, 9, 30, 55)] + [[0] * 64, [-1] * 64]
    for planes, row in zip(clusters.pack(np.array(rows, np.int64)), rows):
        assert clusters.unpack(planes) == row
        assert np.array_equal(clusters.pack_large(row), planes)
    huge = [rng.randrange(-(1 << 200), 1 << 200) for _ in range(64)]
    assert clusters.unpack(clusters.pack_large(huge)) == huge


def test_popcounts_give_dot_products_of_any_size():
    rng = random.Random(2)
    for a, b in ((1, 1), (6, 9), (28, 28), (40, 40), (90, 3)):
        x, y = ([[rng.randrange(-(1 << n), 1 << n) for _ in range(64)] for _ in range(4)] for n in (a, b))
        wide = lambda rows: np.array([np.pad(p, (0, max(len(clusters.pack_large(r)) for r in rows) - len(p)), mode="edge") for p in map(clusters.pack_large, rows)])
        found = clusters.weighted_popcounts(wide(x), wide(y))
        assert [[int(v) for v in row] for row in found] == [[sum(p * q for p, q in zip(r, s)) for s in y] for r in x]


def test_clusters_equal_plain_arithmetic(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) + (i % 5) * 0.1 for _ in range(64)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(3, rows[3][1]), (3, rows[3][1])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, k=3, rounds=0) == brute(rows, k=3, rounds=0)


def test_vectors_that_do_not_fit_and_large_components(spark):
    rng = random.Random(4)
    good = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(20)]
    odd = [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [float("nan")] + [0.0] * 63), (55, [float("inf")] + [0.0] * 63),
           (56, [None] + [0.0] * 63), (57, [0.0] * 64), (57, [-0.0] * 64), (None, [0.5] * 64)]
    large = [(60, [3e6] + [0.0] * 63), (61, [-2e7] * 64)]
    assert run(spark, good + odd + large) == brute(good + odd + large)
    far = [(70, [1e300] * 64)]
    assert run(spark, far) == brute(far)  # its own centroid: the distance is 0
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)], k=1)


def test_empty_few_and_clashing_columns(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    assert run(spark, [(1, [0.25] * 64), (2, [0.5] * 64)]) == brute([(1, [0.25] * 64), (2, [0.5] * 64)])
    df = spark.createDataFrame([(1, [0.25] * 64, "x", 5)], "vec_id long, embedding array<float>, planes string, cluster int")
    found = clusters.cluster(df)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found.collect()[0][:5] == (1, 0, 0, 0, 0)
