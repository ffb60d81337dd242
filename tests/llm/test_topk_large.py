"""Top-k over vectors with components of any size, against whole numbers."""

import math
import random
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in kept if i % 50 == 0}:
        met = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in kept if i != q and len(c) == len(v))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(met, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), **kw).collect())


def test_large_components_take_part(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(200, [3e6, 1.0, 0.0, 0.0]), (201, [1e7, 0.0, 0.0, -1.0]), (202, [-1e7, 0.5, 0.0, 0.0]), (203, [2.0**20, 0.0, 0.0, 0.0]), (204, [5e-324, -5e-324, 0.0, 0.0])]
    rows += [(205, [float("inf"), 0.0, 0.0, 0.0]), (206, None), (250, [3e6, 1.0]), (251, [3e6, 1.0]), (251, [3e6, 1.0])]
    wanted = brute(rows)
    assert run(spark, rows, block=40, query_block=3) == wanted
    assert any(i in (201, 202) for _, _, i, _ in wanted)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}))
    assert sorted(con.execute(topk.SQL).fetchall()) == wanted


def test_scores_beyond_a_long_fail_only_where_they_are_asked_for(spark):
    far = [(0, [1e12, 0.0]), (1, [-1e12, 0.0])]
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, far)
    near = [(i, [1e-3, 0.0]) for i in range(2, 9)]  # the query itself is large, its five best are small
    assert run(spark, far + near) == brute(far + near)
    rows = [(50, [0.5, 0.0]), (1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.25, 0.0])]
    assert run(spark, rows) == brute(rows)
