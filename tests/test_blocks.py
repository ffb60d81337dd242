"""Blocked scans and halos must equal plain per-series computation, however small the blocks are."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import near, random_panel, to_spark
from tidemark.operators import features, folds, quality
from tidemark.operators.panel import PanelSpec, regular_grid, with_positions
from tidemark.operators.quantiles import exact_quantiles

SMALL = PanelSpec(step_seconds=3600, block_rows=7)


def by_series(pdf):
    return {k: g.sort_values("ts").reset_index(drop=True) for k, g in pdf.groupby("series")}


@pytest.mark.parametrize("block_rows", [5, 64, 4096])
def test_positions_and_fill(spark, block_rows):
    pdf = random_panel(1)
    got = with_positions(to_spark(spark, pdf), PanelSpec(block_rows=block_rows)).toPandas()
    for name, g in by_series(pdf).items():
        mine = got[got.series == name].sort_values("ts").reset_index(drop=True)
        assert mine.pos.tolist() == list(range(len(g)))
        assert all(near(a, b) for a, b in zip(mine.y_filled, g.y.ffill()))


@pytest.mark.parametrize("chunk", [3, 10, 5000])
def test_lags_and_targets(spark, chunk):
    pdf = random_panel(2)
    pos = with_positions(to_spark(spark, pdf), SMALL)
    lagged = features.add_lags(pos, (1, 5, 30), chunk_rows=chunk).toPandas()
    ahead = features.add_direct_targets(pos, 6, drop_incomplete=False, chunk_rows=chunk).toPandas()
    for name, g in by_series(pdf).items():
        a = lagged[lagged.series == name].sort_values("ts")
        b = ahead[ahead.series == name].sort_values("ts")
        assert len(a) == len(g) == len(b)
        for k in (1, 5, 30):
            assert all(near(x, y) for x, y in zip(a[f"y_lag_{k}"], g.y.ffill().shift(k)))
        for h in (1, 6):
            assert all(near(x, y) for x, y in zip(b[f"y_t_plus_{h}"], g.y.shift(-h)))


@pytest.mark.parametrize("chunk", [4, 4096])
def test_sequences(spark, chunk):
    pdf = random_panel(3)
    pos = with_positions(to_spark(spark, pdf), SMALL)
    got = {(r.series, r.pos): r for r in features.sequences(pos, ["y", "x"], 5, 2, chunk).collect()}
    wanted = {}
    for name, g in by_series(pdf).items():
        X, y = g[["y", "x"]].to_numpy(), g.y.to_numpy()
        for end in range(4, len(g) - 2):
            if not np.isnan(X[end - 4:end + 1]).any() and not np.isnan(y[end + 1:end + 3]).any():
                wanted[(name, end)] = (X[end - 4:end + 1], y[end + 1:end + 3])
    assert set(got) == set(wanted)
    for key, (x, y) in wanted.items():
        assert np.allclose(np.array(got[key].x), x) and np.allclose(got[key].y_next, y)


def test_latest_sequence_rejects_missing(spark):
    pdf = random_panel(4, missing=0.0)
    pos = with_positions(to_spark(spark, pdf), SMALL)
    assert all(len(r.x) == 4 for r in features.latest_sequence(pos, ["y", "x"], 4).collect())
    with pytest.raises(Exception, match="too few rows"):
        features.latest_sequence(pos, ["y"], 10_000).collect()


def test_steps_cross_blocks(spark):
    pdf = random_panel(5)
    got = quality.time_steps(to_spark(spark, pdf), SMALL).toPandas()
    for name, g in by_series(pdf).items():
        mine = got[got.series == name].sort_values("ts").step_seconds
        assert all(near(a, b) for a, b in zip(mine, g.ts.diff().dt.total_seconds()))


@pytest.mark.parametrize("splits", [2, 16])
def test_quantiles_with_a_hot_group_and_ties(spark, splits):
    rng = np.random.default_rng(6)
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.exponential(5, 3000), 1)})
    tied = pd.DataFrame({"g": "tied", "v": [7.0] * 500 + [1.0, 2.0]})
    pdf = pd.concat([hot, tied, pd.DataFrame({"g": "one", "v": [3.5]})])
    df = spark.createDataFrame(pdf).repartition(6)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, splits, most=9).collect()}
    for name, g in pdf.groupby("g"):
        for col, p in probs.items():
            assert near(got[name][col], g.v.quantile(p)), (name, p)


def test_grid_blocks(spark):
    pdf = random_panel(7)
    grid = regular_grid(to_spark(spark, pdf), SMALL, "series", "is_missing").toPandas()
    for name, g in by_series(pdf).items():
        full = g.set_index("ts").y.reindex(pd.date_range(g.ts.min(), g.ts.max(), freq="h"))
        mine = grid[grid.series == name].sort_values("ts")
        assert mine.ts.tolist() == full.index.tolist()
        assert mine.is_missing.tolist() == full.isna().astype(int).tolist()


@pytest.mark.parametrize("levels,splits,block", [(1, 4, 3), (2, 4, 100), (0, 4, 5)])
def test_fold_medians(spark, levels, splits, block):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({
        "series": rng.choice(["a", "b"], 600, p=[0.9, 0.1]), "k": rng.integers(0, 40, 600),
        "tied": np.where(rng.random(600) < 0.6, 0.0, np.round(rng.normal(0, 1, 600), 2)),
        "u": np.round(rng.normal(0, 2, 600), 1), "v": np.where(rng.random(600) < 0.7, np.nan, rng.normal(5, 1, 600)),
    })
    data = [(r.series, int(r.k), r.tied, r.u, None if np.isnan(r.v) else r.v) for r in rows.itertuples()]
    origins = spark.createDataFrame([(s, k) for s in "abc" for k in range(0, 45, 2)], "series string, origin_seq long")
    got = folds.fold_medians(
        spark.createDataFrame(data, "series string, k long, tied double, u double, v double"), origins, ["tied", "u", "v"], splits, levels, block
    ).collect()
    assert len(got) == 69
    for r in got:
        seen = rows[(rows.series == r.series) & (rows.k <= r.origin_seq)]
        assert all(near(r[f"{c}_median"], seen[c].median()) for c in ("tied", "u", "v"))


def test_dedup_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 1, 3, None), ("a", 1, 5, "x"), ("a", 2, 1, "y")], "k string, t int, seq int, v string")
    last = {(r.k, r.t): r.v for r in quality.dedup(df, ["k", "t"], ["seq"], "last").collect()}
    first = {(r.k, r.t): r.v for r in quality.dedup(df, ["k", "t"], ["seq"], "first").collect()}
    assert last == {("a", 1): "x", ("a", 2): "y"} and first == {("a", 1): None, ("a", 2): "y"}


def test_value_rules_count_what_they_remove(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 600.0), ("b", 600.0), ("b", None)], "series string, y double")
    kept = [(r.series, r.y) for r in quality.apply_value_rules(df, "y", {"a": 500.0}).collect()]
    assert sorted(kept, key=str) == sorted([("a", None), ("a", None), ("b", 600.0), ("b", None)], key=str)
    counts = {r.series: (r.n_negative, r.n_above_cap) for r in quality.value_rule_counts(df, "y", {"a": 500.0}).collect()}
    assert counts == {"a": (1, 1), "b": (0, 0)}


def test_join_rejects_repeated_keys(spark):
    t = spark.createDataFrame([("a", 1, 2.0)], "series string, ts int, y double")
    c = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], "series string, ts int, x double")
    with pytest.raises(Exception, match="not unique"):
        quality.join_covariates(t, c).collect()
    assert quality.join_covariates(t, None) is t


def test_nan_becomes_null(spark):
    from tidemark.operators.panel import clean_nan

    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "y double")
    assert clean_nan(df, ["y"]).filter(F.col("y").isNull()).count() == 2
