"""Moving-average forecasters, per-fold imputation and fold medians against plain folds."""

import numpy as np
import pandas as pd
import pytest

from helpers import near, random_panel, to_spark
from tidemark.operators import arma, blocks, folds, origins
from tidemark.operators.origins import BacktestSpec
from tidemark.operators.panel import PanelSpec
from tidemark.plans import backtest
from tidemark.session import stage

TINY = PanelSpec(block_rows=23)
SPEC = BacktestSpec(
    horizon=4, stride=5, test_start="2024-01-08 00:00:00", test_end="2024-01-14 00:00:00", min_train_rows=50, lags=(1,), season=6,
)


@pytest.fixture(scope="module")
def panel():
    """Series ``a`` starts with a long unknown run, ``b`` is known from the first row, ``c`` is never known before late."""
    pdf = pd.concat([random_panel(31, series=("a",), rows=330), random_panel(33, series=("b",), rows=330)], ignore_index=True)
    first = pdf.groupby("series").cumcount()
    pdf.loc[(pdf.series == "a") & (first < 37), "y"] = np.nan
    pdf.loc[(pdf.series == "b") & (first == 0), "y"] = 20.0
    late = random_panel(32, series=("c",), rows=330)
    late.loc[: len(late) - 60, "y"] = np.nan
    return pd.concat([pdf, late], ignore_index=True)


def places(rows, spec):
    found = {}
    for r in origins.origin_rows(rows, spec).select("series", "origin_seq", "pos").collect():
        found[r.series, r.origin_seq] = r.pos
    return found


def imputed(g, end):
    y = g.y.iloc[: end + 1].ffill()
    return y.fillna(y.median() if y.notna().any() else 0.0).to_numpy()


def test_fills_of_every_fold(spark, panel):
    rows = stage(backtest.prepare(to_spark(spark, panel), TINY, SPEC), "t")
    at = places(rows, SPEC)
    found = arma.fold_fills(rows, SPEC, levels=2).collect()
    assert {(r.series, r.origin_seq) for r in found} == set(at) and len({r.series for r in found}) == 3
    for r in found:
        g = panel[panel.series == r.series].sort_values("ts").reset_index(drop=True)
        end = at[r.series, r.origin_seq] - 1
        y = g.y.iloc[: end + 1].ffill()
        leading = int(y.isna().sum())
        assert (r.train_rows, r.leading) == (end + 1, leading)
        assert near(r.fill, None if not leading else y.median() if y.notna().any() else 0.0)
        assert near(r.total, imputed(g, end).sum(), 1e-9)


def brute(y, ar, ma, long, d, cap, horizon):
    w = np.diff(y, n=d)
    depth = max(arma._offsets(ar, ma, long))
    idx = [t for t in range(depth, len(w)) if cap is None or t + d > len(y) - 1 - cap]
    if len(idx) < 2 + len(ar) + len(ma):
        return None
    fit = lambda cols, t: np.linalg.lstsq(np.column_stack([np.ones(len(t)), *cols]), t, rcond=None)[0]
    lag = lambda k, at=None: np.array([w[t - k] for t in (idx if at is None else at)])
    noise = {}
    cols = [lag(k) for k in ar]
    if ma:
        phi = fit([lag(i) for i in long], lag(0))
        noise = {t: w[t] - phi[0] - sum(c * w[t - i] for c, i in zip(phi[1:], long)) for t in range(max(long), len(w))}
        cols += [np.array([noise[t - j] for t in idx]) for j in ma]
    b = fit(cols, lag(0))
    if ma and (np.abs(np.roots([1.0] + [-sum(c for c, k in zip(b[1:], ar) if k == i) for i in range(1, max(ar) + 1)])) > 1).any():
        b, ma = fit(cols[: len(ar)], lag(0)), ()
    hist, levels, out = list(w), [np.diff(y, n=i)[-1] for i in range(d)], []
    for _ in range(horizon):
        t = len(hist)
        value = b[0] + sum(c * hist[t - k] for c, k in zip(b[1:], ar)) + sum(c * noise.get(t - j, 0.0) for c, j in zip(b[1 + len(ar):], ma))
        hist.append(value)
        for i in range(d - 1, -1, -1):
            levels[i] = value = levels[i] + value
        out.append(value)
    return out


@pytest.mark.parametrize("ar,ma,long,d,cap", [
    ((1, 6, 7), (1, 6), (1, 2, 6, 7), 0, None), ((1, 2), (1,), (1, 2, 3), 1, None), ((1,), (1, 2), (1, 2), 0, 45),
])
def test_two_stages_equal_fold_fits(spark, panel, ar, ma, long, d, cap):
    rows = stage(backtest.prepare(to_spark(spark, panel), TINY, SPEC, arma.depth_needed(ar, ma, long, d)), "t")
    at = places(rows, SPEC)
    found = arma.arma(rows, SPEC, ar, ma, long, d, max_train_rows=cap, chunk_rows=13, origin_block=3).collect()
    assert {(r.series, r.origin_seq) for r in found} == set(at)
    checked = 0
    for r in found:
        g = panel[panel.series == r.series].sort_values("ts").reset_index(drop=True)
        y = imputed(g, at[r.series, r.origin_seq] - 1)
        if np.ptp(y[-cap:] if cap else y) == 0:  # nothing known yet: the fill goes on
            assert np.allclose(r.preds[0], y[-1])
            continue
        if g.y.iloc[: at[r.series, r.origin_seq]].nunique() < 15:  # lags that hardly vary have no definite slope
            continue
        wanted = brute(y, ar, ma, long, d, cap, SPEC.horizon)
        assert np.allclose(r.preds[0], wanted, rtol=1e-4, atol=1e-4), (r, wanted)
        checked += 1
    assert checked > 40


def test_moving_average_needs_a_first_stage(spark, panel):
    with pytest.raises(ValueError):
        arma.arma(to_spark(spark, panel), SPEC, (1,), (1,))


@pytest.mark.parametrize("walk", [60, 20_000])
def test_fold_medians_of_weighted_entries(spark, monkeypatch, walk):
    """One range asked for by many folds, values shared by many rows, and two columns."""
    monkeypatch.setattr(folds, "WALK_ROWS", walk)
    rng = np.random.default_rng(4)
    n = 600
    rows = pd.DataFrame({"series": np.where(rng.random(n) < 0.8, "a", "b"), "k": rng.integers(0, 60, n), "u": rng.integers(0, 12, n).astype(float), "v": rng.normal(0, 1, n).round(2)})
    rows.loc[rng.random(n) < 0.1, "v"] = np.nan
    rows.loc[rng.random(n) < 0.6, "u"] = 5.0
    frame = spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in rows.itertuples(index=False)], "series string, k long, u double, v double")
    asks = spark.createDataFrame([(s, k) for s in ("a", "b", "none") for k in range(65)], "series string, origin_seq long")
    got = folds.fold_medians(frame, asks, ["u", "v"]).collect()
    assert len(got) == 195
    for r in got:
        seen = rows[(rows.series == r.series) & (rows.k <= r.origin_seq)]
        assert near(r.u_median, seen.u.median()) and near(r.v_median, seen.v.median())


def test_scan_of_several_levels(spark):
    """Blocks of 4 rows and groups of 4: no window holds more than 16 rows, and the last one as many totals as are left."""
    from pyspark.sql import functions as F

    n = 4000
    rng = np.random.default_rng(6)
    values = [None if rng.random() < 0.4 else float(rng.integers(0, 9)) for _ in range(n)]
    df = stage(spark.createDataFrame([("a" if i % 3 else "b", i, v) for i, v in enumerate(values)], "s string, i long, v double"), "t").withColumn("b", F.floor(F.col("i") / 4))
    pdf = df.toPandas().sort_values("i")
    pdf["total"], pdf["lasts"] = pdf.groupby("s").v.transform(lambda x: x.fillna(0).cumsum()), pdf.groupby("s").v.ffill()
    for levels in (2, 3, 6):
        got = blocks.scan(df, ["s"], "b", ["i"], {"n": F.lit(1), "total": F.col("v")}, {"lasts": F.col("v")}, levels=levels, fanout=4).toPandas().sort_values("i")
        assert (got.n.to_numpy() == pdf.groupby("s").cumcount().to_numpy() + 1).all()
        assert np.allclose(got.total, pdf.total) and np.array_equal(got.lasts.to_numpy(float), pdf.lasts.to_numpy(float), equal_nan=True)


def test_recursive_learner_on_the_imputed_prefix(spark, panel):
    """Lags, day of week and month of the predicted row; the prefix of each fold imputed from itself alone."""
    lags = (1, 2, 7)
    rows = stage(backtest.prepare(to_spark(spark, panel), TINY, SPEC, arma.depth_needed(lags)), "t")
    at = places(rows, SPEC)
    found = arma.recursive_learner(rows, SPEC, lags, chunk_rows=50).filter("series = 'a'").collect()
    g = panel[panel.series == "a"].sort_values("ts").reset_index(drop=True)
    assert len(found) == sum(s == "a" for s, _ in at) > 15
    for r in found:
        end = at["a", r.origin_seq] - 1
        y = imputed(g, end)
        idx = list(range(max(lags), end + 1))
        calendar = lambda i: [g.ts[i].dayofweek, g.ts[i].month]
        if len(idx) < 80:
            assert r.preds[0] == [None] * SPEC.horizon
            continue
        a = np.array([[1.0, *calendar(i), *[y[i - k] for k in lags]] for i in idx])
        live = np.ptp(a, axis=0) > 0
        live[0] = True
        coef = np.zeros(a.shape[1])
        coef[live] = np.linalg.lstsq(a[:, live], y[idx], rcond=None)[0]
        hist = list(y)
        for h in range(1, SPEC.horizon + 1):
            hist.append(float(np.dot(coef, [1.0, *calendar(end + 1 + h), *[hist[-k] for k in lags]])))
        assert np.allclose(r.preds[0], hist[end + 1:], rtol=1e-4, atol=1e-4)
