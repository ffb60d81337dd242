"""Prefix hooks against plain prefixes, with chunks of a few rows and several levels of merged states."""

import numpy as np
import pandas as pd
import pytest

from helpers import near, random_panel, to_spark
from tidemark.operators import hooks, origins
from tidemark.operators.origins import BacktestSpec
from tidemark.operators.panel import PanelSpec
from tidemark.plans import backtest
from tidemark.session import stage

SPEC = BacktestSpec(horizon=3, stride=5, test_start="2024-01-05 00:00:00", test_end="2024-01-14 00:00:00", min_train_rows=20, lags=(1,), season=3)


def path_hook():
    class Path:
        """State: the positions seen, in order. Shows what every call gets."""

        def init(self):
            return []

        def update(self, state, rows):
            state.extend(rows["pos"].tolist())
            return state

        def merge(self, first, second):
            return first + second

        def predict(self, state, origin):
            state.append(-1)  # must not show up in later calls
            assert state[:-1] == list(range(len(state) - 1))
            return [len(state) - 1, origin["pos"], float("nan")]

    return Path()


@pytest.fixture(scope="module")
def panel():
    return random_panel(21, rows=300)


@pytest.mark.parametrize("convention,chunk,fanout", [("A", 7, 2), ("A", 4096, 512), ("C", 5, 3)])
def test_states_are_those_of_the_whole_prefix(spark, panel, convention, chunk, fanout):
    spec = BacktestSpec(**{**SPEC.__dict__, "convention": convention})
    rows = stage(backtest.prepare(to_spark(spark, panel), PanelSpec(block_rows=23), spec), "t")
    found = hooks.prefix_hook(rows, spec, path_hook(), chunk_rows=chunk, fanout=fanout).collect()
    assert len(found) == origins.origin_rows(rows, spec).count() > 20
    for r in found:
        n, pos, nothing = r.preds[0]
        assert n == pos + spec.train_end_offset + 1 and nothing is None


def test_mean_and_least_squares(spark, panel):
    rows = stage(backtest.prepare(to_spark(spark, panel), PanelSpec(block_rows=23), SPEC), "t")
    at = {(r.series, r.origin_seq): r.pos for r in origins.origin_rows(rows, SPEC).collect()}
    trend = hooks.OnlineLeastSquares(3, ["pos", "x"], lambda origin, h: [origin["pos"] + h, origin["x"]])
    means = {(r.series, r.origin_seq): r.preds[0] for r in hooks.prefix_hook(rows, SPEC, hooks.RunningMean(3), chunk_rows=11, fanout=4).collect()}
    fits = {(r.series, r.origin_seq): r.preds[0] for r in hooks.prefix_hook(rows, SPEC, trend, ["x"], chunk_rows=11, fanout=4).collect()}
    assert means.keys() == fits.keys() == at.keys()
    for (series, seq), pos in at.items():
        g = panel[panel.series == series].sort_values("ts").reset_index(drop=True)
        train = g.iloc[:pos].assign(pos=np.arange(pos))
        assert all(near(v, train.y.mean()) for v in means[series, seq])
        known = train.dropna()
        a = np.column_stack([np.ones(len(known)), known.pos, known.x])
        coef = np.linalg.lstsq(a, known.y.to_numpy(), rcond=None)[0]
        for h, v in enumerate(fits[series, seq], 1):
            assert near(v, None if pd.isna(g.x[pos]) else coef @ [1, pos + h, g.x[pos]], 1e-6)


def test_before_the_first_row(spark):
    spec = BacktestSpec(**{**SPEC.__dict__, "min_train_rows": 0, "test_start": "2024-01-01 00:00:00"})
    rows = backtest.prepare(to_spark(spark, random_panel(3, rows=20, gaps=0)), PanelSpec(), spec)
    found = {(r.series, r.origin_seq): r.preds[0] for r in hooks.prefix_hook(rows, spec, hooks.RunningMean(3)).collect()}
    assert found["a", 0] == [None] * 3 and found["a", 1][0] is not None
