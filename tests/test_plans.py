"""Plans that must hold at any size: what is joined by which key, and how often a table is read."""

import re

import pytest

from helpers import random_panel, to_spark
from tidemark.operators import forecasters, inference, origins, qa
from tidemark.operators.origins import BacktestSpec
from tidemark.operators.panel import PanelSpec, with_positions
from tidemark.plans import backtest
from tidemark.session import stage

SPEC = BacktestSpec(
    horizon=4, stride=5, test_start="2024-01-05 00:00:00", test_end="2024-01-14 00:00:00", min_train_rows=20, lags=(1, 2), season=3, covariates=("x",),
)


@pytest.fixture
def without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins_by_series_alone(df):
    """Joins whose only key is the series, in which a side holds rows: aggregates per series have one row of it."""
    lines, found = plan_of(df).split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if re.search(r"(SortMergeJoin|ShuffledHashJoin) \[series#\d+\], \[series#\d+\]", line):
            below = [x for x in lines[i + 1 :]]
            own = []
            for x in below:
                if depth(x) <= depth(line):
                    break
                own.append(x)
            exchanges = [x for x in own if "Exchange hashpartitioning(series" in x]
            aggregates = [x for x in own if "Aggregate(keys=[series#" in x]
            if len(aggregates) < len(exchanges):
                found.append(line.strip())
    return found


def test_rows_are_not_dealt_by_series_alone(spark, without_broadcasts):
    panel = to_spark(spark, random_panel(5, rows=300))
    positioned = stage(with_positions(panel, PanelSpec()), "positioned")
    rows = stage(backtest.prepare(panel, PanelSpec(), SPEC), "features")
    frame = forecasters.train_frame(rows, SPEC)
    for df in (origins.origins(positioned, SPEC), frame, backtest.baseline_ledger(rows, SPEC)):
        assert "SortMergeJoin" in plan_of(df) and joins_by_series_alone(df) == []


def test_ledger_is_read_once_by_its_gates(spark):
    ledger = stage(backtest.baseline_ledger(backtest.prepare(to_spark(spark, random_panel(5, rows=300)), PanelSpec(), SPEC), SPEC), "gated-ledger")
    none = spark.createDataFrame([], "series string, condition string, model string, horizon int, n_eval long")
    gates = qa.ledger_gates(ledger, none, none, none, ("a", "b"), ("persistence",), ("reference",), 4)
    assert len(re.findall(r"FileScan parquet .*origin", plan_of(gates))) == 1
    found = {r.check: r.passed for r in gates.collect()}
    assert found["ledger key is unique"] and not found["model set is exactly the expected one"]


def test_bootstrap_keeps_no_list_per_origin(spark):
    ledger = stage(backtest.baseline_ledger(backtest.prepare(to_spark(spark, random_panel(5, rows=300)), PanelSpec(), SPEC), SPEC), "booted-ledger")
    from pyspark.sql import functions as F

    boot = inference.bootstrap_skill(ledger, F.col("model") == "seasonal_naive", F.col("model") == "persistence", ("condition", "series", "horizon"), replicates=20)
    assert "collect_list" not in plan_of(boot) and boot.count() == 4
