"""The ledger of a sparse panel from observed rows alone, against the same ledger over the whole grid."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest

from tidemark.catalog import scores
from tidemark.operators.origins import BacktestSpec
from tidemark.operators.panel import PanelSpec, regular_grid
from tidemark.plans import backtest
from tidemark.session import stage

SPEC = BacktestSpec(horizon=5, stride=4, convention="C", min_train_rows=9, lags=(1,), season=3)
STEP = 3600


def observed(spark):
    """Dense, thin, short and late series, unknown values at ends and inside, a null series, a null time, a row beside the grid."""
    rng = np.random.default_rng(4)
    at = lambda k, more=0: dt.datetime(2024, 1, 1, 7) + dt.timedelta(seconds=int(k) * STEP + more)
    rows = []
    for name, share, n in (("dense", 1.0, 200), ("thin", 0.3, 400), ("few", 0.9, 12), ("late", 0.5, 300)):
        for k in range(n):
            if rng.random() < share:
                rows.append((name, at(k + 500 * (name == "late")), None if rng.random() < 0.1 else float(rng.integers(0, 50))))
    rows += [("ends", at(0), None), ("ends", at(12), 3.0), ("ends", at(13), 4.0), ("ends", at(30), None), ("one", at(3), 1.0)]
    rows += [(None, at(5), 2.0), ("dense", None, 2.0), ("thin", at(20, 60), 9.0), ("thin", at(24) + dt.timedelta(microseconds=5), 9.0)]
    return stage(spark.createDataFrame(rows, "series string, ts timestamp, y double").repartition(4), "observed")


@pytest.mark.parametrize("change", [{}, {"max_origins": 3}, {"train_start": "2024-01-03 00:00:00"}, {"season": 40}, {"stride": 1, "min_train_rows": 1}])
def test_sparse_ledger_is_that_of_the_grid(spark, change):
    spec = replace(SPEC, **change)
    rows = observed(spark)
    known = rows.filter("series IS NOT NULL AND ts IS NOT NULL")
    if spec.train_start:
        known = known.filter(f"ts >= '{spec.train_start}'")
    grid = regular_grid(known, PanelSpec(STEP, 4096))
    wanted = sorted(map(str, backtest.baseline_ledger(backtest.prepare(grid, PanelSpec(STEP, 4096), spec), spec).collect()))
    assert len(wanted) > 20
    for width in (3, 50, 4096):  # blocks shorter than the reach, and blocks that hold whole series
        assert sorted(map(str, backtest.sparse_baseline_ledger(rows, PanelSpec(STEP, width), spec).collect())) == wanted
    with pytest.raises(ValueError):
        backtest.sparse_baseline_ledger(rows, PanelSpec(STEP), replace(SPEC, convention="A"))


def test_supplier_queries_grow_with_rows_not_with_days(spark, tmp_path, monkeypatch):
    """Suppliers with few rows over 150 years: nothing that is staged has more rows than the table or than a score per cell."""
    rows = [(s, dt.datetime(1900 + 30 * (i // 40), 1, 1) + dt.timedelta(days=i % 40), float(i)) for s in range(30) for i in range(200)]
    table = spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    sizes = {}

    def counted(df, name):
        kept = stage(df, name)
        sizes[name] = kept.count()
        return kept

    for module in ("tidemark.catalog.scores", "tidemark.plans.backtest", "tidemark.sources.tables"):
        monkeypatch.setattr(f"{module}.stage", counted, raising=False)
    found = scores.supplier_hstar(spark, str(tmp_path)).collect()
    assert len(found) == 60 and sizes and max(sizes.values()) <= len(rows)
