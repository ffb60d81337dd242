"""From a panel to a prediction ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import arma, baselines, blocks, boosting, features, forecasters, origins
from tidemark.operators.panel import PanelSpec, with_positions
from tidemark.operators.origins import BacktestSpec
from tidemark.session import stage

REFERENCE = "reference"


def prepare(
    panel: DataFrame, panel_spec: PanelSpec, spec: BacktestSpec, recent: int = 0, staged: bool = True, slim: bool = False
) -> DataFrame:
    """Feature table of the (staged) panel: positions, lags, forward arrays and back values.

    ``slim`` blanks the arrays that only origins read on all other rows, for tables about to be written.
    """
    rows = origins.trim_to_train_start(panel, spec)
    if staged:
        rows = stage(rows, "panel")
    positioned = with_positions(rows, panel_spec)
    table = features.feature_table(
        positioned, spec.lags, spec.horizon, baselines.back_reach(spec), recent, panel_spec.block_rows
    )
    if not slim:
        return table
    first = (
        F.lit(spec.min_train_rows - 1).cast("long") if spec.convention == "C"
        else F.count_if(F.col("ts") < F.lit(spec.test_start).cast("timestamp"))
    )
    step = F.col("pos") - F.col("_first")
    candidate = (step >= 0) & (step % spec.stride == 0)
    facts = rows.groupBy("series").agg(first.alias("_first"), (F.count("*") - 1).alias("_last"))
    return (
        blocks.attach(table, facts, "_last", size=panel_spec.block_rows)
        .withColumns({c: F.when(candidate, F.col(c)) for c in ("ahead_ts", "back_y")})
        .drop("_first", "_last")
    )


def baseline_ledger(feature_rows: DataFrame, spec: BacktestSpec, models: Sequence[str] = ("persistence", "seasonal_naive")) -> DataFrame:
    """Ledger of the references that need no fitting."""
    available = {"persistence": baselines.persistence, "seasonal_naive": baselines.seasonal_naive}
    at = origins.origin_rows(feature_rows, spec)
    ledger = baselines.to_ledger(at, spec, {(REFERENCE, m): available[m](spec) for m in models})
    return _scored_rows(ledger, spec)


def sparse_baseline_ledger(
    observed: DataFrame, panel_spec: PanelSpec, spec: BacktestSpec, models: Sequence[str] = ("persistence", "seasonal_naive")
) -> DataFrame:
    """:func:`baseline_ledger` of ``regular_grid(observed, panel_spec)`` under convention C, without the grid.

    The references and the truth of this convention are raw values at fixed distances from an origin, and an origin has a known
    value itself, so observed rows (one per series and ``ts``) and the two ends of each series decide the ledger. The work grows with them instead of with the
    steps between those ends. ``observed`` is read twice.
    """
    if spec.convention != "C":
        raise ValueError("only convention C reads raw values alone")
    rows = origins.trim_to_train_start(observed, spec).filter("series IS NOT NULL AND ts IS NOT NULL")
    at = origins.sparse_origin_rows(rows, panel_spec, spec, baselines.back_reach(spec))
    available = {"persistence": baselines.persistence, "seasonal_naive": baselines.seasonal_naive}
    ledger = baselines.to_ledger(at, spec, {(REFERENCE, m): available[m](spec) for m in models})
    return _scored_rows(ledger, spec)


def _scored_rows(ledger: DataFrame, spec: BacktestSpec) -> DataFrame:
    """Convention C keeps no row for an unknown target."""
    return ledger.filter("y_true IS NOT NULL") if spec.convention == "C" else ledger


Forecaster = Callable[[DataFrame, BacktestSpec], DataFrame]


def backtest(
    feature_rows: DataFrame,
    spec: BacktestSpec,
    fitted: Sequence[tuple[Sequence[tuple[str, str]], Forecaster]] = (),
    models: Sequence[str] = ("persistence", "seasonal_naive"),
) -> DataFrame:
    """Baselines plus fitted forecasters in one ledger.

    Each entry of ``fitted`` names its arms as (condition, model) and gives a forecaster returning
    ``series, origin_seq, preds`` with one inner array per arm. References are emitted once, not per condition;
    a fold too short for a learner keeps its rows with a NULL forecast. Stage ``feature_rows`` first: origins,
    training rows and medians all read it.
    """
    at = origins.origin_rows(feature_rows, spec)
    available = {"persistence": baselines.persistence, "seasonal_naive": baselines.seasonal_naive}
    arms = {(REFERENCE, m): available[m](spec) for m in models}
    for i, (names, forecaster) in enumerate(fitted):
        preds = forecaster(feature_rows, spec).withColumnRenamed("preds", f"_p{i}")
        at = at.join(preds, ["series", "origin_seq"], "left")
        for j, name in enumerate(names):
            arms[tuple(name)] = F.element_at(f"_p{i}", j + 1)
    return _scored_rows(baselines.to_ledger(at, spec, arms), spec)


def supervised_rows(panel: DataFrame, panel_spec: PanelSpec, spec: BacktestSpec) -> DataFrame:
    """Convention B: lags from the raw target, rows with an unknown lag dropped, the rest renumbered."""
    numbered = with_positions(panel, panel_spec)
    if spec.lags:
        lagged = features.add_lags(numbered, spec.lags, fill=False, chunk_rows=panel_spec.block_rows)
        numbered = features.drop_insufficient_history(lagged, features.lag_names(spec.lags))
    return numbered.select(*panel.columns)


def single_origin_check(panel: DataFrame, panel_spec: PanelSpec, spec: BacktestSpec, origin: str) -> DataFrame:
    """Persistence at one origin for every series: the smallest end-to-end run (skill is 0 by construction)."""
    one = BacktestSpec(
        horizon=spec.horizon, stride=1, convention="B", train_start=spec.train_start, test_start=origin, test_end=origin,
        min_train_rows=1, lags=(1,), season=spec.season,
    )
    rows = prepare(panel, panel_spec, one, staged=False)
    return baseline_ledger(rows, one, ("persistence",))


def ridge_arms(**kw) -> tuple[list[tuple[str, str]], Forecaster]:
    names = [(arm, "ridge_direct") for arm in forecasters.ARMS]
    return names, lambda f, s: forecasters.direct_ridge(f, s, **kw)


def seasonal_ar_arm(**kw) -> tuple[list[tuple[str, str]], Forecaster]:
    return [(REFERENCE, "seasonal_ar")], lambda f, s: arma.seasonal_ar(f, s, **kw)


def seasonal_arma_arm(**kw) -> tuple[list[tuple[str, str]], Forecaster]:
    return [(REFERENCE, "seasonal_arma")], lambda f, s: arma.seasonal_arma(f, s, **kw)


def boosted_arms(**kw) -> tuple[list[tuple[str, str]], Forecaster]:
    names = [(arm, "boosted_direct") for arm in forecasters.ARMS]
    return names, lambda f, s: boosting.boosted_direct(f, s, **kw)


def recursive_arm(lags: Sequence[int] = (1, 2, 3, 7, 14, 21, 28), **kw) -> tuple[list[tuple[str, str]], Forecaster]:
    return [(REFERENCE, "recursive_learner")], lambda f, s: arma.recursive_learner(f, s, lags, **kw)
