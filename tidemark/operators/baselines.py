"""Reference forecasters that need no fitting, and the horizon expansion into a prediction ledger."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.origins import BacktestSpec

LEDGER = ("series", "origin", "forecast_timestamp", "horizon", "condition", "model", "y_true", "y_pred")


def seasonal_lag(spec: BacktestSpec, h: int) -> int:
    """How far back from the origin the latest training row in phase with horizon ``h`` lies."""
    g = spec.target_offset(h)
    cycles = math.ceil((g - spec.train_end_offset) / spec.season)
    return cycles * spec.season - g


def back_reach(spec: BacktestSpec) -> int:
    """How many raw back values the baselines read."""
    return max(seasonal_lag(spec, h) for h in range(1, spec.horizon + 1))


def persistence(spec: BacktestSpec) -> Column:
    """One value for all horizons: the last known target in the training prefix.

    Convention C takes the origin's own value; convention B the previous row as it is, known or not.
    """
    source = {"A": "prev_y", "B": "prev_y_raw", "C": "y"}[spec.convention]
    return F.array_repeat(F.col(source), spec.horizon)


def seasonal_naive(spec: BacktestSpec) -> Column:
    """The value one season (or more, to stay inside training) before each target."""
    return F.array(*[F.get("back_y", F.lit(seasonal_lag(spec, h))) for h in range(1, spec.horizon + 1)])


def to_ledger(rows: DataFrame, spec: BacktestSpec, forecasts: dict[tuple[str, str], Column]) -> DataFrame:
    """Expand origin rows into one ledger row per (condition, model, horizon).

    ``rows`` are feature rows at origins (``ahead_ts``, ``ahead_y``); each forecast is an array with one
    element per horizon. All models are expanded together, so origins are read once.
    """
    arms = F.array(
        *[
            F.struct(F.lit(c).alias("condition"), F.lit(m).alias("model"), p.cast("array<double>").alias("preds"))
            for (c, m), p in forecasts.items()
        ]
    )
    offset = F.col("horizon") + spec.target_offset(0)
    steps = F.sequence(F.lit(1), F.lit(spec.horizon))
    return (
        rows.select("series", F.col("ts").alias("origin"), "ahead_ts", "ahead_y", F.inline(arms))
        .select("*", F.explode(steps).alias("horizon"))
        .select(
            "series",
            "origin",
            F.get("ahead_ts", offset).alias("forecast_timestamp"),
            "horizon",
            "condition",
            "model",
            F.get("ahead_y", offset).alias("y_true"),
            F.element_at("preds", F.col("horizon")).alias("y_pred"),
        )
    )
