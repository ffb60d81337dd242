"""The panel: one row per (series, ts) with a target ``y`` and optional covariates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks


@dataclass(frozen=True)
class PanelSpec:
    """Cadence and block width of a panel; ``block_rows`` bounds the rows any one task must order."""

    step_seconds: int = 3600
    block_rows: int = 4096
    covariates: tuple[str, ...] = ()

    def block(self, ts: Column) -> Column:
        return blocks.time_block(ts, self.step_seconds, self.block_rows)


def clean_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN is an ordinary (largest) value for Spark; the panel uses NULL for missing numbers."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def regular_grid(
    observed: DataFrame, spec: PanelSpec, span: str = "series", flag: str | None = None
) -> DataFrame:
    """Left-join observations onto an evenly spaced grid; missing steps get NULL.

    ``span="series"`` runs each grid from the first to the last row of its own series,
    ``span="network"`` over the whole table. ``flag`` names an optional 0/1 missing indicator.
    """
    lo, hi = F.min("ts").alias("_lo"), F.max("ts").alias("_hi")
    if span == "series":
        ends = observed.groupBy("series").agg(lo, hi)
    elif span == "network":
        limits = observed.groupBy("series").agg(lo, hi)
        ends = limits.select("series").withColumns(
            {"_lo": limits.agg(F.min("_lo")).scalar(), "_hi": limits.agg(F.max("_hi")).scalar()}
        )
    else:
        raise ValueError(f"unknown span: {span}")
    step, width = F.lit(spec.step_seconds), spec.block_rows
    start = F.unix_timestamp("_lo")
    steps = F.floor((F.unix_timestamp("_hi") - start) / step)
    # Two nested sequences keep each generated array at block length, whatever the span; the (few) block rows
    # are spread before they are expanded, so a long series is not expanded by one task.
    grid = (
        ends.select("series", start.alias("_start"), steps.alias("_steps"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_steps") / width))))
        .repartition("series", "_b")
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .withColumn("_k", F.col("_b") * width + F.col("_i"))
        .filter("_k <= _steps")
        .select("series", F.timestamp_seconds(F.col("_start") + F.col("_k") * step).alias("ts"))
    )
    out = grid.join(observed, ["series", "ts"], "left")
    if flag is not None:
        out = out.withColumn(flag, F.col("y").isNull().cast("int"))
    return out


def with_positions(panel: DataFrame, spec: PanelSpec, fill: bool = True) -> DataFrame:
    """Add the 0-based row position ``pos`` per series and, with ``fill``, the forward-filled ``y_filled``."""
    blocked = panel.withColumn("_block", spec.block(F.col("ts")))
    return (
        blocks.scan(
            blocked,
            ["series"],
            "_block",
            ["ts"],
            sums={"_n": F.lit(1).cast("long")},
            lasts={"y_filled": F.col("y")} if fill else None,
        )
        .withColumn("pos", F.col("_n") - 1)
        .drop("_n", "_block")
    )


def train_test_split(
    panel: DataFrame, train_start: str, train_end: str, test_start: str, test_end: str
) -> tuple[DataFrame, DataFrame]:
    """Two inclusive time ranges; a date-only bound means midnight. Training must end before the test."""
    stamp = lambda s: F.lit(s).cast("timestamp")
    if _parse(train_end) >= _parse(test_start):
        raise ValueError("the training period must end before the test period starts")
    return (
        panel.filter(F.col("ts").between(stamp(train_start), stamp(train_end))),
        panel.filter(F.col("ts").between(stamp(test_start), stamp(test_end))),
    )


def _parse(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text)


def exclude_interval(panel: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Drop rows inside ``[start, end]``; also return the one-row count of what was dropped."""
    inside = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return panel.filter(~inside | inside.isNull()), panel.filter(inside).agg(F.count("*").alias("n_excluded"))


def impute_train_only(panel: DataFrame, spec: PanelSpec, train_end: str) -> DataFrame:
    """Training rows with ``y_imputed``: forward-filled, then the prefix median, then 0.

    Only rows up to ``train_end`` are used, so nothing after it can leak in. The median is that of the
    forward-filled values, and only the leading run of a series can still need it.
    """
    from tidemark.operators.quantiles import exact_quantiles

    train = panel.filter(F.col("ts") <= F.lit(train_end).cast("timestamp"))
    filled = with_positions(train, spec)
    medians = exact_quantiles(filled, ["series"], "y_filled", {"_median": 0.5})
    facts = filled.groupBy("series").agg(F.max("pos").alias("_last")).join(medians, "series", "left")
    return blocks.attach(filled, facts, "_last").withColumn(
        "y_imputed", F.coalesce("y_filled", "_median", F.lit(0.0))
    ).drop("_median", "_last")
