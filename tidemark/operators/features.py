"""Lag, calendar, target and sequence features; all share one exchange and one sort per chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks

# Calendar feature names and condition names shared with published result tables.
CALENDAR = ("hour_of_day", "day_of_week", "month", "julian_day")
CONDITIONS = ("lags_only", "lags_meteo")
CONTROL_GROUPS = ("C0", "C1", "C2", "C3")


def lag_name(k: int) -> str:
    return f"y_lag_{k}"


def lag_names(lags: Sequence[int]) -> list[str]:
    if any(k <= 0 for k in lags):
        raise ValueError("lags must be positive")
    return [lag_name(k) for k in lags]


def add_calendar(df: DataFrame, ts: str = "ts", strict: bool = False) -> DataFrame:
    """Hour, day of week (Monday = 0), month and day of year; ``strict`` makes a NULL timestamp an error."""
    t = F.col(ts)
    if strict:
        t = F.coalesce(t, F.raise_error(F.lit(f"{ts} holds NULL")).cast("timestamp"))
    return df.withColumns(
        {
            "hour_of_day": F.hour(t),
            "day_of_week": F.weekday(t),
            "month": F.month(t),
            "julian_day": F.dayofyear(t),
        }
    )


def add_lags(
    positioned: DataFrame, lags: Sequence[int], fill: bool = True, chunk_rows: int = 4096
) -> DataFrame:
    """``y_lag_k`` by row position, from the forward-filled target or (``fill=False``) from the raw one."""
    names = lag_names(lags)
    source = "y_filled" if fill else "y"
    halo = blocks.with_halo(positioned, "pos", max(lags), 0, chunk_rows)
    w = blocks.chunk_window(["series"], "pos")
    return blocks.owned(halo.withColumns({n: F.lag(source, k).over(w) for n, k in zip(names, lags)}))


def add_direct_targets(
    positioned: DataFrame, horizon: int, drop_incomplete: bool = True, chunk_rows: int = 4096
) -> DataFrame:
    """``y_t_plus_h`` for h = 1..horizon; rows with any missing future value are dropped by default."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    halo = blocks.with_halo(positioned, "pos", 0, horizon, chunk_rows)
    w = blocks.chunk_window(["series"], "pos")
    out = blocks.owned(
        halo.withColumns(
            {f"y_t_plus_{h}": F.lead("y", h).over(w) for h in range(1, horizon + 1)}
            | {"_future": F.count("y").over(w.rowsBetween(1, horizon))}
        )
    )
    if drop_incomplete:
        out = out.filter(F.col("_future") == horizon)
    return out.drop("_future")


def feature_table(
    positioned: DataFrame,
    lags: Sequence[int],
    horizon: int,
    back: int = 0,
    recent: int = 0,
    chunk_rows: int = 4096,
) -> DataFrame:
    """Everything a backtest reads, in a single pass over position chunks.

    Adds the forward-filled lags, ``prev_y`` (last known target strictly before the row) and ``prev_y_raw`` (the
    previous row as it is); ``n_future`` = known targets among the next ``horizon`` rows; and arrays read by offset:
    ``ahead_ts`` / ``ahead_y`` (0..horizon rows ahead), ``back_y`` (0..``back`` rows back, raw) and ``recent``
    (the last ``recent`` filled values, latest first, starting at the row itself). Arrays end early at the ends
    of a series. Steps that do not use an array drop its window function from the plan.
    """
    lag_columns = lag_names(lags)
    reach = max([1, back, recent - 1, *lags])
    halo = blocks.with_halo(positioned, "pos", reach, horizon, chunk_rows)
    w = blocks.chunk_window(["series"], "pos")
    arrays = {"_ahead": F.collect_list(F.struct("ts", "y")).over(w.rowsBetween(0, horizon))}
    if back:
        arrays["_back"] = F.collect_list(F.struct("y")).over(w.rowsBetween(-back, 0))
    if recent:
        # A filled value stays known once it is, so skipping NULL only shortens the list.
        arrays["recent"] = F.reverse(F.collect_list("y_filled").over(w.rowsBetween(1 - recent, 0)))
    out = halo.withColumns(
        {n: F.lag("y_filled", k).over(w) for n, k in zip(lag_columns, lags)}
        | {"prev_y": F.lag("y_filled", 1).over(w), "prev_y_raw": F.lag("y", 1).over(w)}
        | {"n_future": F.count("y").over(w.rowsBetween(1, horizon))}
        | arrays
    )
    out = blocks.owned(out).withColumns({"ahead_ts": F.col("_ahead.ts"), "ahead_y": F.col("_ahead.y")})
    if recent:
        out = out.withMetadata("recent", {"depth": recent})
    if back:
        out = out.withColumn("back_y", F.reverse(F.col("_back.y")))
    return add_calendar(out.drop("_ahead", "_back"))


def condition_columns(
    condition: str, lags: Sequence[int], covariates: Sequence[str], available: Sequence[str],
    calendar: Sequence[str] = CALENDAR, extended: Sequence[str] = (),
) -> list[str]:
    """Feature columns of a condition, restricted to the covariates that exist.

    ``lags_only`` / ``lags_meteo`` are the two study arms; C0..C3 the control groups (none, lags and calendar,
    plus core covariates, plus extended covariates).
    """
    base = lag_names(lags) + list(calendar)
    core = [c for c in covariates if c in available]
    more = [c for c in extended if c in available]
    groups = {
        "lags_only": base,
        "lags_meteo": base + core,
        "C0": [],
        "C1": base,
        "C2": base + core,
        "C3": base + core + more,
    }
    if condition not in groups:
        raise ValueError(f"unknown condition: {condition}")
    return groups[condition]


def drop_insufficient_history(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.dropna(subset=list(required))


def impute_with(value: Column, median: Column) -> Column:
    """Missing feature → fold median, or 0.0 where the fold has none."""
    return F.coalesce(value, median, F.lit(0.0))


def sequences(
    positioned: DataFrame, features: Sequence[str], length: int, horizon: int, chunk_rows: int = 4096
) -> DataFrame:
    """Sliding windows: ``x`` (length × features, ending at ``pos``) and ``y_next`` (horizon values).

    Windows with any missing input or target are skipped, as are those that would leave the series.
    """
    if length <= 0 or horizon <= 0:
        raise ValueError("length and horizon must be positive")
    missing = [c for c in features if c not in positioned.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    cell = F.array(*[F.col(c).cast("double") for c in features])
    whole = F.when(_all_known(features), cell)
    halo = blocks.with_halo(positioned, "pos", length - 1, horizon, chunk_rows)
    w = blocks.chunk_window(["series"], "pos")
    # collect_list skips NULL, so a window is complete exactly when its list has full length.
    out = halo.withColumns(
        {
            "x": F.collect_list(whole).over(w.rowsBetween(1 - length, 0)),
            "y_next": F.collect_list("y").over(w.rowsBetween(1, horizon)),
        }
    )
    return blocks.owned(out).filter((F.size("x") == length) & (F.size("y_next") == horizon)).select(
        "series", "ts", "pos", "x", "y_next"
    )


def latest_sequence(positioned: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """The last ``length`` rows of each series as one input window; short or incomplete input is an error."""
    if length <= 0:
        raise ValueError("length must be positive")
    last = positioned.groupBy("series").agg(F.max("pos").alias("_last"))
    tail = blocks.attach(positioned, last, "_last").filter(F.col("pos") > F.col("_last") - length)
    whole = F.when(_all_known(features), F.array(*[F.col(c).cast("double") for c in features]))
    windows = tail.groupBy("series").agg(
        F.max("ts").alias("ts"), F.sort_array(F.collect_list(F.struct("pos", whole.alias("v")))).alias("_rows")
    )
    values = F.filter(F.transform("_rows", lambda r: r["v"]), lambda v: v.isNotNull())
    checked = F.when(F.size(values) == length, values).otherwise(
        F.raise_error(F.concat(F.lit("too few rows or missing values in series "), F.col("series"))).cast(
            "array<array<double>>"
        )
    )
    return windows.select("series", "ts", checked.alias("x"))


def _all_known(columns: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known
