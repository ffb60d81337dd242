"""Fitted forecasters. Each takes the feature table and the spec and returns one ``preds`` row per origin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks, folds
from tidemark.operators.features import lag_names
from tidemark.operators.origins import BacktestSpec, first_usable_origin, origin_rows, series_bounds

ARMS = ("lags_only", "lags_meteo")


def with_fold(rows: DataFrame, features: DataFrame, spec: BacktestSpec, reach: int) -> DataFrame:
    """Rows some fold trains on, with ``k``, the first such fold; the ``reach`` rows after them must be in it too.

    Origin positions come from the complete table ``features``, of which ``rows`` may be a part.
    """
    return (
        blocks.attach(rows, fold_facts(features, spec))
        .withColumn("k", first_usable_origin(spec, F.col("first_pos"), reach))
        .filter("k <= _kmax")
        .drop("_kmax", "first_pos", "last_pos")
    )


def fold_facts(features: DataFrame, spec: BacktestSpec) -> DataFrame:
    """``series, first_pos, last_pos, _kmax`` of every series with an origin, by aggregates alone."""
    last = origin_rows(features, spec).groupBy("series").agg(F.max("origin_seq").alias("_kmax"))
    return series_bounds(features, spec).join(last, "series")


def train_frame(features: DataFrame, spec: BacktestSpec) -> DataFrame:
    """Complete supervised rows for direct forecasts: all lags and all ``horizon`` future targets known."""
    rows = features.dropna(subset=lag_names(spec.lags)).filter(F.col("n_future") == spec.horizon)
    return with_fold(rows, features, spec, spec.horizon)


def _numbers(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in columns]


def direct_ridge(
    features: DataFrame, spec: BacktestSpec, ridge: float = 1.0, chunk_rows: int = 4096,
    origin_block: int | None = None, median_levels: int | None = None,
) -> DataFrame:
    """One linear model per horizon and fold, for both arms at once: ``series, origin_seq, preds[arm][horizon]``.

    Missing covariates take the fold's train-only median. Since that median changes from fold to fold, the
    moments are kept over (value if known, known-or-not) pairs, from which the moments of the imputed columns
    follow exactly.
    """
    origin_block = origin_block or folds.origin_block(spec.stride, chunk_rows)
    base = lag_names(spec.lags) + list(spec.calendar)
    cov = list(spec.covariates)
    nb, nc, width = 1 + len(base), len(cov), 1 + len(base) + 2 * len(cov)
    rows = train_frame(features, spec)
    z = F.array(
        F.lit(1.0),
        *_numbers(base),
        *[F.coalesce(c, F.lit(0.0)) for c in _numbers(cov)],
        *[c.isNull().cast("double") for c in _numbers(cov)],
    )
    train = rows.select(
        "series", "pos", "k", F.lit(1.0).alias("w"), z.alias("z"),
        F.slice("ahead_y", 2, spec.horizon).alias("t"),
    )
    at = origin_rows(features, spec)
    if cov:
        at = at.join(
            folds.fold_medians(rows.select("series", "k", *cov), at, cov, levels=median_levels, origin_block=origin_block),
            ["series", "origin_seq"],
        )
    asks = at.select(
        "series", F.col("origin_seq").alias("k"), F.array(*_numbers([*base, *cov])).alias("x"),
        F.array(*_numbers([f"{c}_median" for c in cov])).cast("array<double>").alias("aux"),
    )
    fewest, horizon, n_base = spec.min_frame_rows, spec.horizon, nb - 1

    def predict(zz, zt, x, aux):
        missing = [np.nan] * horizon
        if zz[0, 0] < max(fewest, 2) or np.isnan(x[:n_base]).any():
            return [missing, missing]
        fill = np.where(np.isnan(aux), 0.0, aux)
        to_imputed = np.zeros((width, nb + nc))
        to_imputed[np.arange(nb + nc), np.arange(nb + nc)] = 1.0
        to_imputed[np.arange(nb + nc, width), np.arange(nb, nb + nc)] = fill
        full_zz, full_zt = to_imputed.T @ zz @ to_imputed, to_imputed.T @ zt
        known = x.copy()
        known[n_base:] = np.where(np.isnan(x[n_base:]), fill, x[n_base:])
        result = []
        for size in (nb, nb + nc):
            intercept, slopes = folds.solve_standardized(full_zz[:size, :size], full_zt[:size], ridge)
            result.append(intercept + known[: size - 1] @ slopes)
        return result

    return folds.expanding_fit(train, asks, width, spec.horizon, predict, chunk_rows, origin_block)


def autoregression(
    features: DataFrame,
    spec: BacktestSpec,
    lags: Sequence[int],
    difference: int = 0,
    calendar: bool = False,
    max_train_rows: int | None = None,
    fewest_rows: int | None = None,
    chunk_rows: int = 4096,
    origin_block: int | None = None,
) -> DataFrame:
    """Least-squares autoregression per fold, iterated forward: ``series, origin_seq, preds[0][horizon]``.

    Works on the forward-filled target, differenced ``difference`` times; ``features`` must hold ``recent``,
    the filled values at ``pos``, ``pos-1``, … (see :func:`recent_values`). ``calendar`` adds day of week and
    month of the predicted row. With ``max_train_rows`` each fold sees only that many latest rows: a row then
    enters at one fold and leaves at a later one, and its leaving is added with weight -1.
    """
    lags = sorted(lags)
    depth = lags[-1] + difference
    origin_block = origin_block or folds.origin_block(spec.stride, chunk_rows)
    e = spec.train_end_offset
    width = 1 + len(lags) + (2 if calendar else 0)
    level = _differences(F.col("recent"), difference, lags[-1] + 1)
    z = [F.lit(1.0), *[F.element_at("_d", k + 1) for k in lags]]
    if calendar:
        z += [F.weekday("ts").cast("double"), F.month("ts").cast("double")]
    rows = (
        features.filter(F.size("recent") > depth)
        .withColumn("_d", level)
        .select("series", "ts", "pos", F.array(*z).alias("z"), F.array(F.element_at("_d", 1)).alias("t"))
    )
    entering = with_fold(rows, features, spec, 0).withColumn("w", F.lit(1.0))
    if max_train_rows is None:
        train = entering
    else:
        leaving = with_fold(rows.withColumn("pos", F.col("pos") + max_train_rows), features, spec, 0).withColumn("w", F.lit(-1.0))
        train = entering.unionByName(leaving)
    train = train.select("series", "pos", "k", "w", "z", "t")
    at = origin_rows(features, spec)
    start = 1 - e  # 1-based index of the last training value inside ``recent``
    steps = (
        F.flatten(F.transform(F.slice("ahead_ts", spec.target_offset(0) + 2, spec.horizon),
                              lambda t: F.array(F.weekday(t).cast("double"), F.month(t).cast("double"))))
        if calendar else F.array().cast("array<double>")
    )
    asks = at.select(
        "series", F.col("origin_seq").alias("k"), F.slice("recent", start, depth + 1).alias("x"), steps.alias("aux")
    )
    horizon = spec.horizon
    fewest = width + 1 if fewest_rows is None else fewest_rows

    def predict(zz, zt, x, aux):
        if zz[0, 0] < fewest or len(x) < depth + 1 or np.isnan(x).any():
            return [[np.nan] * horizon]
        intercept, slopes = folds.solve_standardized(zz, zt, 1e-9)
        b = slopes[:, 0]
        tails = [x[::-1]]  # oldest first; one list per order of differencing
        for _ in range(difference):
            tails.append(np.diff(tails[-1]))
        history, ends = list(tails[-1]), [t[-1] for t in tails[:-1]]
        out = []
        for h in range(horizon):
            value = intercept[0] + sum(c * history[-k] for c, k in zip(b, lags))
            if calendar:
                value += b[-2] * aux[2 * h] + b[-1] * aux[2 * h + 1]
            history.append(value)
            for i in range(difference - 1, -1, -1):
                ends[i] = value = ends[i] + value
            out.append(value)
        return [out]

    return folds.expanding_fit(train, asks, width, 1, predict, chunk_rows, origin_block)


def _differences(values: Column, order: int, keep: int) -> Column:
    """``order``-fold backward differences of an array that starts at the latest value."""
    out = values
    for i in range(order):
        size = keep + order - i - 1
        out = F.zip_with(F.slice(out, 1, size), F.slice(out, 2, size), lambda a, b: a - b)
    return F.slice(out, 1, keep)


def recent_depth(lags: Sequence[int], difference: int = 0) -> int:
    """How many back values ``recent`` needs for an autoregression, whichever convention is in force."""
    return max(lags) + difference + 2


def plain_ar(features: DataFrame, spec: BacktestSpec, p: int, d: int = 0, **kw) -> DataFrame:
    """Non-seasonal autoregression of order p on the d-fold differenced target."""
    return autoregression(features, spec, tuple(range(1, p + 1)), difference=d, **kw)


def windowed_hook(
    features: DataFrame,
    spec: BacktestSpec,
    fit_predict: Callable[[pd.DataFrame, pd.DataFrame], Sequence[float]],
    columns: Sequence[str],
    max_train_rows: int,
    origin_block: int = 16,
) -> DataFrame:
    """User forecaster: ``fit_predict(train_rows, origin_row)`` returns one value per horizon.

    It is called once per origin with the latest ``max_train_rows`` rows of the training prefix. The window is
    required, because it bounds what a task holds: each row is sent to the few origin blocks that need it. For
    an expanding prefix of any length use the moment-based forecasters.
    """
    e, s = spec.train_end_offset, spec.stride
    at = origin_rows(features, spec)
    k_in = first_usable_origin(spec, F.col("first_pos"), 0)
    k_out = F.floor((F.col("pos") + max_train_rows - e - 1 - F.col("first_pos")) / F.lit(s))  # last fold that sees it
    seen = features.select("series", "ts", "pos", "y", *[c for c in columns if c not in ("ts", "pos", "y")])
    rows = (
        blocks.attach(seen, fold_facts(features, spec))
        .withColumns({"_in": k_in, "_out": F.least(k_out, F.col("_kmax"))})
        .filter("_in <= _out")
        .withColumn("b", F.explode(F.sequence(F.floor(F.col("_in") / origin_block), F.floor(F.col("_out") / origin_block))))
        .drop("first_pos", "last_pos", "_kmax", "_in", "_out")
    )
    asks = at.withColumn("b", F.floor(F.col("origin_seq") / origin_block)).select(
        "series", "b", "origin_seq", "ts", "pos", "y", *[c for c in columns if c not in ("ts", "pos", "y")]
    )

    def run(key, ask: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        train = train.sort_values("pos")
        pos = train["pos"].to_numpy()
        out = []
        for i in range(len(ask)):
            row = ask.iloc[[i]]
            end = int(row["pos"].iloc[0]) + e
            lo, hi = np.searchsorted(pos, [end - max_train_rows + 1, end + 1])
            preds = [float(v) for v in fit_predict(train.iloc[lo:hi], row)]
            out.append((key[0], int(row["origin_seq"].iloc[0]), [preds]))
        return pd.DataFrame(out, columns=["series", "origin_seq", "preds"])

    fits = blocks.fresh(asks).groupBy("series", "b").cogroup(blocks.fresh(rows).groupBy("series", "b")).applyInPandas(
        run, "series string, origin_seq long, preds array<array<double>>"
    )
    return fits.withColumn("preds", F.transform("preds", lambda p: F.transform(p, lambda v: F.when(~F.isnan(v), v))))
