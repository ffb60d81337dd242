"""Autoregressions with moving-average terms, fitted for every fold from running moments of the train-only imputed target.

Two stages: a long autoregression gives residuals, and the target is then regressed on its lags and on lagged residuals. A residual is a
linear combination of the target's lags, so all sums of the second stage follow from one matrix of products of lags, whatever the fold's own
first-stage coefficients are. Likewise the rows before a series' first known value hold one number per fold: products of (value if known,
known or not) pairs turn into those of the imputed target for any fill.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks, folds
from tidemark.operators.forecasters import _differences, fold_facts, with_fold
from tidemark.operators.origins import BacktestSpec, origin_rows

#: Penalty that only settles columns which depend on each other.
RIDGE = 1e-9


def fold_fills(features: DataFrame, spec: BacktestSpec, levels: int | None = None) -> DataFrame:
    """Per origin, how the start of its training prefix is imputed: ``series, origin_seq, train_rows, leading, fill, total``.

    The prefix is filled forward; the ``leading`` rows before the first known value take ``fill``, the median of the filled values, or 0.0
    where there are none. ``total`` is the sum of the imputed prefix. Only series that start with an unknown value need the median: their
    filled values are counted per fold at which they come in, so a value carried over many rows weighs by its run and splits at the origins.
    """
    facts = fold_facts(features, spec)
    at = origin_rows(features, spec).select("series", "pos", "origin_seq")
    known = features.groupBy("series").agg(F.min(F.when(F.col("y_filled").isNotNull(), F.col("pos"))).alias("_known"))
    facts = facts.join(known, "series")
    seen = with_fold(features.select("series", "pos", "y_filled"), features, spec, 0)
    size = F.col("pos") + spec.train_end_offset + 1
    asks = blocks.attach(at, facts.select("series", "last_pos", "_known")).select(
        "series", "origin_seq", size.alias("train_rows"), F.least(F.coalesce("_known", size), size).alias("leading")
    )
    late = facts.filter("_known IS NULL OR _known > 0").select("series", "last_pos")
    if late.isEmpty():  # the usual case needs no order statistics
        medians = asks.select("series", "origin_seq", F.lit(None).cast("double").alias("y_filled_median"))
    else:
        medians = folds.fold_medians(blocks.attach(seen, late), asks.filter("leading > 0"), ["y_filled"], levels=levels)
    sums = folds.running_moments(seen, asks, ["y_filled"])
    fill = F.when(F.col("leading") > 0, F.coalesce("y_filled_median", F.lit(0.0)))
    total = F.coalesce(F.col("y_filled_mean") * F.col("y_filled_n"), F.lit(0.0)) + F.coalesce("fill", F.lit(0.0)) * F.col("leading")
    joined = asks.join(medians, ["series", "origin_seq"], "left").join(sums, ["series", "origin_seq"], "left").withColumn("fill", fill)
    return joined.select("series", "origin_seq", "train_rows", "leading", "fill", total.alias("total"))


def depth_needed(ar: Sequence[int], ma: Sequence[int] = (), long: Sequence[int] = (), difference: int = 0) -> int:
    """How many back values ``recent`` must hold, whichever convention is in force."""
    return max(_offsets(ar, ma, long)) + difference + 2


def _offsets(ar: Sequence[int], ma: Sequence[int], long: Sequence[int]) -> list[int]:
    """Back values that take part: the target, its lags, and whatever the residuals at the asked lags are made of."""
    return sorted({0, *ar, *(long if ma else ()), *(j + i for j in ma for i in (0, *long))})


def arma(
    features: DataFrame,
    spec: BacktestSpec,
    ar: Sequence[int],
    ma: Sequence[int] = (),
    long: Sequence[int] = (),
    difference: int = 0,
    calendar: bool = False,
    max_train_rows: int | None = None,
    fewest_rows: int | None = None,
    chunk_rows: int = 4096,
    origin_block: int | None = None,
    median_levels: int | None = None,
) -> DataFrame:
    """``series, origin_seq, preds[0][horizon]`` by lags ``ar`` of the target and lags ``ma`` of the residuals, iterated forward.

    Residuals are those of a regression on the lags ``long``; both stages use the rows for which all lags of both exist. Residuals
    after the prefix are 0. A fit whose lags of the target alone would explode (a root of modulus above 1) is made again without
    residuals, as lags and residuals of noise nearly cancel out and then have no definite slopes. The target is imputed per fold (see :func:`fold_fills`), then differenced ``difference`` times. ``calendar`` adds day
    of week and month of the predicted row (without ``ma`` only, as the calendar of past rows is not kept). With ``max_train_rows``
    each fold sees its latest rows alone, imputed from its whole prefix.
    """
    ar, ma, long = sorted(ar), sorted(ma), sorted(long)
    if ma and (calendar or not long):
        raise ValueError("residuals need the lags of a first stage, and no calendar")
    offsets = _offsets(ar, ma, long)
    deep = offsets[-1] + difference
    origin_block = origin_block or folds.origin_block(spec.stride, chunk_rows)
    held = features.schema["recent"].metadata.get("depth")
    if held is not None and held < deep + 2:
        raise ValueError(f"recent holds {held} back values of {deep + 2} needed; see depth_needed")
    n, extra = len(offsets), 2 if calendar else 0
    width = 1 + extra + 2 * n
    # Latest first; positions before the first known value hold 0 and are marked.
    known = F.slice("recent", 1, deep + 1)
    rows = (
        features.filter(F.col("pos") >= deep)
        .withColumn("_v", F.slice(F.concat(known, F.array_repeat(F.lit(0.0), deep + 1)), 1, deep + 1))
        .withColumn("_i", F.concat(F.array_repeat(F.lit(0.0), F.size(known)), F.array_repeat(F.lit(1.0), deep + 1 - F.size(known))))
        .withColumns({"_v": _differences(F.col("_v"), difference, offsets[-1] + 1), "_i": _differences(F.col("_i"), difference, offsets[-1] + 1)})
    )
    z = [F.lit(1.0)]
    if calendar:
        z += [F.weekday("ts").cast("double"), F.month("ts").cast("double")]
    z += [F.element_at(c, o + 1) for c in ("_v", "_i") for o in offsets]
    rows = rows.select("series", "ts", "pos", F.array(*z).alias("z"), F.array(F.lit(0.0)).alias("t"))
    train = with_fold(rows, features, spec, 0).withColumn("w", F.lit(1.0))
    if max_train_rows is not None:
        leaving = with_fold(rows.withColumn("pos", F.col("pos") + max_train_rows), features, spec, 0).withColumn("w", F.lit(-1.0))
        train = train.unionByName(leaving)
    train = train.select("series", "pos", "k", "w", "z", "t")
    steps = (
        F.flatten(F.transform(F.slice("ahead_ts", spec.target_offset(0) + 2, spec.horizon),
                              lambda t: F.array(F.weekday(t).cast("double"), F.month(t).cast("double"))))
        if calendar else F.array().cast("array<double>")
    )
    fills = fold_fills(features, spec, median_levels).select("series", "origin_seq", F.coalesce("fill", F.lit(0.0)).alias("_fill"))
    at = origin_rows(features, spec).join(fills, ["series", "origin_seq"])
    asks = at.select(
        "series", F.col("origin_seq").alias("k"), F.slice("recent", 1 - spec.train_end_offset, deep + 1).alias("x"),
        F.concat(F.array("_fill", (F.col("pos") + spec.train_end_offset + 1).cast("double")), steps).alias("aux"),
    )
    horizon = spec.horizon
    place = {o: 1 + extra + i for i, o in enumerate(offsets)}
    fewest = 2 + extra + len(ar) + len(ma) if fewest_rows is None else fewest_rows

    def predict(zz, _, x, aux):
        fill, rows_before, steps = aux[0], aux[1], aux[2:]
        if zz[0, 0] < fewest or rows_before < deep + 1 or np.isnan(x).any():
            return [[np.nan] * horizon]
        to_imputed = np.zeros((width, 1 + extra + n))
        to_imputed[: 1 + extra + n] = np.eye(1 + extra + n)
        to_imputed[1 + extra + n :, 1 + extra :] = np.eye(n) * fill
        m = to_imputed.T @ zz @ to_imputed
        own = np.eye(1 + extra + n)
        lagged_residuals = []
        if ma:
            idx = [0, *(place[o] for o in long)]
            intercept, slopes = folds.solve_standardized(m[np.ix_(idx, idx)], m[np.ix_(idx, [place[0]])], RIDGE)
            base, phi = intercept[0], slopes[:, 0]
            for j in ma:
                residual = own[place[j]] - base * own[0]
                for c, i in zip(phi, long):
                    residual = residual - c * own[place[j + i]]
                lagged_residuals.append(residual)
        to_columns = np.array([own[0], *own[1 : 1 + extra], *[own[place[o]] for o in ar], *lagged_residuals])
        intercept, slopes = folds.solve_standardized(to_columns @ m @ to_columns.T, to_columns @ m[:, [place[0]]], RIDGE)
        if ma and _explodes(slopes[:, 0], ar):
            to_columns = to_columns[: 1 + len(ar)]
            intercept, slopes = folds.solve_standardized(to_columns @ m @ to_columns.T, to_columns @ m[:, [place[0]]], RIDGE)
        b = slopes[:, 0]
        level = np.concatenate([np.full(max(0, deep + 1 - len(x)), fill), x[::-1]])[-(deep + 1):]  # oldest first
        tails = [level]
        for _ in range(difference):
            tails.append(np.diff(tails[-1]))
        history, ends = list(tails[-1]), [t[-1] for t in tails[:-1]]
        noise = {}
        for back in range(max(ma, default=0)):  # residual of the training row ``back`` rows before the last one
            if any(j > back for j in ma):
                at_row = len(history) - 1 - back
                if at_row - max(long, default=0) >= 0:
                    noise[-back] = history[at_row] - base - sum(c * history[at_row - i] for c, i in zip(phi, long))
        out = []
        for h in range(1, horizon + 1):
            value = intercept[0] + sum(c * history[-lag] for c, lag in zip(b[extra:], ar))
            value += sum(c * noise.get(h - j, 0.0) for c, j in zip(b[extra + len(ar):], ma))
            if calendar:
                value += b[0] * steps[2 * h - 2] + b[1] * steps[2 * h - 1]
            history.append(value)
            for i in range(difference - 1, -1, -1):
                ends[i] = value = ends[i] + value
            out.append(value)
        return [out]

    return folds.expanding_fit(train, asks, width, 1, predict, chunk_rows, origin_block)


def _explodes(slopes: np.ndarray, ar: Sequence[int]) -> bool:
    polynomial = np.zeros(max(ar, default=0) + 1)
    polynomial[0] = 1.0
    for slope, lag in zip(slopes, ar):  # residuals follow
        polynomial[lag] = -slope
    return not np.isfinite(slopes).all() or bool((np.abs(np.roots(polynomial)) > 1).any())


def seasonal_ar(features: DataFrame, spec: BacktestSpec, max_train_rows: int | None = None, **kw) -> DataFrame:
    """Seasonal reference without residuals: lags 1, s and s+1, over the whole imputed prefix unless a window is asked for."""
    return arma(features, spec, (1, spec.season, spec.season + 1), max_train_rows=max_train_rows, **kw)


def recursive_learner(features: DataFrame, spec: BacktestSpec, lags: Sequence[int], **kw) -> DataFrame:
    """Daily recursive learner on the imputed prefix: lags, day of week and month, predictions fed back as lags."""
    return arma(features, spec, lags, calendar=True, fewest_rows=max(80, 4 * len(lags)), **kw)


def seasonal_arma(features: DataFrame, spec: BacktestSpec, max_train_rows: int | None = None, **kw) -> DataFrame:
    """Seasonal reference: lags 1, s and s+1 of the target, residuals at lags 1 and s, first stage on 1, 2, s and s+1."""
    s = spec.season
    return arma(features, spec, (1, s, s + 1), (1, s), (1, 2, s, s + 1), max_train_rows=max_train_rows, **kw)


def plain_arma(features: DataFrame, spec: BacktestSpec, p: int, d: int, q: int, first: int | None = None, **kw) -> DataFrame:
    """Non-seasonal (p, d, q); the first stage has ``first`` lags, p + q + 1 by default."""
    long = tuple(range(1, (p + q + 1 if first is None else first) + 1)) if q else ()
    return arma(features, spec, tuple(range(1, p + 1)), tuple(range(1, q + 1)), long, d, **kw)
