"""Per-fold training statistics for all origins at once.

A fold trains on a prefix of its series, so a training row enters at one origin and stays. Rows carry the
index ``k`` of the first origin that sees them; statistics of every fold are then running sums over ``k``
(linear in rows) instead of an origin-by-history join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import blocks
from tidemark.operators.quantiles import range_number
from tidemark.session import stage

ORIGIN_BLOCK = 256
WALK_ROWS = 20_000  # entries and asked ranks of one value range that a task goes through one by one


def origin_block(stride: int, chunk_rows: int) -> int:
    """Origins of one block, such that the rows between the first and the last of them make about one chunk."""
    return max(1, chunk_rows // stride)


def running_moments(
    rows: DataFrame, origins: DataFrame, columns: Sequence[str], origin_block: int = ORIGIN_BLOCK
) -> DataFrame:
    """Training count, mean and population sd of each column per (series, origin_seq): a train-only scaler.

    ``rows`` hold ``series, k`` and the columns; ``origins`` hold ``series, origin_seq``.
    """
    per_k = rows.groupBy("series", F.col("k").alias("origin_seq")).agg(
        *[e for c in columns for e in (
            F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_q")
        )]
    ).withColumn("_asked", F.lit(False))
    asked = origins.select("series", "origin_seq").withColumn("_asked", F.lit(True))
    merged = per_k.unionByName(asked, allowMissingColumns=True).groupBy("series", "origin_seq").agg(
        F.max("_asked").alias("_asked"), *[F.sum(f"{c}{s}").alias(f"{c}{s}") for c in columns for s in ("_n", "_s", "_q")]
    ).withColumn("_block", F.floor(F.col("origin_seq") / origin_block))
    run = blocks.scan(
        merged, ["series"], "_block", ["origin_seq"],
        sums={f"{c}_r{s}": F.col(f"{c}_{s}") for c in columns for s in ("n", "s", "q")},
    ).filter("_asked")
    out = []
    for c in columns:
        mean = F.try_divide(f"{c}_rs", f"{c}_rn")
        var = F.try_divide(f"{c}_rq", f"{c}_rn") - mean * mean
        out += [F.col(f"{c}_rn").alias(f"{c}_n"), mean.alias(f"{c}_mean"), F.sqrt(F.when(var > 0, var).when(var.isNotNull(), F.lit(0.0))).alias(f"{c}_sd")]
    return run.select("series", "origin_seq", *out)


def apply_scaler(origin_features: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores of origin features under the statistics of their own fold (constant columns give 0)."""
    joined = origin_features.join(stats, ["series", "origin_seq"])
    return joined.withColumns(
        {
            f"{c}_z": F.when(F.col(f"{c}_sd") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).otherwise(
                F.when(F.col(c).isNotNull() & F.col(f"{c}_mean").isNotNull(), F.lit(0.0))
            )
            for c in columns
        }
    )


def fold_medians(
    rows: DataFrame,
    origins: DataFrame,
    columns: Sequence[str],
    splits: int = 16,
    levels: int | None = None,
    origin_block: int = ORIGIN_BLOCK,
) -> DataFrame:
    """Exact median of each column over each fold's training rows: ``series, origin_seq, <column>_median``.

    Equal values that enter at one fold become one entry with their number, so that a value carried forward over many rows costs one
    entry per fold. Medians are not summable, so the wanted order statistics are located by running counts over value
    ranges: each level cuts the ranges that still hold a wanted rank into ``splits`` parts and the border
    values themselves. A rank that falls on a border is answered there, so a value shared by many rows never
    has to be walked. Levels go on until no open range holds more than ``WALK_ROWS`` entries and asked ranks together, so that both are
    spread over tasks however many folds ask for the same range; what is left of a range is then counted in one place.
    ``levels`` sets their number instead.
    """
    columns = list(columns)
    # ``path`` numbers the value range; it starts as the column number, so all columns go through together.
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("path"), F.col(c).cast("double").alias("v"))
                      for i, c in enumerate(columns)])
    values = rows.select("series", F.col("k").cast("long").alias("k"), F.inline(cells)).filter("v IS NOT NULL")
    values = stage(values.groupBy("series", "path", "k", "v").agg(F.count("*").alias("c")), "fold-values")  # read at every level
    folds = origins.select("series", F.col("origin_seq").cast("long").alias("k")).distinct()
    wanted = folds.withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(columns) - 1).cast("long"))))
    seen = _running_count(
        values.groupBy("series", "path", "k").agg(F.sum("c").alias("c")), wanted, ["series", "path"], origin_block
    )
    asks = (
        seen.filter("cum > 0")
        .select("series", "path", "k", F.col("path").alias("column"),
                F.explode(F.array(F.floor((F.col("cum") - 1) / 2), F.floor(F.col("cum") / 2))).alias("rank"))
        .groupBy("series", "path", "k", "column", "rank").agg(F.count("*").alias("times"))
    )
    answers = []
    asks = stage(asks, "asked-ranks")
    while len(answers) < levels if levels is not None else _largest(values, asks) > WALK_ROWS:
        values, asks, answered = _narrow(values, asks, splits, origin_block)
        answers.append(answered)
    answers.append(
        blocks.fresh(values).groupBy("series", "path")
        .cogroup(blocks.fresh(asks).groupBy("series", "path"))
        .applyInPandas(_walk, "series string, k long, column long, v double, times long")
    )
    found = reduce(DataFrame.unionByName, answers)
    weight = lambda i, e: F.sum(F.when(F.col("column") == i, e))
    medians = found.groupBy("series", F.col("k").alias("origin_seq")).agg(
        *[
            (weight(i, F.col("v") * F.col("times")) / weight(i, F.col("times"))).alias(f"{c}_median")
            for i, c in enumerate(columns)
        ]
    )
    return folds.select("series", F.col("k").alias("origin_seq")).join(medians, ["series", "origin_seq"], "left")


def _largest(values: DataFrame, asks: DataFrame) -> int:
    """Most entries and asked ranks of one range; the driver gets this number."""
    keys = ["series", "path"]
    both = values.select(*keys).unionByName(asks.select(*keys))
    return both.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _running_count(counts: DataFrame, asked: DataFrame, keys: list[str], origin_block: int) -> DataFrame:
    """Running sum of ``c`` over ``k`` within ``keys``, reported at the asked (keys, k) only."""
    merged = (
        counts.select(*keys, "k", "c", F.lit(False).alias("asked"))
        .unionByName(asked.select(*keys, "k", F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")))
        .groupBy(*keys, "k").agg(F.sum("c").alias("c"), F.max("asked").alias("asked"))
        .withColumn("_block", F.floor(F.col("k") / origin_block))
    )
    return blocks.scan(merged, keys, "_block", ["k"], sums={"cum": F.col("c")}).filter("asked").select(*keys, "k", "cum")


def _narrow(values: DataFrame, asks: DataFrame, splits: int, origin_block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level: the rows and asked ranks that remain, and the ranks that fell on a border value.

    Ranges come in pairs: 2c holds the values between border c-1 and border c, 2c+1 those equal to border c.
    """
    keys = ["series", "path"]
    borders = stage(
        values.groupBy(*keys).agg(
            F.percentile_approx("v", [i / splits for i in range(1, splits)], splits * 8).alias("borders")
        ),
        "range-borders",
    )
    below = range_number(F.col("v"), F.col("borders"), splits)
    on_edge = F.coalesce(F.get("borders", F.col("_c")) == F.col("v"), F.lit(False)).cast("int")
    ranged = stage(
        values.join(borders, keys).withColumn("_c", below).select(
            *keys, "k", "v", "c", (F.col("_c") * 2 + on_edge).alias("r")
        ),
        "ranged-values",
    )
    # One row per fold index with a counter per range: all ranges share one running sum along k.
    names = [f"c{i}" for i in range(2 * splits)]
    counted = ranged.groupBy(*keys, "k").agg(*[F.sum(F.when(F.col("r") == i, F.col("c")).otherwise(0)).alias(n) for i, n in enumerate(names)])
    asked = asks.select(*keys, "k").distinct().withColumn("asked", F.lit(True))
    merged = (
        counted.unionByName(asked, allowMissingColumns=True)
        .groupBy(*keys, "k").agg(F.max("asked").alias("asked"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        .withColumn("_block", F.floor(F.col("k") / origin_block))
    )
    upto = blocks.scan(merged, keys, "_block", ["k"], sums={f"_{n}": F.col(n) for n in names}).filter("asked").select(
        *keys, "k", F.array(*[f"_{n}" for n in names]).alias("upto")
    )
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("cum"), zero.alias("lo"), F.lit(-1).alias("r"))

    def advance(acc, count):
        here = F.struct((acc["cum"] + count).alias("cum"), acc["cum"].alias("lo"), (acc["r"] + 1).alias("r"))
        return F.when(acc["cum"] <= F.col("rank"), here).otherwise(acc)

    placed = stage(
        asks.join(upto, [*keys, "k"])
        .withColumn("_at", F.aggregate("upto", start, advance))
        .select(*keys, "k", "column", F.col("_at.r").alias("r"), (F.col("rank") - F.col("_at.lo")).alias("rank"), "times"),
        "placed-ranks",
    )
    on_border = placed.filter("r % 2 = 1").join(borders, keys).select(
        "series", "k", "column", F.get("borders", F.floor(F.col("r") / 2).cast("int")).alias("v"), "times"
    )
    child = (F.col("path") * (2 * splits) + F.col("r")).alias("path")
    open_asks = placed.filter("r % 2 = 0").select("series", child, "k", "column", "rank", "times")
    open_values = ranged.filter("r % 2 = 0").select("series", child, "k", "v", "c").join(
        open_asks.select(*keys).distinct(), keys, "left_semi"
    )
    return open_values, open_asks, on_border


def _walk(values: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """Count the entries of one value range in order of ``k`` and read off the asked ranks on the way.

    Counts lie in a binary indexed tree over the sorted values, so an entry and a rank take a number of steps that grows with the
    logarithm of the range.
    """
    values = values.sort_values("k", kind="stable")
    sorted_values, place = np.unique(values["v"].to_numpy(), return_inverse=True)
    ks, places, counts = values["k"].to_numpy(), (place + 1).tolist(), values["c"].tolist()
    size = len(sorted_values)
    tree, top = [0] * (size + 1), 1 << max(0, size.bit_length() - 1)
    taken, out = 0, []
    for row in asks.sort_values("k", kind="stable").itertuples(index=False):
        stop = int(np.searchsorted(ks, row.k, side="right"))
        for at, count in zip(places[taken:stop], counts[taken:stop], strict=True):
            while at <= size:
                tree[at] += count
                at += at & -at
        taken = max(taken, stop)
        at, left, step = 0, row.rank, top
        while step:  # the last place whose running count does not exceed the rank
            if at + step <= size and tree[at + step] <= left:
                at += step
                left -= tree[at]
            step >>= 1
        out.append((row.series, row.k, row.column, float(sorted_values[at]), row.times))
    return pd.DataFrame(out, columns=["series", "k", "column", "v", "times"])


# --- expanding least squares -------------------------------------------------------------------------------

Predict = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list]


def solve_standardized(zz: np.ndarray, zt: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts (m) and slopes (p × m) from raw moments whose first column is the constant 1.

    Columns are standardized with the fold's own mean and sd, so the penalty acts on a common scale; columns
    that are constant in the fold get slope 0. Columns that depend on each other share their slopes (least norm); where no solution
    is found, or it is not finite, intercepts and slopes are NaN, which becomes NULL in the forecast.
    """
    n = zz[0, 0]
    mx, my = zz[0, 1:] / n, zt[0] / n
    cov = zz[1:, 1:] / n - np.outer(mx, mx)
    cross = zt[1:] / n - np.outer(mx, my)
    var = np.diag(cov)
    live = var > 1e-10 * np.maximum(1.0, mx * mx)
    slopes = np.zeros((len(mx), zt.shape[1]))
    if live.any():
        sd = np.sqrt(var[live])
        corr = cov[np.ix_(live, live)] / np.outer(sd, sd)
        corr[np.diag_indices_from(corr)] += ridge / n
        try:
            slopes[live] = np.linalg.lstsq(corr, cross[live] / sd[:, None], rcond=1e-12)[0] / sd[:, None]
        except np.linalg.LinAlgError:
            slopes[:] = np.nan
    if not np.isfinite(slopes).all():
        slopes[:] = np.nan
    return my - mx @ slopes, slopes


def expanding_fit(
    train: DataFrame,
    origins: DataFrame,
    width: int,
    targets: int,
    predict: Predict,
    chunk_rows: int,
    origin_block: int = ORIGIN_BLOCK,
) -> DataFrame:
    """Fit every fold from running moments and forecast at its origin.

    ``train``: ``series, pos, k, w, z array<double>[width], t array<double>[targets]``, where ``w`` is +1 for a
    row entering at fold ``k`` and -1 for one leaving; ``origins``: ``series, k, x array<double>, aux array<double>``.
    ``predict(ZZ, ZT, x, aux)`` returns one forecast list per arm. Result: ``series, origin_seq, preds``.

    Rows already visible at the first origin form a block of their own, cut by position, so that no task holds
    more than ``chunk_rows`` or the rows of ``origin_block`` folds.
    """
    size = width * width + width * targets
    block = F.when(F.col("k") == 0, F.lit(-1).cast("long")).otherwise(F.floor(F.col("k") / origin_block))
    rows = train.select(
        "series", block.alias("b"), F.floor(F.col("pos") / chunk_rows).alias("c"), F.col("k").cast("long").alias("k"),
        F.col("w").cast("double").alias("w"), "z", "t",
    )

    def moments(z: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        zw = z * w[:, None]
        return np.concatenate([(zw.T @ z).ravel(), (zw.T @ t).ravel()])

    def totals(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = moments(np.array(pdf["z"].tolist(), float), np.array(pdf["t"].tolist(), float), pdf["w"].to_numpy())
        return pd.DataFrame({"series": [key[0]], "b": [key[1]], "m": [m]})

    partial = rows.groupBy("series", "b", "c").applyInPandas(totals, "series string, b long, m array<double>")
    folds = origins.select("series", F.floor(F.col("k") / origin_block).alias("b")).distinct()
    zeros = folds.withColumn("m", F.array_repeat(F.lit(0.0), size))
    # Element-wise prefix over blocks, one short window per matrix element.
    before = Window.partitionBy("series", "i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        partial.unionByName(zeros)
        .select("series", "b", F.posexplode("m").alias("i", "v"))
        .groupBy("series", "b", "i").agg(F.sum("v").alias("v"))
        .select("series", "b", "i", F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("v"))
        .filter("b >= 0")
        .groupBy("series", "b").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m"))
        .select("series", "b", F.lit(-1).cast("long").alias("k"), F.col("m.v").alias("x"), F.array().cast("array<double>").alias("aux"))
    )
    asks = origins.select(
        "series", F.floor(F.col("k") / origin_block).alias("b"), F.col("k").cast("long").alias("k"), "x", "aux"
    ).unionByName(carry)

    def solve(key, ask: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        start = ask[ask["k"] < 0]
        acc = np.array(start["x"].iloc[0], float) if len(start) else np.zeros(size)
        fresh = fresh.sort_values(["k", "w", "c"], kind="stable")
        ks, w = fresh["k"].to_numpy(), fresh["w"].to_numpy()
        z = np.array(fresh["z"].tolist(), float).reshape(-1, width)
        t = np.array(fresh["t"].tolist(), float).reshape(-1, targets)
        done, out = 0, []
        for row in ask[ask["k"] >= 0].sort_values("k").itertuples(index=False):
            stop = int(np.searchsorted(ks, row.k, side="right"))
            if stop > done:
                acc = acc + moments(z[done:stop], t[done:stop], w[done:stop])
                done = stop
            zz, zt = acc[: width * width].reshape(width, width), acc[width * width:].reshape(width, targets)
            preds = predict(zz, zt, np.array(row.x, float), np.array(row.aux, float))
            out.append((key[0], row.k, [list(map(float, p)) for p in preds]))
        return pd.DataFrame(out, columns=["series", "origin_seq", "preds"])

    fits = (
        blocks.fresh(asks).groupBy("series", "b")
        .cogroup(blocks.fresh(rows.filter("b >= 0")).groupBy("series", "b"))
        .applyInPandas(solve, "series string, origin_seq long, preds array<array<double>>")
    )
    missing = lambda v: F.when(~F.isnan(v), v)
    return fits.withColumn("preds", F.transform("preds", lambda p: F.transform(p, missing)))
