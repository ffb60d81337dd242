"""Exact linear-interpolation quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

#: Ranges that a group is cut into at a time, and different values up to which a range is sorted in one task.
SPLITS, MOST = 256, 1 << 17


def range_number(value: Column, borders: Column, splits: int) -> Column:
    """Number of the ``splits`` - 1 sorted borders below ``value``, by binary search (``splits`` a power of two)."""
    if splits & (splits - 1):
        raise ValueError("splits must be a power of two")
    halves = [splits >> i for i in range(1, splits.bit_length())]
    return F.aggregate(
        F.array(*[F.lit(h) for h in halves]),
        F.lit(0),
        lambda at, half: at + F.when(F.get(borders, at + half - 1) < value, half).otherwise(F.lit(0)),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], splits: int = SPLITS, most: int = MOST
) -> DataFrame:
    """One row per group with one column per requested probability, NULLs ignored.

    The built-in ``percentile`` keeps all distinct values of a group in one buffer. Here the values are counted first (ties
    collapse) and ``quantiles_of_counts`` locates the ranks.
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = stage(present.groupBy(*keys, "_v").agg(F.count("*").alias("_c")), "value-counts")
    return quantiles_of_counts(counts, keys, probs, splits, most)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float], splits: int = SPLITS, most: int = MOST) -> DataFrame:
    """The same from ``counts`` (``keys, _v, _c``: values, none NULL, and how often each occurs).

    As long as a group has more than ``most`` different values, it is cut into ``splits`` ranges at sketched borders, running
    totals of the ranges tell where the asked ranks lie, and only those ranges go on. What is sorted in one place is bounded so
    by ``most`` whatever the size of the group; the sketch only balances the ranges, the result is exact.
    """
    keys, group = list(keys), [*keys, "_path"]
    now = counts.select(*keys, F.lit(0).cast("long").alias("_path"), "_v", "_c")
    rank = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("_name"), part(rank(p)).cast("long").alias("_rank"), (rank(p) - F.floor(rank(p))).alias("_w"), F.lit(i).alias("_part"))
        for name, p in probs.items() for i, part in enumerate((F.floor, F.ceil))
    ])
    asks = now.groupBy(*group).agg(F.sum("_c").alias("_n")).select(*group, F.inline(wanted))
    while (now.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) > most:  # one number
        borders = now.groupBy(*group).agg(F.percentile_approx("_v", [i / splits for i in range(1, splits)], splits * 4).alias("_borders"))
        ranged = stage(now.join(borders, group).withColumn("_range", range_number(F.col("_v"), F.col("_borders"), splits)).drop("_borders"), "ranges")
        totals = ranged.groupBy(*group, "_range").agg(F.sum("_c").alias("_c"))
        until = F.sum("_c").over(Window.partitionBy(*group).orderBy("_range"))
        placed = asks.join(totals.withColumn("_until", until), group).filter(
            (F.col("_until") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_until"))
        )
        child = (F.col("_path") * splits + F.col("_range") + 1).alias("_path")
        asks = stage(placed.select(*keys, child, "_name", (F.col("_rank") - F.col("_until") + F.col("_c")).alias("_rank"), "_w", "_part"), "asked-ranks")
        now = stage(ranged.select(*keys, child, "_v", "_c").join(asks.select(*group).distinct(), group, "left_semi"), "open-ranges")
    until = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v"))
    found = asks.join(now.withColumn("_until", until), group).filter(
        (F.col("_until") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_until"))
    )
    at = lambda name, part: F.max(F.when((F.col("_name") == name) & (F.col("_part") == part), F.col("_v")))
    weight = lambda name: F.max(F.when(F.col("_name") == name, F.col("_w")))
    return found.groupBy(*keys).agg(*[(at(n, 0) + (at(n, 1) - at(n, 0)) * weight(n)).alias(n) for n in probs])
