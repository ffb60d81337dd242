"""Bounded training samples, and model fitting in one task of a Spark job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

SPAN = float(1 << 32)


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 32)) / F.lit(SPAN)


def bounded(rows: DataFrame, key: str, by: str, rows_wanted: int, least: int) -> DataFrame:
    """About ``rows_wanted`` rows drawn by key, and about ``least`` of each value of ``by`` where there are so many.

    Only ids and labels are counted; the counts are written and joined, so that no text is shuffled.
    """
    counts = stage(rows.groupBy(by).agg(F.count("*").alias("__n")), "counts").withColumnRenamed(by, "__by")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    if not total:
        return rows.limit(0)
    rate = F.greatest(F.lit(rows_wanted / total), F.lit(float(least)) / F.col("__n"))
    return rows.join(counts, F.col(by) == F.col("__by")).filter(draw(F.col(key)) < rate).select(*rows.columns)


def fit(sample: DataFrame, order: str, learn: Callable[[list[tuple]], bytes]) -> bytes:
    """Run ``learn`` over the rows of a bounded sample in one task, in the order of the sampling hash; its result.

    No rows at all start no task; the result is then that of no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([learn(rows)], pa.binary())], names=["model"])

    one = stage(sample, "sample").repartition(1).sortWithinPartitions(draw(F.col(order)), order)
    row = one.mapInArrow(run, "model binary").first()
    return bytes(row[0]) if row else learn([])
