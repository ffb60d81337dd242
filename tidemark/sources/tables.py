"""Panels derived from the event and order tables used in tests, benchmarks and registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.panel import PanelSpec, regular_grid
from tidemark.session import ship_package, stage, use_utc

HOURLY = PanelSpec(step_seconds=3600, covariates=("n_events", "k_mean"))
DAILY = PanelSpec(step_seconds=86400)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship_package(use_utc(spark)).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def hourly_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly mean of ``value`` per event type, with event count and mean of ``k`` as covariates."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return read_table(spark, folder, "events").groupBy(F.col("event_type").alias("series"), hour.alias("ts")).agg(
        F.avg("value").alias("y"), F.count("*").cast("double").alias("n_events"), F.avg(k).alias("k_mean")
    )


def hourly_panel(spark: SparkSession, folder: str, flag: str | None = None) -> DataFrame:
    """The observed hours on a regular grid over the whole network's span.

    The hourly aggregate is staged: span, series list and values all come from it, and the raw events, which are
    larger by orders of magnitude, are scanned once.
    """
    return regular_grid(stage(hourly_observed(spark, folder), "hourly"), HOURLY, span="network", flag=flag)


def daily_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Daily shipped quantity per return flag and line status."""
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))
    return read_table(spark, folder, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("series"), day.alias("ts")
    ).agg(F.sum("l_quantity").alias("y"))


def supplier_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Daily shipped quantity per supplier: its number of series grows with the table."""
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))
    return read_table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("series"), day.alias("ts")).agg(
        F.sum("l_quantity").alias("y")
    )


def daily_panel(spark: SparkSession, folder: str, flag: str | None = None) -> DataFrame:
    return regular_grid(stage(daily_observed(spark, folder), "daily"), DAILY, span="series", flag=flag)
