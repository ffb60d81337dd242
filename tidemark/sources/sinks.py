"""Partitioned outputs, run metadata and file manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import delimited, streams

from tidemark.operators.quality import dedup


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = (), fmt: str = "parquet") -> None:
    """One folder per key, rows sorted inside each file.

    Rows are brought together by a rebalance, not a plain repartition: small keys share tasks and a key that is far
    larger than the others is split over several tasks and files.
    """
    out = df.hint("rebalance", *by).sortWithinPartitions(*by, *sort)
    writer = out.write.mode("overwrite").partitionBy(*by).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def export_network(df: DataFrame, path: str, sequence: Sequence[str]) -> None:
    """CSV per (city, station_id, component): the last row per time key in the order of ``sequence``, in time order.

    ``sequence`` names the columns that tell the order of ingest; they are not written.
    """
    rows = dedup(df, ["city", "station_id", "component", "datetime"], list(sequence), "last").drop(*sequence)
    write_partitioned(rows, path, ["city", "station_id", "component"], ["datetime"], "csv")


def write_year_chunks(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_partitioned(df.withColumn("year", F.year("timestamp")), path, ["year"], ["station", "variable", "timestamp"], fmt)


def write_station_raw(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_partitioned(df, path, ["station"], ["variable", "timestamp"], fmt)


def write_run(
    tables: Mapping[str, DataFrame], path: str, started: str, finished: str | None = None, config: Mapping[str, object] | None = None
) -> DataFrame:
    """Write the tables of a run and return its metadata: one row per table with its row count, the run times and the settings.

    The settings are a snapshot as JSON. Tables written by series are brought together first, so that small series share files.

    Row counts are taken from the written files' footers, not by computing the tables again.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        by = ["series"] if name == "ledger" else []
        if by:
            write_partitioned(df, target, by)
        else:
            df.write.mode("overwrite").parquet(target)
        one = spark.read.parquet(target).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    snapshot = json.dumps(dict(config or {}), sort_keys=True, default=str)
    meta = rows.withColumns({"started": F.lit(started), "finished": F.lit(finished), "config": F.lit(snapshot)})
    meta.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_metadata")
    return spark.read.parquet(f"{path.rstrip('/')}/run_metadata")


def read_shards(spark: SparkSession, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """All shard outputs of one table in a single read, in key order."""
    return spark.read.parquet(*paths).orderBy(*keys)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file below ``path``.

    Tasks open the files and hash them piece by piece, so size does not matter; largest files are dealt out first. Files of a store that
    Python cannot open are loaded by Spark instead, each as one value of 2 GB at most.
    """
    files = delimited.list_files(spark, path)
    if streams.openable(files):
        # one file per Arrow batch at a time; dealt by path, so that files of any folder spread
        return files.repartition("path").sortWithinPartitions(F.desc("length")).mapInArrow(streams.digests, "path string, size_bytes long, sha256 string")
    loaded = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return loaded.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
