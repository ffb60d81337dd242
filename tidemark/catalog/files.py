"""Registered queries of file sources and sinks: the given tables are written as files in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog.common import OBS, r, rounded, sql
from tidemark.session import stage, staging_dir
from tidemark.sources import delimited, sinks, tables

STAMP = "yyyy-MM-dd HH:mm:ss"


def _folder(spark, name: str) -> str:
    return f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _observed(spark, d) -> DataFrame:
    return stage(tables.hourly_observed(spark, d), "observed")


def _write(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def _drop_rows(o: DataFrame, shift: float) -> DataFrame:
    """Date, hour 0 to 23 and value as a long layout has them."""
    return o.select(
        F.col("series").alias("codest"), F.date_format("ts", "dd/MM/yyyy").alias("fecha"), F.hour("ts").alias("hora"),
        F.lit("PM10").alias("parametro"), (F.col("y") + shift).alias("valor"),
    )


def _drop_files(spark, d) -> str:
    """Three layouts that repeat keys: all hours, then wide days with every second hour, then every third hour with another column."""
    o, path = _observed(spark, d), _folder(spark, "drop")
    _write(_drop_rows(o, 0.0), f"{path}/1-long", ";")
    day = F.date_format("ts", "dd/MM/yyyy").alias("FECHA")
    even = o.filter((F.hour("ts") % 2 == 0) & (F.hour("ts") > 0)).withColumn("h", F.lpad(F.hour("ts").cast("string"), 2, "0"))
    wide = even.groupBy(F.col("series").alias("CODEST"), day).pivot("h", [f"{h:02d}" for h in range(1, 25)]).agg(F.max(F.col("y") + 1.0))
    _write(wide.select("CODEST", "FECHA", F.lit("pm10").alias("PARAMETRO"), *[F.col(f"{h:02d}").alias(f"H{h:02d}") for h in range(1, 25)]), f"{path}/2-wide", ",")
    _write(_drop_rows(o.filter(F.hour("ts") % 3 == 0), 2.0).withColumn("nota", F.lit("x")), f"{path}/3-comma", ",")
    return path


def drop_folder(spark, d):
    got = delimited.ingest_drop_folder(spark, _drop_files(spark, d)).filter("value IS NOT NULL")
    return rounded(got.select(F.col("timestamp").alias("ts"), "station", "variable", "value"))


def detected_layouts(spark, d):
    return delimited.layout_counts(spark, _drop_files(spark, d))


def drop_folder_files(spark, d):
    """Which layout the files of the folder have; one file has no values."""
    path = _drop_files(spark, d)
    _write(_observed(spark, d).groupBy("series").agg(F.max("ts").alias("fecha")).coalesce(1), f"{path}/4-other")
    found = delimited.drop_folder_files(spark, path)
    folder = F.regexp_extract("path", r"/(\d-\w+)/[^/]*$", 1)
    return found.select(folder.alias("folder"), "layout", F.col("problem").isNotNull().alias("skipped")).distinct()


def _station_folder(spark, d) -> str:
    """One file per station: every hour twice under one header, and one station under another."""
    o, path = _observed(spark, d), _folder(spark, "stations")
    stamp = F.date_format("ts", STAMP)
    for name in ("click", "error", "purchase", "signup"):
        own = o.filter(F.col("series") == name)
        rows = own.select(stamp.alias("Date and Time"), F.col("y").alias("PM10"), F.col("n_events").alias("temp"))
        again = own.select(stamp.alias("Date and Time"), (F.col("y") + 1.0).alias("PM10"), F.lit(None).cast("double").alias("temp"))
        _single(rows.unionByName(again), path, f"{name}_merged_NA.csv")
    other = o.filter(F.col("series") == "view").select(F.col("k_mean").alias("wdsp"), F.lit("x").alias("note"), F.date_format("ts", "dd/MM/yyyy HH:mm").alias("datetime"), F.col("y").alias("NO2"))
    _single(other, path, "view_finalised_merged_NA.csv")
    return path


def station_files(spark, d):
    """The first row of an hour counts."""
    got = delimited.ingest_stations(spark, _station_folder(spark, d))
    return rounded(got.select(F.col("timestamp").alias("ts"), "station", "PM10", "NO2", "temp", "wdsp", "O3"))


def station_columns(spark, d):
    return delimited.station_columns(spark, _station_folder(spark, d))


def _single(df: DataFrame, folder: str, name: str) -> None:
    """One file of the given name, as stations deliver theirs."""
    spark, part = df.sparkSession, f"{folder}-parts/{name}"
    _write(df.coalesce(1), part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    (written,) = [f.getPath() for f in system.listStatus(path(part)) if f.getPath().getName().startswith("part-")]
    system.mkdirs(path(folder))
    system.rename(written, path(f"{folder}/{name}"))


def load_series(spark, d):
    """Every hour twice, the later file with another value; some timestamps do not parse."""
    o, path = _observed(spark, d), _folder(spark, "series")
    stamp = F.when(F.hour("ts") == 5, F.lit("unknown")).otherwise(F.date_format("ts", STAMP))
    _write(o.select("series", stamp.alias("when"), F.lit("n/a").alias("PM10")), f"{path}/1", ";")
    _write(o.select("series", stamp.alias("when"), F.col("y").alias("PM10")), f"{path}/2", ";")
    got = delimited.load_panel(spark, path, "when", "PM10", "series")
    return rounded(got.select("series", "ts", "y"))


def covariate_file(spark, d):
    o = _observed(spark, d).groupBy("ts").agg(F.sum("n_events").alias("n_events"), F.avg("k_mean").alias("k_mean"))
    path = _folder(spark, "covariates")
    _write(o.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(-1.0).alias("n_events"), "k_mean"), f"{path}/1")
    _write(o.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "n_events", "k_mean"), f"{path}/2")
    return rounded(delimited.load_covariates(spark, path).select("ts", "n_events", "k_mean"))


def network_export(spark, d):
    """The last of the rows of a key is exported: here the one with the smallest value."""
    o, path = _observed(spark, d), _folder(spark, "network")
    rows = o.select(
        F.lit("city").alias("city"), F.col("series").alias("station_id"), F.lit("NO2").alias("component"), F.col("ts").alias("datetime"),
        F.inline(F.array(F.struct(F.lit(1).alias("at"), (F.col("y") + 5.0).alias("value")), F.struct(F.lit(2).alias("at"), F.col("y").alias("value")))),
    )
    sinks.export_network(rows, path, ["at"])
    back = spark.read.option("header", True).schema("datetime timestamp, value double, city string, station_id string, component string").csv(path)
    return rounded(back.select("city", "station_id", "component", F.col("datetime").alias("ts"), "value"))


def _long(spark, d) -> DataFrame:
    return _observed(spark, d).select(F.col("ts").alias("timestamp"), F.col("series").alias("station"), F.lit("PM10").alias("variable"), F.col("y").alias("value"))


def year_chunks(spark, d):
    path = _folder(spark, "years")
    sinks.write_year_chunks(_long(spark, d), path)
    return rounded(spark.read.parquet(path).groupBy("year", "station").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


def station_raw(spark, d):
    path = _folder(spark, "raw")
    sinks.write_station_raw(_long(spark, d), path)
    return rounded(spark.read.parquet(path).select("station", "variable", F.col("timestamp").alias("ts"), "value"))


def run_metadata(spark, d):
    o = _observed(spark, d)
    meta = sinks.write_run({"ledger": o, "latest": o.groupBy("series").agg(F.max("ts").alias("ts"))}, _folder(spark, "run"), "t0", "t1", {"stride": 24})
    return meta.select(F.col("table").alias("table_name"), F.col("rows").alias("n_rows"), "started", "finished", "config")


def shards_merged(spark, d):
    o, path = _observed(spark, d), _folder(spark, "shards")
    for i in range(3):
        o.filter(F.pmod(F.hour("ts"), F.lit(3)) == i).write.parquet(f"{path}/{i}")
    return rounded(sinks.read_shards(spark, [f"{path}/{i}" for i in range(3)], ["series", "ts"]).select("series", "ts", "y"))


def shards_ordered(spark, d):
    """The merged shards with the number of each row in the order in which they come."""
    o, path = _observed(spark, d), _folder(spark, "shards")
    for i in range(3):
        o.filter(F.pmod(F.hour("ts"), F.lit(3)) == i).write.parquet(f"{path}/{i}")
    merged = sinks.read_shards(spark, [f"{path}/{i}" for i in range(3)], ["series", "ts"])
    placed = stage(merged.select("series", "ts", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ordered")
    sizes = placed.groupBy("part").count()  # one row per partition
    before = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    return placed.join(before, "part").select((F.col("before") + F.col("at") + 1).alias("row"), "series", "ts")


def manifest_of_exports(spark, d):
    """Customers written as one text file per nation; size and digest of each file."""
    path = _folder(spark, "exports")
    lines = tables.read_table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    dealt = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    dealt.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    found = sinks.file_manifest(spark, path)
    return found.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation"), "size_bytes", "sha256")


QUERIES = {
    # A blank cell of a wide row is the last word on its hour, too.
    "drop_folder": (drop_folder, sql(OBS, """wide AS (
  SELECT DISTINCT series, date_trunc('day', ts) AS d FROM obs WHERE hour(ts) % 2 = 0 AND hour(ts) > 0)""", select=f"""SELECT ts, o.series AS station, 'PM10' AS variable,
  {r("CASE WHEN hour(ts) % 3 = 0 THEN y + 2 WHEN hour(ts) % 2 = 0 THEN y + 1 ELSE y END")} AS value
FROM obs o LEFT JOIN wide w ON w.series = o.series AND w.d = date_trunc('day', ts) WHERE w.d IS NULL OR hour(ts) % 2 = 0 OR hour(ts) % 3 = 0""")),
    "detected_layouts": (detected_layouts, sql(OBS, select="""SELECT ';' AS sep, 5 AS n_columns, count(*) AS n_rows FROM obs
UNION ALL SELECT ',', 27, count(DISTINCT (series, date_trunc('day', ts))) FROM obs WHERE hour(ts) % 2 = 0 AND hour(ts) > 0
UNION ALL SELECT ',', 6, count(*) FROM obs WHERE hour(ts) % 3 = 0""")),
    "drop_folder_files": (drop_folder_files, sql(OBS, select="""SELECT * FROM (VALUES ('1-long', 'long', false), ('2-wide', 'wide', false), ('3-comma', 'long', false), ('4-other', NULL, true))
  t(folder, layout, skipped) WHERE (SELECT count(*) FROM obs) > 0""")),
    "station_files": (station_files, sql(OBS, select=f"""SELECT ts, series AS station, CASE WHEN series <> 'view' THEN {r('y')} END AS "PM10", CASE WHEN series = 'view' THEN {r('y')} END AS "NO2",
  CASE WHEN series <> 'view' THEN {r('n_events')} END AS temp, CASE WHEN series = 'view' THEN {r('k_mean')} END AS wdsp, CAST(NULL AS DOUBLE) AS "O3" FROM obs""")),
    "station_columns": (station_columns, sql(OBS, select="""SELECT series || CASE WHEN series = 'view' THEN '_finalised_merged_NA.csv' ELSE '_merged_NA.csv' END AS file, series AS station,
  CASE WHEN series = 'view' THEN 4 ELSE 3 END AS n_columns, CASE WHEN series = 'view' THEN 'datetime' ELSE 'Date and Time' END AS date_column, series <> 'view' AS pm10_available, false AS pm25_available,
  CASE WHEN series = 'view' THEN 'wdsp' ELSE 'temp' END AS meteo_columns_available, CASE WHEN series = 'view' THEN 'NO2' ELSE '' END AS aux_pollutants_available FROM (SELECT DISTINCT series FROM obs)""")),
    "shards_ordered": (shards_ordered, sql(OBS, select="SELECT row_number() OVER (ORDER BY series, ts) AS row, series, ts FROM obs")),
    "manifest_of_exports": (manifest_of_exports, """WITH files AS (
  SELECT CAST(c_nationkey AS INTEGER) AS nation, string_agg(CAST(c_custkey AS VARCHAR) || ',' || c_name, chr(10) ORDER BY c_custkey) || chr(10) AS content FROM customer GROUP BY 1)
SELECT nation, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM files"""),
    "load_series": (load_series, sql(OBS, select=f"SELECT series, ts, {r('y')} AS y FROM obs WHERE hour(ts) <> 5")),
    "covariate_file": (covariate_file, sql(OBS, select=f"SELECT ts, {r('sum(n_events)')} AS n_events, {r('avg(k_mean)')} AS k_mean FROM obs GROUP BY ts")),
    "network_export": (network_export, sql(OBS, select=f"SELECT 'city' AS city, series AS station_id, 'NO2' AS component, ts, {r('y')} AS value FROM obs")),
    "year_chunks": (year_chunks, sql(OBS, select=f"SELECT CAST(year(ts) AS INTEGER) AS year, series AS station, count(*) AS n, {r('avg(y)')} AS mean_value FROM obs GROUP BY 1, 2")),
    "station_raw": (station_raw, sql(OBS, select=f"SELECT series AS station, 'PM10' AS variable, ts, {r('y')} AS value FROM obs")),
    "run_metadata": (run_metadata, sql(OBS, select="""SELECT t AS table_name, n AS n_rows, 't0' AS started, 't1' AS finished, '{"stride": 24}' AS config FROM (
  SELECT 'ledger' AS t, count(*) AS n FROM obs UNION ALL SELECT 'latest', count(DISTINCT series) FROM obs)""")),
    "shards_merged": (shards_merged, sql(OBS, select=f"SELECT series, ts, {r('y')} AS y FROM obs")),
}
