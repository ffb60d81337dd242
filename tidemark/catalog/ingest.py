"""Registered queries: sources, reshaping, filters, joins, deduplication and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import HOURLY_LEDGER, OBS, PANEL, DAILY_PANEL, baseline_ledger, hourly, r, rounded, sql
from tidemark.functions import scalars
from tidemark.operators import metrics, panel, quality
from tidemark.session import stage
from tidemark.sources import delimited, tables

COVARIATES = ("n_events", "k_mean")


def _orders(spark, d):
    o = tables.read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("y"), F.col("o_orderkey"),
    )


def _events(spark, d):
    return tables.read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _raw_hours(spark, d):
    """Event rows as raw hourly readings: repeated hours occur, and values below 1 stand for unreadable stamps."""
    e = _events(spark, d)
    return e.select(
        F.col("event_type").alias("series"), F.when(F.col("value") >= 1, F.date_trunc("hour", "ts")).alias("ts"),
        F.col("value").alias("y"),
    )


RAW_HOURS = """raw AS (
  SELECT event_type AS series, CASE WHEN value >= 1 THEN date_trunc('hour', ts) END AS ts, value AS y FROM events)"""
ORDERS = "o AS (SELECT o_orderpriority AS series, o_orderdate AS ts, o_totalprice AS y, o_orderkey FROM orders)"


# --- sources and reshaping ---------------------------------------------------------------------------------


def hourly_panel(spark, d):
    return rounded(hourly(spark, d))


def regular_grid(spark, d):
    return rounded(tables.daily_panel(spark, d, flag="is_missing"))


def wide_to_long(spark, d):
    p = hourly(spark, d)
    # Hour 24 of a day is midnight of the next one.
    end_of_day = F.when(F.hour("ts") == 0, F.lit(24)).otherwise(F.hour("ts"))
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    wide = (
        p.select(F.col("series").alias("ESTACION"), F.date_format(day, "dd/MM/yyyy").alias("Fecha"),
                 F.lpad(end_of_day.cast("string"), 2, "0").alias("_h"), "y")
        .groupBy("ESTACION", "Fecha").pivot("_h", [f"{h:02d}" for h in range(1, 25)]).agg(F.first("y"))
    )
    wide = wide.select("ESTACION", "Fecha", F.lit("mean value").alias("Parametro"), *[F.col(f"{h:02d}").alias(f"H{h:02d}") for h in range(1, 25)])
    return rounded(delimited.wide_days_to_long(wide))


def long_hours(spark, d):
    p = hourly(spark, d)
    hour = F.when(F.hour("ts") == 0, F.lit(24)).otherwise(F.hour("ts"))
    rows = p.select(
        F.col("series").alias("codest"), F.date_format(F.col("ts") - F.expr("INTERVAL 1 HOUR"), "dd/MM/yyyy").alias("Día de fecha"),
        F.year(F.col("ts") - F.expr("INTERVAL 1 HOUR")).cast("string").alias("AÑO"),
        F.month(F.col("ts") - F.expr("INTERVAL 1 HOUR")).cast("string").alias("Mes"),
        F.dayofmonth(F.col("ts") - F.expr("INTERVAL 1 HOUR")).cast("string").alias("Día"),
        hour.cast("string").alias("HORA"), F.col("y").cast("string").alias("Valor"),
    ).drop("Día de fecha")
    return rounded(delimited.long_hours_to_panel(rows))


def parsed_timestamps(spark, d):
    o = tables.read_table(spark, d, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    text = (
        F.when(F.col("o_orderpriority").startswith("1"), F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority").startswith("2"), F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderpriority").startswith("3"), F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderpriority").startswith("4"), F.date_format(day, "dd-MM-yyyy HH:mm"))
        .otherwise(F.lit("unknown"))
    )
    stamp = delimited.to_timestamp(text, delimited.TIMESTAMP_FORMATS + delimited.DAY_FIRST_FORMATS)
    price = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return o.select("o_orderkey", stamp.alias("ts"), delimited.to_number(price).alias("y"))


def parse_fallback(spark, d):
    o = tables.read_table(spark, d, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderpriority").startswith("1"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    few = F.when(F.col("o_totalprice") > 490000, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    many = delimited.parse_with_fallback(o.select("o_orderkey", text.alias("t"), few.alias("u")), "t", "many_failed")
    return delimited.parse_with_fallback(many, "u", "few_failed", tolerance=0.5).select("o_orderkey", "many_failed", "few_failed")


def network_rows(spark, d):
    e = _events(spark, d)
    raw = e.select(
        F.concat(F.lit(" New "), F.initcap("event_type"), F.lit(" ")).alias("Ciudad"),
        F.col("user_id").cast("string").alias("station"),
        F.when(F.col("value") > 50, F.lit("pm25")).when(F.col("value") > 10, F.lit(" Pm 10 ")).otherwise(F.lit("no2")).alias("Pollutant"),
        F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("value") < 1, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("concentration"),
    )
    out = delimited.standardize_network(raw)
    return rounded(out.groupBy("city", "station_id", "component").agg(
        F.count("*").alias("n"), F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen"),
        F.avg("value").alias("mean_value"),
    ))


def canonical_columns(spark, d):
    p = hourly(spark, d).withColumnsRenamed({"ts": "timestamp", "series": "station", "y": "PM10", "n_events": "rain", "k_mean": "temp"})
    return rounded(delimited.canonical_columns(p, ["timestamp", "station", *delimited.POLLUTANTS, *delimited.WEATHER]).withColumnRenamed("PM2.5", "PM2_5"))


def station_names(spark, d):
    s = tables.read_table(spark, d, "supplier")
    suffix = F.when(F.col("s_nationkey") < 8, F.lit("_finalised_merged_NA.csv")).when(
        F.col("s_nationkey") < 16, F.lit("_finalised merging_NA.csv")).otherwise(F.lit("_merged_NA.csv"))
    file = F.concat(F.lit("site_ "), F.col("s_suppkey").cast("string"), F.lit("__north"), suffix)
    code = F.concat(F.lit("data 30"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(" hourly.csv"))
    daily = F.concat(F.lit("PM25_Big_City_"), F.col("s_suppkey").cast("string"), F.lit("_daily.csv"))
    parts = delimited.daily_file_parts(daily)
    return s.select(
        "s_suppkey", delimited.station_from_file(file).alias("station"), delimited.station_code_from_file(code).alias("code"),
        parts["pollutant"].alias("pollutant"), parts["city"].alias("city"), parts["station_id"].alias("station_id"),
    )


def label_normalization(spark, d):
    e = _events(spark, d)
    label = F.when(F.col("value") > 50, F.lit(" pm25")).when(F.col("value") > 10, F.lit("Pm 10 ")).otherwise(F.lit("pm2.5"))
    return e.select(
        "event_id", scalars.normalize_pollutant(label).alias("pollutant"), scalars.safe_tag(label).alias("tag"),
        scalars.normalize_city(F.concat(F.lit(" San "), "event_type")).alias("city"),
        scalars.normalize_label(F.concat(F.lit(" ESTACIÓN "), F.upper("event_type"))).alias("header"),
    )


def allowed_pollutants(spark, d):
    e = _events(spark, d).withColumn("label", F.when(F.col("value") > 20, F.lit("pm25")).otherwise(F.lit(" PM 10")))
    return scalars.require_allowed(e, "label").groupBy("label").agg(F.count("*").alias("n"))


def condition_labels(spark, d):
    led = baseline_ledger(spark, d).withColumn("condition", F.when(F.col("model") == "persistence", F.col("condition")).otherwise(F.lit("lags_only")))
    kept = metrics.select_ledger(led, ["persistence", "seasonal_naive"], ["reference", "lag_only"], {"lags_only": "lag_only", "lags_meteo": "lag_plus_met"})
    return kept.groupBy("condition", "model").agg(F.count("*").alias("n"))


# --- filters -----------------------------------------------------------------------------------------------


def series_filter(spark, d):
    p = hourly(spark, d).withColumn("series", F.concat(F.lit(" "), "series", F.lit(" ")))
    return rounded(quality.select_series(p, ["click", "view"]).withColumn("series", F.trim("series")))


def split_periods(spark, d):
    train, test = panel.train_test_split(hourly(spark, d), "2024-01-01", "2024-01-14", "2024-01-15 00:00:00", "2024-01-30 23:00:00")
    tag = lambda x, n: x.groupBy("series").agg(F.count("*").alias("rows"), F.count("y").alias("known"), F.max("ts").alias("last_ts")).withColumn("part", F.lit(n))
    return tag(train, "train").unionByName(tag(test, "test"))


def excluded_interval(spark, d):
    kept, dropped = panel.exclude_interval(hourly(spark, d), "2024-01-10 00:00:00", "2024-01-12 23:00:00")
    return kept.groupBy("series").agg(F.count("*").alias("rows")).withColumn("n_excluded", dropped.scalar())


def excluded_series(spark, d):
    return quality.drop_series(hourly(spark, d), ["error"]).groupBy("series").agg(F.count("*").alias("rows"), F.count("y").alias("known"))


def quality_rules(spark, d):
    shifted = hourly(spark, d).withColumn("y", F.col("y") - 20)
    return rounded(quality.apply_value_rules(shifted, "y", {"click": 60.0}).select("series", "ts", "y"))


def quality_rule_counts(spark, d):
    return quality.value_rule_counts(hourly(spark, d).withColumn("y", F.col("y") - 20), "y", {"click": 60.0})


def covariate_join(spark, d):
    p = stage(hourly(spark, d), "panel")
    return rounded(quality.join_covariates(p.select("series", "ts", "y"), p.select("series", "ts", *COVARIATES).filter("k_mean > 40")))


# --- deduplication and audits ------------------------------------------------------------------------------

LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_LINE_DEDUP = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"""


def dedup_last(spark, d):
    return quality.dedup(tables.read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER, "last")


def dedup_first(spark, d):
    return quality.dedup(tables.read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER, "first")


def daily_mean(spark, d):
    return rounded(quality.hourly_to_daily(hourly(spark, d), "mean"))


def daily_max(spark, d):
    return rounded(quality.hourly_to_daily(hourly(spark, d), "max"))


def missingness(spark, d):
    return rounded(quality.missingness(hourly(spark, d), ["y", *COVARIATES]))


def numeric_profile(spark, d):
    return rounded(quality.numeric_profile(_orders(spark, d), ["y"]))


def panel_profile(spark, d):
    p = stage(hourly(spark, d), "panel")
    return rounded(quality.numeric_profile(p, ["y", *COVARIATES]))


def absent_columns(spark, d):
    p = stage(hourly(spark, d), "panel")
    return quality.with_absent_columns(quality.numeric_profile(p, ["y"]), ["y", "humidity"]).select("series", "column", "available")


_PROFILE = """quart AS (
  SELECT series, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT l.series, l."column", true AS available, (round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) * 100.0, 3) + 0.0) AS missing_pct,
  count(*) FILTER (WHERE value < 0) AS negative_count, count(*) FILTER (WHERE value = 0) AS zero_count,
  (round(min(value), 6) + 0.0) AS min, (round(quantile_cont(value, 0.5), 6) + 0.0) AS p50, (round(quantile_cont(value, 0.95), 6) + 0.0) AS p95,
  (round(quantile_cont(value, 0.99), 6) + 0.0) AS p99, (round(max(value), 6) + 0.0) AS max,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outlier_count
FROM long l JOIN quart q ON q.series = l.series AND q."column" = l."column" GROUP BY ALL"""


def series_inventory(spark, d):
    return rounded(quality.series_inventory(_raw_hours(spark, d)))


def audit_flags(spark, d):
    raw = _raw_hours(spark, d)
    profile = quality.numeric_profile(raw.withColumn("y", F.col("y") - 1), ["y"])
    return quality.audit_flags(quality.series_inventory(raw), profile, ["y"]).select("series", "rows", "audit_flags")


def time_index(spark, d):
    return quality.validate_time_index(_raw_hours(spark, d), tables.HOURLY)


def time_steps(spark, d):
    return quality.time_steps(tables.hourly_observed(spark, d), tables.HOURLY)


def station_usability(spark, d):
    p = stage(hourly(spark, d), "panel")
    return rounded(quality.station_usability(p, COVARIATES, tables.HOURLY, joint_rows=600))


def completeness_months(spark, d):
    done = quality.annual_completeness(_orders(spark, d), strict_years=range(1995, 2001), relaxed={2001: [9, 10, 11, 12]})
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return done.select(
        "series", "year", text("months_found").alias("months_found"), text("months_missing").alias("months_missing"),
        "complete", "partial_year_allowed", "error",
    )


def completeness_reasons(spark, d):
    """One strict year, one whose last months are excluded, one whose first month is excluded but present, and years without a policy."""
    done = quality.annual_completeness(_orders(spark, d), strict_years=[1995], relaxed={2001: [9, 10, 11, 12], 1996: [1]})
    return done.select("series", "year", "complete", "partial_year_allowed", "reason")


def target_description(spark, d):
    return rounded(quality.describe_target(_orders(spark, d)))


def lag1_autocorr(spark, d):
    p = stage(hourly(spark, d).filter("ts <= '2024-01-14 23:00:00'"), "panel")
    return rounded(quality.lag1_autocorrelation(p, tables.HOURLY))


def setup_report(spark, d):
    raw = stage(hourly(spark, d).withColumn("y", F.col("y") - 20), "panel")
    kept = quality.drop_series(quality.apply_value_rules(raw, "y", {"click": 60.0}), ["error"])
    return rounded(quality.setup_report(kept, raw, {"click": 60.0}, ["error"]))


def sort_by_missing(spark, d):
    p = hourly(spark, d)
    share = p.groupBy("series").agg((F.avg(F.col("y").isNull().cast("int")) * 100.0).alias("pct_missing"))
    return rounded(share.orderBy(F.desc("pct_missing"), "series"))


QUERIES = {
    "hourly_panel": (hourly_panel, sql(OBS, PANEL, select=f"SELECT series, ts, {r('y')} AS y, {r('n_events')} AS n_events, {r('k_mean')} AS k_mean FROM panel")),
    "regular_grid": (regular_grid, sql(DAILY_PANEL, select=f"SELECT series, ts, {r('y')} AS y, CAST(y IS NULL AS INTEGER) AS is_missing FROM panel")),
    "wide_to_long": (wide_to_long, sql(OBS, PANEL, """d AS (SELECT DISTINCT series, date_trunc('day', ts - INTERVAL 1 HOUR) AS d FROM panel)""",
        select=f"""SELECT d.series AS station, 'MEAN VALUE' AS variable, CAST(d.d AS TIMESTAMP) + h * INTERVAL 1 HOUR AS timestamp, {r('p.y')} AS value
FROM d CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h) g LEFT JOIN panel p ON p.series = d.series AND p.ts = CAST(d.d AS TIMESTAMP) + h * INTERVAL 1 HOUR""")),
    "long_hours_to_panel": (long_hours, sql(OBS, PANEL, select=f"SELECT series AS station, 'UNKNOWN' AS variable, ts AS timestamp, {r('y')} AS value FROM panel")),
    "parsed_timestamps": (parsed_timestamps, """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderdate END AS ts,
CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS y FROM orders"""),
    "parse_fallback": (parse_fallback, """SELECT o_orderkey, o_orderdate AS many_failed,
CASE WHEN o_totalprice > 490000 THEN NULL ELSE o_orderdate END AS few_failed FROM orders"""),
    "network_rows": (network_rows, f"""SELECT 'New_' || upper(event_type[1]) || event_type[2:] AS city, CAST(user_id AS VARCHAR) AS station_id,
CASE WHEN value > 50 THEN 'PM2.5' WHEN value > 10 THEN 'PM10' ELSE 'NO2' END AS component, count(*) AS n,
min(date_trunc('second', ts)) AS first_seen, max(date_trunc('second', ts)) AS last_seen, {r('avg(value)')} AS mean_value
FROM events WHERE value >= 1 GROUP BY 1, 2, 3"""),
    "canonical_columns": (canonical_columns, sql(OBS, PANEL, select="SELECT ts AS timestamp, series AS station, " + r("y") + " AS \"PM10\", " +
        ", ".join(f"CAST(NULL AS DOUBLE) AS \"{c}\"" for c in ("PM2_5", "NO2", "O3", "SO2", "CO")) + f", {r('n_events')} AS rain, {r('k_mean')} AS temp, " +
        ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("wetb", "dewpt", "vappr", "rhum", "msl", "wdsp", "wddir")) + " FROM panel")),
    "station_names": (station_names, """SELECT s_suppkey, 'site ' || s_suppkey || ' north' AS station, '30' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code,
'PM2.5' AS pollutant, 'Big_City' AS city, CAST(s_suppkey AS VARCHAR) AS station_id FROM supplier"""),
    "label_normalization": (label_normalization, """SELECT event_id, CASE WHEN value > 50 THEN 'PM2.5' WHEN value > 10 THEN 'PM10' ELSE 'PM2.5' END AS pollutant,
CASE WHEN value > 50 THEN 'PM25' WHEN value > 10 THEN 'PM10' ELSE 'PM25' END AS tag, 'San_' || event_type AS city, 'estacion ' || event_type AS header FROM events"""),
    "allowed_pollutants": (allowed_pollutants, "SELECT CASE WHEN value > 20 THEN 'PM2.5' ELSE 'PM10' END AS label, count(*) AS n FROM events GROUP BY 1"),
    "condition_labels": (condition_labels, sql(*HOURLY_LEDGER, select="""SELECT CASE WHEN model = 'persistence' THEN 'reference' ELSE 'lag_only' END AS condition, model, count(*) AS n FROM ledger GROUP BY 1, 2""")),
    "series_filter": (series_filter, sql(OBS, PANEL, select=f"SELECT series, ts, {r('y')} AS y, {r('n_events')} AS n_events, {r('k_mean')} AS k_mean FROM panel WHERE series IN ('click', 'view')")),
    "split_periods": (split_periods, sql(OBS, PANEL, select="""SELECT series, count(*) AS rows, count(y) AS known, max(ts) AS last_ts, 'train' AS part FROM panel
WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-14' GROUP BY series UNION ALL
SELECT series, count(*), count(y), max(ts), 'test' FROM panel WHERE ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-30 23:00:00' GROUP BY series""")),
    "excluded_interval": (excluded_interval, sql(OBS, PANEL, select="""SELECT series, count(*) FILTER (WHERE NOT inside) AS rows,
(SELECT count(*) FROM panel WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:00:00') AS n_excluded
FROM (SELECT *, ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:00:00' AS inside FROM panel) GROUP BY series""")),
    "excluded_series": (excluded_series, sql(OBS, PANEL, select="SELECT series, count(*) AS rows, count(y) AS known FROM panel WHERE series <> 'error' GROUP BY series")),
    "quality_rules": (quality_rules, sql(OBS, PANEL, select=f"SELECT series, ts, {r('CASE WHEN y - 20 < 0 OR (series = $$click$$ AND y - 20 > 60) THEN NULL ELSE y - 20 END')} AS y FROM panel")),
    "quality_rule_counts": (quality_rule_counts, sql(OBS, PANEL, select="""SELECT series, count(*) FILTER (WHERE y - 20 < 0) AS n_negative,
count(*) FILTER (WHERE series = 'click' AND y - 20 > 60) AS n_above_cap FROM panel GROUP BY series""")),
    "covariate_join": (covariate_join, sql(OBS, PANEL, select=f"""SELECT p.series, p.ts, {r('p.y')} AS y, {r('c.n_events')} AS n_events, {r('c.k_mean')} AS k_mean
FROM panel p LEFT JOIN (SELECT * FROM panel WHERE k_mean > 40) c ON c.series = p.series AND c.ts = p.ts""")),
    "dedup_last": (dedup_last, _LINE_DEDUP.format(order=", ".join(f"{c} DESC" for c in LINE_ORDER))),
    "dedup_first": (dedup_first, _LINE_DEDUP.format(order=", ".join(LINE_ORDER))),
    "daily_mean": (daily_mean, sql(OBS, PANEL, select=f"SELECT series, CAST(ts AS DATE) AS date, {r('avg(y)')} AS value FROM panel GROUP BY 1, 2 HAVING count(y) > 0")),
    "daily_max": (daily_max, sql(OBS, PANEL, select=f"SELECT series, CAST(ts AS DATE) AS date, {r('max(y)')} AS value FROM panel GROUP BY 1, 2 HAVING count(y) > 0")),
    "missingness": (missingness, sql(OBS, PANEL, select=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS pct_missing FROM panel" for c in ("y", *COVARIATES)))),
    "numeric_profile": (numeric_profile, sql("long AS (SELECT o_orderpriority AS series, 'y' AS \"column\", o_totalprice AS value FROM orders)", _PROFILE.split("\nSELECT", 1)[0], select="SELECT" + _PROFILE.split("\nSELECT", 1)[1])),
    "panel_profile": (panel_profile, sql(OBS, PANEL, "long AS (" + " UNION ALL ".join(f"SELECT series, '{c}' AS \"column\", {c} AS value FROM panel" for c in ("y", *COVARIATES)) + ")",
        _PROFILE.split("\nSELECT", 1)[0], select="SELECT" + _PROFILE.split("\nSELECT", 1)[1])),
    "absent_columns": (absent_columns, "SELECT DISTINCT event_type AS series, c AS \"column\", c = 'y' AS available FROM events CROSS JOIN (VALUES ('y'), ('humidity')) v(c)"),
    "series_inventory": (series_inventory, sql(RAW_HOURS, "g AS (SELECT series, ts, count(*) AS c FROM raw GROUP BY ALL)", select="""SELECT series, CAST(sum(c) AS BIGINT) AS rows, min(ts) AS start, max(ts) AS "end",
CAST(coalesce(sum(c) FILTER (WHERE ts IS NULL), 0) AS BIGINT) AS datetime_parse_failures, CAST(sum(c - 1) AS BIGINT) AS duplicate_timestamps,
date_diff('hour', min(ts), max(ts)) + 1 AS expected_hourly_rows,
(round(sum(c) / (date_diff('hour', min(ts), max(ts)) + 1) * 100.0, 3) + 0.0) AS hourly_coverage_pct FROM g GROUP BY series""")),
    "audit_flags": (audit_flags, sql(RAW_HOURS, select="""SELECT series, count(*) AS rows, CASE WHEN len(f) = 0 THEN 'OK' ELSE array_to_string(f, ';') END AS audit_flags FROM (
SELECT series, list_filter([CASE WHEN count(*) > count(ts) THEN 'datetime_parse_failures' END,
 CASE WHEN count(*) > count(DISTINCT ts) + 1 THEN 'duplicate_timestamps' END, CASE WHEN count(*) FILTER (WHERE y - 1 < 0) > 0 THEN 'y_negative_values' END,
 CASE WHEN max(y - 1) > 500 THEN 'y_max_gt_500' END], lambda x: x IS NOT NULL) AS f FROM raw GROUP BY series) JOIN raw USING (series) GROUP BY series, f""")),
    "time_index": (time_index, sql(RAW_HOURS, "k AS (SELECT series, ts, count(*) AS c FROM raw WHERE ts IS NOT NULL GROUP BY ALL)",
        "st AS (SELECT series, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS s FROM k)",
        "fr AS (SELECT series, s, count(*) AS c FROM st WHERE s IS NOT NULL GROUP BY ALL)",
        "dom AS (SELECT series, count(*) AS distinct_steps, arg_max(s, c * 100000000 - s) AS dominant_step FROM fr GROUP BY series)",
        "rep AS (SELECT series, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM k GROUP BY series)",
        select="SELECT *, distinct_steps = 1 AND dominant_step = 3600 AND duplicates = 0 AS is_regular FROM rep JOIN dom USING (series)")),
    "time_steps": (time_steps, sql(OBS, select="SELECT series, ts, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS step_seconds FROM obs")),
    "station_usability": (station_usability, sql(OBS, PANEL,
        "m AS (SELECT series, median(s) AS med FROM (SELECT series, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS s FROM panel) GROUP BY series)",
        "a AS (SELECT series, count(*) AS rows, count(*) FILTER (WHERE y IS NOT NULL AND n_events IS NOT NULL AND k_mean IS NOT NULL) AS joint_rows, count(y) / count(*) AS ys, least(count(n_events), count(k_mean)) / count(*) AS cs, min(ts) AS lo, max(ts) AS hi FROM panel GROUP BY series)",
        select=f"""SELECT series, ys > 0 AS target_available, cs > 0 AS covariates_available, strftime(lo, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(hi, '%Y-%m-%d %H:%M:%S') AS joint_period,
rows, joint_rows, {r('ys')} AS y_share, {r('cs')} AS min_covariate_share, ys >= 0.95 AND cs >= 0.95 AND joint_rows >= 600 AND med = 3600 AS usable FROM a JOIN m USING (series)""")),
    "completeness_months": (completeness_months, sql(ORDERS, "f AS (SELECT series, CAST(year(ts) AS INTEGER) AS year, list_sort(list(DISTINCT CAST(month(ts) AS INTEGER))) AS mf FROM o GROUP BY 1, 2)",
        "g AS (SELECT *, CASE WHEN year = 2001 THEN [9, 10, 11, 12] ELSE [] END AS ex FROM f)",
        "h AS (SELECT *, list_filter(range(1, 13), lambda x: NOT list_contains(mf, CAST(x AS INTEGER))) AS ab, list_filter(range(1, 13), lambda x: NOT list_contains(mf, CAST(x AS INTEGER)) AND NOT list_contains(ex, CAST(x AS INTEGER))) AS mr FROM g)",
        select="""SELECT series, year, array_to_string(mf, ',') AS months_found, array_to_string(ab, ',') AS months_missing,
len(mr) = 0 AND len(list_intersect(mf, ex)) = 0 AS complete, year = 2001 AS partial_year_allowed,
CASE WHEN len(mr) > 0 THEN 'year=' || year || ': missing months ' || array_to_string(mr, ',') END AS error FROM h""")),
    "completeness_reasons": (completeness_reasons, sql(ORDERS, "f AS (SELECT series, CAST(year(ts) AS INTEGER) AS year, list_sort(list(DISTINCT CAST(month(ts) AS INTEGER))) AS mf FROM o GROUP BY 1, 2)",
        "g AS (SELECT *, CASE year WHEN 2001 THEN [9, 10, 11, 12] WHEN 1996 THEN [1] ELSE [] END AS ex FROM f)",
        "h AS (SELECT *, list_filter(range(1, 13), lambda x: NOT list_contains(mf, CAST(x AS INTEGER)) AND NOT list_contains(ex, CAST(x AS INTEGER))) AS mr, list_sort(list_intersect(mf, ex)) AS pr FROM g)",
        select="""SELECT series, year, year NOT IN (1995, 1996, 2001) OR (len(mr) = 0 AND len(pr) = 0) AS complete, year <> 1995 AS partial_year_allowed,
CASE WHEN year = 1995 THEN '' WHEN year IN (1996, 2001) THEN 'excluded by design: months ' || array_to_string(ex, ',') || CASE WHEN len(pr) > 0 THEN '; present all the same: ' || array_to_string(pr, ',') ELSE '' END
  ELSE 'year=' || year || ': no policy, included as it is' END AS reason FROM h""")),
    "target_description": (target_description, sql(ORDERS, select=f"SELECT series, count(y) AS n, {r('avg(y)')} AS mean, {r('stddev_samp(y)')} AS sd, {r('quantile_cont(y, 0.95)')} AS p95 FROM o GROUP BY series")),
    "lag1_autocorr": (lag1_autocorr, sql(OBS, PANEL, "k AS (SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY ts) AS p FROM panel WHERE y IS NOT NULL AND ts <= TIMESTAMP '2024-01-14 23:00:00')",
        select=f"SELECT series, count(y) AS n, {r('corr(y, p)')} AS rho1 FROM k GROUP BY series")),
    "setup_report": (setup_report, sql(OBS, PANEL, "q AS (SELECT series, ts, y - 20 AS y, y - 20 < 0 AS neg, coalesce(series = 'click' AND y - 20 > 60, false) AS cap FROM panel)",
        select=f"""SELECT series, count(*) FILTER (WHERE neg) AS n_negative, count(*) FILTER (WHERE cap) AS n_above_cap,
count(*) FILTER (WHERE series <> 'error') AS rows_included, min(ts) FILTER (WHERE series <> 'error') AS start, max(ts) FILTER (WHERE series <> 'error') AS "end",
CASE WHEN series <> 'error' THEN {r('avg(CASE WHEN y IS NULL OR neg OR cap THEN 1 ELSE 0 END) * 100.0')} END AS missing_pct,
CASE WHEN series = 'error' THEN 'excluded' ELSE 'included' END AS status FROM q GROUP BY series""")),
    "missing_by_series": (sort_by_missing, sql(OBS, PANEL, select=f"SELECT series, {r('avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END) * 100.0')} AS pct_missing FROM panel GROUP BY series")),
}
