"""Registered queries: lags, targets, origins, windows and per-fold training statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import (
    DAILY, DAILY_ORIGINS, DAILY_PANEL, HOURLY, HOURLY_SHORT, LAST_120, LAST_120_ORIGINS, OBS, PANEL, POS, daily_positioned, hourly,
    hourly_positioned, origins_sql, r, rounded, sql, staged_features,
)
from tidemark.operators import features as feat
from tidemark.operators import folds, forecasters, origins, panel, qa
from tidemark.session import stage
from tidemark.sources import tables

LAGS = (1, 2, 24)


def lags_ffill(spark, d):
    rows = feat.add_lags(hourly_positioned(spark, d), LAGS)
    return rounded(feat.add_calendar(rows, strict=True).drop("n_events", "k_mean"))


def lags_raw(spark, d):
    rows = feat.add_lags(hourly_positioned(spark, d), LAGS, fill=False)
    return rounded(rows.select("series", "ts", *feat.lag_names(LAGS)))


def complete_history(spark, d):
    rows = feat.add_lags(hourly_positioned(spark, d), LAGS, fill=False)
    return rounded(feat.drop_insufficient_history(rows, feat.lag_names(LAGS)).groupBy("series").agg(
        F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.sum("y_lag_24").alias("sum_lag_24")))


def train_imputation(spark, d):
    p = stage(hourly(spark, d).withColumn("y", F.when(F.col("ts") >= "2024-01-02 12:00:00", F.col("y"))), "panel")
    return rounded(panel.impute_train_only(p, tables.HOURLY, "2024-01-14 23:00:00").select("series", "ts", "y", "y_imputed"))


def direct_targets(spark, d):
    rows = feat.add_direct_targets(hourly_positioned(spark, d), 6)
    return rounded(rows.select("series", "ts", "y", *[f"y_t_plus_{h}" for h in range(1, 7)]))


def rolling_origins(spark, d):
    return origins.origins(hourly_positioned(spark, d), HOURLY)


FIRST_FIVE = origins.BacktestSpec(**{**HOURLY.__dict__, "max_origins": 5})


def first_origins(spark, d):
    return origins.origins(hourly_positioned(spark, d), FIRST_FIVE)


def daily_origins(spark, d):
    return origins.origins(daily_positioned(spark, d), DAILY)


def latest_daily_origins(spark, d):
    return origins.origins(daily_positioned(spark, d), LAST_120)


def train_window(spark, d):
    w = origins.train_window(hourly(spark, d), "2024-01-20 00:00:00", "2024-01-02 00:00:00")
    return rounded(w.select("series", "ts", "y"))


def test_window(spark, d):
    w = origins.test_window(hourly_positioned(spark, d), "2024-01-20 00:00:00", 25)
    return rounded(w.select("series", "ts", "y"))


def origin_features(spark, d):
    rows = staged_features(spark, d)
    cols = feat.condition_columns("lags_meteo", HOURLY.lags, HOURLY.covariates, rows.columns)
    return rounded(origins.origin_rows(rows, HOURLY).select("series", F.col("ts").alias("origin"), *cols))


def control_groups(spark, d):
    """Complete rows under each feature group: how many rows each condition could train on."""
    rows = feat.add_calendar(feat.add_lags(hourly_positioned(spark, d), LAGS, fill=False))
    counts = []
    for c in feat.CONTROL_GROUPS:
        cols = feat.condition_columns(c, LAGS, ("n_events",), rows.columns, extended=("k_mean", "absent"))
        known = F.lit(True)
        for name in cols:
            known = known & F.col(name).isNotNull()
        counts.append(F.struct(F.lit(c).alias("condition"), F.lit(len(cols)).alias("n_features"), F.count_if(known).alias("complete_rows")))
    return rows.groupBy("series").agg(*[x.alias(f"_{i}") for i, x in enumerate(counts)]).select(
        "series", F.inline(F.array(*[F.col(f"_{i}") for i in range(len(counts))])))


def sequences(spark, d):
    s = feat.sequences(hourly_positioned(spark, d), ["y", "n_events"], 12, 3)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(s.select("series", "ts", F.size("x").alias("n_steps"), F.element_at(F.element_at("x", 1), 1).alias("oldest"),
                            total(F.flatten("x")).alias("sum_x"), total(F.col("y_next")).alias("sum_y")))


def latest_sequence(spark, d):
    filled = hourly_positioned(spark, d).fillna(0.0, ["n_events"])
    s = feat.latest_sequence(filled, ["y_filled", "n_events"], 6)
    return rounded(s.select("series", "ts", F.posexplode("x").alias("step", "v")).select(
        "series", "ts", "step", F.element_at("v", 1).alias("y"), F.element_at("v", 2).alias("n_events")))


def fold_index(spark, d, spec=HOURLY_SHORT):
    rows = staged_features(spark, d, spec)
    f = forecasters.train_frame(rows, spec)
    return f.groupBy("series", "k").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def fold_medians(spark, d, spec=HOURLY_SHORT):
    rows = staged_features(spark, d, spec)
    frame = forecasters.train_frame(rows, spec)
    return rounded(folds.fold_medians(frame, origins.origin_rows(rows, spec), ["n_events", "k_mean"]))


def fold_scaler(spark, d, spec=HOURLY_SHORT):
    rows = staged_features(spark, d, spec)
    frame = forecasters.train_frame(rows, spec)
    return rounded(folds.running_moments(frame, origins.origin_rows(rows, spec), ["y_lag_1", "k_mean"]))


def scaled_origins(spark, d, spec=HOURLY_SHORT):
    rows = staged_features(spark, d, spec)
    frame, at = forecasters.train_frame(rows, spec), origins.origin_rows(rows, spec)
    z = folds.apply_scaler(at.select("series", "origin_seq", "ts", "y_lag_1", "k_mean"), folds.running_moments(frame, at, ["y_lag_1", "k_mean"]), ["y_lag_1", "k_mean"])
    return rounded(z.select("series", F.col("ts").alias("origin"), "y_lag_1_z", "k_mean_z"))


def imputed_features(spark, d, spec=HOURLY_SHORT):
    rows = staged_features(spark, d, spec)
    frame, at = forecasters.train_frame(rows, spec), origins.origin_rows(rows, spec)
    med = folds.fold_medians(frame, at, ["n_events", "k_mean"])
    both = at.join(med, ["series", "origin_seq"])
    return rounded(both.select("series", F.col("ts").alias("origin"), *[feat.impute_with(F.col(c), F.col(f"{c}_median")).alias(c) for c in ("n_events", "k_mean")]))


def leakage_check(spark, d):
    """Stamp every lag feature of every origin with the time of the row it came from."""
    rows = hourly_positioned(spark, d).withColumn("y_filled", F.unix_timestamp("ts").cast("double")).withColumn("y", F.col("y_filled"))
    lagged = feat.add_lags(rows, HOURLY.lags)
    at = origins.origin_rows(lagged, HOURLY)
    stamps = at.select("series", F.col("ts").alias("origin"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.timestamp_seconds(n).alias("feature_ts")) for n in feat.lag_names(HOURLY.lags)])))
    return qa.leakage_violations(stamps)


def planted_leakage(spark, d):
    """A feature of every known origin that is an hour old, of the origin itself, or of the hour after it, in turn."""
    at = origins.origin_rows(hourly_positioned(spark, d), HOURLY).filter("y IS NOT NULL")
    late = F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("origin_seq") % 3 - 1) * 3600)
    return qa.leakage_violations(at.select("series", F.col("ts").alias("origin"), F.lit("planted").alias("feature"), late.alias("feature_ts")))


def _lags(source: str) -> str:
    return ", ".join(f"lag({source}, {k}) OVER (PARTITION BY series ORDER BY ts) AS y_lag_{k}" for k in LAGS)


def _frame(spec) -> str:
    lags = ", ".join(f"lag(y_filled, {k}) OVER w AS y_lag_{k}" for k in spec.lags)
    return f"""feats AS (
  SELECT *, {lags}, count(y) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {spec.horizon} FOLLOWING) AS nf
  FROM pos WINDOW w AS (PARTITION BY series ORDER BY ts)),
frame AS (SELECT * FROM feats WHERE {" AND ".join(f"y_lag_{k} IS NOT NULL" for k in spec.lags)} AND nf = {spec.horizon})"""


def _fold_queries(spec, suffix: str) -> dict:
    """Fold statistics under one spec, each with the join of origins and history written out."""
    base = (OBS, PANEL, POS, origins_sql(spec), _frame(spec))
    prefix = f"JOIN frame f ON f.series = o.series AND f.pos <= o.origin_pos - {spec.horizon + 1}"
    run = lambda fn: lambda spark, d: fn(spark, d, spec)
    found = {
        "fold_index": (run(fold_index), sql(*base, f"first AS (SELECT f.series, f.pos, f.ts, min(o.origin_seq) AS k FROM origins o {prefix} GROUP BY ALL)",
            select="SELECT series, k, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM first GROUP BY series, k")),
        "fold_medians": (run(fold_medians), sql(*base, select=f"SELECT o.series, o.origin_seq, {r('median(f.n_events)')} AS n_events_median, {r('median(f.k_mean)')} AS k_mean_median FROM origins o LEFT {prefix} GROUP BY ALL")),
        "fold_scaler": (run(fold_scaler), sql(*base, select="SELECT o.series, o.origin_seq, " + ", ".join(
            f"count(f.{c}) AS {c}_n, {r(f'avg(f.{c})')} AS {c}_mean, {r(f'stddev_pop(f.{c})')} AS {c}_sd" for c in ("y_lag_1", "k_mean")) + f" FROM origins o LEFT {prefix} GROUP BY ALL")),
        "scaled_origins": (run(scaled_origins), sql(*base, f"st AS (SELECT o.series, o.origin, o.origin_pos, avg(f.y_lag_1) AS ma, stddev_pop(f.y_lag_1) AS sa, avg(f.k_mean) AS mb, stddev_pop(f.k_mean) AS sb FROM origins o LEFT {prefix} GROUP BY ALL)",
            select=f"SELECT s.series, s.origin, {r('(x.y_lag_1 - ma) / sa')} AS y_lag_1_z, {r('(x.k_mean - mb) / sb')} AS k_mean_z FROM st s JOIN feats x ON x.series = s.series AND x.pos = s.origin_pos")),
        "imputed_features": (run(imputed_features), sql(*base, f"st AS (SELECT o.series, o.origin, o.origin_pos, median(f.n_events) AS a, median(f.k_mean) AS b FROM origins o LEFT {prefix} GROUP BY ALL)",
            select=f"SELECT s.series, s.origin, {r('coalesce(p.n_events, a, 0.0)')} AS n_events, {r('coalesce(p.k_mean, b, 0.0)')} AS k_mean FROM st s JOIN pos p ON p.series = s.series AND p.pos = s.origin_pos")),
    }
    return {name + suffix: pair for name, pair in found.items()}


QUERIES = {
    "lags_ffill": (lags_ffill, sql(OBS, PANEL, POS, f"l AS (SELECT *, {_lags('y_filled')} FROM pos)", select=f"""SELECT series, ts, {r('y')} AS y, {r('y_filled')} AS y_filled, pos,
{', '.join(r(f'y_lag_{k}') + f' AS y_lag_{k}' for k in LAGS)}, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS julian_day FROM l""")),
    "lags_raw": (lags_raw, sql(OBS, PANEL, f"l AS (SELECT *, {_lags('y')} FROM panel)", select=f"SELECT series, ts, {', '.join(r(f'y_lag_{k}') + f' AS y_lag_{k}' for k in LAGS)} FROM l")),
    "complete_history": (complete_history, sql(OBS, PANEL, f"l AS (SELECT *, {_lags('y')} FROM panel)",
        select=f"SELECT series, count(*) AS rows, min(ts) AS first_ts, {r('sum(y_lag_24)')} AS sum_lag_24 FROM l WHERE y_lag_1 IS NOT NULL AND y_lag_2 IS NOT NULL AND y_lag_24 IS NOT NULL GROUP BY series")),
    "train_imputation": (train_imputation, sql(OBS, PANEL, "t AS (SELECT series, ts, CASE WHEN ts >= TIMESTAMP '2024-01-02 12:00:00' THEN y END AS y FROM panel WHERE ts <= TIMESTAMP '2024-01-14 23:00:00')",
        "f AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS yf FROM t)",
        "m AS (SELECT series, median(yf) AS med FROM f GROUP BY series)", select=f"SELECT series, ts, {r('y')} AS y, {r('coalesce(yf, med, 0.0)')} AS y_imputed FROM f JOIN m USING (series)")),
    "direct_targets": (direct_targets, sql(OBS, PANEL, "l AS (SELECT *, " + ", ".join(f"lead(y, {h}) OVER (PARTITION BY series ORDER BY ts) AS y_t_plus_{h}" for h in range(1, 7)) + " FROM panel)",
        select=f"SELECT series, ts, {r('y')} AS y, " + ", ".join(r(f"y_t_plus_{h}") + f" AS y_t_plus_{h}" for h in range(1, 7)) + " FROM l WHERE " + " AND ".join(f"y_t_plus_{h} IS NOT NULL" for h in range(1, 7)))),
    "rolling_origins": (rolling_origins, sql(OBS, PANEL, POS, origins_sql(), select="SELECT * FROM origins")),
    "first_origins": (first_origins, sql(OBS, PANEL, POS, origins_sql(FIRST_FIVE), select="SELECT * FROM origins")),
    "daily_origins": (daily_origins, sql(DAILY_PANEL, POS, DAILY_ORIGINS, select="SELECT * FROM origins")),
    "latest_daily_origins": (latest_daily_origins, sql(DAILY_PANEL, POS, LAST_120_ORIGINS, select="SELECT * FROM latest")),
    "train_window": (train_window, sql(OBS, PANEL, select=f"SELECT series, ts, {r('y')} AS y FROM panel WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'")),
    "test_window": (test_window, sql(OBS, PANEL, POS, select=f"SELECT p.series, p.ts, {r('p.y')} AS y FROM pos p JOIN pos o ON o.series = p.series AND o.ts = TIMESTAMP '2024-01-20' WHERE p.pos >= o.pos AND p.pos < o.pos + 25")),
    "origin_features": (origin_features, sql(OBS, PANEL, POS, origins_sql(), select="SELECT o.series, o.origin, " + ", ".join(
        f"{r(f'l{k}.y_filled')} AS y_lag_{k}" for k in HOURLY.lags) + f""", CAST(hour(o.origin) AS INTEGER) AS hour_of_day, CAST(isodow(o.origin) - 1 AS INTEGER) AS day_of_week,
CAST(month(o.origin) AS INTEGER) AS month, CAST(dayofyear(o.origin) AS INTEGER) AS julian_day, {r('p.n_events')} AS n_events, {r('p.k_mean')} AS k_mean
FROM origins o JOIN pos p ON p.series = o.series AND p.pos = o.origin_pos """ + " ".join(f"LEFT JOIN pos l{k} ON l{k}.series = o.series AND l{k}.pos = o.origin_pos - {k}" for k in HOURLY.lags))),
    "control_groups": (control_groups, sql(OBS, PANEL, f"l AS (SELECT *, {_lags('y')} FROM panel)",
        "c AS (SELECT *, y_lag_1 IS NOT NULL AND y_lag_2 IS NOT NULL AND y_lag_24 IS NOT NULL AS ok FROM l)", select="""SELECT series, 'C0' AS condition, 0 AS n_features, count(*) AS complete_rows FROM c GROUP BY series
UNION ALL SELECT series, 'C1', 7, count(*) FILTER (WHERE ok) FROM c GROUP BY series
UNION ALL SELECT series, 'C2', 8, count(*) FILTER (WHERE ok AND n_events IS NOT NULL) FROM c GROUP BY series
UNION ALL SELECT series, 'C3', 9, count(*) FILTER (WHERE ok AND n_events IS NOT NULL AND k_mean IS NOT NULL) FROM c GROUP BY series""")),
    "sequences": (sequences, sql(OBS, PANEL, """s AS (SELECT series, ts, count(CASE WHEN y IS NOT NULL AND n_events IS NOT NULL THEN 1 END) OVER a AS nx, lag(y, 11) OVER w AS oldest, sum(y + n_events) OVER a AS sx,
 count(y) OVER b AS ny, sum(y) OVER b AS sy FROM panel WINDOW w AS (PARTITION BY series ORDER BY ts), a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))""",
        select=f"SELECT series, ts, 12 AS n_steps, {r('oldest')} AS oldest, {r('sx')} AS sum_x, {r('sy')} AS sum_y FROM s WHERE nx = 12 AND ny = 3")),
    "latest_sequence": (latest_sequence, sql(OBS, PANEL, POS, select=f"""SELECT series, max(ts) OVER (PARTITION BY series) AS ts, CAST(row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS INTEGER) AS step,
{r('y_filled')} AS y, {r('coalesce(n_events, 0.0)')} AS n_events FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS b FROM pos) WHERE b <= 6""")),
    **_fold_queries(HOURLY_SHORT, ""),
    **_fold_queries(HOURLY, "_full"),
    "leakage_check": (leakage_check, sql(OBS, PANEL, POS, origins_sql(), f"used AS (SELECT o.origin, p.ts AS feature_ts FROM origins o CROSS JOIN (SELECT unnest({list(HOURLY.lags)}) AS lag) l LEFT JOIN pos p ON p.series = o.series AND p.pos = o.origin_pos - l.lag)",
        select="SELECT count(*) FILTER (WHERE feature_ts > origin) AS violations, count(*) AS checked FROM used")),
    "planted_leakage": (planted_leakage, sql(OBS, PANEL, POS, origins_sql(), "used AS (SELECT o.origin, o.origin + (o.origin_seq % 3 - 1) * INTERVAL 1 HOUR AS feature_ts FROM origins o JOIN pos p ON p.series = o.series AND p.pos = o.origin_pos WHERE p.y IS NOT NULL)",
        select="SELECT count(*) FILTER (WHERE feature_ts > origin) AS violations, count(*) AS checked FROM used")),
}
