"""Shared pieces of the registered queries: settings, panels, and the same steps as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.origins import BacktestSpec
from tidemark.operators.panel import with_positions
from tidemark.plans import backtest
from tidemark.session import stage
from tidemark.sources import tables

HOURLY = BacktestSpec(
    horizon=24, stride=24, convention="A", test_start="2024-01-15 00:00:00", test_end="2024-01-30 23:00:00",
    min_train_rows=240, lags=(1, 2, 3, 6, 12, 24, 48), covariates=("n_events", "k_mean"), season=24,
)
# Short lags and horizon, so that enough complete training rows exist on sparse panels.
HOURLY_SHORT = BacktestSpec(
    horizon=6, stride=24, convention="A", test_start="2024-01-15 00:00:00", test_end="2024-01-30 23:00:00",
    min_train_rows=120, lags=(1, 2, 3), covariates=("n_events", "k_mean"), season=24,
)
DAILY = BacktestSpec(
    horizon=7, stride=7, convention="C", min_train_rows=365, lags=(1, 2, 3, 7, 14, 21, 28), season=7,
)
LAST_120 = BacktestSpec(**{**DAILY.__dict__, "max_origins": 120})  # only where the latest origins are the feature
NUDGE = 2.5e-8
DM_HORIZONS = (1, 6, 12, 24)

def arm(model: str) -> Column:
    return F.col("model") == model


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles for comparison by value: no -0.0, and a nudge so that decimal ties round alike."""
    return df.select(
        *[(F.round(F.col(f"`{c}`") + F.lit(NUDGE), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return tables.hourly_panel(spark, folder)


def hourly_positioned(spark: SparkSession, folder: str) -> DataFrame:
    return with_positions(stage(hourly(spark, folder), "panel"), tables.HOURLY)


def daily_positioned(spark: SparkSession, folder: str) -> DataFrame:
    return with_positions(stage(tables.daily_panel(spark, folder), "panel"), tables.DAILY)


def features(spark: SparkSession, folder: str, spec: BacktestSpec = HOURLY, recent: int = 0) -> DataFrame:
    panel, cadence = (tables.daily_panel, tables.DAILY) if spec.convention == "C" else (tables.hourly_panel, tables.HOURLY)
    return backtest.prepare(panel(spark, folder), cadence, spec, recent)


def staged_features(spark: SparkSession, folder: str, spec: BacktestSpec = HOURLY, recent: int = 0) -> DataFrame:
    panel, cadence = (tables.daily_panel, tables.DAILY) if spec.convention == "C" else (tables.hourly_panel, tables.HOURLY)
    return stage(backtest.prepare(panel(spark, folder), cadence, spec, recent, slim=True), "features")


def baseline_ledger(spark: SparkSession, folder: str, spec: BacktestSpec = HOURLY) -> DataFrame:
    return backtest.baseline_ledger(features(spark, folder, spec), spec)


def staged_ledger(spark: SparkSession, folder: str, spec: BacktestSpec = HOURLY) -> DataFrame:
    return stage(baseline_ledger(spark, folder, spec), "ledger")


# --- the same steps as SQL ---------------------------------------------------------------------------------


def r(expr: str, places: int = 6) -> str:
    return f"(round({expr} + {NUDGE}, {places}) + 0.0)"


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


OBS = """obs AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS y, CAST(count(*) AS DOUBLE) AS n_events,
         avg(TRY_CAST(regexp_extract(props, '"k": *([-0-9.]+)', 1) AS DOUBLE)) AS k_mean
  FROM events GROUP BY 1, 2)"""
PANEL = """hours AS (
  SELECT unnest(generate_series((SELECT min(ts) FROM obs), (SELECT max(ts) FROM obs), INTERVAL 1 HOUR)) AS ts),
panel AS (
  SELECT s.series, h.ts, o.y, o.n_events, o.k_mean
  FROM (SELECT DISTINCT series FROM obs) s CROSS JOIN hours h LEFT JOIN obs o ON o.series = s.series AND o.ts = h.ts)"""
DAILY_PANEL = """dobs AS (
  SELECT l_returnflag || l_linestatus AS series, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, sum(l_quantity) AS y
  FROM lineitem GROUP BY 1, 2),
days AS (
  SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM dobs GROUP BY series),
panel AS (
  SELECT d.series, d.ts, o.y FROM days d LEFT JOIN dobs o ON o.series = d.series AND o.ts = d.ts)"""
POS = """pos AS (
  SELECT *, row_number() OVER w - 1 AS pos,
         last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y_filled
  FROM panel WINDOW w AS (PARTITION BY series ORDER BY ts))"""


def origins_sql(spec: BacktestSpec = HOURLY) -> str:
    """``bounds`` and ``origins`` of conventions A and B."""
    cap = "" if spec.max_origins is None else f" AND (p.pos - b.p0) // {spec.stride} < {spec.max_origins}"
    return f"""bounds AS (
  SELECT series, min(pos) FILTER (WHERE ts >= TIMESTAMP '{spec.test_start}') AS p0, max(pos) AS last_pos FROM pos GROUP BY series),
origins AS (
  SELECT p.series, p.ts AS origin, p.pos AS origin_pos, (p.pos - b.p0) // {spec.stride} AS origin_seq
  FROM pos p JOIN bounds b USING (series)
  WHERE p.ts BETWEEN TIMESTAMP '{spec.test_start}' AND TIMESTAMP '{spec.test_end}'
    AND p.pos + {spec.rows_needed - 1} <= b.last_pos AND (p.pos - b.p0) % {spec.stride} = 0
    AND p.pos >= {spec.min_train_rows}{cap})"""


DAILY_ORIGINS = """bounds AS (SELECT series, max(pos) AS last_pos FROM pos GROUP BY series),
found AS (
  SELECT p.series, p.ts AS origin, p.pos AS origin_pos, (p.pos - 364) // 7 AS origin_seq,
         row_number() OVER (PARTITION BY p.series ORDER BY p.pos DESC) AS rn
  FROM pos p JOIN bounds b USING (series)
  WHERE p.pos >= 364 AND (p.pos - 364) % 7 = 0 AND p.y IS NOT NULL AND p.pos + 7 <= b.last_pos),
origins AS (SELECT series, origin, origin_pos, origin_seq FROM found)"""
LAST_120_ORIGINS = DAILY_ORIGINS + """,
latest AS (SELECT series, origin, origin_pos, origin_seq FROM found WHERE rn <= 120)"""


def ledger_sql(spec: BacktestSpec = HOURLY) -> str:
    """Both unfitted references for every origin and horizon."""
    e, s = spec.train_end_offset, spec.season
    g = "h.h - 1" if spec.convention == "B" else "h.h"
    last = {"A": "f.y_filled", "B": "f.y", "C": "f.y"}[spec.convention]
    known = "WHERE t.y IS NOT NULL" if spec.convention == "C" else ""
    return f"""steps AS (SELECT CAST(unnest(generate_series(1, {spec.horizon})) AS INTEGER) AS h),
ledger AS (
  SELECT o.series, o.origin, t.ts AS forecast_timestamp, h.h AS horizon, 'reference' AS condition, m.model, t.y AS y_true,
         CASE m.model WHEN 'persistence' THEN {last} ELSE b.y END AS y_pred
  FROM origins o CROSS JOIN steps h CROSS JOIN (VALUES ('persistence'), ('seasonal_naive')) m(model)
  JOIN pos t ON t.series = o.series AND t.pos = o.origin_pos + {g}
  LEFT JOIN pos f ON f.series = o.series AND f.pos = o.origin_pos + {e}
  LEFT JOIN pos b ON b.series = o.series
    AND b.pos = o.origin_pos + {g} - {s} * CAST(ceil(({g} - ({e})) / {s}.0) AS BIGINT)
  {known})"""


HOURLY_LEDGER = (OBS, PANEL, POS, origins_sql(), ledger_sql())
DAILY_LEDGER = (DAILY_PANEL, POS, DAILY_ORIGINS, ledger_sql(DAILY))
METRICS = """metrics AS (
  SELECT series, condition, model, horizon, count(y_true - y_pred) AS n_eval, avg(abs(y_true - y_pred)) AS mae,
         sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse
  FROM ledger GROUP BY ALL)"""
SKILL = """base AS (SELECT series, horizon, mae AS mae_persistence, rmse AS rmse_persistence FROM metrics WHERE model = 'persistence'),
skills AS (
  SELECT m.*, b.mae_persistence, b.rmse_persistence,
         CASE WHEN m.model <> 'persistence' AND b.mae_persistence <> 0 THEN 1 - m.mae / b.mae_persistence END AS skill_mae_vs_persistence,
         CASE WHEN m.model <> 'persistence' AND b.rmse_persistence <> 0 THEN 1 - m.rmse / b.rmse_persistence END AS skill_rmse_vs_persistence
  FROM metrics m LEFT JOIN base b USING (series, horizon))"""


def hstar_sql(horizon: int) -> str:
    return f"""marks AS (
  SELECT series, condition, model, horizon, horizon - row_number() OVER (PARTITION BY series, condition, model ORDER BY horizon) AS island
  FROM skills WHERE skill_rmse_vs_persistence > 0 AND horizon BETWEEN 1 AND {horizon}),
runs AS (
  SELECT series, condition, model, island, count(*) AS n, min(horizon) AS lo, max(horizon) AS hi FROM marks GROUP BY ALL),
hstar AS (
  SELECT k.series, k.condition, k.model, {horizon} AS H, CAST(coalesce(max(hi), 0) AS INTEGER) AS H_relax,
         CAST(coalesce(max(n), 0) AS INTEGER) AS H_strict_max_run,
         CAST(coalesce(max(n) FILTER (WHERE lo = 1), 0) AS INTEGER) AS H_strict_from_h1
  FROM (SELECT DISTINCT series, condition, model FROM skills) k LEFT JOIN runs USING (series, condition, model)
  GROUP BY ALL)"""


def student_p_sql(t: str, df: str) -> str:
    """Two-sided Student p for whole df, by the same finite sums."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    cos2 = f"(1.0 / (1.0 + ({t}) * ({t}) / ({df})))"
    odd_sum = (
        f"list_sum(list_transform(range(0, CAST(({df} - 3) // 2 AS BIGINT) + 1), lambda j: pow({cos2}, j) * "
        f"coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: 2.0 * i / (2.0 * i + 1)), 'product'), 1.0)))"
    )
    even_sum = (
        f"list_sum(list_transform(range(0, CAST(({df} - 2) // 2 AS BIGINT) + 1), lambda j: pow({cos2}, j) * "
        f"coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: (2.0 * i - 1) / (2.0 * i)), 'product'), 1.0)))"
    )
    return (
        f"CASE WHEN ({t}) IS NULL OR {df} < 1 THEN NULL WHEN {df} = 1 THEN 1 - 2 / pi() * {theta} "
        f"WHEN {df} % 2 = 1 THEN greatest(0, 1 - 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd_sum})) "
        f"ELSE greatest(0, 1 - sin({theta}) * {even_sum}) END"
    )
