"""Registered queries: ledgers, scores, skill horizons, fidelity and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import (
    DAILY, DAILY_LEDGER, DM_HORIZONS, HOURLY, HOURLY_LEDGER, HOURLY_SHORT, METRICS, OBS, PANEL, POS, SKILL, arm, baseline_ledger,
    features, hourly, hstar_sql, ledger_sql, origins_sql, r, rounded, sql, staged_features, staged_ledger, student_p_sql,
)
from tidemark.functions import scalars
from tidemark.operators import arma, baselines, forecasters, hooks, metrics, origins, quality, reports
from tidemark.plans import backtest, study
from tidemark.session import stage
from tidemark.sources import tables

CALENDAR_DAILY = (1, 2, 3, 7, 14, 21, 28)
STEP = origins.BacktestSpec(**{**HOURLY.__dict__, "convention": "B", "min_train_rows": 1, "lags": (1,)})
NAMES = ("persistence", "seasonal")


def arms():
    return arm("persistence"), arm("seasonal_naive")


# --- ledgers -----------------------------------------------------------------------------------------------


def persistence_ledger(spark, d):
    return rounded(baseline_ledger(spark, d).filter(arm("persistence")))


def seasonal_ledger(spark, d):
    return rounded(baseline_ledger(spark, d).filter(arm("seasonal_naive")))


def daily_ledger(spark, d):
    return rounded(baseline_ledger(spark, d, DAILY))


def step_ledger(spark, d):
    """Convention B with one raw lag: rows lacking it are dropped before positions are counted."""
    spec = STEP
    rows = backtest.supervised_rows(stage(hourly(spark, d), "panel"), tables.HOURLY, spec)
    feats = backtest.prepare(rows, tables.HOURLY, spec)
    return rounded(backtest.baseline_ledger(feats, spec, ("persistence",)))


def single_origin(spark, d):
    led = backtest.single_origin_check(stage(hourly(spark, d), "panel"), tables.HOURLY, HOURLY, "2024-01-20 00:00:00")
    return rounded(led)


def _fitted(spark, d, spec, fitted, recent=0):
    rows = staged_features(spark, d, spec, recent)
    return backtest.backtest(rows, spec, fitted, models=("persistence",))


def ridge_ledger(spark, d):
    return rounded(_fitted(spark, d, HOURLY_SHORT, [backtest.ridge_arms()]).filter(arm("ridge_direct")))


def seasonal_ar_ledger(spark, d):
    recent = forecasters.recent_depth((1, 24, 25))
    return rounded(_fitted(spark, d, HOURLY, [backtest.seasonal_ar_arm()], recent).filter(arm("seasonal_ar")))


def plain_ar_ledger(spark, d):
    names = [("reference", "ar_2_1")]
    return rounded(_fitted(
        spark, d, HOURLY, [(names, lambda f, s: forecasters.plain_ar(f, s, 2, 1))], forecasters.recent_depth((1, 2), 1)
    ).filter(arm("ar_2_1")))


def first_order_ar(spark, d):
    """AR(1) over the expanding prefix, small enough to be written out as a regression in SQL."""
    names = [("reference", "ar_1")]
    return rounded(_fitted(
        spark, d, HOURLY_SHORT, [(names, lambda f, s: forecasters.plain_ar(f, s, 1))], forecasters.recent_depth((1,))
    ).filter(arm("ar_1")), 4)


def capped_ar(spark, d):
    """AR(1) over the latest 200 training rows: rows enter and leave the running moments."""
    names = [("reference", "ar_1")]
    return rounded(_fitted(
        spark, d, HOURLY_SHORT, [(names, lambda f, s: forecasters.plain_ar(f, s, 1, max_train_rows=200))], forecasters.recent_depth((1,))
    ).filter(arm("ar_1")), 4)


def recursive_ledger(spark, d):
    recent = forecasters.recent_depth((*CALENDAR_DAILY, 8))
    return rounded(_fitted(spark, d, DAILY, [backtest.recursive_arm(CALENDAR_DAILY)], recent).filter(arm("recursive_learner")))


def _window_mean(train, origin):
    return [train["y"].mean()] * HOURLY_SHORT.horizon


def user_forecaster(spark, d):
    """A user's function fitted per origin on the latest 168 training rows."""
    names = [("reference", "window_mean")]
    return rounded(_fitted(
        spark, d, HOURLY_SHORT, [(names, lambda f, s: forecasters.windowed_hook(f, s, _window_mean, ["y"], 168))]
    ).filter(arm("window_mean")))


def prefix_mean(spark, d):
    """A user's mergeable state over the whole prefix: its mean."""
    names = [("reference", "prefix_mean")]
    hook = hooks.RunningMean(HOURLY.horizon)
    return rounded(_fitted(spark, d, HOURLY, [(names, lambda f, s: hooks.prefix_hook(f, s, hook))]).filter(arm("prefix_mean")))


def _trend_ahead(origin, h):
    return [origin["pos"] + h]


def prefix_trend(spark, d):
    """Online least squares of the target on the row number, over the whole prefix."""
    names = [("reference", "prefix_trend")]
    hook = hooks.OnlineLeastSquares(HOURLY.horizon, ["pos"], _trend_ahead)
    return rounded(_fitted(spark, d, HOURLY, [(names, lambda f, s: hooks.prefix_hook(f, s, hook, chunk_rows=128))]).filter(arm("prefix_trend")))


def late_panel(spark, d):
    """The hourly panel with some series unknown until after the first origin, so that prefixes start with an unknown run."""
    late = (F.length("series") % 2 == 1) & (F.col("ts") < F.lit("2024-01-16 06:00:00").cast("timestamp"))
    return hourly(spark, d).withColumn("y", F.when(~late, F.col("y")))


def _late_features(spark, d, recent):
    return stage(backtest.prepare(late_panel(spark, d), tables.HOURLY, HOURLY, recent, slim=True), "features")


def fold_imputation(spark, d):
    """How the prefix of every origin is imputed: unknown rows at its start, their fill, and the sum of the imputed target."""
    rows = _late_features(spark, d, 0)
    return rounded(arma.fold_fills(rows, HOURLY))


def arma_ledger(spark, d):
    """(1, 0, 1) by two stages on the imputed prefix, small enough to be written out in SQL."""
    names = [("reference", "arma_1_0_1")]
    rows = _late_features(spark, d, arma.depth_needed((1,), (1,), (1, 2)))
    led = backtest.backtest(rows, HOURLY, [(names, lambda f, s: arma.plain_arma(f, s, 1, 0, 1, first=2))], models=())
    return rounded(led, 4)


def seasonal_arma_ledger(spark, d):
    recent = arma.depth_needed((1, 24, 25), (1, 24), (1, 2, 24, 25))
    return rounded(_fitted(spark, d, HOURLY, [backtest.seasonal_arma_arm()], recent).filter(arm("seasonal_arma")))


def ridge_ledger_full(spark, d):
    """All 24 horizons and lags up to 48; folds with too few complete rows forecast nothing."""
    return rounded(_fitted(spark, d, HOURLY, [backtest.ridge_arms()]).filter(arm("ridge_direct")))


def boosted_ledger(spark, d):
    """300 trees of depth 4 for every horizon and both conditions, refitted every 16 origins, as ledger rows."""
    return rounded(_fitted(spark, d, HOURLY_SHORT, [backtest.boosted_arms(refit_every=16, partitions=1)]).filter(arm("boosted_direct")))


# --- scores ------------------------------------------------------------------------------------------------


def cell_metrics(spark, d):
    return rounded(metrics.cell_metrics(baseline_ledger(spark, d)))


def _skills(spark, d, spec=HOURLY):
    return metrics.attach_skill(metrics.cell_metrics(baseline_ledger(spark, d, spec)))


def skill_vs_persistence(spark, d):
    return rounded(_skills(spark, d))


def skill_vs_seasonal(spark, d):
    m = metrics.cell_metrics(baseline_ledger(spark, d))
    return rounded(metrics.attach_skill(m, baseline=arm("seasonal_naive"), suffix="seasonal"))


def pooled_skill(spark, d):
    """Cells pooled over series: the baseline is matched on horizon only."""
    m = metrics.cell_metrics(baseline_ledger(spark, d), by=("condition", "model", "horizon"))
    return rounded(metrics.attach_skill(m, on=("horizon",)))


def daily_skill(spark, d):
    m = metrics.cell_metrics(baseline_ledger(spark, d, DAILY))
    return rounded(metrics.attach_skill(m, own_skill="zero"))


def _supplier_skills(spark, d):
    observed = stage(tables.supplier_observed(spark, d), "supplier-days")
    cells = metrics.cell_metrics(backtest.sparse_baseline_ledger(observed, tables.DAILY, DAILY))
    return metrics.attach_skill(stage(cells, "supplier-cells"))


def supplier_skill(spark, d):
    """As many series as suppliers, so that the ledger grows with the table."""
    return rounded(_supplier_skills(spark, d))


def supplier_hstar(spark, d):
    return metrics.hstar_summary(_supplier_skills(spark, d), 7)


def loss_by_kind(spark, d):
    led = baseline_ledger(spark, d)
    return rounded(led.groupBy("series", "model").agg(
        F.avg(scalars.loss(F.col("y_true"), F.col("y_pred"), "squared_error")).alias("squared"),
        F.avg(scalars.loss(F.col("y_true"), F.col("y_pred"), "absolute_error")).alias("absolute")))


def skill_classes(spark, d):
    s = _skills(spark, d).filter("skill_rmse_vs_persistence IS NOT NULL")
    return s.groupBy("series", scalars.skill_class(F.col("skill_rmse_vs_persistence")).alias("skill_class")).agg(F.count("*").alias("n_cells"))


def hstar_three_defs(spark, d):
    return metrics.skill_horizons(_skills(spark, d), 24)


def hstar_summary(spark, d):
    return metrics.hstar_summary(_skills(spark, d), 24)


def daily_hstar(spark, d):
    return metrics.hstar_summary(_skills(spark, d, DAILY), 7)


def fidelity_kge(spark, d):
    return rounded(metrics.fidelity(baseline_ledger(spark, d)))


def master_table(spark, d):
    return rounded(metrics.master_table(staged_ledger(spark, d)))


# --- reports -----------------------------------------------------------------------------------------------


def wide_horizon_table(spark, d):
    return rounded(reports.wide_by_horizon(_skills(spark, d), 24))


def delta_table(spark, d):
    values = ("rmse", "mae")
    return rounded(reports.delta_table(_skills(spark, d), *arms(), NAMES, values=values))


def hstar_wide(spark, d):
    return reports.hstar_wide(metrics.hstar_summary(_skills(spark, d), 24), *arms(), NAMES)


def mean_delta_hstar(spark, d):
    return rounded(reports.mean_delta(hstar_wide(spark, d), "delta_H_star_strict"))


def _rho_table(spark, d):
    p = stage(hourly(spark, d), "panel")
    rho = quality.lag1_autocorrelation(p.filter("ts <= '2024-01-14 23:00:00'"), tables.HOURLY)
    return reports.horizon_persistence_table(hstar_wide(spark, d), rho)


def rho1_vs_delta_hstar(spark, d):
    return rounded(_rho_table(spark, d))


def regression_across_series(spark, d):
    return rounded(reports.linear_regression(_rho_table(spark, d), "rho1", "delta_H_star_strict"), 5)


def cross_series_profile(spark, d):
    return rounded(reports.cross_series_profile(_skills(spark, d)))


def _both_master(spark, d):
    """Fidelity of both references, with the seasonal one in the role of the second arm."""
    return metrics.fidelity(staged_ledger(spark, d)).withColumn("skill_h", F.lit(None).cast("double"))


def median_profile(spark, d):
    return rounded(reports.median_profile(stage(_both_master(spark, d), "master"), ("rmse", "phi_h", "kge_h")))


def _deltas(spark, d):
    cells = metrics.fidelity(staged_ledger(spark, d))
    base = F.max(F.when(arm("persistence"), F.col("rmse")))
    top = cells.groupBy("series", "horizon").agg(base.alias("_b"))
    master = cells.join(top, ["series", "horizon"]).withColumn("skill_h", scalars.skill(F.col("rmse"), F.col("_b")))
    return reports.fidelity_deltas(master, *arms())


def fidelity_deltas(spark, d):
    return rounded(_deltas(spark, d))


def median_deltas_by_horizon(spark, d):
    return rounded(reports.median_deltas(stage(_deltas(spark, d), "deltas"), "horizon"))


def sign_counts(spark, d):
    return reports.sign_counts(stage(_deltas(spark, d), "deltas"))


def verdict(spark, d):
    return reports.decision(sign_counts(spark, d))


def delta_summary(spark, d):
    t = reports.delta_table(_skills(spark, d), *arms(), NAMES, values=("rmse",))
    return rounded(reports.delta_summary(t, "delta_rmse"))


_SCORED = (*HOURLY_LEDGER, METRICS, SKILL)
_HSTAR = (*_SCORED, hstar_sql(24))
_SUPPLIERS = (DAILY_LEDGER[0].replace("l_returnflag || l_linestatus", "CAST(l_suppkey AS VARCHAR)"), *DAILY_LEDGER[1:])
_SKILL_COLS = "series, condition, model, horizon, n_eval, " + ", ".join(f"{r(c)} AS {c}" for c in (
    "mae", "rmse", "mae_persistence", "rmse_persistence", "skill_mae_vs_persistence", "skill_rmse_vs_persistence"))
_CELLS = "series, condition, model, horizon, n_eval"
_LED = f"series, origin, forecast_timestamp, horizon, condition, model, {r('y_true')} AS y_true, {r('y_pred')} AS y_pred"
FIDELITY = """fid AS (
  SELECT series, condition, model, horizon, count(*) FILTER (WHERE ok) AS n_eval, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
    CASE WHEN count(*) FILTER (WHERE ok) >= 3 AND stddev_pop(y_true) FILTER (WHERE ok) > 0 AND stddev_pop(y_pred) FILTER (WHERE ok) > 0
      THEN covar_pop(y_true, y_pred) / (stddev_pop(y_true) FILTER (WHERE ok) * stddev_pop(y_pred) FILTER (WHERE ok)) END AS r_h,
    stddev_pop(y_pred) FILTER (WHERE ok) / nullif(stddev_pop(y_true) FILTER (WHERE ok), 0) AS phi_h,
    avg(y_pred) FILTER (WHERE ok) / nullif(avg(y_true) FILTER (WHERE ok), 0) AS beta_h
  FROM (SELECT *, y_true IS NOT NULL AND y_pred IS NOT NULL AS ok FROM ledger) GROUP BY series, condition, model, horizon),
kge AS (SELECT *, 1 - sqrt((r_h - 1) ** 2 + (phi_h - 1) ** 2 + (beta_h - 1) ** 2) AS kge_h FROM fid)"""
DELTAS = """fd AS (
  SELECT a.series, a.horizon, (1 - b.rmse / a.rmse) - (1 - a.rmse / a.rmse) AS skill_h, b.phi_h - a.phi_h AS phi_h, b.r_h - a.r_h AS r_h,
    b.beta_h - a.beta_h AS beta_h, b.kge_h - a.kge_h AS kge_h, abs(b.phi_h - 1) - abs(a.phi_h - 1) AS phi_distance
  FROM kge a JOIN kge b ON a.series = b.series AND a.horizon = b.horizon AND a.model = 'persistence' AND b.model = 'seasonal_naive')"""
_SIGNS = """mh AS (SELECT horizon, median(skill_h) AS s, median(kge_h) AS k, median(phi_distance) AS p FROM fd GROUP BY horizon),
ms AS (SELECT series, median(skill_h) AS s, median(kge_h) AS k, median(phi_distance) AS p FROM fd GROUP BY series),
signs AS (SELECT (SELECT count(*) FROM mh) AS n_horizons, (SELECT count(*) FROM mh WHERE s > 0) AS skill_positive_horizons,
 (SELECT count(*) FROM mh WHERE k > 0) AS kge_positive_horizons, (SELECT count(*) FROM mh WHERE p < 0) AS phi_closer_horizons,
 (SELECT count(*) FROM ms) AS n_series, (SELECT count(*) FROM ms WHERE s > 0) AS skill_positive_series,
 (SELECT count(*) FROM ms WHERE k > 0) AS kge_positive_series, (SELECT count(*) FROM ms WHERE p < 0) AS phi_closer_series,
 (SELECT count(*) FROM fd WHERE skill_h > 0 AND abs(phi_h) < 0.01 AND kge_h <= 0) AS skill_without_fidelity,
 (SELECT count(*) FROM fd WHERE (r_h > 0 OR kge_h > 0) AND abs(phi_h) < 0.01) AS fidelity_without_phi)"""
_WIDE = ", ".join(
    f"{r(f'max(CASE WHEN horizon = {h} THEN {m} END)')} AS {m}_h{h}"
    for m in ("rmse", "mae", "skill_rmse_vs_persistence", "skill_mae_vs_persistence") for h in range(1, 25)
)
HSTAR_WIDE = """hw AS (SELECT a.series, a.H_relax AS H_star_relax_persistence, a.H_strict_max_run AS H_star_strict_persistence,
  b.H_relax AS H_star_relax_seasonal, b.H_strict_max_run AS H_star_strict_seasonal, b.H_relax - a.H_relax AS delta_H_star_relax,
  b.H_strict_max_run - a.H_strict_max_run AS delta_H_star_strict
  FROM hstar a JOIN hstar b ON a.series = b.series AND a.model = 'persistence' AND b.model = 'seasonal_naive')"""
_RHO = """rho AS (SELECT series, corr(y, p) AS rho1 FROM (
  SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY ts) AS p FROM panel WHERE y IS NOT NULL AND ts <= TIMESTAMP '2024-01-14 23:00:00') GROUP BY series)"""


def _ar1_sql(cap: int | None) -> str:
    low = "" if cap is None else f" AND f.pos > o.origin_pos - 1 - {cap}"
    chain = []
    prev = "x0"
    for h in range(1, 7):
        chain.append(f"(a + b * {prev})")
        prev = chain[-1]
    preds = ", ".join(f"({h}, {c})" for h, c in enumerate(chain, 1))
    return sql(
        OBS, PANEL, POS, origins_sql(HOURLY_SHORT),
        "ar AS (SELECT *, lag(y_filled) OVER (PARTITION BY series ORDER BY ts) AS prev FROM pos)",
        f"""fit AS (SELECT o.series, o.origin, o.origin_pos, regr_slope(f.y_filled, f.prev) AS b, regr_intercept(f.y_filled, f.prev) AS a
  FROM origins o JOIN ar f ON f.series = o.series AND f.pos <= o.origin_pos - 1{low} AND f.prev IS NOT NULL GROUP BY ALL)""",
        "go AS (SELECT fit.*, p.y_filled AS x0 FROM fit JOIN pos p ON p.series = fit.series AND p.pos = fit.origin_pos - 1)",
        select=f"""SELECT g.series, g.origin, t.ts AS forecast_timestamp, CAST(v.h AS INTEGER) AS horizon, 'reference' AS condition, 'ar_1' AS model,
{r('t.y', 4)} AS y_true, {r('v.p', 4)} AS y_pred FROM go g CROSS JOIN LATERAL (VALUES {preds}) v(h, p)
JOIN pos t ON t.series = g.series AND t.pos = g.origin_pos + v.h""",
    )


LATE_PANEL = PANEL.replace("panel AS (", "all_hours AS (") + """,
panel AS (
  SELECT series, ts, CASE WHEN NOT (length(series) % 2 = 1 AND ts < TIMESTAMP '2024-01-16 06:00') THEN y END AS y, n_events, k_mean FROM all_hours)"""
_FILLS = """fills AS (
  SELECT o.series, o.origin, o.origin_seq, o.origin_pos, count(p.pos) AS train_rows, count(p.pos) FILTER (WHERE p.y_filled IS NULL) AS "leading", median(p.y_filled) AS med,
    sum(p.y_filled) AS known
  FROM origins o JOIN pos p ON p.series = o.series AND p.pos <= o.origin_pos - 1 GROUP BY ALL)"""


def _two_regressors(name: str, source: str, where: str, y: str, u: str, v: str) -> str:
    """Least squares of ``y`` on ``u`` and ``v`` per origin; slopes are 0 where the columns do not vary."""
    det = "(suu * svv - suv * suv)"
    return f"""{name}_m AS (
  SELECT series, origin, avg({y}) AS my, avg({u}) AS mu, avg({v}) AS mv, var_pop({u}) AS suu, var_pop({v}) AS svv, covar_pop({u}, {v}) AS suv,
    covar_pop({u}, {y}) AS suy, covar_pop({v}, {y}) AS svy FROM {source} WHERE {where} GROUP BY ALL),
{name}_b AS (
  SELECT *, CASE WHEN {det} > 1e-9 THEN (suy * svv - svy * suv) / {det} ELSE 0 END AS bu, CASE WHEN {det} > 1e-9 THEN (svy * suu - suy * suv) / {det} ELSE 0 END AS bv FROM {name}_m),
{name} AS (SELECT series, origin, my - bu * mu - bv * mv AS b0, bu, bv FROM {name}_b)"""


_ARMA_SQL = sql(
    OBS, LATE_PANEL, POS, origins_sql(), _FILLS,
    "im AS (SELECT f.series, f.origin, p.pos, coalesce(p.y_filled, f.med, 0.0) AS y FROM fills f JOIN pos p ON p.series = f.series AND p.pos <= f.origin_pos - 1)",
    "w AS (SELECT *, lag(y, 1) OVER o AS y1, lag(y, 2) OVER o AS y2, lag(y, 3) OVER o AS y3 FROM im WINDOW o AS (PARTITION BY series, origin ORDER BY pos))",
    _two_regressors("one", "w", "y3 IS NOT NULL", "y", "y1", "y2"),
    "e AS (SELECT w.*, y - b0 - bu * y1 - bv * y2 AS e, y1 - b0 - bu * y2 - bv * y3 AS e1 FROM w JOIN one USING (series, origin))",
    _two_regressors("second", "e", "y3 IS NOT NULL", "y", "y1", "e1"),
    """two AS (
  SELECT series, origin, CASE WHEN abs(bu) > 1 THEN my - suy / suu * mu ELSE my - bu * mu - bv * mv END AS b0, CASE WHEN abs(bu) > 1 THEN suy / suu ELSE bu END AS bu,
    CASE WHEN abs(bu) > 1 THEN 0 ELSE bv END AS bv FROM second_b)""",
    "go AS (SELECT t.*, f.origin_pos, t.b0 + t.bu * e.y + t.bv * e.e AS f1 FROM two t JOIN fills f USING (series, origin) JOIN e ON e.series = t.series AND e.origin = t.origin AND e.pos = f.origin_pos - 1)",
    select=f"""SELECT g.series, g.origin, p.ts AS forecast_timestamp, CAST(p.pos - g.origin_pos AS INTEGER) AS horizon, 'reference' AS condition, 'arma_1_0_1' AS model,
{r('p.y', 4)} AS y_true, {r('b0 / (1 - bu) + pow(bu, p.pos - g.origin_pos - 1) * (f1 - b0 / (1 - bu))', 4)} AS y_pred
FROM go g JOIN pos p ON p.series = g.series AND p.pos BETWEEN g.origin_pos + 1 AND g.origin_pos + 24""",
)


def _hook_sql(model: str, value: str) -> str:
    return sql(
        OBS, PANEL, POS, origins_sql(),
        "m AS (SELECT o.series, o.origin, o.origin_pos, avg(f.y) AS mean, regr_slope(f.y, f.pos) AS b, regr_intercept(f.y, f.pos) AS a FROM origins o JOIN pos f ON f.series = o.series AND f.pos <= o.origin_pos - 1 GROUP BY ALL)",
        select=f"""SELECT m.series, m.origin, t.ts AS forecast_timestamp, CAST(t.pos - m.origin_pos AS INTEGER) AS horizon, 'reference' AS condition, '{model}' AS model, {r('t.y')} AS y_true, {r(value)} AS y_pred
FROM m JOIN pos t ON t.series = m.series AND t.pos BETWEEN m.origin_pos + 1 AND m.origin_pos + 24""",
    )


QUERIES = {
    "persistence_ledger": (persistence_ledger, sql(*HOURLY_LEDGER, select=f"SELECT {_LED} FROM ledger WHERE model = 'persistence'")),
    "seasonal_ledger": (seasonal_ledger, sql(*HOURLY_LEDGER, select=f"SELECT {_LED} FROM ledger WHERE model = 'seasonal_naive'")),
    "daily_ledger": (daily_ledger, sql(*DAILY_LEDGER, select=f"SELECT {_LED} FROM ledger")),
    "step_ledger": (step_ledger, sql(OBS, PANEL, "lagged AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY ts) AS y1 FROM panel)",
        "pos AS (SELECT series, ts, y, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, NULL AS y_filled FROM lagged WHERE y1 IS NOT NULL)",
        origins_sql(STEP), ledger_sql(STEP), select=f"SELECT {_LED} FROM ledger WHERE model = 'persistence'")),
    "single_origin_check": (single_origin, sql(OBS, PANEL, POS, "o AS (SELECT series, pos AS p FROM pos WHERE ts = TIMESTAMP '2024-01-20')",
        select=f"""SELECT o.series, TIMESTAMP '2024-01-20' AS origin, t.ts AS forecast_timestamp, CAST(t.pos - o.p + 1 AS INTEGER) AS horizon, 'reference' AS condition, 'persistence' AS model,
{r('t.y')} AS y_true, {r('f.y')} AS y_pred FROM o JOIN pos t ON t.series = o.series AND t.pos BETWEEN o.p AND o.p + 23 JOIN pos f ON f.series = o.series AND f.pos = o.p - 1""")),
    "first_order_ar": (first_order_ar, _ar1_sql(None)),
    "capped_ar": (capped_ar, _ar1_sql(200)),
    "user_forecaster": (user_forecaster, sql(OBS, PANEL, POS, origins_sql(HOURLY_SHORT),
        "m AS (SELECT o.series, o.origin, o.origin_pos, avg(f.y) AS p FROM origins o JOIN pos f ON f.series = o.series AND f.pos BETWEEN o.origin_pos - 168 AND o.origin_pos - 1 GROUP BY ALL)",
        select=f"""SELECT m.series, m.origin, t.ts AS forecast_timestamp, CAST(t.pos - m.origin_pos AS INTEGER) AS horizon, 'reference' AS condition, 'window_mean' AS model, {r('t.y')} AS y_true, {r('m.p')} AS y_pred
FROM m JOIN pos t ON t.series = m.series AND t.pos BETWEEN m.origin_pos + 1 AND m.origin_pos + 6""")),
    "ridge_ledger": (ridge_ledger, None),
    "seasonal_ar_ledger": (seasonal_ar_ledger, None),
    "plain_ar_ledger": (plain_ar_ledger, None),
    "recursive_ledger": (recursive_ledger, None),
    "boosted_ledger": (boosted_ledger, None),
    "prefix_mean": (prefix_mean, _hook_sql("prefix_mean", "m.mean")),
    "prefix_trend": (prefix_trend, _hook_sql("prefix_trend", "m.a + m.b * t.pos")),
    "fold_imputation": (fold_imputation, sql(OBS, LATE_PANEL, POS, origins_sql(), _FILLS, select=f"""SELECT series, origin_seq, train_rows, "leading",
{r('CASE WHEN "leading" > 0 THEN coalesce(med, 0.0) END')} AS fill, {r('coalesce(known, 0.0) + "leading" * coalesce(med, 0.0)')} AS total FROM fills""")),
    "arma_ledger": (arma_ledger, _ARMA_SQL),
    "seasonal_arma_ledger": (seasonal_arma_ledger, None),
    "ridge_ledger_full": (ridge_ledger_full, None),
    "cell_metrics": (cell_metrics, sql(*HOURLY_LEDGER, METRICS, select=f"SELECT {_CELLS}, {r('mae')} AS mae, {r('rmse')} AS rmse FROM metrics")),
    "skill_vs_persistence": (skill_vs_persistence, sql(*_SCORED, select=f"SELECT {_CELLS}, " + ", ".join(f"{r(c)} AS {c}" for c in (
        "mae", "rmse", "mae_persistence", "rmse_persistence", "skill_mae_vs_persistence", "skill_rmse_vs_persistence")) + " FROM skills")),
    "skill_vs_seasonal": (skill_vs_seasonal, sql(*HOURLY_LEDGER, METRICS, "b AS (SELECT series, horizon, mae AS mb, rmse AS rb FROM metrics WHERE model = 'seasonal_naive')",
        select=f"SELECT {_CELLS}, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('mb')} AS mae_seasonal, {r('rb')} AS rmse_seasonal, CASE WHEN model <> 'seasonal_naive' THEN {r('1 - mae / mb')} END AS skill_mae_vs_seasonal, CASE WHEN model <> 'seasonal_naive' THEN {r('1 - rmse / rb')} END AS skill_rmse_vs_seasonal FROM metrics JOIN b USING (series, horizon)")),
    "pooled_skill": (pooled_skill, sql(*HOURLY_LEDGER, "m AS (SELECT condition, model, horizon, count(y_true - y_pred) AS n_eval, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse FROM ledger GROUP BY ALL)",
        "b AS (SELECT horizon, mae AS mb, rmse AS rb FROM m WHERE model = 'persistence')",
        select=f"SELECT condition, model, horizon, n_eval, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('mb')} AS mae_persistence, {r('rb')} AS rmse_persistence, CASE WHEN model <> 'persistence' THEN {r('1 - mae / mb')} END AS skill_mae_vs_persistence, CASE WHEN model <> 'persistence' THEN {r('1 - rmse / rb')} END AS skill_rmse_vs_persistence FROM m JOIN b USING (horizon)")),
    "supplier_skill": (supplier_skill, sql(*_SUPPLIERS, METRICS, SKILL, select=f"SELECT {_SKILL_COLS} FROM skills")),
    "supplier_hstar": (supplier_hstar, sql(*_SUPPLIERS, METRICS, SKILL, hstar_sql(7), select="SELECT series, condition, model, H, H_relax AS H_star_relax, H_strict_max_run AS H_star_strict FROM hstar")),
    "daily_skill": (daily_skill, sql(*DAILY_LEDGER, METRICS, "b AS (SELECT series, horizon, mae AS mb, rmse AS rb FROM metrics WHERE model = 'persistence')",
        select=f"SELECT {_CELLS}, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('mb')} AS mae_persistence, {r('rb')} AS rmse_persistence, CASE WHEN mb > 0 THEN {r('1 - mae / mb')} END AS skill_mae_vs_persistence, CASE WHEN rb > 0 THEN {r('1 - rmse / rb')} END AS skill_rmse_vs_persistence FROM metrics JOIN b USING (series, horizon)")),
    "loss_by_kind": (loss_by_kind, sql(*HOURLY_LEDGER, select=f"SELECT series, model, {r('avg((y_true - y_pred) ** 2)')} AS squared, {r('avg(abs(y_true - y_pred))')} AS absolute FROM ledger GROUP BY ALL")),
    "skill_classes": (skill_classes, sql(*_SCORED, select="SELECT series, CASE WHEN skill_rmse_vs_persistence > 0.02 THEN 'gain' WHEN skill_rmse_vs_persistence < -0.02 THEN 'loss' ELSE 'neutral' END AS skill_class, count(*) AS n_cells FROM skills WHERE skill_rmse_vs_persistence IS NOT NULL GROUP BY 1, 2")),
    "hstar_three_defs": (hstar_three_defs, sql(*_HSTAR, select="SELECT *, H_strict_max_run = 24 AS censored FROM hstar")),
    "hstar_summary": (hstar_summary, sql(*_HSTAR, select="SELECT series, condition, model, H, H_relax AS H_star_relax, H_strict_max_run AS H_star_strict FROM hstar")),
    "daily_hstar": (daily_hstar, sql(*DAILY_LEDGER, METRICS, SKILL, hstar_sql(7), select="SELECT series, condition, model, H, H_relax AS H_star_relax, H_strict_max_run AS H_star_strict FROM hstar")),
    "fidelity_kge": (fidelity_kge, sql(*HOURLY_LEDGER, FIDELITY, select=f"SELECT {_CELLS}, " + ", ".join(f"{r(c)} AS {c}" for c in ("rmse", "r_h", "phi_h", "beta_h", "kge_h")) + " FROM kge")),
    "master_table": (master_table, sql(*HOURLY_LEDGER, FIDELITY, select="SELECT k.series, 'unknown' AS station_type, k.model, k.condition, k.horizon, k.n_eval, " + r("1 - k.rmse / b.rmse") + " AS skill_h, " + ", ".join(
        f"{r('k.' + c)} AS {c}" for c in ("phi_h", "r_h", "beta_h", "kge_h", "rmse")) + f", {r('b.rmse')} AS rmse_persistence FROM kge k JOIN kge b ON b.series = k.series AND b.horizon = k.horizon AND b.model = 'persistence' WHERE k.model <> 'persistence'")),
    "wide_horizon_table": (wide_horizon_table, sql(*_SCORED, select=f"SELECT series, model, condition, {_WIDE} FROM skills GROUP BY ALL")),
    "delta_table": (delta_table, sql(*HOURLY_LEDGER, METRICS, select="SELECT a.series, a.horizon, " + ", ".join(
        f"{r('a.' + m)} AS {m}_persistence, {r('b.' + m)} AS {m}_seasonal, {r(f'b.{m} - a.{m}')} AS delta_{m}" for m in ("rmse", "mae")) +
        " FROM metrics a JOIN metrics b ON a.series = b.series AND a.horizon = b.horizon AND a.model = 'persistence' AND b.model = 'seasonal_naive'")),
    "hstar_wide": (hstar_wide, sql(*_HSTAR, HSTAR_WIDE, select="SELECT * FROM hw")),
    "mean_delta_hstar": (mean_delta_hstar, sql(*_HSTAR, HSTAR_WIDE, select=f"SELECT {r('avg(delta_H_star_strict)')} AS mean_delta_H_star_strict, count(*) AS n_series FROM hw")),
    "rho1_vs_delta_hstar": (rho1_vs_delta_hstar, sql(*_HSTAR, HSTAR_WIDE, _RHO, select=f"SELECT hw.*, {r('rho1')} AS rho1 FROM hw LEFT JOIN rho USING (series)")),
    "regression_across_series": (regression_across_series, sql(*_HSTAR, HSTAR_WIDE, _RHO,
        "fit AS (SELECT count(*) AS n, regr_slope(delta_H_star_strict, rho1) AS slope, regr_intercept(delta_H_star_strict, rho1) AS intercept, corr(rho1, delta_H_star_strict) AS rr FROM hw JOIN rho USING (series))",
        "t AS (SELECT *, rr * sqrt((n - 2) / (1 - rr * rr)) AS t FROM fit)",
        select=f"SELECT n, {r('slope', 5)} AS slope, {r('intercept', 5)} AS intercept, {r('rr', 5)} AS r, {r(student_p_sql('t', '(n - 2)'), 5)} AS p_value FROM t")),
    "cross_series_profile": (cross_series_profile, sql(*_SCORED, select=f"SELECT condition, model, horizon, {r('avg(skill_rmse_vs_persistence)')} AS mean, {r('stddev_samp(skill_rmse_vs_persistence)')} AS std, count(skill_rmse_vs_persistence) AS n_series FROM skills GROUP BY ALL")),
    "median_profile": (median_profile, sql(*HOURLY_LEDGER, FIDELITY, select="SELECT condition, model, horizon, " + ", ".join(f"{r(f'median({c})')} AS median_{c}" for c in ("rmse", "phi_h", "kge_h")) + " FROM kge GROUP BY ALL")),
    "fidelity_deltas": (fidelity_deltas, sql(*HOURLY_LEDGER, FIDELITY, DELTAS, select="SELECT series, horizon, " + ", ".join(f"{r(c)} AS {c}" for c in ("skill_h", "phi_h", "r_h", "beta_h", "kge_h", "phi_distance")) + " FROM fd")),
    "median_deltas_by_horizon": (median_deltas_by_horizon, sql(*HOURLY_LEDGER, FIDELITY, DELTAS, select="SELECT horizon, " + ", ".join(f"{r(f'median({c})')} AS median_{c}" for c in ("skill_h", "phi_h", "r_h", "beta_h", "kge_h", "phi_distance")) + " FROM fd GROUP BY horizon")),
    "sign_counts": (sign_counts, sql(*HOURLY_LEDGER, FIDELITY, DELTAS, _SIGNS, select="SELECT * FROM signs")),
    "decision_label": (verdict, sql(*HOURLY_LEDGER, FIDELITY, DELTAS, _SIGNS, select="""SELECT *, CASE WHEN skill_positive_series = n_series AND kge_positive_series = n_series THEN 'go: accuracy and fidelity improve'
WHEN skill_positive_series > 0 AND (kge_positive_series > 0 OR kge_positive_horizons > 0) THEN 'go: accuracy improves, fidelity is mixed' ELSE 'hold: no consistent gain' END AS verdict FROM signs""")),
    "delta_summary": (delta_summary, sql(*HOURLY_LEDGER, METRICS, select=f"""SELECT a.series, {r('avg(b.rmse - a.rmse)')} AS mean_delta, count(*) FILTER (WHERE b.rmse > a.rmse) AS n_positive, count(*) FILTER (WHERE b.rmse < a.rmse) AS n_negative
FROM metrics a JOIN metrics b ON a.series = b.series AND a.horizon = b.horizon AND a.model = 'persistence' AND b.model = 'seasonal_naive' GROUP BY a.series""")),
}
