"""Registered queries: a whole study of two learned arms, with and without a covariate, from its fits to the verdict.

The arms are direct ridge regressions on one lag, and on one lag and a covariate imputed with the fold's median, so that even the fits can be
written out in SQL.
"""

from __future__ import annotations

from tidemark.catalog.common import HOURLY_SHORT, METRICS, OBS, PANEL, POS, SKILL, hstar_sql, ledger_sql, origins_sql, r, rounded, sql
from tidemark.catalog.scores import _SIGNS, FIDELITY
from tidemark.catalog.tests_and_gates import BH, PAIRS, SERIES, dm_sql
from tidemark.operators import reports
from tidemark.operators.origins import BacktestSpec
from tidemark.plans import backtest, study
from tidemark.session import stage
from tidemark.sources import tables

SPEC = BacktestSpec(**{**HOURLY_SHORT.__dict__, "lags": (1,), "calendar": (), "covariates": ("n_events",)})
ARMS = ("lags_only", "lags_meteo")
HORIZONS = (1, 6)


def _study(spark, d) -> study.Study:
    rows = stage(backtest.prepare(tables.hourly_panel(spark, d), tables.HOURLY, SPEC, slim=True), "features")
    return study.Study(SPEC, stage(backtest.backtest(rows, SPEC, [backtest.ridge_arms()], models=("persistence",)), "ledger"), *ARMS, HORIZONS)


def study_ledger(spark, d):
    return rounded(_study(spark, d).ledger)


def study_deltas(spark, d):
    return rounded(_study(spark, d).deltas)


def study_hstar(spark, d):
    run = _study(spark, d)
    return reports.hstar_wide(run.hstar, *run.arms(), ARMS)


def study_inference(spark, d):
    return rounded(_study(spark, d).inference())


def study_master(spark, d):
    return rounded(_study(spark, d).master)


def study_verdict(spark, d):
    return _study(spark, d).verdict


def study_gates(spark, d):
    return _study(spark, d).gates(SERIES, ("persistence", "ridge_direct"), ("reference", *ARMS))


_H = SPEC.horizon
_TARGETS = ", ".join(f"lead(y, {h}) OVER w AS t{h}" for h in range(1, _H + 1))
_LONG = ", ".join(f"({h}, t{h})" for h in range(1, _H + 1))
_LIVE1, _LIVE2 = (f"(s{i}{i} > 1e-10 * greatest(1.0, m{i} * m{i}))" for i in (1, 2))
#: Slopes of standardized columns under a penalty of 1 on their sum of squares, put back on the columns' own scale.
_ALONE1, _ALONE2 = (f"CASE WHEN {live} THEN s{i}t / s{i}{i} / (1 + 1.0 / n) ELSE 0 END" for i, live in ((1, _LIVE1), (2, _LIVE2)))
_RHO = "(s12 / sqrt(s11 * s22))"
_BOTH1, _BOTH2 = (
    f"((1 + 1.0 / n) * s{i}t / sqrt(s{i}{i}) - {_RHO} * s{j}t / sqrt(s{j}{j})) / ((1 + 1.0 / n) * (1 + 1.0 / n) - {_RHO} * {_RHO}) / sqrt(s{i}{i})" for i, j in ((1, 2), (2, 1))
)
LEDGER = (
    OBS, PANEL, POS, origins_sql(SPEC), ledger_sql(SPEC).replace("ledger AS (", "refs AS (", 1),
    f"""feats AS (
  SELECT *, lag(y_filled, 1) OVER w AS y_lag_1, {_TARGETS}, count(y) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {_H} FOLLOWING) AS nf
  FROM pos WINDOW w AS (PARTITION BY series ORDER BY ts)),
frame AS (SELECT * FROM feats WHERE y_lag_1 IS NOT NULL AND nf = {_H}),
med AS (
  SELECT o.series, o.origin, o.origin_pos, median(f.n_events) AS med FROM origins o LEFT JOIN frame f ON f.series = o.series AND f.pos <= o.origin_pos - {_H + 1} GROUP BY ALL),
mom AS (
  SELECT series, origin, h, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(t) AS mt, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
    covar_pop(x1, t) AS s1t, covar_pop(x2, t) AS s2t
  FROM (SELECT m.series, m.origin, v.h, f.y_lag_1 AS x1, coalesce(f.n_events, m.med, 0.0) AS x2, v.t
    FROM med m JOIN frame f ON f.series = m.series AND f.pos <= m.origin_pos - {_H + 1} CROSS JOIN LATERAL (VALUES {_LONG}) v(h, t)) GROUP BY ALL),
slopes AS (
  SELECT *, {_ALONE1} AS a1, CASE WHEN {_LIVE1} AND {_LIVE2} THEN {_BOTH1} ELSE {_ALONE1} END AS b1, CASE WHEN {_LIVE1} AND {_LIVE2} THEN {_BOTH2} ELSE {_ALONE2} END AS b2
  FROM mom WHERE n >= {SPEC.min_frame_rows}),
learned AS (
  SELECT m.series, m.origin, t.ts AS forecast_timestamp, CAST(h.h AS INTEGER) AS horizon, c.condition, 'ridge_direct' AS model, t.y AS y_true,
    CASE c.condition WHEN 'lags_only' THEN s.mt + s.a1 * (x.y_lag_1 - s.m1) ELSE s.mt + s.b1 * (x.y_lag_1 - s.m1) + s.b2 * (coalesce(x.n_events, m.med, 0.0) - s.m2) END AS y_pred
  FROM med m CROSS JOIN steps h CROSS JOIN (VALUES ('lags_only'), ('lags_meteo')) c(condition) JOIN pos t ON t.series = m.series AND t.pos = m.origin_pos + h.h
  JOIN feats x ON x.series = m.series AND x.pos = m.origin_pos LEFT JOIN slopes s ON s.series = m.series AND s.origin = m.origin AND s.h = h.h),
ledger AS (SELECT * FROM refs WHERE model = 'persistence' UNION ALL BY NAME SELECT * FROM learned)""",
)
_SCORED = (*LEDGER, METRICS, SKILL)
_DM = dm_sql("overlap")[0].replace("'seasonal'", "'lags_meteo'").replace("'persistence'", "'lags_only'").replace("[1, 6, 12, 24]", "[1, 6]")
_PAIRS = PAIRS.replace("a.model = 'persistence'", "a.condition = 'lags_only'").replace("b.model = 'seasonal_naive'", "b.condition = 'lags_meteo'").replace("(1, 6, 12, 24)", "(1, 6)")
_MASTER = "ms_table AS (SELECT k.*, 1 - k.rmse / b.rmse AS skill_h, b.rmse AS rmse_persistence FROM kge k LEFT JOIN kge b ON b.series = k.series AND b.horizon = k.horizon AND b.model = 'persistence' WHERE k.model <> 'persistence')"
_FD = """fd AS (
  SELECT a.series, a.horizon, b.skill_h - a.skill_h AS skill_h, b.phi_h - a.phi_h AS phi_h, b.r_h - a.r_h AS r_h, b.beta_h - a.beta_h AS beta_h, b.kge_h - a.kge_h AS kge_h,
    abs(b.phi_h - 1) - abs(a.phi_h - 1) AS phi_distance
  FROM ms_table a JOIN ms_table b ON a.series = b.series AND a.horizon = b.horizon AND a.condition = 'lags_only' AND b.condition = 'lags_meteo')"""
_BY_ARM = "a.series = b.series AND a.condition = 'lags_only' AND b.condition = 'lags_meteo'"

QUERIES = {
    "study_ledger": (study_ledger, sql(*LEDGER, select=f"SELECT series, origin, forecast_timestamp, horizon, condition, model, {r('y_true')} AS y_true, {r('y_pred')} AS y_pred FROM ledger")),
    "study_deltas": (study_deltas, sql(*_SCORED, select="SELECT a.series, a.horizon, " + ", ".join(
        f"{r('a.' + m)} AS {m}_lags_only, {r('b.' + m)} AS {m}_lags_meteo, {r(f'b.{m} - a.{m}')} AS delta_{m}" for m in reports.METRICS) + f" FROM skills a JOIN skills b ON a.horizon = b.horizon AND {_BY_ARM}")),
    "study_hstar": (study_hstar, sql(*_SCORED, hstar_sql(_H), select=f"""SELECT a.series, a.H_relax AS H_star_relax_lags_only, a.H_strict_max_run AS H_star_strict_lags_only,
  b.H_relax AS H_star_relax_lags_meteo, b.H_strict_max_run AS H_star_strict_lags_meteo, b.H_relax - a.H_relax AS delta_H_star_relax, b.H_strict_max_run - a.H_strict_max_run AS delta_H_star_strict
FROM hstar a JOIN hstar b ON {_BY_ARM}""")),
    "study_inference": (study_inference, sql(*LEDGER, _PAIRS, _DM, BH, select="SELECT series, horizon, n, q, bonferroni_reject, bh_series_reject, dependence_specification, " + ", ".join(
        f"{r(c)} AS {c}" for c in ("mean_loss_diff", "dm_stat", "dm_hln_stat", "p_raw", "p_bonferroni", "p_bh_series")) + " FROM tab")),
    "study_master": (study_master, sql(*LEDGER, FIDELITY, _MASTER, select="SELECT series, 'unknown' AS station_type, model, condition, horizon, n_eval, " + ", ".join(
        f"{r(c)} AS {c}" for c in ("skill_h", "phi_h", "r_h", "beta_h", "kge_h", "rmse", "rmse_persistence")) + " FROM ms_table")),
    "study_verdict": (study_verdict, sql(*LEDGER, FIDELITY, _MASTER, _FD, _SIGNS, select="""SELECT *, CASE WHEN skill_positive_series = n_series AND kge_positive_series = n_series THEN 'go: accuracy and fidelity improve'
WHEN skill_positive_series > 0 AND (kge_positive_series > 0 OR kge_positive_horizons > 0) THEN 'go: accuracy improves, fidelity is mixed' ELSE 'hold: no consistent gain' END AS verdict FROM signs""")),
    "study_gates": (study_gates, sql(*LEDGER, METRICS, "par AS (SELECT count(*) AS n FROM metrics a JOIN metrics b ON a.series = b.series AND a.horizon = b.horizon AND a.model <> 'persistence' AND b.model = 'persistence' WHERE a.n_eval <> b.n_eval)",
        select=f"""SELECT 'series set is exactly the expected one' AS "check", count(DISTINCT series) = 5 AS passed, 'found=' || count(DISTINCT series) || ' unexpected=0' AS detail FROM ledger
UNION ALL SELECT 'every series has origins', count(DISTINCT series) = 5, 'series_with_origins=' || count(DISTINCT series) FROM ledger
UNION ALL SELECT 'horizons are exactly 1..H', count(DISTINCT horizon) = {_H}, 'found=' || count(DISTINCT horizon) || ' unexpected=0' FROM ledger
UNION ALL SELECT 'model set is exactly the expected one', count(DISTINCT model) = 2, 'found=' || count(DISTINCT model) || ' unexpected=0' FROM ledger
UNION ALL SELECT 'condition set is exactly the expected one', count(DISTINCT condition) = 3, 'found=' || count(DISTINCT condition) || ' unexpected=0' FROM ledger
UNION ALL SELECT 'ledger key is unique', count(*) = count(DISTINCT (series, origin, horizon, model, condition)), 'duplicate_rows=' || (count(*) - count(DISTINCT (series, origin, horizon, model, condition))) FROM ledger
UNION ALL SELECT 'forecast timestamps lie after their origin', count(*) FILTER (WHERE forecast_timestamp <= origin) = 0, 'violations=' || count(*) FILTER (WHERE forecast_timestamp <= origin) FROM ledger
UNION ALL SELECT 'models and persistence share n_eval', n = 0, 'mismatched_cells=' || n FROM par
UNION ALL SELECT 'no forbidden series', true, 'hits=0'
UNION ALL SELECT 'skill horizons cover all series', count(DISTINCT series) = 5, 'covered=' || count(DISTINCT series) FROM metrics
UNION ALL SELECT 'tests cover all series', count(DISTINCT series) = 5, 'covered=' || count(DISTINCT series) FROM metrics""")),
}
