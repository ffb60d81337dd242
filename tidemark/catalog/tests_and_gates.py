"""Registered queries: paired tests, multiplicity, bootstrap and output checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.catalog.common import (
    DM_HORIZONS, HOURLY, HOURLY_LEDGER, METRICS, SKILL, arm, baseline_ledger, hstar_sql, r, rounded, sql, staged_ledger,
    student_p_sql,
)
from tidemark.functions import scalars
from tidemark.functions.student import two_sided_p
from tidemark.operators import inference, metrics, qa, reports
from tidemark.session import stage
from tidemark.sources import sinks, tables

SERIES = ("click", "error", "purchase", "signup", "view")


def arms():
    return arm("persistence"), arm("seasonal_naive")


def _pairs(spark, d, kind="squared_error"):
    return inference.paired_losses(baseline_ledger(spark, d), *arms(), DM_HORIZONS, kind)


def _dm(spark, d, rule, kind="squared_error"):
    ledger = staged_ledger(spark, d)
    pairs = stage(inference.paired_losses(ledger, *arms(), DM_HORIZONS, kind), "pairs")
    cells = inference.cells_by_series(ledger, *arms(), DM_HORIZONS)
    return inference.diebold_mariano(pairs, rule, HOURLY.stride, ("persistence", "seasonal"), cells)


def paired_losses(spark, d):
    return rounded(_pairs(spark, d))


def dm_legacy(spark, d):
    return rounded(_dm(spark, d, "legacy"))


def dm_q0(spark, d):
    return rounded(_dm(spark, d, "overlap"))


def dm_newey_west(spark, d):
    return rounded(_dm(spark, d, "bartlett"))


def dm_absolute_loss(spark, d):
    return rounded(_dm(spark, d, "overlap", "absolute_error"))


def _inference(spark, d, rule="overlap", label="q_overlap"):
    return inference.inference_table(_dm(spark, d, rule), label)


def bonferroni_bh(spark, d):
    return rounded(_inference(spark, d))


def inference_summary(spark, d):
    return inference.inference_summary(_inference(spark, d))


def surviving_cells(spark, d):
    return inference.surviving_cells(_inference(spark, d))


def outcome_counts(spark, d):
    return inference.outcome_counts(_dm(spark, d, "overlap"), ["horizon"])


def dm_direction(spark, d):
    ledger = staged_ledger(spark, d)
    deltas = reports.delta_table(metrics.cell_metrics(ledger), *arms(), ("persistence", "seasonal"), values=("rmse",))
    pairs = stage(inference.paired_losses(ledger, *arms(), DM_HORIZONS), "pairs")
    cells = inference.cells_by_series(ledger, *arms(), DM_HORIZONS)
    dm = inference.diebold_mariano(pairs, "overlap", HOURLY.stride, ("persistence", "seasonal"), cells)
    # A lower error of the second arm is a gain.
    gain = deltas.withColumn("delta", -F.col("delta_rmse"))
    return rounded(reports.dm_direction(dm, gain, "delta").select("series", "horizon", "p_value", "delta", "cell_class"))


def two_source_consistency(spark, d):
    """Two tables of tests over the same cells, of which the second lacks some cells and counts one pair too many in others."""
    first, second = _inference(spark, d), _inference(spark, d, "bartlett", "q_auto")
    planted = second.filter("NOT (series = 'view' AND horizon = 24)").withColumn("n", F.when(F.col("series") == "click", F.col("n") + 1).otherwise(F.col("n")))
    return qa.two_source_consistency(first, planted)


SHIFT = 300.0


def _shifted(spark, d):
    """The ledger with the seasonal forecasts of some series moved away, so that the other arm wins clearly there."""
    moved = arm("seasonal_naive") & (F.col("series") < "p")
    return stage(baseline_ledger(spark, d).withColumn("y_pred", F.when(moved, F.col("y_pred") + SHIFT).otherwise(F.col("y_pred"))), "ledger")


def _shifted_inference(spark, d):
    ledger = _shifted(spark, d)
    pairs = stage(inference.paired_losses(ledger, *arms(), DM_HORIZONS), "pairs")
    dm = inference.diebold_mariano(pairs, "overlap", HOURLY.stride, ("persistence", "seasonal"), inference.cells_by_series(ledger, *arms(), DM_HORIZONS))
    return inference.inference_table(dm, "q_overlap")


def shifted_bonferroni_bh(spark, d):
    return rounded(_shifted_inference(spark, d))


def shifted_surviving_cells(spark, d):
    return inference.surviving_cells(_shifted_inference(spark, d))


def shifted_summary(spark, d):
    return inference.inference_summary(_shifted_inference(spark, d))


def bootstrap_by_series(spark, d):
    return rounded(inference.bootstrap_skill(staged_ledger(spark, d), arm("seasonal_naive"), arm("persistence"), ("condition", "series", "horizon"), replicates=40))


def bandwidths(spark, d):
    counts = metrics.cell_metrics(baseline_ledger(spark, d)).filter(arm("persistence"))
    return counts.select(
        "series", "horizon", "n_eval", scalars.lead_steps(F.col("horizon"), 6).alias("lead_steps"),
        scalars.overlap_bandwidth(F.col("horizon"), 6).alias("q_overlap"), scalars.automatic_bandwidth(F.col("n_eval")).alias("q_auto"),
    )


def student_p_values(spark, d):
    e = tables.read_table(spark, d, "events")
    hours = e.groupBy("event_type", F.hour(F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("n"))
    t = (F.col("m") - 40.0) / (F.col("s") / F.sqrt("n"))
    return rounded(hours.withColumn("t", t).select("event_type", "hour", "n", "t", two_sided_p(F.col("t"), F.col("n") - 1).alias("p")))


def bootstrap_skill(spark, d):
    return rounded(inference.bootstrap_skill(staged_ledger(spark, d), arm("seasonal_naive"), arm("persistence"), replicates=100))


def _gated(spark, d):
    ledger = staged_ledger(spark, d)
    m = metrics.attach_skill(metrics.cell_metrics(ledger))
    return ledger, m, metrics.hstar_summary(m, 24)


def ledger_gates(spark, d):
    ledger, m, h = _gated(spark, d)
    pairs = inference.paired_losses(ledger, *arms(), DM_HORIZONS)
    dm = inference.diebold_mariano(pairs, "overlap", 24)
    return qa.ledger_gates(ledger, m, h, dm, SERIES, ("persistence", "seasonal_naive"), ("reference",), 24, ("refund",))


def output_contract(spark, d):
    ledger = baseline_ledger(spark, d)
    return qa.output_contract(ledger, ledger.columns, ("series", "origin", "forecast_timestamp", "horizon", "condition", "model"), ("reference",), 24)


def coverage_gaps(spark, d):
    """Cells evaluated at every origin against the full grid of cells, one series too many being expected."""
    m = metrics.cell_metrics(baseline_ledger(spark, d)).filter(F.col("n_eval") >= 15)
    wanted = tables.read_table(spark, d, "events").select(F.col("event_type").alias("series")).distinct()
    refund = wanted.agg(F.concat(F.min("series"), F.lit("_refund")).alias("series"))
    return qa.coverage_gaps(m, qa.expected_cells(wanted.unionByName(refund), range(1, 23)))


def n_eval_parity(spark, d):
    return qa.n_eval_parity(metrics.cell_metrics(baseline_ledger(spark, d)), arm("seasonal_naive"))


def origins_per_series(spark, d):
    return qa.origins_per_series(baseline_ledger(spark, d))


def distinct_sets(spark, d):
    return qa.distinct_sets(baseline_ledger(spark, d))


def _claims(spark, d):
    """Claims about every horizon, built from rounded metrics: exact, nearly right, wrong, textual and without a source."""
    m = metrics.cell_metrics(baseline_ledger(spark, d))
    found = m.select(
        F.concat(F.lit("rmse_h"), F.col("horizon").cast("string")).alias("metric"), "series", F.col("model").alias("condition"),
        F.round(F.col("rmse"), 3).cast("string").alias("value"), F.round(F.col("rmse"), 3).alias("number"),
        F.lit("metrics").alias("source_file"), F.concat_ws("|", "series", "model", F.col("horizon").cast("string")).alias("source_row"),
    )
    shown = F.when(F.col("condition") == "persistence", F.col("number")).when(F.col("series") < "p", F.col("number") + 0.25).otherwise(F.col("number") + 50)
    claims = found.select(
        F.concat_ws("-", "series", "condition", "metric").alias("claim_id"), "metric", F.concat(F.lit("The "), F.col("series")).alias("series"),
        F.when(F.col("series") == "view", F.lit("unknown")).otherwise(F.col("condition")).alias("condition"),
        F.when(F.col("series") == "signup", F.lit("see table")).otherwise(shown.cast("string")).alias("claimed_value"),
    )
    return qa.reconcile_claims(claims, found, {f"The {s}": s for s in SERIES})


def claim_status(spark, d):
    return _claims(spark, d).select("claim_id", "status", F.round("absolute_difference", 3).alias("absolute_difference"), "source_file", "source_row")


def claim_counts(spark, d):
    return qa.status_counts(_claims(spark, d))


def table_mismatches(spark, d):
    """Skill horizons of the two definitions against each other: where do they disagree?"""
    h = metrics.skill_horizons(metrics.attach_skill(metrics.cell_metrics(baseline_ledger(spark, d))), 24)
    a = h.select("series", "model", F.col("H_strict_max_run").alias("h"))
    b = h.select("series", "model", F.col("H_strict_from_h1").alias("h"))
    bad = qa.table_mismatches(a, b, ["series", "model"], ["h"])
    return bad.select("series", "model", F.col("found.h").alias("found"), F.col("expected.h").alias("expected"))


def availability_contract(spark, d):
    """Every user's hourly count is a predictor; its class follows from its events, and some have none or an unknown one."""
    users = tables.read_table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("predictor")).agg(F.count("*").alias("n"))
    classes = F.element_at(F.split(F.lit("A,B,C,D,E,F,G,H"), ","), (F.col("n") % 8 + 1).cast("int"))
    contract = users.filter("n % 5 <> 0").select("predictor", classes.alias("availability"))
    return qa.availability_violations(contract, users)


def file_manifest(spark, d):
    return sinks.file_manifest(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "sha256")


PAIRS = """pairs AS (
  SELECT a.series, a.horizon, a.origin, a.forecast_timestamp, a.y_true, a.y_pred AS y_pred_a, b.y_pred AS y_pred_b,
         (a.y_true - a.y_pred) ** 2 - (a.y_true - b.y_pred) ** 2 AS d
  FROM ledger a JOIN ledger b ON a.series = b.series AND a.horizon = b.horizon AND a.origin = b.origin
    AND a.model = 'persistence' AND b.model = 'seasonal_naive'
  WHERE a.horizon IN (1, 6, 12, 24) AND a.y_true IS NOT NULL AND a.y_pred IS NOT NULL AND b.y_pred IS NOT NULL)"""
ABS_PAIRS = PAIRS.replace("(a.y_true - a.y_pred) ** 2 - (a.y_true - b.y_pred) ** 2", "abs(a.y_true - a.y_pred) - abs(a.y_true - b.y_pred)")


def dm_sql(rule: str) -> tuple[str, ...]:
    q = {"legacy": "horizon - 1", "overlap": "0", "bartlett": "CAST(floor(4 * pow(n / 100.0, 2.0 / 9.0)) AS INTEGER)"}[rule]
    hd = "horizon" if rule == "legacy" else "1"
    weight = "1.0 - (a.rn - b.rn) / (s.q + 1.0)" if rule == "bartlett" else "1.0"
    whole = "true" if rule == "bartlett" else "(q <= 0 OR q < n - 1)"
    return (
        f"""st AS (SELECT *, CAST({q} AS INTEGER) AS q, {hd} AS hd FROM (SELECT series, horizon, count(*) AS n, avg(d) AS md FROM pairs GROUP BY ALL)),
num AS (SELECT p.series, p.horizon, row_number() OVER (PARTITION BY p.series, p.horizon ORDER BY p.origin) AS rn, p.d - s.md AS e FROM pairs p JOIN st s USING (series, horizon)),
g0 AS (SELECT series, horizon, sum(e * e) AS s0 FROM num GROUP BY ALL),
gq AS (SELECT s.series, s.horizon, sum(a.e * b.e * ({weight})) AS sq FROM st s JOIN num a ON a.series = s.series AND a.horizon = s.horizon
  JOIN num b ON b.series = s.series AND b.horizon = s.horizon AND a.rn - b.rn BETWEEN 1 AND s.q GROUP BY ALL),
om AS (SELECT s.*, g0.s0, (g0.s0 + 2 * coalesce(gq.sq, 0)) / n AS omega FROM st s JOIN g0 USING (series, horizon) LEFT JOIN gq USING (series, horizon)),
raw AS (SELECT *, CASE WHEN n >= 10 AND omega > 0 AND {whole} THEN md / sqrt(greatest(omega, 1e-300) / n) END AS dm_raw FROM om),
dms AS (SELECT *, dm_raw * sqrt((n + 1 - 2 * hd + hd * (hd - 1) / n) / n) AS dm_stat FROM raw),
cells AS (SELECT s.series, CAST(h AS INTEGER) AS horizon FROM (SELECT DISTINCT series FROM ledger) s CROSS JOIN (SELECT unnest([1, 6, 12, 24]) AS h)),
dm AS (SELECT series, horizon, coalesce(n, 0) AS n, q, CASE WHEN n >= 10 THEN md END AS mean_loss_diff, dm_raw, dm_stat, {student_p_sql('dm_stat', '(n - 1)')} AS p_value,
  CASE WHEN n >= 10 AND omega > 0 AND {whole} THEN CASE WHEN md > 0 THEN 'seasonal' ELSE 'persistence' END ELSE 'undetermined' END AS favours
  FROM cells LEFT JOIN dms USING (series, horizon))""",
    )


_DM_COLS = "series, horizon, n, q, " + ", ".join(f"{r(c)} AS {c}" for c in ("mean_loss_diff", "dm_raw", "dm_stat", "p_value")) + ", favours"
BH = """fam AS (SELECT *, count(p_value) OVER () AS m FROM dm),
rk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY p_value, horizon) AS k, count(p_value) OVER (PARTITION BY series) AS ms FROM fam WHERE p_value IS NOT NULL),
inf AS (SELECT *, least(1.0, m * p_value) AS p_bonferroni, min(least(1.0, p_value * ms / k)) OVER (PARTITION BY series ORDER BY p_value, horizon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_bh FROM rk),
tab AS (SELECT d.series, d.horizon, d.n, d.mean_loss_diff, d.dm_raw AS dm_stat, d.dm_stat AS dm_hln_stat, d.q, d.p_value AS p_raw, i.p_bonferroni, i.p_bonferroni < 0.05 AS bonferroni_reject,
  i.p_bh AS p_bh_series, i.p_bh < 0.05 AS bh_series_reject, 'q_overlap' AS dependence_specification FROM dm d LEFT JOIN inf i USING (series, horizon))"""
_Q0 = (*HOURLY_LEDGER, PAIRS, *dm_sql("overlap"))
_LED15 = "md AS (SELECT *, count(*) FILTER (WHERE n_eval >= 15) AS ok FROM metrics GROUP BY ALL)"
_CLAIMS = """fnd AS (
  SELECT 'rmse_h' || horizon AS metric, series, model AS condition, round(rmse, 3) AS v, series || '|' || model || '|' || horizon AS source_row FROM metrics),
said AS (
  SELECT series || '-' || condition || '-' || metric AS claim_id, metric, series, CASE WHEN series = 'view' THEN 'unknown' ELSE condition END AS condition,
    CASE WHEN series = 'signup' THEN 'see table' ELSE CAST(CASE WHEN condition = 'persistence' THEN v WHEN series < 'p' THEN v + 0.25 ELSE v + 50 END AS VARCHAR) END AS claimed FROM fnd),
met AS (
  SELECT s.claim_id, s.claimed, f.v, f.source_row, TRY_CAST(replace(s.claimed, ',', '') AS DOUBLE) AS n, round(abs(TRY_CAST(replace(s.claimed, ',', '') AS DOUBLE) - f.v), 6) AS gap
  FROM said s LEFT JOIN fnd f USING (metric, series, condition)),
cl AS (
  SELECT claim_id, round(gap, 3) AS absolute_difference, CASE WHEN source_row IS NOT NULL THEN 'metrics' END AS source_file, source_row,
    CASE WHEN v IS NULL THEN 'SOURCE_NOT_FOUND' WHEN n IS NULL THEN CASE WHEN claimed = CAST(v AS VARCHAR) THEN 'MATCH' ELSE 'MISMATCH' END
      WHEN gap = 0 THEN 'MATCH' WHEN gap <= greatest(1.0, 0.01 * abs(n)) THEN 'ROUNDING_MATCH' ELSE 'MISMATCH' END AS status FROM met)"""
_POISSON = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in inference.POISSON_CDF)


def _boot(replicates: int, more: str = "") -> str:
    return f"""po AS (SELECT condition, horizon, origin{more}, sum((y_true - y_pred) ** 2) FILTER (WHERE model = 'seasonal_naive') AS sm, count(y_true - y_pred) FILTER (WHERE model = 'seasonal_naive') AS nm,
  sum((y_true - y_pred) ** 2) FILTER (WHERE model = 'persistence') AS sb, count(y_true - y_pred) FILTER (WHERE model = 'persistence') AS nb FROM ledger GROUP BY condition, horizon, origin{more}),
dr AS (SELECT *, CAST('0x' || substr(md5('7|' || rep || '|' || strftime(origin, '%Y%m%d%H%M%S')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM po CROSS JOIN (SELECT unnest(generate_series(1, {replicates})) AS rep)),
wt AS (SELECT *, {_POISSON} AS w FROM dr),
rp AS (SELECT condition, horizon, rep{more}, 1 - sqrt(sum(w * sm) / nullif(sum(w * nm), 0)) / sqrt(sum(w * sb) / nullif(sum(w * nb), 0)) AS sk FROM wt GROUP BY ALL)"""


BOOT = _boot(100)
#: The tests of the second table, under other names.
_SECOND = re.sub(r"\b(st|num|g0|gq|om|raw|dms|cells|dm)\b", r"\1_2", dm_sql("bartlett")[0])
_SHIFTED = (*HOURLY_LEDGER[:-1], HOURLY_LEDGER[-1].replace("ledger AS (", "plain AS (", 1),
            f"ledger AS (SELECT * REPLACE (CASE WHEN model = 'seasonal_naive' AND series < 'p' THEN y_pred + {SHIFT} ELSE y_pred END AS y_pred) FROM plain)", PAIRS, *dm_sql("overlap"))

QUERIES = {
    "paired_losses": (paired_losses, sql(*HOURLY_LEDGER, PAIRS, select="SELECT series, horizon, origin, forecast_timestamp, " + ", ".join(f"{r(c)} AS {c}" for c in ("y_true", "y_pred_a", "y_pred_b", "d")) + " FROM pairs")),
    "dm_legacy": (dm_legacy, sql(*HOURLY_LEDGER, PAIRS, *dm_sql("legacy"), select=f"SELECT {_DM_COLS} FROM dm")),
    "dm_q0": (dm_q0, sql(*_Q0, select=f"SELECT {_DM_COLS} FROM dm")),
    "dm_newey_west": (dm_newey_west, sql(*HOURLY_LEDGER, PAIRS, *dm_sql("bartlett"), select=f"SELECT {_DM_COLS} FROM dm")),
    "dm_absolute_loss": (dm_absolute_loss, sql(*HOURLY_LEDGER, ABS_PAIRS, *dm_sql("overlap"), select=f"SELECT {_DM_COLS} FROM dm")),
    "bonferroni_bh": (bonferroni_bh, sql(*_Q0, BH, select="SELECT series, horizon, n, q, bonferroni_reject, bh_series_reject, dependence_specification, " + ", ".join(
        f"{r(c)} AS {c}" for c in ("mean_loss_diff", "dm_stat", "dm_hln_stat", "p_raw", "p_bonferroni", "p_bh_series")) + " FROM tab")),
    "inference_summary": (inference_summary, sql(*_Q0, BH, select="SELECT count(p_raw) AS valid, count(*) FILTER (WHERE p_raw < 0.05) AS raw_lt_alpha, count(*) FILTER (WHERE bonferroni_reject) AS bonferroni_reject, count(*) FILTER (WHERE bh_series_reject) AS bh_series_reject FROM tab")),
    "surviving_cells": (surviving_cells, sql(*_Q0, BH, select="SELECT series, horizon FROM tab WHERE bh_series_reject")),
    "outcome_counts": (outcome_counts, sql(*_Q0, select="SELECT horizon, favours, count(*) AS n_cells FROM dm GROUP BY ALL")),
    "dm_direction": (dm_direction, sql(*_Q0, METRICS, select=f"""SELECT d.series, d.horizon, {r('d.p_value')} AS p_value, {r('coalesce(a.rmse - b.rmse, 0.0)')} AS delta,
CASE WHEN coalesce(a.rmse - b.rmse, 0.0) >= 0 THEN 'gain' ELSE 'loss' END || CASE WHEN d.p_value < 0.05 THEN '_significant' ELSE '_open' END AS cell_class
FROM dm d LEFT JOIN metrics a ON a.series = d.series AND a.horizon = d.horizon AND a.model = 'persistence' LEFT JOIN metrics b ON b.series = d.series AND b.horizon = d.horizon AND b.model = 'seasonal_naive'""")),
    "two_source_consistency": (two_source_consistency, sql(*_Q0, _SECOND, "two AS (SELECT series, horizon, n + CASE WHEN series = 'click' THEN 1 ELSE 0 END AS n, p_value FROM dm_2 WHERE NOT (series = 'view' AND horizon = 24))",
        select="""SELECT count(*) AS cells, count(*) FILTER (WHERE (a.p_value IS NOT NULL) IS DISTINCT FROM CASE WHEN b.series IS NOT NULL THEN b.p_value IS NOT NULL END) AS validity_mismatches,
  count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS support_mismatches, bool_and(coalesce(a.p_value IS NOT NULL, false) AND coalesce(b.p_value IS NOT NULL, false)) AS all_cells_valid
FROM dm a FULL JOIN two b ON a.series = b.series AND a.horizon = b.horizon""")),
    "shifted_bonferroni_bh": (shifted_bonferroni_bh, sql(*_SHIFTED, BH, select="SELECT series, horizon, n, q, bonferroni_reject, bh_series_reject, dependence_specification, " + ", ".join(
        f"{r(c)} AS {c}" for c in ("mean_loss_diff", "dm_stat", "dm_hln_stat", "p_raw", "p_bonferroni", "p_bh_series")) + " FROM tab")),
    "shifted_surviving_cells": (shifted_surviving_cells, sql(*_SHIFTED, BH, select="SELECT series, horizon FROM tab WHERE bh_series_reject")),
    "shifted_summary": (shifted_summary, sql(*_SHIFTED, BH, select="SELECT count(p_raw) AS valid, count(*) FILTER (WHERE p_raw < 0.05) AS raw_lt_alpha, count(*) FILTER (WHERE bonferroni_reject) AS bonferroni_reject, count(*) FILTER (WHERE bh_series_reject) AS bh_series_reject FROM tab")),
    "bootstrap_by_series": (bootstrap_by_series, sql(*HOURLY_LEDGER, _boot(40, ", series"), select=f"SELECT condition, series, horizon, {r('avg(sk)')} AS skill_mean, {r('quantile_cont(sk, 0.025)')} AS ci_lower, {r('quantile_cont(sk, 0.975)')} AS ci_upper FROM rp GROUP BY ALL")),
    "bandwidths": (bandwidths, sql(*HOURLY_LEDGER, METRICS, select="SELECT series, horizon, n_eval, CAST(ceil(horizon / 6.0) AS INTEGER) AS lead_steps, CAST(greatest(0, ceil(horizon / 6.0) - 1) AS INTEGER) AS q_overlap, CAST(floor(4 * pow(n_eval / 100.0, 2.0 / 9.0)) AS INTEGER) AS q_auto FROM metrics WHERE model = 'persistence'")),
    "student_p_values": (student_p_values, sql("h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, (avg(value) - 40.0) / (stddev_samp(value) / sqrt(count(*))) AS t, count(*) AS n FROM events GROUP BY 1, 2)",
        select=f"SELECT event_type, hour, n, {r('t')} AS t, {r(student_p_sql('t', '(n - 1)'))} AS p FROM h")),
    "bootstrap_skill": (bootstrap_skill, sql(*HOURLY_LEDGER, BOOT, select=f"SELECT condition, horizon, {r('avg(sk)')} AS skill_mean, {r('quantile_cont(sk, 0.025)')} AS ci_lower, {r('quantile_cont(sk, 0.975)')} AS ci_upper FROM rp GROUP BY ALL")),
    "ledger_gates": (ledger_gates, sql(*HOURLY_LEDGER, METRICS, "par AS (SELECT count(*) AS n FROM metrics a JOIN metrics b ON a.series = b.series AND a.horizon = b.horizon AND a.model <> 'persistence' AND b.model = 'persistence' WHERE a.n_eval <> b.n_eval)",
        select="""SELECT 'series set is exactly the expected one' AS "check", count(DISTINCT series) = 5 AS passed, 'found=' || count(DISTINCT series) || ' unexpected=0' AS detail FROM ledger
UNION ALL SELECT 'every series has origins', count(DISTINCT series) = 5, 'series_with_origins=' || count(DISTINCT series) FROM ledger
UNION ALL SELECT 'horizons are exactly 1..H', count(DISTINCT horizon) = 24, 'found=' || count(DISTINCT horizon) || ' unexpected=0' FROM ledger
UNION ALL SELECT 'model set is exactly the expected one', count(DISTINCT model) = 2, 'found=' || count(DISTINCT model) || ' unexpected=0' FROM ledger
UNION ALL SELECT 'condition set is exactly the expected one', count(DISTINCT condition) = 1, 'found=' || count(DISTINCT condition) || ' unexpected=0' FROM ledger
UNION ALL SELECT 'ledger key is unique', count(*) = count(DISTINCT (series, origin, horizon, model, condition)), 'duplicate_rows=' || (count(*) - count(DISTINCT (series, origin, horizon, model, condition))) FROM ledger
UNION ALL SELECT 'forecast timestamps lie after their origin', count(*) FILTER (WHERE forecast_timestamp <= origin) = 0, 'violations=' || count(*) FILTER (WHERE forecast_timestamp <= origin) FROM ledger
UNION ALL SELECT 'models and persistence share n_eval', n = 0, 'mismatched_cells=' || n FROM par
UNION ALL SELECT 'no forbidden series', count(*) FILTER (WHERE series = 'refund') = 0, 'hits=' || count(*) FILTER (WHERE series = 'refund') FROM ledger
UNION ALL SELECT 'skill horizons cover all series', count(DISTINCT series) = 5, 'covered=' || count(DISTINCT series) FROM metrics
UNION ALL SELECT 'tests cover all series', count(DISTINCT series) = 5, 'covered=' || count(DISTINCT series) FROM metrics""")),
    "output_contract": (output_contract, sql(*HOURLY_LEDGER, select="""SELECT 'columns present' AS "check", true AS passed, '8' AS detail
UNION ALL SELECT 'identifiers are not null', count(*) = count(series) AND count(*) = count(forecast_timestamp), CAST(count(*) - count(forecast_timestamp) AS VARCHAR) FROM ledger
UNION ALL SELECT 'horizons are 1..H', count(DISTINCT horizon) = 24, CAST(count(DISTINCT horizon) AS VARCHAR) FROM ledger
UNION ALL SELECT 'conditions are known', true, CAST(count(*) FILTER (WHERE condition <> 'reference') AS VARCHAR) FROM ledger""")),
    "coverage_gaps": (coverage_gaps, sql(*HOURLY_LEDGER, METRICS, "seen AS (SELECT DISTINCT series, horizon FROM metrics WHERE n_eval >= 15)",
        "want AS (SELECT s.series, CAST(h AS INTEGER) AS horizon FROM (SELECT DISTINCT event_type AS series FROM events UNION ALL SELECT min(event_type) || '_refund' FROM events) s CROSS JOIN (SELECT unnest(generate_series(1, 22)) AS h))",
        select="SELECT series, horizon, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT * FROM seen) UNION ALL SELECT series, horizon, 'extra' FROM (SELECT * FROM seen EXCEPT SELECT * FROM want)")),
    "n_eval_parity": (n_eval_parity, sql(*HOURLY_LEDGER, METRICS, select="SELECT a.series, a.condition, a.model, a.horizon, a.n_eval, b.n_eval AS n_baseline FROM metrics a JOIN metrics b ON a.series = b.series AND a.horizon = b.horizon AND a.model = 'seasonal_naive' AND b.model = 'persistence' WHERE a.n_eval <> b.n_eval")),
    "origins_per_series": (origins_per_series, sql(*HOURLY_LEDGER, select="SELECT series, count(DISTINCT origin) AS n_origins FROM ledger GROUP BY series")),
    "distinct_sets": (distinct_sets, sql(*HOURLY_LEDGER, select="SELECT DISTINCT 'series' AS dimension, series AS value FROM ledger UNION ALL SELECT DISTINCT 'horizon', CAST(horizon AS VARCHAR) FROM ledger UNION ALL SELECT DISTINCT 'model', model FROM ledger UNION ALL SELECT DISTINCT 'condition', condition FROM ledger")),
    "claim_status": (claim_status, sql(*HOURLY_LEDGER, METRICS, _CLAIMS, select="SELECT * FROM cl")),
    "claim_counts": (claim_counts, sql(*HOURLY_LEDGER, METRICS, _CLAIMS, select="SELECT status, count(*) AS n_claims FROM cl GROUP BY status")),
    "table_mismatches": (table_mismatches, sql(*HOURLY_LEDGER, METRICS, SKILL, hstar_sql(24), select="SELECT series, model, H_strict_max_run AS found, H_strict_from_h1 AS expected FROM hstar WHERE H_strict_max_run <> H_strict_from_h1")),
    "availability_contract": (availability_contract, """WITH users AS (SELECT CAST(user_id AS VARCHAR) AS predictor, count(*) AS n FROM events GROUP BY 1),
marked AS (SELECT predictor, CASE WHEN n % 5 <> 0 THEN ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'][n % 8 + 1] END AS availability FROM users)
SELECT * FROM marked WHERE availability IS NULL OR availability NOT IN ('A', 'B', 'C', 'D', 'E', 'F')"""),
    "file_manifest": (file_manifest, None),
}
