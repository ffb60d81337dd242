"""Scores over a prediction ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars

CELL = ("series", "condition", "model", "horizon")


def cell_metrics(ledger: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """n_eval, MAE and RMSE per cell over rows where truth and forecast are both known.

    A cell without such rows is kept with n_eval 0 and NULL metrics. One partial + final hash aggregate.
    """
    error = F.col("y_true") - F.col("y_pred")
    return ledger.groupBy(*by).agg(
        F.count(error).alias("n_eval"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def attach_skill(
    metrics: DataFrame,
    on: Sequence[str] = ("series", "horizon"),
    baseline: Column | None = None,
    suffix: str = "persistence",
    own_skill: str = "null",
) -> DataFrame:
    """Skill of every cell against the baseline cells on the same keys.

    ``own_skill="null"`` blanks the baseline's own skill; ``"zero"`` keeps it (0 by construction) and requires
    a positive baseline error for any skill.
    """
    is_base = (F.col("model") == "persistence") if baseline is None else baseline
    base = metrics.filter(is_base).groupBy(*on).agg(
        F.min("mae").alias(f"mae_{suffix}"), F.min("rmse").alias(f"rmse_{suffix}")
    )
    out = metrics.join(base, list(on), "left")
    for m in ("mae", "rmse"):
        b = F.col(f"{m}_{suffix}")
        value = scalars.skill(F.col(m), b)
        value = F.when(~is_base, value) if own_skill == "null" else F.when(b > 0, value)
        out = out.withColumn(f"skill_{m}_vs_{suffix}", value)
    return out


def fidelity(ledger: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Correlation, variability ratio, bias ratio and their combined efficiency (KGE) per cell.

    Population moments over known pairs; r needs three pairs and both variances positive. RMSE and n_eval ride
    along, so the cell table needs only this one aggregate.
    """
    both = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    obs, pred = F.when(both, F.col("y_true")), F.when(both, F.col("y_pred"))
    error = obs - pred
    cells = ledger.groupBy(*by).agg(
        F.count(error).alias("n_eval"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.stddev_pop(obs).alias("_so"),
        F.stddev_pop(pred).alias("_sp"),
        F.avg(obs).alias("_mo"),
        F.avg(pred).alias("_mp"),
        F.covar_pop(obs, pred).alias("_cov"),
    )
    r = F.when(
        (F.col("n_eval") >= 3) & (F.col("_so") > 0) & (F.col("_sp") > 0), F.col("_cov") / (F.col("_so") * F.col("_sp"))
    )
    out = cells.withColumns(
        {
            "r_h": r,
            "phi_h": F.try_divide("_sp", "_so"),
            "beta_h": F.try_divide("_mp", "_mo"),
        }
    )
    kge = F.lit(1.0) - F.sqrt(F.pow(F.col("r_h") - 1, 2) + F.pow(F.col("phi_h") - 1, 2) + F.pow(F.col("beta_h") - 1, 2))
    return out.withColumn("kge_h", kge).select(*by, "n_eval", "rmse", "r_h", "phi_h", "beta_h", "kge_h")


def master_table(ledger: DataFrame, reference: Column | None = None) -> DataFrame:
    """Fidelity of every non-reference cell plus skill against the reference RMSE of its (series, horizon)."""
    is_ref = (F.col("model") == "persistence") if reference is None else reference
    cells = fidelity(ledger)
    base = cells.filter(is_ref).groupBy("series", "horizon").agg(F.min("rmse").alias("rmse_persistence"))
    return cells.filter(~is_ref).join(base, ["series", "horizon"], "left").withColumns(
        {"skill_h": scalars.skill(F.col("rmse"), F.col("rmse_persistence")), "station_type": F.lit("unknown")}
    ).select(
        "series", "station_type", "model", "condition", "horizon", "n_eval", "skill_h", "phi_h", "r_h", "beta_h",
        "kge_h", "rmse", "rmse_persistence",
    )


def select_ledger(
    ledger: DataFrame, models: Sequence[str], conditions: Sequence[str], rename: dict[str, str] | None = None
) -> DataFrame:
    """Check the ledger's columns, keep the listed models, relabel conditions and keep the listed ones."""
    needed = ("series", "origin", "forecast_timestamp", "horizon", "condition", "model", "y_true", "y_pred")
    missing = [c for c in needed if c not in ledger.columns]
    if missing:
        raise ValueError(f"the ledger lacks columns: {missing}")
    kept = ledger.filter(F.col("model").isin(list(models)))
    if rename:
        kept = kept.replace(rename, subset=["condition"])
    return kept.filter(F.col("condition").isin(list(conditions)))


# --- skill horizons ----------------------------------------------------------------------------------------


def skill_horizons(
    skills: DataFrame,
    horizon: int,
    by: Sequence[str] = ("series", "condition", "model"),
    skill: str = "skill_rmse_vs_persistence",
    baseline: Column | None = None,
) -> DataFrame:
    """H* descriptors of each skill curve over h = 1..horizon.

    * ``H_strict_max_run``: longest run of positive skill anywhere;
    * ``H_strict_from_h1``: run of positive skill that starts at h = 1;
    * ``H_relax``: last h with positive skill;
    * ``censored``: the max run spans the whole range, so the true value may be larger.

    A missing or NULL horizon ends a run. Baseline rows are 0 throughout. A curve has at most ``horizon``
    points, so it is folded as one short array after a single aggregate.
    """
    h = F.col("horizon")
    positive = F.collect_set(F.when((F.col(skill) > 0) & h.between(1, horizon), h))
    flags = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.array_contains("_pos", i))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("first"), F.lit(True).alias("open"))

    def step(acc, ok):
        run = F.when(ok, acc["run"] + 1).otherwise(F.lit(0))
        still = acc["open"] & ok
        return F.struct(
            run.alias("run"),
            F.greatest(acc["best"], run).alias("best"),
            (acc["first"] + still.cast("int")).alias("first"),
            still.alias("open"),
        )

    is_base = (F.col("model") == "persistence") if baseline is None else baseline
    zero_base = lambda c: F.when(is_base, F.lit(0)).otherwise(c)
    runs = (
        skills.groupBy(*by)
        .agg(positive.alias("_pos"))
        .withColumn("_runs", F.aggregate(flags, start, step))
    )
    return runs.select(
        *by,
        F.lit(horizon).alias("H"),
        zero_base(F.coalesce(F.array_max("_pos"), F.lit(0))).cast("int").alias("H_relax"),
        zero_base(F.col("_runs.best")).alias("H_strict_max_run"),
        zero_base(F.col("_runs.first")).alias("H_strict_from_h1"),
    ).withColumn("censored", F.col("H_strict_max_run") == horizon)


def hstar_summary(skills: DataFrame, horizon: int, **kw) -> DataFrame:
    """The two published descriptors under their table names."""
    full = skill_horizons(skills, horizon, **kw)
    by = [c for c in full.columns if not c.startswith("H") and c != "censored"]
    return full.select(*by, "H", F.col("H_relax").alias("H_star_relax"), F.col("H_strict_max_run").alias("H_star_strict"))
