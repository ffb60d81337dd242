"""Checks over outputs; each returns rows of (check, passed, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars

KEY = ("series", "origin", "horizon", "model", "condition")


def coverage_gaps(observed: DataFrame, expected: DataFrame, keys: Sequence[str] = ("series", "horizon")) -> DataFrame:
    """Cells that are expected but absent, or present but not expected."""
    seen, wanted = observed.select(*keys).distinct(), expected.select(*keys).distinct()
    return (
        wanted.join(seen, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
        .unionByName(seen.join(wanted, list(keys), "left_anti").withColumn("problem", F.lit("extra")))
    )


def expected_cells(series: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return series.select("series").distinct().withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))
    )


def distinct_sets(ledger: DataFrame) -> DataFrame:
    """Distinct values of the ledger's small dimensions, as rows."""
    cells = ledger.groupBy("series", "horizon", "model", "condition").agg(F.lit(1).alias("_"))
    dims = ("series", "horizon", "model", "condition")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return cells.select(F.inline(pairs)).distinct()


def origins_per_series(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("series").agg(F.countDistinct("origin").alias("n_origins"))


def n_eval_parity(metrics: DataFrame, model: Column, baseline: Column | None = None) -> DataFrame:
    """Cells of ``model`` whose n_eval differs from the baseline's in the same (series, horizon)."""
    is_base = (F.col("model") == "persistence") if baseline is None else baseline
    base = metrics.filter(is_base).groupBy("series", "horizon").agg(F.min("n_eval").alias("n_baseline"))
    return metrics.filter(model).join(base, ["series", "horizon"]).filter("n_eval <> n_baseline").select(
        "series", "condition", "model", "horizon", "n_eval", "n_baseline"
    )


def _gate(name: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def ledger_cells(ledger: DataFrame) -> DataFrame:
    """One row per (series, horizon, model, condition): ``keys`` with an origin, ``origins``, ``repeated`` rows of a key, rows ``early`` for their origin.

    The gates need nothing else of a ledger; its rows are read once.
    """
    early = F.count_if(F.col("forecast_timestamp") <= F.col("origin")).alias("early")
    per_key = ledger.groupBy(*KEY).agg(F.count("*").alias("c"), early)
    return per_key.groupBy("series", "horizon", "model", "condition").agg(
        F.count("origin").alias("origins"), F.sum(F.col("c") - 1).alias("repeated"), F.sum("early").alias("early")
    )


def ledger_gates(
    ledger: DataFrame,
    metrics: DataFrame,
    hstar: DataFrame,
    dm: DataFrame | None,
    series: Sequence[str],
    models: Sequence[str],
    conditions: Sequence[str],
    horizon: int,
    forbidden: Sequence[str] = (),
    parity_model: Column | None = None,
) -> DataFrame:
    """The structural gates of a finished run, one row each.

    The ledger is summed up once; its gates are counters of one aggregate over that small table.
    """
    expected = {"series": series, "horizon": range(1, horizon + 1), "model": models, "condition": conditions}
    wanted = {d: [str(v) for v in values] for d, values in expected.items()}
    counters = [F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in ("repeated", "early")]
    counters.append(F.countDistinct(F.when(F.col("origins") > 0, F.col("series"))).alias("_with_origins"))
    counters.append(F.countDistinct(F.when(F.lower("series").rlike("|".join(forbidden)) if forbidden else F.lit(False), F.col("series"))).alias("_forbidden"))
    for d, values in wanted.items():
        text = F.col(d).cast("string")
        counters += [F.countDistinct(F.when(text.isin(values), text)).alias(f"_{d}_hits"), F.countDistinct(F.when(~text.isin(values), text)).alias(f"_{d}_others")]
    others = {
        "_parity": n_eval_parity(metrics, (F.col("model") != "persistence") if parity_model is None else parity_model).agg(F.count("*")).scalar(),
        "_hstar": _covered(hstar, series),
    } | ({} if dm is None else {"_dm": _covered(dm, series)})
    one = ledger_cells(ledger).agg(*counters).withColumns(others)

    def exactly(d: str, name: str) -> Column:
        hits, more = F.col(f"_{d}_hits"), F.col(f"_{d}_others")
        return _gate(name, (hits == len(set(wanted[d]))) & (more == 0), F.concat(F.lit("found="), hits.cast("string"), F.lit(" unexpected="), more.cast("string")))

    def counted(column: str, name: str, label: str, right: int) -> Column:
        return _gate(name, F.col(column) == right, F.concat(F.lit(f"{label}="), F.col(column).cast("string")))

    gates = [
        exactly("series", "series set is exactly the expected one"),
        counted("_with_origins", "every series has origins", "series_with_origins", len(series)),
        exactly("horizon", "horizons are exactly 1..H"),
        exactly("model", "model set is exactly the expected one"),
        exactly("condition", "condition set is exactly the expected one"),
        counted("_repeated", "ledger key is unique", "duplicate_rows", 0),
        counted("_early", "forecast timestamps lie after their origin", "violations", 0),
        counted("_parity", "models and persistence share n_eval", "mismatched_cells", 0),
        counted("_forbidden", "no forbidden series", "hits", 0),
        counted("_hstar", "skill horizons cover all series", "covered", len(series)),
    ]
    if dm is not None:
        gates.append(counted("_dm", "tests cover all series", "covered", len(series)))
    return one.select(F.inline(F.array(*gates)))


def _covered(df: DataFrame, series: Sequence[str]) -> Column:
    return df.filter(F.col("series").isin(list(series))).agg(F.countDistinct("series")).scalar()


def output_contract(df: DataFrame, columns: Sequence[str], identifiers: Sequence[str], conditions: Sequence[str],
                    horizon: int) -> DataFrame:
    """Expected columns, no NULL identifiers, horizons within 1..H and the condition set, in one scan."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in identifiers])
    one = df.agg(
        F.count_if(nulls).alias("nulls"),
        F.count_if(~F.col("horizon").between(1, horizon)).alias("range"),
        F.countDistinct("horizon").alias("horizons"),
        F.count_if(~F.col("condition").isin(list(conditions))).alias("conditions"),
    )
    row = lambda name, ok, detail: F.struct(
        F.lit(name).alias("check"), ok.alias("passed"), detail.cast("string").alias("detail")
    )
    cells = F.array(
        row("columns present", F.lit(True), F.lit(len(columns))),
        row("identifiers are not null", F.col("nulls") == 0, F.col("nulls")),
        row("horizons are 1..H", (F.col("range") == 0) & (F.col("horizons") == horizon), F.col("horizons")),
        row("conditions are known", F.col("conditions") == 0, F.col("conditions")),
    )
    return one.select(F.inline(cells))


def reconcile_claims(claims: DataFrame, found: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Left-join claimed values with recomputed ones and grade each.

    ``claims``: claim_id, metric, series, condition, claimed_value (text). ``found``: metric, series, condition,
    value (text), number (NULL for text values) and, where known, ``source_file`` and ``source_row``, the table and row that
    the value comes from. ``labels`` maps display names to series names.
    """
    if labels:
        claims = claims.replace(dict(labels), subset=["series"])
    left, right = claims.alias("c"), found.alias("f")
    keys = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("metric", "series", "condition")]
    joined = left.join(right, reduce(lambda a, b: a & b, keys), "left")
    number = F.replace(F.col("c.claimed_value"), F.lit(","), F.lit("")).try_cast("double")
    source = [F.col(f"f.{c}").alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("source_file", "source_row")]
    return joined.select(
        F.col("c.claim_id"),
        F.col("c.metric"),
        F.col("c.claimed_value"),
        F.coalesce("f.value", F.lit("NOT_FOUND")).alias("recomputed_value"),
        F.round(F.abs(number - F.col("f.number")), 6).alias("absolute_difference"),
        scalars.claim_status(F.col("c.claimed_value"), F.col("f.value"), F.col("f.number")).alias("status"),
        *source,
    )


def status_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("status").agg(F.count("*").alias("n_claims"))


def table_mismatches(found: DataFrame, expected: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose values differ between a computed table and the expected one, or that only one side has."""
    a = found.select(*keys, F.struct(*values).alias("found"))
    b = expected.select(*keys, F.struct(*values).alias("expected"))
    return a.join(b, list(keys), "full").filter(~F.col("found").eqNullSafe(F.col("expected")))


def two_source_consistency(first: DataFrame, second: DataFrame, p: str = "p_raw") -> DataFrame:
    """One row: cells in either inference table, cells valid in only one of them, and whether supports agree."""
    a = first.select("series", "horizon", F.col("n").alias("na"), F.col(p).isNotNull().alias("va"))
    b = second.select("series", "horizon", F.col("n").alias("nb"), F.col(p).isNotNull().alias("vb"))
    both = a.join(b, ["series", "horizon"], "full")
    return both.agg(
        F.count("*").alias("cells"),
        F.count_if(~F.col("va").eqNullSafe(F.col("vb"))).alias("validity_mismatches"),
        F.count_if(~F.col("na").eqNullSafe(F.col("nb"))).alias("support_mismatches"),
        F.bool_and(F.coalesce("va", F.lit(False)) & F.coalesce("vb", F.lit(False))).alias("all_cells_valid"),
    )


# Availability classes a predictor may carry, by when its value is known at forecast time.
AVAILABILITY_CLASSES = ("A", "B", "C", "D", "E", "F")


def availability_violations(contract: DataFrame, predictors: DataFrame | Sequence[str]) -> DataFrame:
    """Predictors without a valid availability class. ``contract``: predictor, availability; ``predictors``: names, or a table of them."""
    if isinstance(predictors, DataFrame):
        wanted = predictors.select("predictor").distinct()
    else:
        wanted = contract.sparkSession.createDataFrame([(p,) for p in predictors], "predictor string")
    return wanted.join(contract, "predictor", "left").filter(
        F.col("availability").isNull() | ~F.col("availability").isin(list(AVAILABILITY_CLASSES))
    )


def leakage_violations(feature_times: DataFrame) -> DataFrame:
    """Count of features stamped later than the origin they serve. Columns: series, origin, feature, feature_ts."""
    return feature_times.agg(
        F.count_if(F.col("feature_ts") > F.col("origin")).alias("violations"), F.count("*").alias("checked")
    )
