"""Deduplication, value rules and audits of raw panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import blocks
from tidemark.operators.panel import PanelSpec, with_positions
from tidemark.operators.quantiles import exact_quantiles, quantiles_of_counts
from tidemark.session import stage

# Thresholds of the audit flags and of the usability rule.
MISSING_FLAG_PCT, MAX_FLAG = 5.0, 500.0
USABLE_SHARE, USABLE_JOINT_ROWS = 0.95, 8760
IQR_FACTOR = 1.5


def _ref(name: str) -> Column:
    """Column by its exact name; pollutant names such as PM2.5 hold a dot."""
    return F.col(f"`{name}`")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the first or last in ``order``, which should end in an ingest sequence.

    Written as a min/max aggregate over a struct, which combines map-side: a key repeated in a third of all
    rows still ships one row per input partition.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep}")
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[_ref(c) for c in order])
    pick = F.max_by if keep == "last" else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*[_ref(c) for c in rest]), rank).alias("_row"))
    flat = picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    return flat.select(*[_ref(c) for c in df.columns])


def apply_value_rules(
    panel: DataFrame, column: str = "y", caps: Mapping[str, float] | None = None
) -> DataFrame:
    """Set impossible values to NULL: negatives everywhere, values above the cap of their series. No row drops."""
    return panel.withColumn(column, F.when(~_negative(column) & ~_above_cap(column, caps), _ref(column)))


def value_rule_counts(panel: DataFrame, column: str = "y", caps: Mapping[str, float] | None = None) -> DataFrame:
    """How many values each rule removes, per series."""
    return panel.groupBy("series").agg(
        F.count_if(_negative(column)).alias("n_negative"),
        F.count_if(~_negative(column) & _above_cap(column, caps)).alias("n_above_cap"),
    )


def _negative(column: str) -> Column:
    return F.coalesce(_ref(column) < 0, F.lit(False))


def _above_cap(column: str, caps: Mapping[str, float] | None) -> Column:
    if not caps:
        return F.lit(False)
    # A handful of configured rules: a literal map instead of a join.
    table = F.create_map(*[F.lit(v) for pair in caps.items() for v in pair])
    return F.coalesce(_ref(column) > F.try_element_at(table, F.col("series")), F.lit(False))


def drop_series(panel: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return panel.filter(~F.col("series").isin(list(excluded))) if excluded else panel


def select_series(panel: DataFrame, wanted: Sequence[str], column: str = "series") -> DataFrame:
    return panel.filter(F.trim(F.col(column)).isin(list(wanted)))


def hourly_to_daily(panel: DataFrame, how: str = "mean") -> DataFrame:
    """Daily mean or maximum per series; days without any value are dropped."""
    fold = {"mean": F.avg, "max": F.max}[how]
    return (
        panel.groupBy("series", F.to_date("ts").alias("date")).agg(fold("y").alias("value")).filter("value IS NOT NULL")
    )


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage per column, one row each, worst first."""
    columns = list(columns or df.columns)
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(_ref(c).isNull()).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _ref(c).alias("n_missing")) for c in columns])
    return (
        one.select("_n", F.inline(cells))
        .select("column", "n_missing", (F.try_divide("n_missing", "_n") * 100.0).alias("pct_missing"))
        .orderBy(F.desc("pct_missing"), "column")
    )


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def _long(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), _ref(c).cast("double").alias("value")) for c in columns]
    )
    return panel.select("series", F.inline(cells))


def numeric_profile(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share, negatives, zeros, min, p50/p95/p99, max and interquartile outliers per (series, column).

    All of it comes from one table of values and how often each occurs, so the panel is read once.
    """
    keys = ["series", "column"]
    counts = stage(_long(panel, columns).groupBy(*keys, F.col("value").alias("_v")).agg(F.count("*").alias("_c")), "value-counts")
    quantiles = quantiles_of_counts(
        counts.filter("_v IS NOT NULL"), keys, {"q1": 0.25, "p50": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
    )
    reach = IQR_FACTOR * (F.col("q3") - F.col("q1"))
    outside = (F.col("_v") < F.col("q1") - reach) | (F.col("_v") > F.col("q3") + reach)
    rows = lambda condition: F.sum(F.when(condition, F.col("_c")).otherwise(0))
    return (
        counts.join(quantiles, keys, "left")
        .groupBy(*keys)
        .agg(
            F.round(rows(F.col("_v").isNull()) / F.sum("_c") * 100.0, 3).alias("missing_pct"),
            rows(F.col("_v") < 0).alias("negative_count"),
            rows(F.col("_v") == 0).alias("zero_count"),
            F.round(F.min("_v"), 6).alias("min"),
            F.round(F.max("p50"), 6).alias("p50"),
            F.round(F.max("p95"), 6).alias("p95"),
            F.round(F.max("p99"), 6).alias("p99"),
            F.round(F.max("_v"), 6).alias("max"),
            rows(outside).alias("iqr_outlier_count"),
        )
        .select(*keys, F.lit(True).alias("available"), F.col("missing_pct"), "negative_count", "zero_count", "min",
                "p50", "p95", "p99", "max", "iqr_outlier_count")
    )


def with_absent_columns(profile: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Add an ``available = false`` row for each expected column a series does not have."""
    wanted = profile.select("series").distinct().withColumn(
        "column", F.explode(F.array(*[F.lit(c) for c in expected]))
    )
    return wanted.join(profile, ["series", "column"], "left").withColumn(
        "available", F.coalesce("available", F.lit(False))
    )


def expected_hourly_rows(start: Column, end: Column) -> Column:
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(seconds >= 0, F.floor(seconds / 3600) + 1).otherwise(F.lit(0))


def series_inventory(raw: DataFrame) -> DataFrame:
    """Rows, span, expected hours, coverage, parse failures and duplicates of each series (``ts`` may be NULL).

    Coverage relates all rows, unparsed ones included, to the expected hours; NULL timestamps count as
    repeats of one another.
    """
    per_ts = raw.groupBy("series", "ts").agg(F.count("*").alias("c"))
    found = per_ts.groupBy("series").agg(
        F.sum("c").alias("rows"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("c"))), F.lit(0)).alias("datetime_parse_failures"),
        F.sum(F.col("c") - 1).alias("duplicate_timestamps"),
    )
    hours = F.coalesce(expected_hourly_rows(F.col("start"), F.col("end")), F.lit(0))
    return found.withColumn("expected_hourly_rows", hours).withColumn(
        "hourly_coverage_pct",
        F.round(F.try_divide(F.col("rows"), F.col("expected_hourly_rows")) * 100.0, 3),
    )


def audit_flags(inventory: DataFrame, profile: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``audit_flags`` per series: a ;-joined list of findings, or OK."""
    wide = profile.filter(F.col("column").isin(list(targets))).groupBy("series").agg(
        *[
            F.max(F.when(F.col("column") == t, F.struct("negative_count", "missing_pct", "max"))).alias(f"_{i}")
            for i, t in enumerate(targets)
        ]
    )
    checks = [
        (F.col("datetime_parse_failures") > 0, "datetime_parse_failures"),
        (F.col("duplicate_timestamps") > 0, "duplicate_timestamps"),
    ]
    for i, t in enumerate(targets):
        checks += [
            (F.col(f"_{i}.negative_count") > 0, f"{t}_negative_values"),
            (F.col(f"_{i}.missing_pct") > MISSING_FLAG_PCT, f"{t}_missing_gt_5pct"),
            (F.col(f"_{i}.max") > MAX_FLAG, f"{t}_max_gt_500"),
        ]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    joined = inventory.join(wide, "series", "left")
    return joined.withColumn(
        "audit_flags", F.when(F.size(flags) > 0, F.concat_ws(";", flags)).otherwise(F.lit("OK"))
    ).drop(*[f"_{i}" for i in range(len(targets))])


def _steps(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Seconds between consecutive rows of a series; the first row of a series has none."""
    blocked = panel.select("series", "ts", spec.block(F.col("ts")).alias("_block"))
    inside = Window.partitionBy("series", "_block").orderBy("ts")
    local = blocked.withColumn("_prev", F.lag("ts").over(inside))
    # The first row of a block follows the last row of the block before it.
    ends = blocked.groupBy("series", "_block").agg(F.min("ts").alias("ts"), F.max("ts").alias("_end"))
    before = Window.partitionBy("series").orderBy("_block")
    heads = ends.select("series", "_block", F.lag("_end").over(before).alias("_carry"))
    return (
        local.join(heads, ["series", "_block"])
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
        .select("series", "ts", (F.unix_timestamp("ts") - F.unix_timestamp("_prev")).alias("step_seconds"))
    )


def time_steps(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """``step_seconds`` between neighbouring rows of each series."""
    return _steps(panel, spec)


def validate_time_index(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per series: NULL and repeated timestamps, distinct steps, dominant step, and whether it is the expected one."""
    known = panel.filter("ts IS NOT NULL").groupBy("series", "ts").agg(F.count("*").alias("c"))
    repeats = known.groupBy("series").agg(F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("duplicates"))
    steps = _steps(known.select("series", "ts"), spec).filter("step_seconds IS NOT NULL")
    per_step = steps.groupBy("series", "step_seconds").agg(F.count("*").alias("c"))
    shape = per_step.groupBy("series").agg(
        F.count("*").alias("distinct_steps"),
        F.max_by("step_seconds", F.struct(F.col("c"), -F.col("step_seconds"))).alias("dominant_step"),
    )
    regular = (F.col("distinct_steps") == 1) & (F.col("dominant_step") == spec.step_seconds) & (F.col("duplicates") == 0)
    return repeats.join(shape, "series", "left").withColumn("is_regular", F.coalesce(regular, F.lit(False)))


def station_usability(panel: DataFrame, covariates: Sequence[str], spec: PanelSpec, joint_rows: int = USABLE_JOINT_ROWS) -> DataFrame:
    """Is a series usable: 95 % targets, 95 % of each covariate, enough complete rows, median step of one hour."""
    share = lambda c: F.avg(_ref(c).isNotNull().cast("int"))
    joint = F.lit(True)
    for c in ("y", *covariates):
        joint = joint & _ref(c).isNotNull()
    stats = panel.groupBy("series").agg(
        F.count("*").alias("rows"),
        F.count_if(joint).alias("joint_rows"),
        share("y").alias("y_share"),
        F.least(*[share(c) for c in covariates], F.lit(1.0)).alias("min_covariate_share"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
    )
    steps = exact_quantiles(_steps(panel, spec), ["series"], "step_seconds", {"median_step": 0.5})
    usable = (
        (F.col("y_share") >= USABLE_SHARE)
        & (F.col("min_covariate_share") >= USABLE_SHARE)
        & (F.col("joint_rows") >= joint_rows)
        & (F.col("median_step") == 3600)
    )
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return stats.join(steps, "series", "left").select(
        "series",
        (F.col("y_share") > 0).alias("target_available"),
        (F.col("min_covariate_share") > 0).alias("covariates_available"),
        F.concat(text("start"), F.lit(" to "), text("end")).alias("joint_period"),
        "rows", "joint_rows", "y_share", "min_covariate_share",
        F.coalesce(usable, F.lit(False)).alias("usable"),
    )


def annual_completeness(
    panel: DataFrame,
    strict_years: Sequence[int] = (),
    relaxed: Mapping[int, Sequence[int]] | None = None,
) -> DataFrame:
    """Months present per (series, year) against the policy of that year.

    Strict years need all twelve months. ``relaxed`` years name months that are expected to be absent: the
    others are required, and an excluded month that is present also makes the year incomplete. Other years pass. ``reason`` tells which
    rule let a year be partial, and warns of excluded months that are present; it is empty for strict years.
    """
    relaxed = dict(relaxed or {})
    years = panel.groupBy("series", F.year("ts").alias("year")).agg(
        F.sort_array(F.collect_set(F.month("ts"))).alias("months_found")
    )
    everything = F.sequence(F.lit(1), F.lit(12))
    year = F.col("year")
    excluded = F.array().cast("array<int>")
    for y, months in relaxed.items():
        excluded = F.when(year == y, F.array(*[F.lit(m) for m in months])).otherwise(excluded)
    is_strict = year.isin(list(strict_years)) if strict_years else F.lit(False)
    is_relaxed = year.isin(list(relaxed)) if relaxed else F.lit(False)
    absent = F.array_except(everything, "months_found")
    required = F.array_except(absent, "excluded_months")
    present = F.array_intersect("months_found", "excluded_months")
    complete = F.when(is_strict | is_relaxed, (F.size("missing_required") == 0) & (F.size(present) == 0)).otherwise(F.lit(True))
    message = F.concat(
        F.lit("year="), year.cast("string"), F.lit(": missing months "), F.array_join("missing_required", ",")
    )
    warning = F.when(F.size(present) > 0, F.concat(F.lit("; present all the same: "), F.array_join(present, ","))).otherwise(F.lit(""))
    reason = (
        F.when(is_strict, F.lit(""))
        .when(is_relaxed, F.concat(F.lit("excluded by design: months "), F.array_join("excluded_months", ","), warning))
        .otherwise(F.concat(F.lit("year="), year.cast("string"), F.lit(": no policy, included as it is")))
    )
    return (
        years.withColumn("excluded_months", excluded)
        .withColumn("missing_required", required)
        .withColumn("months_missing", F.when(is_strict | is_relaxed, absent).otherwise(F.array().cast("array<int>")))
        .withColumn("complete", complete)
        .withColumn("partial_year_allowed", ~is_strict)
        .withColumn("reason", reason)
        .withColumn("error", F.when((is_strict | is_relaxed) & (F.size("missing_required") > 0), message))
        .drop("missing_required")
    )


def describe_target(panel: DataFrame) -> DataFrame:
    """n, mean, sample sd and p95 of the known targets of each series."""
    p95 = exact_quantiles(panel, ["series"], "y", {"p95": 0.95})
    return (
        panel.groupBy("series")
        .agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))
        .join(p95, "series", "left")
    )


def lag1_autocorrelation(panel: DataFrame, spec: PanelSpec, chunk_rows: int = 4096) -> DataFrame:
    """Correlation of each known target with the previous known one; NULLs are dropped first, closing gaps."""
    known = with_positions(panel.filter("y IS NOT NULL").select("series", "ts", "y"), spec, fill=False)
    halo = blocks.with_halo(known, "pos", 1, 0, chunk_rows)
    pairs = blocks.owned(halo.withColumn("_prev", F.lag("y").over(blocks.chunk_window(["series"], "pos"))))
    return pairs.groupBy("series").agg(F.count("y").alias("n"), F.corr("y", "_prev").alias("rho1"))


def setup_report(panel: DataFrame, raw: DataFrame, caps: Mapping[str, float] | None = None,
                 excluded: Sequence[str] = ()) -> DataFrame:
    """Per series: status, rows kept, period, missing share and how many values each rule removed."""
    counts = value_rule_counts(raw, "y", caps)
    kept = panel.groupBy("series").agg(
        F.count("*").alias("rows_included"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        (F.avg(F.col("y").isNull().cast("int")) * 100.0).alias("missing_pct"),
    )
    out = counts.join(kept, "series", "left")
    status = F.when(F.col("series").isin(list(excluded)), F.lit("excluded")) if excluded else F.lit(None)
    return out.withColumn("status", F.coalesce(status, F.lit("included"))).withColumn(
        "rows_included", F.coalesce("rows_included", F.lit(0))
    )


def join_covariates(target: DataFrame, covariates: DataFrame | None, keys: Sequence[str] = ("series", "ts"), how: str = "left") -> DataFrame:
    """Join covariates one-to-one. A key that occurs twice on either side fails the job."""
    if covariates is None:
        return target
    left = target.groupBy(*keys).agg(
        F.count("*").alias("_nl"), F.first(F.struct(*[_ref(c) for c in target.columns if c not in keys])).alias("_l")
    )
    right = covariates.groupBy(*keys).agg(
        F.count("*").alias("_nr"), F.first(F.struct(*[_ref(c) for c in covariates.columns if c not in keys])).alias("_r")
    )
    twice = F.raise_error(F.lit("the join keys are not unique")).cast("boolean")
    checked = left.join(right, list(keys), how).filter(
        F.when((F.coalesce("_nl", F.lit(1)) > 1) | (F.coalesce("_nr", F.lit(1)) > 1), twice).otherwise(F.lit(True))
    )
    return checked.select(*keys, "_l.*", "_r.*")
