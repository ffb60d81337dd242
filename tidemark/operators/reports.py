"""Report tables over metrics, skill horizons and tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.student import two_sided_p
from tidemark.operators.quantiles import exact_quantiles

METRICS = ("rmse", "mae", "skill_rmse_vs_persistence", "skill_mae_vs_persistence")
FIDELITY = ("skill_h", "phi_h", "r_h", "beta_h", "kge_h")


def wide_by_horizon(metrics: DataFrame, horizon: int, values: Sequence[str] = METRICS,
                    by: Sequence[str] = ("series", "model", "condition")) -> DataFrame:
    """One column per metric and horizon (``<metric>_h<n>``); the horizon list is given, so no extra pass."""
    wide = metrics.groupBy(*by).pivot("horizon", list(range(1, horizon + 1))).agg(*[F.first(v).alias(v) for v in values])
    return wide.select(
        *by, *[F.col(f"{h}_{v}").alias(f"{v}_h{h}") if len(values) > 1 else F.col(str(h)).alias(f"{v}_h{h}")
               for v in values for h in range(1, horizon + 1)]
    )


def delta_table(
    metrics: DataFrame, arm_a: Column, arm_b: Column, names: tuple[str, str] = ("a", "b"),
    on: Sequence[str] = ("series", "horizon"), values: Sequence[str] = METRICS,
) -> DataFrame:
    """Both arms side by side and b - a for each metric, on keys present in both; one grouped pass."""
    a, b = names
    both = metrics.filter(arm_a | arm_b).groupBy(*on).agg(
        F.count_if(arm_a).alias("_na"), F.count_if(arm_b).alias("_nb"),
        *[F.max(F.when(arm_a, F.col(v))).alias(f"{v}_{a}") for v in values],
        *[F.max(F.when(arm_b, F.col(v))).alias(f"{v}_{b}") for v in values],
    )
    return both.filter("_na > 0 AND _nb > 0").drop("_na", "_nb").withColumns(
        {f"delta_{v}": F.col(f"{v}_{b}") - F.col(f"{v}_{a}") for v in values}
    )


def hstar_wide(hstar: DataFrame, arm_a: Column, arm_b: Column, names: tuple[str, str] = ("a", "b"),
               values: Sequence[str] = ("H_star_relax", "H_star_strict"), by: Sequence[str] = ("series",)) -> DataFrame:
    """Skill horizons of the two arms per series and their difference b - a."""
    return delta_table(hstar, arm_a, arm_b, names, on=by, values=values)


def mean_delta(deltas: DataFrame, value: str) -> DataFrame:
    return deltas.agg(F.avg(value).alias(f"mean_{value}"), F.count(value).alias("n_series"))


def horizon_persistence_table(hstar_deltas: DataFrame, rho1: DataFrame, delta: str = "delta_H_star_strict") -> DataFrame:
    """Memory of a series (lag-1 autocorrelation) next to its change in skill horizon, strongest memory first."""
    return hstar_deltas.join(rho1.select("series", "rho1"), "series", "left").orderBy(F.desc("rho1"), "series")


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over rows with both values, r, and its two-sided p with n - 2 degrees of freedom."""
    fit = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
    )
    return fit.withColumn("p_value", correlation_p(F.col("r"), F.col("n")))


def correlation_p(r: Column, n: Column) -> Column:
    t = r * F.sqrt(F.try_divide(n - 2, F.lit(1.0) - r * r))
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(two_sided_p(t, n - 2))


def dm_direction(dm: DataFrame, deltas: DataFrame, delta: str = "delta_skill_rmse_vs_persistence") -> DataFrame:
    """Tests joined to the skill delta of their cell: direction and significance class."""
    joined = dm.join(deltas.select("series", "horizon", F.col(delta).alias("_delta")), ["series", "horizon"], "left")
    return joined.withColumn("delta", F.coalesce("_delta", F.lit(0.0))).withColumn(
        "cell_class", scalars.significance_class(F.col("p_value"), F.col("_delta"))
    ).drop("_delta")


def cross_series_profile(metrics: DataFrame, value: str = "skill_rmse_vs_persistence",
                         by: Sequence[str] = ("condition", "model", "horizon")) -> DataFrame:
    """Mean and sample sd of a metric over series."""
    return metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n_series")
    )


def median_profile(master: DataFrame, values: Sequence[str] = ("skill_h", "phi_h", "kge_h"),
                   by: Sequence[str] = ("condition", "model", "horizon")) -> DataFrame:
    """Median over series of each metric; all metrics go through one quantile pass."""
    return _medians(master, values, by)


def _medians(df: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(v).alias("_m"), F.col(v).cast("double").alias("_x")) for v in values])
    long = df.select(*by, F.inline(cells))
    med = exact_quantiles(long, [*by, "_m"], "_x", {"_q": 0.5})
    keys = df.select(*by).distinct()
    wide = med.groupBy(*by).agg(*[F.max(F.when(F.col("_m") == v, F.col("_q"))).alias(f"median_{v}") for v in values])
    return keys.join(wide, list(by), "left")


def fidelity_deltas(master: DataFrame, arm_a: Column, arm_b: Column) -> DataFrame:
    """b - a of every fidelity metric per (series, horizon), and of the distance of phi from 1."""
    wide = delta_table(master, arm_a, arm_b, ("a", "b"), values=FIDELITY)
    closer = F.abs(F.col("phi_h_b") - 1) - F.abs(F.col("phi_h_a") - 1)
    return wide.select("series", "horizon", *[F.col(f"delta_{m}").alias(m) for m in FIDELITY], closer.alias("phi_distance"))


def median_deltas(deltas: DataFrame, by: str) -> DataFrame:
    """Median of each delta by ``horizon`` or by ``series``."""
    return _medians(deltas, [*FIDELITY, "phi_distance"], [by])


def sign_counts(deltas: DataFrame) -> DataFrame:
    """One row: how many horizons and series gain in the median, and the skill-without-fidelity patterns."""
    def gains(by: str, prefix: str) -> DataFrame:
        return median_deltas(deltas, by).agg(
            F.count("*").alias(f"n_{prefix}"),
            F.count_if(F.col("median_skill_h") > 0).alias(f"skill_positive_{prefix}"),
            F.count_if(F.col("median_kge_h") > 0).alias(f"kge_positive_{prefix}"),
            F.count_if(F.col("median_phi_distance") < 0).alias(f"phi_closer_{prefix}"),
        )

    small_phi = F.abs(F.col("phi_h")) < 0.01
    patterns = deltas.agg(
        F.count_if((F.col("skill_h") > 0) & small_phi & (F.col("kge_h") <= 0)).alias("skill_without_fidelity"),
        F.count_if(((F.col("r_h") > 0) | (F.col("kge_h") > 0)) & small_phi).alias("fidelity_without_phi"),
    )
    # Three one-row results, brought together on a constant key.
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(gains("horizon", "horizons")).join(one(gains("series", "series")), "_k").join(one(patterns), "_k").drop("_k")


def decision(counts: DataFrame) -> DataFrame:
    """Verdict on the second arm from the sign counts."""
    skill, kge, n = F.col("skill_positive_series"), F.col("kge_positive_series"), F.col("n_series")
    verdict = (
        F.when((skill == n) & (kge == n), F.lit("go: accuracy and fidelity improve"))
        .when((skill > 0) & ((kge > 0) | (F.col("kge_positive_horizons") > 0)), F.lit("go: accuracy improves, fidelity is mixed"))
        .otherwise(F.lit("hold: no consistent gain"))
    )
    return counts.withColumn("verdict", verdict)


def delta_summary(deltas: DataFrame, value: str = "delta_skill_rmse_vs_persistence") -> DataFrame:
    """Mean delta per series with the number of horizons that gain and lose."""
    return deltas.groupBy("series").agg(
        F.avg(value).alias("mean_delta"),
        F.count_if(F.col(value) > 0).alias("n_positive"),
        F.count_if(F.col(value) < 0).alias("n_negative"),
    )
