"""Paired tests of predictive accuracy and their multiplicity control."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars
from tidemark.functions.student import two_sided_p
from tidemark.operators import blocks
from tidemark.session import stage

CELL = ("series", "horizon")
MIN_PAIRS = 10


def paired_losses(
    ledger: DataFrame, arm_a: Column, arm_b: Column, horizons: Sequence[int] | None = None,
    kind: str = "squared_error",
) -> DataFrame:
    """Loss differentials d = L(a) - L(b) per (series, horizon, origin), positive where b is better.

    ``arm_a`` and ``arm_b`` are row conditions. Pairs are matched by key in one grouped pass; a key that holds
    an arm twice fails the job, keys lacking an arm or a value are dropped.
    """
    rows = ledger.filter(arm_a | arm_b)
    if horizons is not None:
        rows = rows.filter(F.col("horizon").isin(list(horizons)))
    keys = ["series", "horizon", "origin", "forecast_timestamp"]
    pairs = rows.groupBy(*keys).agg(
        F.count_if(arm_a).alias("_na"),
        F.count_if(arm_b).alias("_nb"),
        F.max(F.when(arm_a, F.col("y_true"))).alias("y_true"),
        F.max(F.when(arm_a, F.col("y_pred"))).alias("y_pred_a"),
        F.max(F.when(arm_b, F.col("y_pred"))).alias("y_pred_b"),
    )
    twice = F.raise_error(F.lit("a forecast key occurs twice in one arm")).cast("boolean")
    pairs = pairs.filter(F.when((F.col("_na") > 1) | (F.col("_nb") > 1), twice).otherwise(
        (F.col("_na") == 1) & (F.col("_nb") == 1)
    ))
    d = scalars.loss(F.col("y_true"), F.col("y_pred_a"), kind) - scalars.loss(F.col("y_true"), F.col("y_pred_b"), kind)
    return pairs.dropna(subset=["y_true", "y_pred_a", "y_pred_b"]).select(
        *keys, "y_true", "y_pred_a", "y_pred_b", d.alias("d")
    )


def cells_by_series(ledger: DataFrame, arm_a: Column, arm_b: Column, horizons: Sequence[int]) -> DataFrame:
    """All tested cells: series that hold both arms, times the tested horizons."""
    return (
        ledger.groupBy("series").agg(F.max(arm_a).alias("_a"), F.max(arm_b).alias("_b"))
        .filter(F.col("_a") & F.col("_b"))
        .select("series", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    )


def diebold_mariano(
    pairs: DataFrame,
    rule: str = "overlap",
    stride: int = 24,
    names: tuple[str, str] = ("a", "b"),
    cells: DataFrame | None = None,
    max_lag: int | None = None,
    tiny: float = 0.0,
    block_seconds: int = 24 * 3600 * 512,
    chunk_rows: int = 2048,
) -> DataFrame:
    """Equal-accuracy test per (series, horizon) with the small-sample factor, against t(n-1).

    ``rule`` selects the long-run variance of d and the lead time h_dm of the small-sample factor:

    * ``"legacy"``: unweighted autocovariances 1..h-1, h_dm = h;
    * ``"overlap"``: q = max(0, ceil(h/stride) - 1) unweighted, h_dm = ceil(h/stride);
    * ``"bartlett"``: q = floor(4 (n/100)^(2/9)) with weights 1 - k/(q+1), h_dm = ceil(h/stride).

    Fewer than ten pairs give NULL throughout; a variance that is not positive gives NULL for the statistic
    only, and so does one that is not above ``tiny`` times the plain variance. With q >= n-1 the unweighted sum is zero by
    identity and counts as such. Origins are numbered in blocks and lagged products computed in chunks with a halo, so a cell may
    hold any number of origins. The halo reaches as far as the largest bandwidth found in the data; with none above zero there
    is no lagged pass. A given ``max_lag`` bounds it instead, and a cell that needs more fails the job.
    ``cells`` adds tested cells for which no pair exists.
    """
    if rule not in ("legacy", "overlap", "bartlett"):
        raise ValueError(f"unknown variance rule: {rule}")
    keys = list(CELL)
    n, h = F.col("n"), F.col("horizon")
    stats = pairs.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean_loss_diff"))
    steps = h if rule == "legacy" else scalars.lead_steps(h, stride)
    q = {
        "legacy": h - 1,
        "overlap": scalars.overlap_bandwidth(h, stride),
        "bartlett": scalars.automatic_bandwidth(n),
    }[rule].cast("int")
    if max_lag is None:
        max_lag = int(stats.agg(F.max(F.least(q, n.cast("int") - 1))).first()[0] or 0)  # one number
    else:
        q = F.when(q <= max_lag, q).otherwise(F.raise_error(F.lit(f"bandwidth above max_lag={max_lag}")).cast("int"))
    stats = stats.withColumns({"q": q, "h_dm": steps.cast("int")})

    if max_lag <= 0:
        variance = pairs.join(stats.select(*keys, "mean_loss_diff"), keys).groupBy(*keys).agg(
            F.sum((F.col("d") - F.col("mean_loss_diff")) * (F.col("d") - F.col("mean_loss_diff"))).alias("_s0"), F.lit(0.0).alias("_sq"))
    else:
        variance = _lagged_products(pairs, stats, rule, max_lag, block_seconds, chunk_rows)

    tested = stats.join(variance, keys)
    if cells is not None:
        tested = cells.join(tested, keys, "left").fillna(0, subset=["n"])
    omega = (F.col("_s0") + 2.0 * F.col("_sq")) / n
    enough = n >= MIN_PAIRS
    valid = enough & (omega > tiny * F.col("_s0") / n)
    if rule != "bartlett":
        valid = valid & ((F.col("q") <= 0) | (F.col("q") < n - 1))
    raw = F.when(valid, F.col("mean_loss_diff") / F.sqrt(omega / n))
    hd = F.col("h_dm")
    factor = F.sqrt((n + 1 - 2 * hd + hd * (hd - 1) / n) / n)
    out = tested.withColumn("dm_raw", raw).withColumn("dm_stat", F.col("dm_raw") * factor)
    return out.select(
        *keys,
        "n",
        "q",
        F.when(enough, F.col("mean_loss_diff")).alias("mean_loss_diff"),
        "dm_raw",
        "dm_stat",
        two_sided_p(F.col("dm_stat"), n - 1).alias("p_value"),
        F.when(~valid | valid.isNull(), F.lit("undetermined"))
        .when(F.col("mean_loss_diff") > 0, F.lit(names[1]))
        .otherwise(F.lit(names[0]))
        .alias("favours"),
    )


def _lagged_products(pairs: DataFrame, stats: DataFrame, rule: str, max_lag: int, block_seconds: int, chunk_rows: int) -> DataFrame:
    """Sums of squares and of weighted lagged products of the centred differentials per cell."""
    keys = list(CELL)
    numbered = blocks.scan(
        pairs.select(*keys, "origin", "d").withColumn("_block", F.floor(F.unix_timestamp("origin") / block_seconds)),
        keys, "_block", ["origin"], sums={"_pos": F.lit(1).cast("long")},
    ).join(stats.select(*keys, "q", "mean_loss_diff"), keys)
    centred = numbered.select(*keys, "q", (F.col("_pos") - 1).alias("_pos"), (F.col("d") - F.col("mean_loss_diff")).alias("e"))
    halo = blocks.with_halo(centred, "_pos", max_lag, 0, chunk_rows)
    w = blocks.chunk_window(keys, "_pos").rowsBetween(-max_lag, -1)
    earlier = F.slice(F.reverse(F.collect_list("e").over(w)), F.lit(1), F.greatest(F.col("q"), F.lit(0)))
    weight = (lambda k: F.lit(1.0) - (k + 1) / (F.col("q") + 1.0)) if rule == "bartlett" else (lambda k: F.lit(1.0))
    lagged = F.aggregate(
        F.transform("_earlier", lambda v, k: v * weight(k)), F.lit(0.0), lambda acc, v: acc + v
    )
    products = blocks.owned(halo.withColumn("_earlier", earlier)).select(
        *keys, (F.col("e") * F.col("e")).alias("_own2"), (F.col("e") * lagged).alias("_cross")
    )
    return products.groupBy(*keys).agg(F.sum("_own2").alias("_s0"), F.sum("_cross").alias("_sq"))


def bonferroni(cells: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """min(1, m p) with m = number of valid tests in the whole table."""
    family = cells.agg(F.count(p)).scalar()
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * family))
    return cells.withColumn("p_bonferroni", adjusted).withColumn("bonferroni_reject", F.col("p_bonferroni") < alpha)


def benjamini_hochberg(
    cells: DataFrame, p: str = "p_value", family: Sequence[str] = ("series",), alpha: float = 0.05
) -> DataFrame:
    """Step-up adjusted p-values inside each family (a family holds one series' horizons)."""
    valid = F.col(p).isNotNull()
    whole = Window.partitionBy(*family, valid)
    by_p = whole.orderBy(p, "horizon")
    m, rank = F.count(p).over(whole), F.row_number().over(by_p)
    ranked = cells.withColumn("_scaled", F.when(valid, F.least(F.lit(1.0), F.col(p) * m / rank)))
    upward = F.min("_scaled").over(by_p.rowsBetween(0, Window.unboundedFollowing))
    return (
        ranked.withColumn("p_bh_series", F.when(valid, upward))
        .drop("_scaled")
        .withColumn("bh_series_reject", F.col("p_bh_series") < alpha)
    )


def inference_table(dm: DataFrame, specification: str) -> DataFrame:
    """Cell-level table: raw and adjusted p-values, decisions and the dependence rule they rest on."""
    return benjamini_hochberg(bonferroni(dm)).select(
        "series", "horizon", "n", "mean_loss_diff", F.col("dm_raw").alias("dm_stat"),
        F.col("dm_stat").alias("dm_hln_stat"), "q", F.col("p_value").alias("p_raw"), "p_bonferroni",
        "bonferroni_reject", "p_bh_series", "bh_series_reject",
        F.lit(specification).alias("dependence_specification"),
    )


def inference_summary(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Counts of valid tests and of rejections, with the cells that survive the step-up procedure."""
    return cells.agg(
        F.count("p_raw").alias("valid"),
        F.count_if(F.col("p_raw") < alpha).alias("raw_lt_alpha"),
        F.count_if("bonferroni_reject").alias("bonferroni_reject"),
        F.count_if("bh_series_reject").alias("bh_series_reject"),
    )


def surviving_cells(cells: DataFrame) -> DataFrame:
    """The rejected cells themselves, as rows rather than one collected list."""
    return cells.filter("bh_series_reject").select("series", "horizon")


def outcome_counts(dm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return dm.groupBy(*by, "favours").agg(F.count("*").alias("n_cells"))


# --- bootstrap ---------------------------------------------------------------------------------------------

#: Cumulative Poisson(1) probabilities that turn a uniform draw into a weight, as far as a 32-bit draw can tell them from 1.
POISSON_CDF = tuple(c for c in (sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(20)) if c < 1 - 2.0**-33)


def bootstrap_skill(
    ledger: DataFrame, model: Column, baseline: Column, by: Sequence[str] = ("condition", "horizon"),
    replicates: int = 200, level: float = 0.95, seed: int = 7,
) -> DataFrame:
    """Percentile interval of RMSE skill per (condition, horizon), resampling origins.

    Each replicate gives every origin a Poisson(1) weight drawn from a hash of (seed, replicate, origin), so
    the result does not depend on partitioning. Squared errors are first summed per origin and cell. The weights of an origin are drawn once,
    as one array of ``replicates`` small numbers, and joined to its cells; weighted sums per cell and replicate combine
    map-side, so nothing grows with the cells of an origin, however many there are (series, for instance).
    """
    cond = [c for c in by if c != "condition"]
    error2 = F.pow(F.col("y_true") - F.col("y_pred"), 2)
    per_origin = ledger.filter(model).groupBy(*by, "origin").agg(
        F.sum(error2).alias("sm"), F.count(error2).alias("nm")
    )
    base = ledger.filter(baseline).groupBy(*cond, "origin").agg(F.sum(error2).alias("sb"), F.count(error2).alias("nb"))
    sums = ("sm", "nm", "sb", "nb")
    cells = stage(per_origin.join(base, [*cond, "origin"]), "origin-sums")
    stamp = F.date_format("origin", "yyyyMMddHHmmss")

    def uniform(rep: Column) -> Column:
        digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), stamp).cast("binary")), 1, 8)
        return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)

    weight = lambda u: sum(((u >= c).cast("int") for c in POISSON_CDF), F.lit(0))
    draws = cells.select("origin").distinct().withColumn("_w", F.transform(F.transform(F.sequence(F.lit(1), F.lit(replicates)), uniform), weight))
    weighted = cells.join(draws, "origin").select(*by, *sums, F.posexplode("_w").alias("rep", "w")).filter("w > 0")
    sums = weighted.groupBy(*by, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])
    rmse = lambda s, n: F.sqrt(F.try_divide(s, n))
    skills = sums.withColumn("skill", scalars.skill(rmse("sm", "nm"), rmse("sb", "nb")))
    tail = (1 - level) / 2
    # One buffer holds ``replicates`` numbers, a fixed count.
    return skills.groupBy(*by).agg(
        F.avg("skill").alias("skill_mean"),
        F.percentile("skill", F.lit(tail)).alias("ci_lower"),
        F.percentile("skill", F.lit(1 - tail)).alias("ci_upper"),
    )
