"""Published values, typed in, and small exact cases."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import near
from tidemark.functions import scalars
from tidemark.functions.student import two_sided_p
from tidemark.operators import inference, metrics, qa, reports


def skills(spark, positive, model="m", horizon=24):
    rows = [("s", "c", model, h, 0.1 if h in positive else -0.1) for h in range(1, horizon + 1)]
    return spark.createDataFrame(rows, "series string, condition string, model string, horizon int, skill_rmse_vs_persistence double")


# Published statistics.
P_CASES = [(1.16901717167, 354, 0.243185513423), (2.65199344286, 346, 0.0083712676589)]
BH_P = [0.243185513423, 0.960048198833, 0.0083712676589, 0.345845904128]
BH_ADJUSTED = [0.461127872171, 0.960048198833, 0.0334850706356, 0.461127872171]
Q_CASES = {354: 5, 211: 4, 145: 4}


def test_student_p(spark):
    df = spark.createDataFrame([(t, n) for t, n, _ in P_CASES], "t double, n int")
    got = [r.p for r in df.select(two_sided_p(F.col("t"), F.col("n") - 1).alias("p")).collect()]
    assert all(near(a, b, 1e-9) for a, (_, _, b) in zip(got, P_CASES))


def test_student_p_of_many_degrees_of_freedom(spark):
    # So many that the distribution is normal to nine places, up to its first correction.
    rows = spark.createDataFrame([(t, n) for t in (0.0, 0.3, 1.96, 4.0, 9.0) for n in (10**6, 2 * 10**7, 2**40)], "t double, n long")
    for r in rows.select("t", "n", two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        normal = math.erfc(r.t / math.sqrt(2))
        density = math.exp(-r.t * r.t / 2) / math.sqrt(2 * math.pi)
        assert abs(r.p - (normal + 2 * density * (r.t**3 + r.t) / (4 * r.n))) < 1e-9


@pytest.mark.parametrize("df", [1, 2, 3, 4])
def test_student_p_small_df(spark, df):
    # Closed forms of the central probability.
    t = 1.7
    central = {
        1: 2 / math.pi * math.atan(t),
        2: t / math.sqrt(2 + t * t),
        3: 2 / math.pi * (math.atan(t / math.sqrt(3)) + (t / math.sqrt(3)) / (1 + t * t / 3)),
        4: (t / math.sqrt(4 + t * t)) * (1 + 0.5 * 4 / (4 + t * t)),
    }[df]
    got = spark.range(1).select(two_sided_p(F.lit(-t), F.lit(df)).alias("p")).first().p
    assert near(got, 1 - central, 1e-12)


def test_bh_and_bonferroni(spark):
    df = spark.createDataFrame([("s", h, p) for h, p in zip((1, 6, 12, 24), BH_P)], "series string, horizon int, p_value double")
    got = {r.horizon: r for r in inference.benjamini_hochberg(inference.bonferroni(df)).collect()}
    for h, want in zip((1, 6, 12, 24), BH_ADJUSTED):
        assert near(got[h].p_bh_series, want, 1e-9)
    assert got[12].bh_series_reject and not got[1].bh_series_reject
    family = spark.createDataFrame(
        [(f"s{i}", 1, 0.5) for i in range(34)] + [("a", 1, BH_P[0]), ("a", 12, BH_P[2])], "series string, horizon int, p_value double"
    )
    adj = {(r.series, r.horizon): r.p_bonferroni for r in inference.bonferroni(family).collect()}
    assert near(adj[("a", 12)], 0.30136563572, 1e-9) and adj[("a", 1)] == 1.0


def test_bandwidth_and_factor(spark):
    df = spark.createDataFrame([(n,) for n in Q_CASES], "n int")
    assert {r.n: r.q for r in df.select("n", scalars.automatic_bandwidth(F.col("n")).alias("q")).collect()} == Q_CASES
    assert near(1.17067183233 * math.sqrt(353 / 354), 1.16901717167, 1e-9)


@pytest.mark.parametrize("positive,from_h1,max_run,relax", [
    ({1, *range(3, 20), 24}, 1, 17, 24),
    ({*range(1, 8), *range(9, 25)}, 7, 16, 24),
    (set(), 0, 0, 0),
    (set(range(1, 25)), 24, 24, 24),
])
def test_hstar_definitions(spark, positive, from_h1, max_run, relax):
    r = metrics.skill_horizons(skills(spark, positive), 24).first()
    assert (r.H_strict_from_h1, r.H_strict_max_run, r.H_relax) == (from_h1, max_run, relax)
    assert r.censored == (max_run == 24)


def test_hstar_missing_horizon_and_baseline(spark):
    broken = skills(spark, set(range(1, 25))).filter("horizon <> 5")
    r = metrics.skill_horizons(broken, 24).first()
    assert (r.H_strict_from_h1, r.H_strict_max_run) == (4, 19)
    r = metrics.skill_horizons(skills(spark, {1, 2}, "persistence"), 24).first()
    assert (r.H_strict_max_run, r.H_relax) == (0, 0)


def test_skill_value(spark):
    rows = [("s", "r", "persistence", 1, 5, 1.0, 5.081816482032989), ("s", "c", "m", 1, 5, 1.0, 5.111287696592806)]
    m = spark.createDataFrame(rows, "series string, condition string, model string, horizon int, n_eval long, mae double, rmse double")
    got = {r.model: r.skill_rmse_vs_persistence for r in metrics.attach_skill(m).collect()}
    assert near(got["m"], -0.005799346486440982, 1e-12) and got["persistence"] is None
    zero = {r.model: r.skill_rmse_vs_persistence for r in metrics.attach_skill(m, own_skill="zero").collect()}
    assert zero["persistence"] == 0.0


def test_strict_skill_rejects_bad_baseline(spark):
    with pytest.raises(Exception, match="must be positive"):
        spark.range(1).select(scalars.strict_skill(F.lit(1.0), F.lit(0.0))).collect()
    with pytest.raises(ValueError):
        scalars.loss(F.lit(1.0), F.lit(1.0), "huber")


def test_regression_p(spark):
    got = spark.range(1).select(reports.correlation_p(F.lit(0.554715), F.lit(9)).alias("p")).first().p
    assert near(got, 0.121110, 1e-5)


def test_expected_hours(spark):
    from tidemark.operators.quality import expected_hourly_rows

    ts = lambda s: F.lit(s).cast("timestamp")
    n = spark.range(1).select(expected_hourly_rows(ts("2020-09-04 00:00:00"), ts("2023-08-01 00:00:00")).alias("n")).first().n
    assert n == 25465


def make_pairs(spark, values):
    import datetime as dt

    rows = [("s", 6, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, horizon int, origin timestamp, d double")


def brute_dm(d, q, hd, bartlett):
    n = len(d)
    m = sum(d) / n
    e = [x - m for x in d]
    omega = sum(x * x for x in e) / n
    for k in range(1, q + 1):
        omega += 2 * (1 - k / (q + 1) if bartlett else 1) * sum(e[i] * e[i - k] for i in range(k, n)) / n
    return m / math.sqrt(omega / n) * math.sqrt((n + 1 - 2 * hd + hd * (hd - 1) / n) / n)


@pytest.mark.parametrize("chunk,days", [(5, 3), (2048, 512)])
@pytest.mark.parametrize("rule", ["legacy", "overlap", "bartlett"])
def test_dm_chunks(spark, rule, chunk, days):
    import random

    random.seed(4)
    d = [random.gauss(0.4, 1) for _ in range(150)]
    got = inference.diebold_mariano(make_pairs(spark, d), rule, 24, block_seconds=days * 86400, chunk_rows=chunk).first()
    q, hd = {"legacy": (5, 6), "overlap": (0, 1), "bartlett": (4, 1)}[rule]
    assert got.q == q and near(got.dm_stat, brute_dm(d, q, hd, rule == "bartlett"), 1e-9)
    assert got.favours == "b"


def test_dm_guards(spark):
    few = inference.diebold_mariano(make_pairs(spark, range(9)), "overlap").first()
    assert few.favours == "undetermined" and few.mean_loss_diff is None and few.n == 9
    flat = inference.diebold_mariano(make_pairs(spark, [2.0] * 12), "overlap").first()
    assert flat.favours == "undetermined" and flat.mean_loss_diff == 2.0 and flat.dm_stat is None
    with pytest.raises(Exception, match="bandwidth above"):
        inference.diebold_mariano(make_pairs(spark, range(30)), "legacy", max_lag=3).collect()


def test_pairs_reject_repeats(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    row = ("s", t, t, 1, "r", "a", 1.0, 2.0)
    led = spark.createDataFrame([row, row], "series string, origin timestamp, forecast_timestamp timestamp, horizon int, condition string, model string, y_true double, y_pred double")
    with pytest.raises(Exception, match="occurs twice"):
        inference.paired_losses(led, F.col("model") == "a", F.col("model") == "b").collect()


def test_claims(spark):
    claims = spark.createDataFrame(
        [("1", "h", "A", "c", "17"), ("2", "h", "A", "d", "1,000"), ("3", "h", "A", "e", "23/8/1"), ("4", "h", "B", "c", "1"), ("5", "h", "A", "f", "30")],
        "claim_id string, metric string, series string, condition string, claimed_value string",
    )
    found = spark.createDataFrame(
        [("h", "a", "c", "17", 17.0), ("h", "a", "d", "1009", 1009.0), ("h", "a", "e", "23/8/1", None), ("h", "a", "f", "35", 35.0)],
        "metric string, series string, condition string, value string, number double",
    )
    got = {r.claim_id: r.status for r in qa.reconcile_claims(claims, found, {"A": "a"}).collect()}
    assert got == {"1": "MATCH", "2": "ROUNDING_MATCH", "3": "MATCH", "4": "SOURCE_NOT_FOUND", "5": "MISMATCH"}


# Published mean skill horizons and test directions over eight series.
def test_mean_delta(spark):
    only, meteo = [24, 22, 24, 24, 24, 16, 17, 24], [24, 23, 24, 24, 24, 16, 24, 24]
    rows = [(f"s{i}", c, "m", v) for c, vs in (("o", only), ("w", meteo)) for i, v in enumerate(vs)]
    h = spark.createDataFrame(rows, "series string, condition string, model string, H_star_strict int")
    wide = reports.hstar_wide(h, F.col("condition") == "o", F.col("condition") == "w", ("o", "w"), ("H_star_strict",))
    assert reports.mean_delta(wide, "delta_H_star_strict").first()[0] == 1.0
    assert near(sum(only) / 8, 21.875) and near(sum(meteo) / 8, 22.875)
