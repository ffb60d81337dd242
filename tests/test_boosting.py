"""Boosted trees that grow side by side: the same as Spark's regressor one by one, whatever the tasks, in jobs that do not multiply by models."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from helpers import random_panel, to_spark
from tidemark.operators import boosting
from tidemark.operators.origins import BacktestSpec
from tidemark.operators.panel import PanelSpec
from tidemark.plans import backtest
from tidemark.session import stage


def test_trees_are_those_of_sparks_regressor(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (500, 4))
    t = np.c_[x[:, 0] * 2.0 - (x[:, 1] > 3) * x[:, 2] + rng.normal(0, 1, 500), np.sin(x[:, 3]) * 5 + rng.normal(0, 1, 500)]
    rows = [(i, [int(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, t))]
    table = stage(spark.createDataFrame(rows, "mark long, x array<int>, t array<double>"), "rows")
    growth = boosting.Growth(2, np.ones((2, 4), bool), 8, 3, 1.0, 1.0, 2.0**26)
    packed = stage(table.repartition(3, "mark").mapInArrow(boosting._pack, "mark binary, x binary, t binary"), "packed")
    forest = boosting._grow(packed, growth, 7, 0.3)  # more trees than are added to the rows at once
    found = sum(boosting._leaves(np.ascontiguousarray(x.T.astype(np.uint8)), tree, 8) for tree in forest)
    columns = table.select("mark", *[F.col("x")[i].cast("double").alias(f"x{i}") for i in range(4)], "t")
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="v").transform(columns)
    for m in range(2):
        model = GBTRegressor(featuresCol="v", labelCol="y", maxIter=7, maxDepth=3, stepSize=0.3, maxBins=8, seed=1).fit(vectors.withColumn("y", F.col("t")[m]))
        wanted = [r.prediction for r in model.transform(vectors).orderBy("mark").collect()]
        assert np.abs(found[m] - wanted).max() < 1e-6


def test_jobs_do_not_multiply_by_models_and_tasks_change_nothing(spark):
    spec = BacktestSpec(horizon=3, stride=10, test_start="2024-01-16 00:00:00", test_end="2024-01-22 00:00:00", lags=(1, 2), covariates=("x",))
    rows = stage(backtest.prepare(to_spark(spark, random_panel(rows=700, missing=0.02)), PanelSpec(3600, covariates=("x",)), spec), "t")

    def run(parts, trees):
        group = f"boosting-{parts}-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        told = sorted(map(str, boosting.boosted_direct(rows, spec, 100, trees=trees, depth=3, partitions=parts).collect()))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return told, jobs

    few, base = run(1, 2)
    more, jobs = run(1, 6)
    assert any("None" not in r for r in few) and few != more
    assert jobs - base <= 4 * 3  # a job per level of each further tree, for all 6 models
    assert run(4, 6)[0] == more
