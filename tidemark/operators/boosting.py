"""Boosted trees pooled over series, one model per refit, arm and horizon; the models of a refit grow together, level by level, in shared Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.operators.features import lag_names
from tidemark.operators.forecasters import ARMS, train_frame
from tidemark.operators.origins import BacktestSpec, origin_rows
from tidemark.session import stage

#: Ranges that a feature is cut into.
BINS = 32
#: Training rows that are worth a task of their own, rows worked on at once, and trees after which forecasts of the training rows are kept.
TASK_ROWS, BLOCK_ROWS, KEPT = 20_000, 8192, 5
#: Residuals are whole numbers of so many bits, so that sums do not depend on the order of rows.
BITS = 30


@dataclass(frozen=True)
class Growth:
    """What all models of a refit share; ``usable`` tells which features each model may read, one row per model."""

    horizon: int
    usable: np.ndarray
    bins: int
    depth: int
    subsampling: float
    subset: float
    scale: float
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """One tree of every model: per inner node (by level) the feature and the last range that goes left, per leaf its value times its weight."""

    feature: np.ndarray
    left_upto: np.ndarray
    leaf: np.ndarray


def boosted_direct(
    features: DataFrame,
    spec: BacktestSpec,
    refit_every: int = 30,
    arms: Sequence[str] = ARMS,
    trees: int = 300,
    depth: int = 4,
    step_size: float = 0.05,
    subsampling: float = 0.9,
    feature_subset: float = 0.9,
    bins: int = BINS,
    at_once: int = 8,
    partitions: int | None = None,
) -> DataFrame:
    """``series, origin_seq, preds[arm][horizon]`` by direct boosted trees.

    A model is fitted on the rows of all series that every origin of its refit may see (those of the refit's first fold) and forecasts the
    ``refit_every`` origins from there on, so no later row takes part. Missing covariates take the median of the refit's training
    rows, 0.0 without any. Feature values become the numbers of ``bins`` ranges, whose borders come from the rows of the first refit alone. The binned
    rows are staged once. The models of all arms and horizons of a refit grow side by side: a job per level sums the residuals of all models by node,
    feature and range, so that jobs do not multiply by models and each reads the rows once; ``at_once`` refits run at a time on ``partitions`` tasks, more where
    there are many rows. As in Spark's regressor, the first tree counts whole, and the others ``step_size`` times twice the mean residual. Refits with fewer rows
    than ``spec.min_frame_rows`` and origins with an unknown lag give NULL.
    """
    spark = features.sparkSession
    base, cov = lag_names(spec.lags) + list(spec.calendar), list(spec.covariates)
    columns = base + cov
    frame = train_frame(features, spec).select("series", F.col("k").cast("long").alias("k"), *_doubles(columns), F.slice("ahead_y", 2, spec.horizon).alias("t"))
    frame = stage(frame, "boosting-frame")
    at = stage(origin_rows(features, spec).select("series", F.col("origin_seq").cast("long").alias("origin_seq"), *_doubles(columns)), "boosting-origins")
    last = at.agg(F.max("origin_seq")).first()[0]
    names = "series {}, origin_seq long, preds array<array<double>>".format(features.schema["series"].dataType.simpleString())
    if last is None:
        return spark.createDataFrame([], names)
    refits = list(range(0, last + 1, refit_every))
    rows = frame.groupBy("k").count().collect()  # one number per fold
    enough = {k0: sum(r["count"] for r in rows if r["k"] <= k0) >= spec.min_frame_rows for k0 in refits}
    fills = _fills(frame, refits, cov)
    borders = _borders(frame.filter(F.col("k") <= next((k for k in refits if enough[k]), 0)), columns, bins)
    binned = lambda df: df.select(*[c for c in df.columns if c not in columns], *[_bin(F.col(c), borders[c]).alias(c) for c in columns])
    table, asked = stage(binned(frame), "binned-frame"), stage(binned(at), "binned-origins")
    usable = np.array([[arm == "lags_meteo" or c in base for c in columns] for arm in arms for _ in range(spec.horizon)])

    def filled(k0: int) -> list[Column]:
        own = {c: _bin(F.lit(fills[k0][c]), borders[c]) for c in cov}
        return [(F.coalesce(F.col(c), own[c]) if c in own else F.col(c)).cast("int").alias(c) for c in columns]

    def fit(k0: int) -> DataFrame:
        train = table.filter(F.col("k") <= k0)
        largest = train.select(F.explode("t").alias("v")).agg(F.max(F.abs("v"))).first()[0]
        scale = 2.0 ** (BITS - math.frexp(largest)[1]) if largest and math.isfinite(largest) else 1.0
        growth = Growth(spec.horizon, usable, bins, depth, subsampling, feature_subset, scale)
        size = sum(r["count"] for r in rows if r["k"] <= k0)
        parts = max(partitions or 1, min(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_ROWS)))
        mark = F.xxhash64("series", "k", *columns, "t").alias("mark")
        packed = train.select(mark, F.array(*filled(k0)).alias("x"), "t").repartition(parts, "mark").mapInArrow(_pack, "mark binary, x binary, t binary")
        forest = _grow(stage(packed, "boosting-blocks"), growth, trees, step_size)
        own = asked.filter((F.col("origin_seq") >= k0) & (F.col("origin_seq") < k0 + refit_every)).dropna(subset=base)
        told = own.select("series", "origin_seq", F.array(*filled(k0)).alias("x")).mapInArrow(
            _tell(spark.sparkContext.broadcast(forest), len(arms), spec.horizon, bins), names
        )
        return stage(told, "boosted")

    jobs = [k0 for k0 in refits if enough[k0]]
    with ThreadPoolExecutor(at_once) as pool:
        told = list(pool.map(inheritable_thread_target(spark)(fit), jobs))
    keys = at.select("series", "origin_seq")
    empty = F.array(*[F.array(*[F.lit(None).cast("double")] * spec.horizon)] * len(arms))
    if not told:
        return keys.withColumn("preds", empty)
    found = told[0]
    for part in told[1:]:
        found = found.unionByName(part)
    return keys.join(found, ["series", "origin_seq"], "left").withColumn("preds", F.coalesce("preds", empty))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of arrays of one length, without missing values."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks: their marks, feature ranges and targets."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            own = batch.slice(at, BLOCK_ROWS)
            parts = [own.column(0).to_numpy(), _matrix(own.column(1), np.int32), _matrix(own.column(2), np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["mark", "x", "t"])


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _unpacked(growth: Growth):
    def run(row) -> Block:
        mark = np.frombuffer(row["mark"], np.int64).view(np.uint64)
        x = np.frombuffer(row["x"], np.int32).reshape(len(mark), -1).astype(np.uint8 if growth.bins <= 256 else np.int32)
        x = np.ascontiguousarray(x.T)
        return mark, x, np.frombuffer(row["t"], np.float64).reshape(len(mark), -1), np.zeros((len(growth.usable), len(mark)))

    return run


def _descend(x: np.ndarray, node: np.ndarray, feature: np.ndarray, left_upto: np.ndarray, bins: int) -> np.ndarray:
    """Nodes of the next level of one tree, from features by column: a comparison per divided node costs less than a look-up per row."""
    right = np.zeros(len(node), bool)
    for j in np.flatnonzero(left_upto < bins).tolist():
        right |= (node == j) & (x[feature[j]] > int(left_upto[j]))
    return 2 * node + right


def _leaves(x: np.ndarray, tree: Tree, bins: int) -> np.ndarray:
    """What the trees of all models say of each row (``models, rows``)."""
    models, leaves = tree.leaf.shape
    out = np.empty((models, x.shape[1]))
    for m in range(models):
        node = np.zeros(x.shape[1], np.uint8 if leaves <= 256 else np.int32)
        for level in range(int(math.log2(leaves))):
            inner = slice(2**level - 1, 2 ** (level + 1) - 1)
            node = _descend(x, node, tree.feature[m, inner], tree.left_upto[m, inner], bins)
        out[m] = tree.leaf[m].take(node)
    return out


def _with_trees(forest: list[Tree], bins: int):
    def run(block: Block) -> Block:
        mark, x, t, pred = block
        return mark, x, t, sum((_leaves(x, tree, bins) for tree in forest), pred)

    return run


def _drawn(mark: np.ndarray, number: int, growth: Growth) -> np.ndarray:
    """The rows of a tree by a hash of row and tree, whatever task holds them."""
    if growth.subsampling >= 1:
        return np.ones(len(mark), bool)
    z = mark + np.uint64((growth.seed + number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(growth.subsampling * 2**64)


def _sums(growth: Growth, number: int, late: list[Tree], feature: np.ndarray, left_upto: np.ndarray, level: int):
    """Residuals and rows by model, node of ``level``, feature and range, one array a task; ``late`` trees are not in the blocks' forecasts yet."""

    def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        models, features = growth.usable.shape
        nodes = 2**level
        cells = nodes * features * growth.bins
        total = np.zeros((2, models, cells))
        for mark, x, t, pred in blocks:
            taken = np.flatnonzero(_drawn(mark, number, growth))
            x, t, pred = x[:, taken], t[taken], pred[:, taken]
            pred = sum((_leaves(x, tree, growth.bins) for tree in late), pred)
            place = x + np.arange(features)[:, None] * growth.bins
            for m in range(models):
                node = np.zeros(len(taken), np.int64)
                for above in range(level):
                    inner = slice(2**above - 1, 2 ** (above + 1) - 1)
                    node = _descend(x, node, feature[m, inner], left_upto[m, inner], growth.bins)
                cell = (place + node * (features * growth.bins)).reshape(-1)
                residual = np.rint((t[:, m % growth.horizon] - pred[m]) * growth.scale)
                total[0, m] += np.bincount(cell, np.tile(residual, features), cells)
                total[1, m] += np.bincount(cell, minlength=cells)
        yield total.reshape(2, models, nodes, features, growth.bins)

    return run


def _grow(packed: DataFrame, growth: Growth, trees: int, step_size: float) -> list[Tree]:
    """All trees of all models. The driver sees sums by node, feature and range alone, whose number does not depend on the rows."""
    blocks = packed.rdd.map(_unpacked(growth)).persist(StorageLevel.MEMORY_AND_DISK)
    many = blocks.getNumPartitions() > 16
    forest: list[Tree] = []
    late: list[Tree] = []
    before = None
    for number in range(trees):
        tree = _tree(blocks, many, growth, number, late, 1.0 if number == 0 else 2 * step_size)
        if before is not None:  # the jobs of this tree have filled the blocks that follow
            before.unpersist()
            before = None
        forest.append(tree)
        late.append(tree)
        if len(late) == KEPT:
            before, blocks = blocks, blocks.map(_with_trees(late, growth.bins)).persist(StorageLevel.MEMORY_AND_DISK)
            late = []
    for left in (before, blocks):
        if left is not None:
            left.unpersist()
    return forest


def _tree(blocks: RDD, many: bool, growth: Growth, number: int, late: list[Tree], weight: float) -> Tree:
    models, features = growth.usable.shape
    inner = 2**growth.depth - 1
    feature, left_upto = np.zeros((models, inner), np.int64), np.full((models, inner), growth.bins, np.int64)
    draw = np.random.default_rng((growth.seed, number))
    alive = np.ones((models, 1), bool)
    sums = counts = np.zeros((models, 1))
    for level in range(growth.depth):
        found = blocks.mapPartitions(_sums(growth, number, list(late), feature, left_upto, level))
        total = found.treeReduce(np.add) if many else found.reduce(np.add)
        nodes = 2**level
        s, n = total[0].cumsum(axis=-1), total[1].cumsum(axis=-1)
        sums, counts = s[:, :, 0, -1], n[:, :, 0, -1]
        right_s, right_n = sums[:, :, None, None] - s, counts[:, :, None, None] - n
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = np.where(counts > 0, sums**2 / counts, 0.0)
            gain = s**2 / n + right_s**2 / right_n - whole[:, :, None, None]
        read = _subset(draw, growth, nodes)
        gain = np.where((n > 0) & (right_n > 0) & read[..., None], gain, -np.inf).reshape(models, nodes, -1)
        best = gain.argmax(axis=2)
        top = np.take_along_axis(gain, best[..., None], axis=2)[..., 0]
        split = alive & (top > 1e-12 * np.abs(whole)) & (top > 0)
        own = slice(nodes - 1, 2 * nodes - 1)
        feature[:, own] = np.where(split, best // growth.bins, 0)
        left_upto[:, own] = np.where(split, best % growth.bins, growth.bins)  # an undivided node goes left as a whole
        at = lambda a: np.take_along_axis(a.reshape(models, nodes, -1), best[..., None], axis=2)[..., 0]
        left_s, left_n = np.where(split, at(s), sums), np.where(split, at(n), counts)
        sums = np.stack([left_s, sums - left_s], axis=2).reshape(models, -1)
        counts = np.stack([left_n, counts - left_n], axis=2).reshape(models, -1)
        alive = np.repeat(split, 2, axis=1)
    mean = np.divide(sums, counts, out=np.zeros_like(sums), where=counts > 0) / growth.scale
    return Tree(feature, left_upto, weight * mean)


def _subset(draw: np.random.Generator, growth: Growth, nodes: int) -> np.ndarray:
    """The features that every node may be divided by: a share of those of its model, rounded up."""
    models, features = growth.usable.shape
    order = np.where(growth.usable[:, None, :], draw.random((models, nodes, features)), 2.0).argsort(axis=2).argsort(axis=2)
    most = np.ceil(np.minimum(1.0, growth.subset) * growth.usable.sum(axis=1) - 1e-9)
    return growth.usable[:, None, :] & (order < most[:, None, None])


def _tell(forest, arms: int, horizon: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(at, BLOCK_ROWS)
                x = np.ascontiguousarray(_matrix(own.column(2), np.uint8 if bins <= 256 else np.int32).T)
                told = sum(_leaves(x, tree, bins) for tree in forest.value).T.reshape(own.num_rows, arms, horizon)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(told.tolist(), pa.list_(pa.list_(pa.float64())))], names=["series", "origin_seq", "preds"])

    return run


def _doubles(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in columns]


def _fills(frame: DataFrame, refits: list[int], cov: list[str]) -> dict[int, dict[str, float]]:
    """Median of every covariate over the training rows of each refit: a few numbers."""
    if not cov:
        return {k: {} for k in refits}
    asks = frame.sparkSession.createDataFrame([("*", k) for k in refits], "series string, origin_seq long")
    medians = folds.fold_medians(frame.select(F.lit("*").alias("series"), "k", *cov), asks, cov).collect()
    found = {r["origin_seq"]: {c: r[f"{c}_median"] for c in cov} for r in medians}
    return {k: {c: 0.0 if found[k][c] is None else found[k][c] for c in cov} for k in refits}


def _borders(rows: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Increasing upper borders of all ranges but the last, at sketched quantiles: ``bins`` - 1 numbers a column at most."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, at, 2000).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def _bin(value: Column, borders: list[float]) -> Column:
    """How many borders lie below the value; null stays null."""
    if not borders:
        return F.when(value.isNotNull(), F.lit(0.0))
    count = F.size(F.filter(F.lit(borders), lambda b: b < value)).cast("double")
    return F.when(value.isNotNull(), count)
