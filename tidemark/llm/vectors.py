"""Near-duplicate vectors by sorted projection passes, with exact link counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ready
from tidemark.llm.components import connected_components
from tidemark.session import stage

THRESHOLD = 0.98
#: Neighbours compared on either side in each sorted pass.
WINDOW = 32
#: Random hyperplanes per pass: bits of the sort key.
BITS = 62
#: Wanted chance that a pair at the threshold meets in no pass.
MISSED = 1e-5
#: Passes are added for a label, half as many again, while the last third of them still adds more than this share of its links between components.
STILL_NEW = 0.001
#: Passes sorted by one job; bounds what is written at once.
TOGETHER = 8
#: Members of a component compared by one task with as many others.
BLOCK = 2048
SEED = 20_011


def usable(vector: Column) -> Column:
    """Not null, with finite components of which one is not zero."""
    finite = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def passes_needed(rows: int, spread: float = 1.0, threshold: float = THRESHOLD, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold is missed with chance ``missed`` at most, if rows spread evenly around their mean.

    ``spread`` is the mean squared distance of a label's unit vectors from their mean. Two of them at the threshold are 2 - 2 * threshold
    apart (squared), and seen from the mean agree on a hyperplane with chance 1 - angle / pi. They meet in a window if they agree on
    so many leading bits that the other rows of the same prefix fit in it. Where rows are as near to each other as the threshold asks,
    nearly all are linked and any neighbours tell, so that the angle counts as a right one at most.
    """
    bits = max(0.0, math.log2(max(1, rows) / window))
    cosine = min(1.0, max(0.0, 1 - (1 - threshold) / max(spread, 1e-9)))
    if spread <= 2 * (1 - threshold):  # the mean pair is linked
        cosine = max(cosine, threshold)
    meet = (1 - math.acos(cosine) / math.pi) ** math.ceil(bits)
    return max(4, math.ceil(math.log(missed) / math.log(max(1e-9, 1 - min(meet, 1 - 1e-9)))))


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, number]).standard_normal((dim, BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _keys(numbers: range):
    """Each vector once per pass of its label, with the bits of its sides of the pass's hyperplanes through the label's mean as a number: its order is lexicographic."""
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, start, stop = (np.asarray(batch.column(i)) for i in (3, 5, 6))
            for dim in np.unique(dims):
                for number in numbers:
                    part = batch.filter(pa.array((dims == dim) & (start <= number) & (number < stop)))
                    if not part.num_rows:
                        continue
                    key = ((_matrix(part.column(4)) @ _planes(int(dim), number)) >= 0) @ powers
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), number, np.int32)), part.column(1), part.column(3), pa.array(key), part.column(0), part.column(2)],
                        names=["pass", "label", "dim", "key", "id", "v"],
                    )

    return run


KEYED = "pass int, label {label}, dim int, key long, id long, v {v}"


def centred(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``classes`` with ``c``, the unit vector less the mean of its label and length, and ``(label, dim, rows, spread)``."""
    unit = classes.withColumn("u", F.transform("v", lambda x: x / F.col("norm")))
    places = unit.select("label", "dim", F.posexplode("u").alias("place", "x")).groupBy("label", "dim", "place")
    places = places.agg(F.round(F.avg("x"), 6).alias("x"), F.count("*").alias("rows"))
    means = places.groupBy("label", "dim").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("mean"), F.max("rows").alias("rows"),
        (1 - F.sum(F.col("x") * F.col("x"))).alias("spread"),
    )
    means = stage(means, "means")
    moved = unit.join(means.select("label", "dim", "mean"), ["label", "dim"]).withColumn("c", F.zip_with("u", "mean", lambda x, m: (x - m).cast("float")))
    return stage(moved.select("id", "label", "v", "dim", "c"), "centred"), means.select("label", "dim", "rows", "spread")


def _near(run_of: np.ndarray, ids: np.ndarray, vectors: np.ndarray, threshold: float, window: int) -> tuple[list[int], list[int]]:
    """Spanning links of the verified pairs among neighbours of one run (equal pass, label and length)."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    top = np.arange(len(ids))
    first, second = [], []
    for offset in range(1, min(window, len(ids) - 1) + 1):
        same = np.flatnonzero(run_of[offset:] == run_of[:-offset])
        cosine = np.einsum("ij,ij->i", vectors[same + offset], vectors[same]) / (norms[same + offset] * norms[same])
        hit = same[cosine >= threshold]
        first.append(hit)
        second.append(hit + offset)
    if not first:
        return [], []
    a, b = np.concatenate(first), np.concatenate(second)
    while True:  # least position of each local component, by steps over links and jumps
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, top):
            break
        top = new
    tied = np.flatnonzero(top != np.arange(len(ids)))
    return ids[tied].tolist(), ids[top[tied]].tolist()


def _sweep(threshold: float, window: int):
    """Links within a sorted partition, and the rows near its ends, which have neighbours in others."""
    names = ["src", "dst", "pass", "label", "dim", "key", "id", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True

        def out(src, dst, of: list, border: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
            n, m = len(src), border.num_rows
            columns = [pa.array(src + [None] * m, pa.int64()), pa.array(dst + [None] * m, pa.int64())]
            for at, c in enumerate(names[2:]):  # a link has its pass, label and length
                kind = schema.field(c).type
                told = pa.array([mark[at] for mark in of], kind) if at < 3 else pa.nulls(n, kind)
                columns.append(pa.concat_arrays([told, *border.column(c).chunks]))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]).combine_chunks()
            if first:
                yield out([], [], [], now.slice(0, window), batch.schema)
                first = False
            joined = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            src, dst, of = [], [], []
            start = 0
            marks = list(zip(*[joined.column(c).to_pylist() for c in ("pass", "label", "dim")], strict=True))
            for at in range(1, len(marks) + 1):  # runs of one length each, so that they are matrices
                if at == len(marks) or marks[at] != marks[start]:
                    part = joined.slice(start, at - start)
                    a, b = _near(np.zeros(at - start, np.int8), part.column("id").to_numpy(), _matrix(part.column("v")), threshold, window)
                    src += a
                    dst += b
                    of += [marks[start]] * len(a)
                    start = at
            yield out(src, dst, of, joined.slice(0, 0), batch.schema)
            held = joined.slice(max(0, joined.num_rows - window))
        if held is not None:
            yield out([], [], [], held, held.schema)

    return run


def _links(keyed: DataFrame, partitions: int, kind: str, threshold: float, window: int) -> DataFrame:
    """Pairs of neighbours in the order of (pass, label, length, key), partition borders included."""
    schema = f"src long, dst long, {kind}"
    order = ["pass", "label", "dim", "key", "id"]
    swept = stage(keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(_sweep(threshold, window), schema), "swept")
    links = swept.filter(F.col("src").isNotNull()).select("src", "dst", "pass", "label", "dim")
    if partitions == 1:
        return links
    borders = swept.filter(F.col("src").isNull()).drop("src", "dst").dropDuplicates(["pass", "label", "dim", "id"])
    return links.unionByName(_links(borders, max(1, partitions // 64), kind, threshold, window))


def _run_passes(rows: DataFrame, todo: DataFrame, threshold: float, window: int) -> DataFrame:
    """``(src, dst, pass, label, dim)`` verified links of the passes from ``start`` to before ``stop`` of each label in ``todo``."""
    kind = KEYED.format(**{c: rows.schema[c].dataType.simpleString() for c in ("label", "v")})
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first, last = todo.agg(F.min("start"), F.max("stop")).first()
    found = None
    for at in range(first or 0, last or 1, TOGETHER):
        now = todo.filter((F.col("start") < at + TOGETHER) & (F.col("stop") > at)).select("label", "dim", "start", "stop")
        asked = rows.join(now, ["label", "dim"]).select("id", "label", "v", "dim", "c", "start", "stop")
        keyed = asked.mapInArrow(_keys(range(at, min(last or 1, at + TOGETHER))), kind)
        part = stage(_links(keyed, partitions, kind, threshold, window).distinct(), "links")
        found = part if found is None else found.unionByName(part)
    return found


def _across(links: DataFrame, reach: DataFrame) -> DataFrame:
    """``(src, dst, label, dim)``: components of ``reach`` (or rows that it lacks) that ``links`` join."""
    ends = links.join(reach.select(F.col("id").alias("src"), F.col("component").alias("a")), "src", "left")
    ends = ends.join(reach.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst", "left")
    ends = ends.select("label", "dim", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")).filter(F.col("a") != F.col("b"))
    return ends.select("label", "dim", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def find_components(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, missed: float = MISSED, still_new: float = STILL_NEW) -> DataFrame:
    """``(id, component)`` of the ``classes`` (``id, label, v, dim, norm``) that a verified link reaches.

    Every label gets the passes that its rows and their spread ask for. Whether these do is measured: the links of the last third
    that join components of the others are counted by label, and labels in which they are more than ``still_new`` of all get half as many
    passes again, until a run adds no more than that. Labels with dense groups, in which prefixes tell little, so get what they need.
    """
    rows, facts = centred(classes)
    told = F.udf(lambda n, spread: passes_needed(n, spread, threshold, window, missed), "int")
    todo = stage(facts.select("label", "dim", F.lit(0).alias("start"), told("rows", "spread").alias("stop")), "todo")
    links = _run_passes(rows, todo, threshold, window)
    cut = links.join(todo, ["label", "dim"]).withColumn("late", 3 * F.col("pass") >= 2 * F.col("stop"))
    reach = stage(connected_components(cut.filter(~F.col("late"))).withColumnRenamed("node", "id"), "reach")
    late = cut.filter("late")
    while True:
        new = stage(_across(late, reach), "new")
        if new.isEmpty():
            return reach
        moved = connected_components(new).select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = stage(moved, "moved")
        kept = reach.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        alone = moved.select(F.col("component").alias("id"), F.col("to").alias("component")).join(reach.select("id"), "id", "left_anti")
        reach = stage(kept.unionByName(alone), "reach")
        ties = reach.join(classes.select("id", "label", "dim"), "id").groupBy("label", "dim")
        ties = ties.agg((F.count("*") - F.count_distinct("component")).alias("ties")).join(new.groupBy("label", "dim").agg(F.count("*").alias("new")), ["label", "dim"])
        more = ties.filter(F.col("new") > still_new * F.col("ties")).select("label", "dim")
        todo = todo.join(more, ["label", "dim"]).select("label", "dim", F.col("stop").alias("start"), F.ceil(1.5 * F.col("stop")).cast("int").alias("stop"))
        todo = stage(todo, "todo")
        if todo.isEmpty():
            return reach
        late = _run_passes(rows, todo, threshold, window)


def _count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``(id, linked)``: rows of other classes at the threshold or above, over all pairs inside each component.

    Every pair of blocks of a component is one group; a task compares two blocks and returns sums per class, never pairs.
    """
    sizes = stage(members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).filter(F.col("blocks") > 0), "blocks")
    placed = members.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("component", F.col("mine").alias("a"), copies.alias("b"), "id", "n", "v")
    right = placed.select(*[F.col(c).alias(f"{c}_") for c in ("component", "mine", "blocks", "id", "n", "v")])
    right = right.select("component_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)).alias("a_"), F.col("mine_").alias("b_"), "id_", "n_", "v_")

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        ids, linked = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if one.num_rows and other.num_rows:
            x, y = _matrix(one.column("v")), _matrix(other.column("v_"))
            norms = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
            ids, own, weight = one.column("id").to_numpy(), other.column("id_").to_numpy(), other.column("n_").to_numpy()
            linked = np.zeros(len(ids), np.int64)
            for at in range(0, len(ids), 256):
                near = (x[at : at + 256] @ y.T) / (norms[0][at : at + 256, None] * norms[1]) >= threshold
                linked[at : at + 256] = (near & (ids[at : at + 256, None] != own)) @ weight
        return pa.table({"id": pa.array(ids, pa.int64()), "linked": pa.array(linked, pa.int64())})

    pairs = left.groupBy("component", "a", "b").cogroup(right.groupBy("component_", "a_", "b_")).applyInArrow(compare, "id long, linked long")
    return pairs.groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    window: int = WINDOW, missed: float = MISSED, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id reachable) and ``kept`` (the id is that one).

    Equal vectors of a label form a class first and are searched once. Sorted passes find links, whose components hold every
    linked pair unless it met in no pass (see :func:`find_components`); inside a component all links are counted exactly, in blocks, so that the bounded
    window never bounds ``n_links``. Vectors that are null, zero or hold null or non-finite components, and those without a label,
    link with nothing. Vectors of different length never link. Repeated rows of an id count as vectors of their own.
    A null id is the last in its component and has a component of its own where it is alone.
    """
    spark = ready(vectors.sparkSession)
    source = vectors.schema[vector_col].dataType
    kind = "float" if source == T.ArrayType(T.FloatType(), source.containsNull) else "double"
    rows = vectors.select(F.col(id_col).alias("vid"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    good = F.col("label").isNotNull() & usable(F.col("v"))
    sound = rows.filter(good).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    grouped = sound.groupBy("label", "v").agg(F.min("vid").alias("least"), F.count("*").alias("n"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))  # written once, not worked out per component
    classes = stage(grouped.select(F.xxhash64("label", "v").alias("id"), "label", "v", F.size("v").alias("dim"), norm.alias("norm"), "least", "n"), "classes")
    reach = find_components(classes, threshold, window, missed)
    linked = _count_links(classes.join(reach, "id").select("component", "id", "n", "v"), threshold, block)
    least = classes.join(reach, "id").groupBy("component").agg(F.min("least").alias("component_id"))
    told = (
        classes.select("id", "n", "least").join(reach, "id", "left").join(least, "component", "left").join(linked, "id", "left")
        .select("id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    told = stage(told, "told")
    with_class = sound.select("vid", F.xxhash64("label", "v").alias("id")).join(told, "id").select("vid", "n_links", "component_id")
    alone = rows.filter(~good).select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component_id"))
    return with_class.unionByName(alone).select(
        F.col("vid").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vid") == F.col("component_id"), F.lit(False)).alias("kept")
    )
