"""Centroid clustering of whole-number vectors by bit planes: AND and popcount give exact dot products and distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready
from tidemark.session import stage

#: Components of a vector: a bit plane of all of them is one unsigned 64-bit number.
DIM = 64
#: Results within so many bits are worked out in longs, longer ones in whole numbers of any size.
LONG_BITS = 61
#: Vectors of one plane count worked on at once inside a task.
ROWS = 4096


def usable(vector: Column, dim: int = DIM) -> Column:
    """Exactly ``dim`` components, none null and all finite."""
    finite = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


# --- bit planes


def pack(values: np.ndarray) -> list[np.ndarray]:
    """Two's complement bit planes of integer rows (n × dim, longs): for each row its planes, lowest first."""
    size = np.max(values ^ (values >> 63), axis=1, initial=0)  # v, or its complement where it is negative
    bits = 1 + np.sum((size[:, None] >> np.arange(63)) > 0, axis=1)
    out: list = [None] * len(values)
    for b in np.unique(bits):
        rows = np.flatnonzero(bits == b)
        planes = _planes(values[rows], int(b))
        for row, p in zip(rows.tolist(), planes, strict=True):
            out[row] = p
    return out


def _planes(values: np.ndarray, bits: int) -> np.ndarray:
    planes = np.zeros((len(values), bits), np.uint64)
    for i in range(bits):
        packed = np.packbits(((values >> i) & 1).astype(np.uint8), axis=1, bitorder="little")
        planes[:, i] = np.pad(packed, ((0, 0), (0, 8 - packed.shape[1]))).view("<u8")[:, 0]
    return planes


def pack_large(values: Sequence[int]) -> np.ndarray:
    """The same for one row of whole numbers of any size."""
    bits = 1 + max((v if v >= 0 else ~v).bit_length() for v in values)
    return np.array([sum(((v >> i) & 1) << d for d, v in enumerate(values)) for i in range(bits)], np.uint64)


def unpack(planes: np.ndarray, dim: int = DIM) -> list[int]:
    """Components of one row from its planes."""
    weights = place_values(len(planes))
    return [sum(w for w, p in zip(weights, planes.tolist(), strict=True) if (p >> d) & 1) for d in range(dim)]


def place_values(bits: int) -> list[int]:
    """What a one in each plane stands for; the highest plane is the negative one."""
    return [1 << i for i in range(bits - 1)] + [-(1 << (bits - 1))]


def weighted_popcounts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact dot products of every row of ``x`` (n × planes) with every row of ``y`` (k × planes).

    A pair of planes adds the number of components that have a one in both, times both place values. Sums that may leave a long
    are kept in Python's whole numbers.
    """
    large = x.shape[1] + y.shape[1] + 6 > LONG_BITS
    total = np.zeros((len(x), len(y)), object if large else np.int64)
    left, right = place_values(x.shape[1]), place_values(y.shape[1])
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            ones = np.bitwise_count(x[:, i, None] & y[None, :, j])
            total += ones.astype(object if large else np.int64) * (a * b)
    return total


def _own_squares(x: np.ndarray) -> np.ndarray:
    """Squared length of every row of ``x``."""
    large = 2 * x.shape[1] + 6 > LONG_BITS
    total = np.zeros(len(x), object if large else np.int64)
    values = place_values(x.shape[1])
    for i, a in enumerate(values):
        for j in range(i, len(values)):
            ones = np.bitwise_count(x[:, i] & x[:, j])
            total += ones.astype(object if large else np.int64) * (a * values[j] * (1 if i == j else 2))
    return total


class Centroids:
    """Whole-number centroids as planes of equal number, with their squared lengths."""

    def __init__(self, points: Sequence[Sequence[int]]):
        own = [pack_large(p) for p in points]
        bits = max(len(p) for p in own)
        # a longer two's complement repeats the highest plane
        self.planes = np.array([np.concatenate([p, np.repeat(p[-1:], bits - len(p))]) for p in own], np.uint64)
        self.squares = np.array([sum(v * v for v in p) for p in points], object)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and the squared distance to it, for rows of equal plane count."""
        dots = weighted_popcounts(rows, self.planes)
        squares = _own_squares(rows)
        small = dots.dtype == np.int64 and squares.dtype == np.int64 and max(self.squares) < 1 << LONG_BITS
        far = self.squares.astype(np.int64) if small else self.squares
        away = squares[:, None] + far[None, :] - (dots if small else dots.astype(object)) * 2
        best = np.argmin(away, axis=1)
        return best, away[np.arange(len(rows)), best]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(ids, planes)`` of the rows of each plane count in a batch, in bounded runs."""
    for batch in batches:
        lists = batch.column(1)
        counts = np.diff(np.asarray(lists.offsets))
        for bits in np.unique(counts):
            rows = np.flatnonzero(counts == bits)
            for at in range(0, len(rows), ROWS):
                part = pa.array(rows[at : at + ROWS])
                flat = lists.take(part).flatten().to_numpy(zero_copy_only=False)
                yield batch.column(0).take(part), flat.astype(np.int64).view(np.uint64).reshape(len(part), int(bits))


# --- jobs


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dim: int) -> DataFrame:
    """``vec_id, planes`` of every usable vector, whose components become floor(scale × x)."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v"), dim)).select(
        "vec_id", F.transform("v", lambda x: x.cast("double")).alias("v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            fits = (np.abs(x) < 2.0**61 / scale).all(axis=1)
            planes = pack(np.floor(np.where(fits[:, None], x, 0.0) * scale).astype(np.int64))
            for row in np.flatnonzero(~fits).tolist():
                # a double is a whole number over a power of two, so the product and its floor are exact
                planes[row] = pack_large([n * scale // d for n, d in (v.as_integer_ratio() for v in x[row].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.view(np.int64) for p in planes], pa.list_(pa.int64()))], names=["vec_id", "planes"])

    kind = source.schema["vec_id"].dataType.simpleString()
    return source.mapInArrow(run, f"vec_id {kind}, planes array<long>")


def _ones(centroids: Centroids, dim: int):
    """Per task and cluster: how many ones each plane has in each component, and (place -1) the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bool], np.ndarray] = {}
        for _, rows in _groups(batches):
            best, _ = centroids.nearest(rows)
            bits = rows.shape[1]
            ones = np.unpackbits(rows.view(np.uint8).reshape(len(rows), bits, 8), axis=2, bitorder="little")[:, :, :dim]
            for c in np.unique(best).tolist():
                mine = ones[best == c].sum(axis=0, dtype=np.int64)
                held[c, -1, False] = held.get((c, -1, False), 0) + np.full(dim, np.count_nonzero(best == c), np.int64)
                for i in range(bits):
                    key = (c, i, i == bits - 1)
                    held[key] = held.get(key, 0) + mine[i]
        keys = sorted(held)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([held[k] for k in keys], pa.list_(pa.int64()))], names=["cluster", "place", "negative", "ones"])

    return run


def _moved(rows: DataFrame, points: list[list[int]], dim: int) -> list[list[int]]:
    """One round: centroids after every vector went to its nearest one. The driver gets one row of sums per cluster and plane."""
    told = rows.mapInArrow(_ones(Centroids(points), dim), "cluster int, place int, negative boolean, ones array<long>")
    summed = told.groupBy("cluster", "place", "negative").agg(*[F.sum(F.get("ones", F.lit(d))).alias(f"_{d}") for d in range(dim)])
    sums, counts = [[0] * dim for _ in points], [0] * len(points)
    for cluster, place, negative, *ones in summed.collect():
        if place < 0:
            counts[cluster] = ones[0]
            continue
        value = -(1 << place) if negative else 1 << place
        sums[cluster] = [s + value * n for s, n in zip(sums[cluster], ones, strict=True)]
    return [[s // n for s in total] if n else old for old, total, n in zip(points, sums, counts, strict=True)]


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1",
    dim: int = DIM,
) -> DataFrame:
    """One row per usable vector: id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors of another length than ``dim`` (64 at most), null ones and those with null or non-finite components are left out.
    Components become floor(scale × x) and are packed into bit planes once; every round reads the planes, sends one row of sums per
    cluster, plane and task, and moves the centroids to the floor of the exact means (empty ones stay). Centroids start as the ``k`` vectors with the
    smallest sha256 of ``seed:id``; repeated ids are vectors of their own and go by their planes where hashes tie, null ids come last.
    Fewer than ``k`` vectors give as many centroids; an empty table gives an empty result. Sizes are exact however large the components are; a
    squared distance or an inertia beyond a long is an error.
    """
    if not 0 < dim <= 64:
        raise ValueError("a bit plane holds 1 to 64 components")
    spark = ready(vectors.sparkSession)
    rows = stage(packed(vectors, id_col, vector_col, scale, dim), "planes")
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.withColumn("_code", code).orderBy(F.col("_code").asc_nulls_last(), "planes").limit(k).select("planes").collect()
    points = [unpack(np.array(r.planes, np.int64).view(np.uint64), dim) for r in first]
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long"
    if not points:
        told = spark.createDataFrame([], schema)
        sums = spark.createDataFrame([], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    else:
        for _ in range(rounds):
            points = _moved(rows, points, dim)
        told = stage(rows.mapInArrow(_assign(Centroids(points)), schema), "assigned")
        inertia = {r.cluster: int(r.total) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
        total = sum(inertia.values())
        if total >= 1 << 63:
            raise OverflowError(f"an inertia of {total} does not fit a long")
        sums = spark.createDataFrame(
            [(c, inertia[c], total, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c in sorted(inertia)],
            "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
        )
    return told.join(F.broadcast(sums), "cluster").select(  # one row per centroid: k at most
        F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _assign(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _groups(batches):
            best, away = centroids.nearest(rows)
            if away.dtype == object and max(away) >= 1 << 63:
                raise OverflowError("a squared distance does not fit a long")
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(away.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return run


def _round_sql(n: int) -> str:
    """``a<n>``: the nearest centroid of ``c<n>`` for every vector."""
    return f"""a{n} AS MATERIALIZED (
  SELECT place, vec_id, v, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (
    SELECT k.place, k.vec_id, k.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS distance FROM kept k, c{n} c)
  GROUP BY place, vec_id, v)"""


def _moved_sql(n: int) -> str:
    """``c<n+1>``: every centroid that has vectors moved to the floor of their mean."""
    return f"""m{n + 1} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
  FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN m{n + 1} m USING (c))"""


#: The same in DuckDB's dialect.
SQL = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY code, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS code, v FROM kept ORDER BY 1, 2 LIMIT 16)),
{_round_sql(0)},
{_moved_sql(0)},
{_round_sql(1)},
{_moved_sql(1)},
{_round_sql(2)},
{_moved_sql(2)},
{_round_sql(3)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c USING (c)"""
