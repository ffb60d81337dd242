"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists per dimension."""

from __future__ import annotations

import heapq


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ready
from tidemark.session import stage

#: Rows of a block of candidates and of a block of queries: one task holds one of each.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Components from here on are scored as whole numbers of any size: their products need not fit a long.
LARGEST = 1 << 20
SCALE = 256


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component finite."""
    finite = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def codes(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision, where all are small; null where one is not."""
    small = F.forall(vector, lambda x: F.abs(x) < LARGEST)
    return F.when(small, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def large_codes(vectors: list[list[float]], scale: int = SCALE) -> np.ndarray:
    """The same as whole numbers of any size, for vectors with large components; a double is a fraction, so nothing is rounded."""
    exact = lambda x: (lambda n, d: n * scale // d)(*float(x).as_integer_ratio())
    out = np.empty((len(vectors), len(vectors[0])), object)
    for i, v in enumerate(vectors):
        out[i] = [exact(x) for x in v]
    return out


class Lists:
    """A block of candidates with one ascending list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors, self.order.T, axis=0).T.copy()
        self.exact = vectors.astype(np.float64)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` other than the query's own, best first, ties to smaller ids.

        Sorted access goes down all lists together, in rounds of doubling depth (from the top for positive weights of the query,
        from the bottom for negative ones); each candidate met is scored whole. No candidate not met yet can score more than the
        weighted values at the current depth, so the search stops when the kth score is above that bound.
        """
        used = np.flatnonzero(query)
        n = len(self.ids)
        seen = self.ids == own
        best: list[tuple[int, int]] = []
        down, weights = query[used] > 0, query[used].astype(np.int64)
        at, depth = 0, 1 if len(used) else n
        exact = query.astype(np.float64)
        while True:
            depth = min(depth, n)
            met = np.zeros(n, bool) if len(used) else np.ones(n, bool)
            met[self.order[used[down], n - depth : n - at]] = True
            met[self.order[used[~down], at:depth]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            if len(new):
                scores = _scores(self.exact, self.vectors, new, exact, query)
                if len(best) + len(new) > k:  # ties at the kth place stay
                    kept = np.argpartition(-scores, k - 1)[:k] if len(new) > k else np.arange(len(new))
                    least = scores[kept].min()
                    new, scores = new[scores >= least], scores[scores >= least]
                best = sorted([*best, *zip((-scores).tolist(), self.ids[new].tolist(), strict=True)])[:k]
            if depth == n:
                break
            edge = np.where(down, self.values[used, n - depth], self.values[used, depth - 1])
            if len(best) == k and -best[-1][0] > int(edge @ weights):
                break
            at, depth = depth, depth * 2
        return [(-s, i) for s, i in best]


def _scores(exact: np.ndarray, vectors: np.ndarray, rows: np.ndarray, query: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while these are exact, else in longs."""
    size = np.abs(query).max() * np.abs(exact[rows]).max() * len(query) if len(rows) else 0
    return (exact[rows] @ query).astype(np.int64) if size < 2**53 else vectors[rows] @ whole


def _parts(rows: pa.Table) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """``(large, ids, codes)`` of the rows with small components, and of those with large ones."""
    ids, code, large = rows.column("id").to_numpy(), rows.column("code").combine_chunks(), rows.column("large").combine_chunks()
    small = np.asarray(code.is_valid())
    out = []
    if small.any():
        out.append((False, ids[small], code.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(small.sum()), -1)))
    if not small.all():
        out.append((True, ids[~small], large_codes(large.drop_null().to_pylist())))
    return out


def _whole(rows: np.ndarray, ids: np.ndarray, vector: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best by inner products of whole numbers, for the few rows or queries with large components: all are scored."""
    scores = rows.astype(object) @ vector.astype(object)
    met = [(int(score), int(i)) for score, i in zip(scores, ids.tolist(), strict=True) if i != own]
    return heapq.nsmallest(k, met, key=lambda m: (-m[0], m[1]))


def _block(column: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("block")), F.lit(blocks)).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates for each query.

    Both tables are dealt into hashed blocks and every pair of a query block and a candidate block is one group, searched by
    the threshold algorithm; the k best of all groups of a query are merged. Vectors that are null, empty or hold null
    or non-finite components take no part, neither do rows without an id; a score beyond a long is an error; only vectors of the query's length are its candidates.
    A row with the query's id counts as the query's own row. Repeated rows of one id stay repeated as candidates, queries are taken once by id and vector.
    """
    ready(vectors.sparkSession)
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    slim = lambda df: named(df).filter(F.col("id").isNotNull() & usable(F.col("v"))).select(
        "id", F.size("v").alias("d"), codes(F.col("v")).alias("code"), F.when(codes(F.col("v")).isNull(), F.col("v")).alias("large")
    )
    rows, asked = stage(slim(vectors), "candidates"), stage(slim(queries).distinct(), "queries")
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((rows, block), (asked, query_block)))
    left = rows.select(_block(F.col("id"), blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "d", "id", "code", "large")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), _block(F.col("id"), parts).alias("p"), "d", "id", "code", "large")

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        best: dict[tuple, list[tuple[int, int]]] = {}
        if candidates.num_rows and wanted.num_rows:
            for large, ids, rows in _parts(candidates):
                lists = None if large else Lists(ids, rows)
                for asked_large, query_ids, vectors in _parts(wanted):
                    for place, (query_id, vector) in enumerate(zip(query_ids.tolist(), vectors, strict=True)):
                        met = _whole(rows, ids, vector, query_id, k) if large or asked_large else lists.top(vector, query_id, k)
                        best.setdefault((query_id, asked_large, place), []).extend(met)
        out = [[], [], [], []]
        for (query_id, _, _), met in best.items():
            for score, vec_id in heapq.nsmallest(k, met, key=lambda m: (-m[0], m[1])):
                held = min(max(score, -(1 << 63)), (1 << 63) - 1)
                for column, value in zip(out, (query_id, vec_id, held, held == score), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score", "fits"), out, kinds, strict=True)})

    found = left.groupBy("b", "p", "d").cogroup(right.groupBy("b", "p", "d")).applyInArrow(search, "query_id long, vec_id long, score long, fits boolean")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    beyond = F.raise_error(F.concat(F.lit("a score of query "), F.col("query_id").cast("string"), F.lit(" does not fit a long"))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("fits"), F.col("score")).otherwise(beyond).alias("score"))


#: The same in DuckDB's dialect, over all pairs of a query and a candidate.
SQL = """WITH coded AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS code FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.code) + 1), lambda i: q.code[i] * c.code[i])) AS BIGINT) AS score
  FROM coded q JOIN coded c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.code) = len(q.code)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
