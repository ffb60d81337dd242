"""Ordered operators over groups of any length.

A plain ``Window.partitionBy(series)`` puts a whole series into one task. The helpers here cut every group
into bounded blocks instead:

* :func:`scan` computes running sums and last-known values in two levels: inside each block, plus an
  offset taken from the (small) table of block totals;
* :func:`with_halo` replicates the few rows next to a block border, so that lag and lead expressions of
  bounded reach can be evaluated inside each block.

Both need blocks that grow with the order column, e.g. ``floor(epoch / width)`` or ``pos div n``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CHUNK = "_chunk"
OWN = "_own"


def time_block(ts: Column, step_seconds: int, block_rows: int) -> Column:
    """Block number of a timestamp; a block spans ``block_rows`` steps of the nominal cadence."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / F.lit(step_seconds * block_rows))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    levels: int = 2,
    fanout: int = 4096,
) -> DataFrame:
    """Add inclusive running sums and last non-null values along ``order`` within ``keys``.

    ``order`` must be unique within a block. ``df`` is read once per level (rows, block totals, totals of ``fanout`` blocks and so on), so stage it
    first when it is costly to compute. The last level orders all its totals of a key in one task: with blocks of 4096 rows, two levels
    do for billions of rows of one key (a million totals), three for trillions.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    keys = list(keys)
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*[F.col(c) for c in order])

    totals = df.groupBy(*keys, block).agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), rank)).alias(f"_t_{n}") for n, e in lasts.items()],
    )
    offsets = _offsets(totals, keys, block, list(sums), list(lasts), levels - 2, fanout)
    local = df.select(
        "*",
        *[F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(f"_l_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(inside).alias(f"_l_{n}") for n, e in lasts.items()],
    )
    joined = local.join(offsets, [*keys, block])
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_o_{n}").alias(n) for n in lasts],
    )


def _offsets(totals: DataFrame, keys: list[str], block: str, sums: list[str], lasts: list[str], more: int, fanout: int) -> DataFrame:
    """``keys, block, _o_*``: sums and last values of all blocks before, by ``more`` further levels of groups of ``fanout`` blocks."""
    number = f"_g{more}"
    group = [*keys, number] if more > 0 else keys
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    grouped = totals.withColumn(number, F.floor(F.col(block) / fanout)) if more > 0 else totals
    inside = grouped.select(
        *group, block,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_o_{n}") for n in lasts],
    )
    if more <= 0:
        return inside
    above = grouped.groupBy(*group).agg(
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_t_{n}", F.when(F.col(f"_t_{n}").isNotNull(), F.col(block))).alias(f"_t_{n}") for n in lasts],
    )
    ahead = _offsets(above, keys, number, sums, lasts, more - 1, fanout).select(*group, *[F.col(f"_o_{n}").alias(f"_a_{n}") for n in [*sums, *lasts]])
    return inside.join(ahead, group).select(
        *keys, block,
        *[(F.col(f"_o_{n}") + F.col(f"_a_{n}")).alias(f"_o_{n}") for n in sums],
        *[F.coalesce(f"_o_{n}", f"_a_{n}").alias(f"_o_{n}") for n in lasts],
    )


def attach(rows: DataFrame, facts: DataFrame, last: str = "last_pos", key: str = "series", pos: str = "pos", size: int = 4096) -> DataFrame:
    """Rows with the ``facts`` of their series (one row each, with ``last``, its last position); rows of other series go.

    The facts are copied to every block of positions and joined by (series, block), so that a series that holds most rows is
    dealt out like any other and no row is shuffled by its series alone.
    """
    copies = facts.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / size))))
    return rows.withColumn("_at", F.floor(F.col(pos) / size)).join(copies, [key, "_at"]).drop("_at")


def with_halo(df: DataFrame, pos: str, before: int, after: int, chunk_rows: int) -> DataFrame:
    """Tag rows with the position chunk(s) that need them.

    A row at position ``p`` is owned by chunk ``p div chunk_rows`` and copied into a neighbour when it lies
    within ``before`` rows of its start or ``after`` rows of its end. Window expressions over
    ``partitionBy(keys, _chunk).orderBy(pos)`` that reach at most so far are then exact on rows with
    ``_own``; drop the copies with :func:`owned`.
    """
    p, size = F.col(pos), F.lit(chunk_rows)
    first = F.greatest(F.floor((p - after) / size), F.lit(0))
    last = F.floor((p + before) / size)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(CHUNK) == F.floor(p / size)
    )


def chunk_window(keys: Sequence[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(pos)


def fresh(df: DataFrame) -> DataFrame:
    """Re-alias all columns, so that two frames of common descent can be cogrouped without ambiguity."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def owned(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(CHUNK, OWN)
