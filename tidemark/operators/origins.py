"""Rolling origins and the windows around them, by row position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import blocks
from tidemark.operators.features import CALENDAR
from tidemark.operators.panel import PanelSpec


@dataclass(frozen=True)
class BacktestSpec:
    """Settings of a rolling-origin backtest.

    ``convention`` fixes where training ends and which row a horizon means, relative to the origin position P:

    * ``"A"``: trains on rows before P, horizon h is row P+h (the origin row itself is never scored);
    * ``"B"``: trains on rows before P, step h is row P+h-1;
    * ``"C"``: trains on rows up to and including P, horizon h is row P+h.
    """

    horizon: int = 24
    stride: int = 24
    convention: str = "A"
    train_start: str | None = None
    test_start: str | None = None
    test_end: str | None = None
    min_train_rows: int = 0
    max_origins: int | None = None
    lags: tuple[int, ...] = (1, 2, 3, 6, 12, 24, 48)
    calendar: tuple[str, ...] = CALENDAR
    covariates: tuple[str, ...] = ()
    season: int = 24

    def __post_init__(self):
        if self.convention not in ("A", "B", "C"):
            raise ValueError(f"unknown convention: {self.convention}")
        if self.horizon <= 0 or self.stride <= 0:
            raise ValueError("horizon and stride must be positive")

    @property
    def train_end_offset(self) -> int:
        """Last training row relative to the origin."""
        return 0 if self.convention == "C" else -1

    def target_offset(self, h: int) -> int:
        return h - 1 if self.convention == "B" else h

    @property
    def rows_needed(self) -> int:
        """Rows that must exist from the origin on, the origin included."""
        return self.target_offset(self.horizon) + 1

    @property
    def min_frame_rows(self) -> int:
        """Fewest complete training rows for which a learned forecaster is fitted."""
        return max(200, self.min_train_rows // 2)


def trim_to_train_start(panel: DataFrame, spec: BacktestSpec) -> DataFrame:
    """Rows before ``train_start`` take no part: not in fills, lags, positions or training."""
    if spec.train_start is None:
        return panel
    return panel.filter(F.col("ts") >= F.lit(spec.train_start).cast("timestamp"))


def origin_rows_by_time(rows: DataFrame, spec: BacktestSpec) -> DataFrame:
    """Every ``stride``-th valid row of the test period, with its ``origin_seq``.

    A row is valid when enough rows follow it. Valid rows are contiguous in position, so the stride is plain
    arithmetic on ``pos`` and needs one small aggregate per series instead of a window.
    """
    start, end = F.lit(spec.test_start).cast("timestamp"), F.lit(spec.test_end).cast("timestamp")
    step = F.col("pos") - F.col("first_pos")
    found = (
        blocks.attach(rows.filter((F.col("ts") >= start) & (F.col("ts") <= end)), series_bounds(rows, spec))
        .filter((F.col("pos") + (spec.rows_needed - 1) <= F.col("last_pos")) & (step % spec.stride == 0))
        .withColumn("origin_seq", F.floor(step / spec.stride))
    )
    if spec.max_origins is not None:
        found = found.filter(F.col("origin_seq") < spec.max_origins)  # keeps the first n
    return found.filter(F.col("pos") >= spec.min_train_rows).drop("first_pos", "last_pos")


def origin_rows_by_count(rows: DataFrame, spec: BacktestSpec) -> DataFrame:
    """Rows at positions min_train-1, then every ``stride``, with a known target; the last n are kept."""
    step = F.col("pos") - (spec.min_train_rows - 1)
    found = (
        blocks.attach(rows.filter((step >= 0) & (step % spec.stride == 0) & F.col("y").isNotNull()), series_bounds(rows, spec))
        .filter(F.col("pos") + spec.horizon <= F.col("last_pos"))
        .withColumn("origin_seq", F.floor(step / spec.stride))
    )
    if spec.max_origins is not None:
        # A rank filter of this form is cut down per input partition before the exchange.
        latest = Window.partitionBy("series").orderBy(F.col("pos").desc())
        found = found.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= spec.max_origins).drop("_r")
    return found.drop("first_pos", "last_pos")


def sparse_origin_rows(observed: DataFrame, panel_spec: PanelSpec, spec: BacktestSpec, back: int) -> DataFrame:
    """:func:`origin_rows_by_count` of the grid over ``observed``, with the arrays that references read, from observed rows alone.

    Positions follow from the time since the first row of a series. Rows are cut into blocks of time with the neighbours that the arrays
    reach; the ends of a series are copied to its blocks. Steps without a row are NULL in ``ahead_y`` and ``back_y``.
    """
    step = panel_spec.step_seconds
    width = step * panel_spec.block_rows
    ends = observed.groupBy("series").agg(F.unix_timestamp(F.min("ts")).alias("_lo"), F.unix_timestamp(F.max("ts")).alias("_hi"))
    block = lambda t: F.floor(t / F.lit(width))
    at = F.unix_timestamp("ts")
    rows = observed.select("series", "ts", "y", at.alias("_at"), block(at).alias("_own")).withColumn(
        "_block", F.explode(F.sequence(block(F.col("_at") - spec.horizon * step), block(F.col("_at") + back * step)))
    )
    ends = ends.withColumn("_block", F.explode(F.sequence(block(F.col("_lo")), block(F.col("_hi")))))
    span = F.col("_at") - F.col("_lo")
    placed = (
        rows.join(ends, ["series", "_block"])
        .filter((span % step == 0) & (F.timestamp_seconds("_at") == F.col("ts")) & F.col("y").isNotNull())
        .withColumns({"pos": F.floor(span / F.lit(step)), "last_pos": F.floor((F.col("_hi") - F.col("_lo")) / F.lit(step))})
    )
    near = Window.partitionBy("series", "_block").orderBy("pos").rangeBetween(-back, spec.horizon)
    first = spec.min_train_rows - 1
    found = (
        placed.withColumn("_near", F.collect_list(F.struct("pos", "y")).over(near))
        .filter(F.col("_own") == F.col("_block"))
        .filter((F.col("pos") >= first) & ((F.col("pos") - first) % spec.stride == 0) & (F.col("pos") + spec.horizon <= F.col("last_pos")))
        .withColumns({"origin_seq": F.floor((F.col("pos") - first) / spec.stride), "_near": F.map_from_entries("_near")})
    )
    if spec.max_origins is not None:
        latest = Window.partitionBy("series").orderBy(F.col("pos").desc())
        found = found.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= spec.max_origins)
    value = lambda p: F.try_element_at("_near", p)
    return found.select(
        "series", "ts", "pos", "y", "origin_seq",
        F.array(*[F.timestamp_seconds(F.col("_at") + h * step) for h in range(spec.horizon + 1)]).alias("ahead_ts"),
        F.array(*[value(F.col("pos") + h) for h in range(spec.horizon + 1)]).alias("ahead_y"),
        F.array(*[value(F.col("pos") - h) for h in range(back + 1)]).alias("back_y"),
    )


def series_bounds(rows: DataFrame, spec: BacktestSpec) -> DataFrame:
    """One row per series: position of the first origin candidate and of the last row."""
    if spec.convention == "C":
        first = F.lit(spec.min_train_rows - 1).cast("long")
    else:
        first = F.min(F.when(F.col("ts") >= F.lit(spec.test_start).cast("timestamp"), F.col("pos")))
    return rows.groupBy("series").agg(first.alias("first_pos"), F.max("pos").alias("last_pos"))


def origin_rows(rows: DataFrame, spec: BacktestSpec) -> DataFrame:
    return origin_rows_by_count(rows, spec) if spec.convention == "C" else origin_rows_by_time(rows, spec)


def origins(positioned: DataFrame, spec: BacktestSpec) -> DataFrame:
    """``series, origin, origin_pos, origin_seq``."""
    return origin_rows(positioned, spec).select(
        "series", F.col("ts").alias("origin"), F.col("pos").alias("origin_pos"), "origin_seq"
    )


def train_window(panel: DataFrame, origin: str, train_start: str | None = None) -> DataFrame:
    """Rows strictly before one origin."""
    rows = panel.filter(F.col("ts") < F.lit(origin).cast("timestamp"))
    return rows if train_start is None else rows.filter(F.col("ts") >= F.lit(train_start).cast("timestamp"))


def test_window(positioned: DataFrame, origin: str, rows: int) -> DataFrame:
    """The origin row and those after it, ``rows`` in all, for every series that has this origin."""
    at = positioned.filter(F.col("ts") == F.lit(origin).cast("timestamp")).select("series", F.col("pos").alias("_p"))
    # The few positions asked for, so that only rows of the window meet.
    wanted = at.select("series", F.explode(F.sequence(F.col("_p"), F.col("_p") + (rows - 1))).alias("pos"))
    return positioned.join(wanted, ["series", "pos"], "left_semi")


def first_usable_origin(spec: BacktestSpec, first_pos, horizon: int | None = None):
    """Index of the first origin whose training set contains the row at ``pos``.

    With first origin position P0 and stride s, a row whose H targets must lie inside the training prefix is
    usable from k = max(0, ceil((pos + H - e - P0) / s)), e being the offset of the last training row.
    """
    h = spec.horizon if horizon is None else horizon
    return F.greatest(
        F.lit(0).cast("long"),
        F.ceil((F.col("pos") + h - spec.train_end_offset - first_pos) / F.lit(spec.stride)),
    )
