"""Delimited station files of varying layout, read as text columns and normalized into panels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import normalize_component, normalize_header, normalize_city
from tidemark.operators.quality import dedup
from tidemark.session import stage
from tidemark.sources import streams

# Column aliases, canonical columns and file-name patterns of the supported layouts.
DATE_COLUMNS = ("Date and Time", "datetime", "timestamp", "date")
POLLUTANTS = ("PM10", "PM2.5", "NO2", "O3", "SO2", "CO")
WEATHER = ("rain", "temp", "wetb", "dewpt", "vappr", "rhum", "msl", "wdsp", "wddir")
STATION_ALIASES = ("codest", "estacion", "codigo", "cod_est", "station", "cod")
DATE_ALIASES = ("fecha", "date")
YEAR_ALIASES = ("año", "anyo", "year", "anio")
MONTH_ALIASES = ("mes", "month")
DAY_ALIASES = ("dia", "day")
VARIABLE_ALIASES = ("parametro", "variable", "param", "contaminante", "pollutant")
HOUR_ALIASES = ("hora", "hour", "hh")
VALUE_ALIASES = ("valor", "value", "concentracion", "conc")
NETWORK_ALIASES = {
    "city": ("city", "city_name", "ciudad"),
    "station_id": ("station_id", "station", "station_code"),
    "component": ("component", "pollutant", "parameter"),
    "datetime": ("datetime", "timestamp", "date"),
    "value": ("value", "concentration", "valor"),
}
STATION_SUFFIXES = (
    "_finalised_merged_dublin_NA",
    "_finalised merged_NA",
    "_finalised merging_NA",
    "_merging finalised_NA",
    "_finalised_merged_NA",
    "_merged_NA",
)
STATION_CODE = r"\b(30\d{5})\b"
DAILY_FILE = r"^(PM10|PM25|PM2\.5)_(.+)_(.+)_daily\.csv$"
HOUR_COLUMN = r"^[Hh](\d{1,2})$"
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd",
)
DAY_FIRST_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm", "dd-MM-yyyy")
MONTH_FIRST_FORMATS = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")


# --- headers -----------------------------------------------------------------------------------------------


def separator_of(header: str, tie: str = ";") -> str:
    semicolons, commas = header.count(";"), header.count(",")
    if semicolons == commas:
        return tie
    return ";" if semicolons > commas else ","


#: Bytes of a long file whose lines are joined with the file's header by one task.
PART_BYTES = 64 << 20


def _listed(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _decoded(name: str) -> Column:
    """A text of the hidden metadata column; it is percent-encoded there, apart from plus signs."""
    return F.url_decode(F.replace(F.col(f"_metadata.{name}"), F.lit("+"), F.lit("%2B")))


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``_line`` of all files with ``_path``, ``_part`` of the file, ``_file`` and ``_seq``, which orders lines by file and place in the file.

    Spark reads the files, so any store it knows will do. Long files come in blocks; lines of one block are read by one task.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(_listed(paths))
    block = F.col("_metadata.file_block_start")
    place = F.struct(_decoded("file_path").alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("row"))
    line = F.regexp_replace("value", "^\ufeff|\\r$", "")
    return raw.select(line.alias("_line"), place["path"].alias("_path"), F.floor(block / PART_BYTES).alias("_part"), _decoded("file_name").alias("_file"), place.alias("_seq"))


def file_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, length, header`` of every file that has a line: the whole first line, however long.

    Only the start of each file is read, by tasks that open it themselves. Files of a store that Python cannot open are read by Spark, whole.
    """
    files = list_files(spark, paths).filter("length > 0")
    opened = streams.openable(files)
    if opened:
        kind = "path string, length long, header string"
        return files.repartition("path").mapInArrow(streams.first_lines, kind).withColumn("header", F.regexp_replace("header", "^\ufeff|\\r$", ""))
    first = text_lines(spark, paths).groupBy(F.col("_path").alias("path")).agg(F.min_by("_line", "_seq").alias("header"))
    return first.join(files, "path").select("path", "length", "header")


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, length`` of all files that have a byte (Spark lists no others); contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_listed(paths))
    return found.select(_decoded("file_path").alias("path"), "length")


def detect_separator(spark: SparkSession, path: str, tie: str = ";") -> str:
    return separator_of(file_headers(spark, path).orderBy("path").select("header").first()[0], tie)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip byte-order marks and blanks from column names."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def find_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias present, comparing without case, blanks and accents on both sides."""
    normed = {normalize_header(c): c for c in columns}
    for alias in aliases:
        if normalize_header(alias) in normed:
            return normed[normalize_header(alias)]
    return None


def pick_column(columns: Sequence[str], aliases: Sequence[str]) -> str:
    found = find_column(columns, aliases)
    if found is None:
        raise ValueError(f"none of {list(aliases)} among {list(columns)}")
    return found


def read_text_columns(spark: SparkSession, paths: str | Sequence[str], sep: str | None = None, tie: str = ";") -> DataFrame:
    """All columns as strings, headers cleaned, plus the file name as ``_file`` and the order of ingest as ``_seq``.

    Files may differ in separator and header: each is read by its own, and columns that a file lacks are NULL.
    """
    found = stage(file_layouts(spark, paths, tie, sep), "layouts")
    each = found.select("header", F.posexplode("names").alias("at", "name"))
    # The schema: names in the order of the sorted headers. It is the only thing that reaches the driver.
    names = [r["name"] for r in each.groupBy("name").agg(F.min(F.struct("header", "at")).alias("first")).orderBy("first").select("name").collect()]
    if not names:
        raise ValueError(f"no lines in {paths}")
    at = F.transform(
        F.array(*[F.lit(n) for n in names]), lambda n: F.nullif(F.array_position(F.col("names"), n).cast("int"), F.lit(0)) - 1
    )
    rows = file_rows(spark, paths, found.withColumn("slots", at))
    return rows.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)], "_file", "_seq")


# --- values ------------------------------------------------------------------------------------------------


def to_number(x: Column) -> Column:
    """Text to double; what does not parse, and NaN, becomes NULL."""
    value = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_timestamp(x: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    text = F.trim(x.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_with_fallback(
    df: DataFrame, column: str, out: str = "ts", first: Sequence[str] = TIMESTAMP_FORMATS,
    second: Sequence[str] = MONTH_FIRST_FORMATS, tolerance: float = 0.01,
) -> DataFrame:
    """Parse with the first formats; the second ones apply only if more than ``tolerance`` of all rows failed."""
    failed = df.agg(F.avg(to_timestamp(F.col(column), first).isNull().cast("int"))).scalar()
    primary = to_timestamp(F.col(column), first)
    return df.withColumn(
        out, F.when(failed > tolerance, F.coalesce(primary, to_timestamp(F.col(column), second))).otherwise(primary)
    )


def station_from_file(file_name: Column) -> Column:
    """Station name from a file name: extension and known suffixes off, underscores to blanks, blanks collapsed."""
    name = F.regexp_replace(file_name, r"\.[^.]*$", "")
    for suffix in STATION_SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    return F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+", " "))


def station_code_from_file(file_name: Column) -> Column:
    code = F.regexp_extract(F.regexp_replace(file_name, r"\.[^.]*$", ""), STATION_CODE, 1)
    return F.when(code != "", code)


def daily_file_parts(file_name: Column) -> Column:
    """``pollutant, city, station_id`` of a daily series file, NULL for other names."""
    part = lambda i: F.regexp_extract(file_name, DAILY_FILE, i)
    return F.when(
        file_name.rlike(DAILY_FILE),
        F.struct(
            F.when(part(1) == "PM25", F.lit("PM2.5")).otherwise(part(1)).alias("pollutant"),
            part(2).alias("city"),
            part(3).alias("station_id"),
        ),
    )


# --- panels ------------------------------------------------------------------------------------------------


def load_panel(spark: SparkSession, path: str, ts: str, target: str, series: str | None = None,
               sep: str | None = None) -> DataFrame:
    """Target series from delimited or parquet files: parsed, rows without a timestamp dropped, last row per key kept.

    The ingest order, needed to tell the last row, is (file, position in file).
    """
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_text_columns(spark, path, sep)
    missing = [c for c in (ts, target) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = raw.select(
        (F.col(series) if series else F.lit("series")).cast("string").alias("series"),
        to_timestamp(F.col(ts)).alias("ts"),
        to_number(F.col(target)).alias("y"),
        F.col("_seq") if "_seq" in raw.columns else F.monotonically_increasing_id().alias("_seq"),
    ).filter("ts IS NOT NULL")
    return dedup(rows, ["series", "ts"], ["_seq"], "last").drop("_seq")


def load_covariates(spark: SparkSession, path: str | None, ts: str = "timestamp", sep: str | None = None) -> DataFrame:
    """Covariates by timestamp; an empty table when no file is given."""
    if path is None:
        return spark.createDataFrame([], "ts timestamp")
    raw = read_text_columns(spark, path, sep)
    names = [c for c in raw.columns if c not in (ts, "_file", "_seq")]
    rows = raw.select(
        to_timestamp(F.col(ts)).alias("ts"), *[to_number(F.col(f"`{c}`")).alias(c) for c in names], "_seq",
    ).filter("ts IS NOT NULL")
    return dedup(rows, ["ts"], ["_seq"], "last").drop("_seq")


def canonical_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Project to a fixed column list; absent columns come out as NULL doubles."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in wanted])


@dataclass(frozen=True)
class Layout:
    """What files with one header share."""

    header: str
    sep: str

    @property
    def columns(self) -> list[str]:
        return header_names(self.header, self.sep)


def header_names(header: str, sep: str) -> list[str]:
    """Names of a header; a quoted name may hold the separator."""
    return [c.replace("\ufeff", "").strip().strip('"') for c in streams.cells_of(header, sep)]


def layouts(spark: SparkSession, paths: str | Sequence[str], tie: str = ";") -> list[Layout]:
    """The different headers of all files."""
    heads = file_headers(spark, paths).select("header").distinct().orderBy("header").collect()
    return [Layout(row["header"], separator_of(row["header"], tie)) for row in heads]


#: From the names of a header: where the asked columns are (None: not there). ValueError if the files cannot be used.
Pick = Callable[[list[str]], list[int | None]]


def file_layouts(spark: SparkSession, paths: str | Sequence[str], tie: str = ";", sep: str | None = None, pick: Pick | None = None) -> DataFrame:
    """One row per file: ``path, length, header, sep, names, slots, problem``. ``slots`` are the places that ``pick`` found, ``problem`` why it found none."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seps, names, slots, problems = [], [], [], []
            for header in batch.column(2).to_pylist():
                mark = sep or separator_of(header, tie)
                own, found, problem = header_names(header, mark), None, None
                if pick is not None:
                    try:
                        found = pick(own)
                    except ValueError as error:
                        problem = str(error)
                for column, value in zip((seps, names, slots, problems), (mark, own, found, problem), strict=True):
                    column.append(value)
            columns = [pa.array(seps, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.int32())), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["path", "length", "header", "sep", "names", "slots", "problem"])

    kind = "path string, length long, header string, sep string, names array<string>, slots array<int>, problem string"
    return file_headers(spark, paths).mapInArrow(describe, kind)


def file_rows(spark: SparkSession, paths: str | Sequence[str], found: DataFrame) -> DataFrame:
    """``cells`` (one text per slot), ``header``, ``_file`` and ``_seq`` of every line of the files of ``found`` that have slots, in one scan.

    A cell is null where the file has no such column and empty where the line leaves it blank. Lines that repeat the header and blank
    lines are no rows. Lines meet their file's header by (path, part of the file), so a file of any size is spread. A quoted value
    that goes on in the next line is an error.
    """
    heads = found.filter("slots IS NOT NULL").select(
        F.col("path").alias("_path"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / PART_BYTES))).alias("_part"), "header", "sep", "slots"
    )
    lines = text_lines(spark, paths).join(heads, ["_path", "_part"])
    data = lines.filter((F.col("_line") != F.col("header")) & (F.trim("_line") != "")).select("_line", "sep", "slots", "header", "_file", "_seq")
    kind = f"cells array<string>, header string, _file string, _seq {data.schema['_seq'].dataType.simpleString()}"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for line, sep, slots, file in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                try:
                    row = streams.cells_of(line, sep)
                except ValueError as error:
                    raise ValueError(f"{file}: {error}") from None
                cells.append([None if at is None else row[at] if at < len(row) else "" for at in slots])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.string())), *batch.columns[3:]], names=["cells", "header", "_file", "_seq"])

    return data.mapInArrow(parse, kind)


def layout_counts(spark: SparkSession, paths: str | Sequence[str], tie: str = ";") -> DataFrame:
    """``sep, n_columns, n_rows`` of every different header, from one scan."""
    found = stage(file_layouts(spark, paths, tie, pick=lambda names: [0]), "layouts")
    counts = file_rows(spark, paths, found).groupBy("header").agg(F.count("*").alias("n_rows"))
    heads = found.groupBy("header").agg(F.any_value("sep").alias("sep"), F.any_value(F.size("names")).alias("n_columns"))
    return heads.join(counts, "header", "left").select("sep", "n_columns", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


_NUMBERS = (*POLLUTANTS, *WEATHER)


def _pick_station(names: list[str]) -> list[int | None]:
    at = {c: i for i, c in enumerate(names)}
    return [at[pick_column(names, DATE_COLUMNS)], *[at.get(c) for c in _NUMBERS]]


def ingest_stations(spark: SparkSession, folder: str, exclude: Sequence[str] = (), keep: str = "first") -> DataFrame:
    """One file per station → panel with the canonical columns (``timestamp, station``, pollutants, weather), in one scan.

    Station names come from file names; unparsed timestamps are dropped; one row per (station, timestamp). A file without a
    column of times is an error.
    """
    found = stage(file_layouts(spark, folder, ",", pick=_pick_station), "layouts")
    bad = found.filter("slots IS NULL").select("path", "problem").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: {bad['problem']}")
    if found.isEmpty():
        raise ValueError(f"no usable file in {folder}")
    rows = file_rows(spark, folder, found).select(
        to_timestamp(F.get("cells", F.lit(0)), TIMESTAMP_FORMATS + DAY_FIRST_FORMATS).alias("timestamp"),
        station_from_file(F.col("_file")).alias("station"),
        *[to_number(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(_NUMBERS, 1)],
        "_seq",
    ).filter("timestamp IS NOT NULL")
    if exclude:
        rows = rows.filter(~F.col("station").isin(list(exclude)))
    return dedup(rows, ["station", "timestamp"], ["_seq"], keep).drop("_seq")


def station_columns(spark: SparkSession, folder: str) -> DataFrame:
    """What each station file offers, from headers alone: ``file, station, n_columns, date_column, pm10_available, pm25_available`` and the
    comma-joined ``meteo_columns_available`` and ``aux_pollutants_available``, in the order of the canonical columns."""
    names = F.col("names")
    listed = lambda wanted: F.array_join(F.filter(F.array(*[F.lit(c) for c in wanted]), lambda c: F.array_contains(names, c)), ",")
    dates = F.filter(F.array(*[F.lit(c) for c in DATE_COLUMNS]), lambda c: F.array_contains(F.transform(names, F.lower), F.lower(c)))
    file = F.element_at(F.split("path", "/"), -1)
    return file_layouts(spark, folder, ",").select(
        file.alias("file"), station_from_file(file).alias("station"), F.size(names).alias("n_columns"), F.get(dates, F.lit(0)).alias("date_column"),
        F.array_contains(names, "PM10").alias("pm10_available"), F.array_contains(names, "PM2.5").alias("pm25_available"),
        listed(WEATHER).alias("meteo_columns_available"), listed([c for c in POLLUTANTS if not c.startswith("PM")]).alias("aux_pollutants_available"),
    )


def standardize_network(df: DataFrame) -> DataFrame:
    """Network export → ``city, station_id, component, datetime, value``; rows lacking time or value are dropped."""
    source = {name: F.col(f"`{pick_column(df.columns, aliases)}`") for name, aliases in NETWORK_ALIASES.items()}
    return df.select(
        normalize_city(source["city"]).alias("city"),
        F.trim(source["station_id"].cast("string")).alias("station_id"),
        normalize_component(source["component"]).alias("component"),
        to_timestamp(source["datetime"]).alias("datetime"),
        to_number(source["value"]).alias("value"),
    ).dropna(subset=["datetime", "value"])


def hour_columns(columns: Sequence[str]) -> dict[int, str]:
    return {int(m.group(1)): c for c in columns if (m := re.match(HOUR_COLUMN, c))}


def _row_date(df: DataFrame) -> Column | None:
    day = find_column(df.columns, DATE_ALIASES)
    if day is not None:
        return to_timestamp(F.col(f"`{day}`"), DAY_FIRST_FORMATS + TIMESTAMP_FORMATS)
    parts = [find_column(df.columns, a) for a in (YEAR_ALIASES, MONTH_ALIASES, DAY_ALIASES)]
    if any(p is None for p in parts):
        return None
    y, m, d = [F.trim(F.col(f"`{p}`").cast("string")) for p in parts]
    return to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def _station_and_variable(df: DataFrame) -> tuple[Column, Column]:
    station = find_column(df.columns, STATION_ALIASES)
    variable = find_column(df.columns, VARIABLE_ALIASES)
    from_file = station_code_from_file(F.col("_file")) if "_file" in df.columns else F.lit(None).cast("string")
    return (
        F.trim(F.col(f"`{station}`").cast("string")) if station else from_file,
        F.upper(F.trim(F.col(f"`{variable}`").cast("string"))) if variable else F.lit("UNKNOWN"),
    )


def wide_days_to_long(df: DataFrame) -> DataFrame:
    """Rows of H01..H24 per day → one row per hour; H24 is midnight of the next day."""
    hours = hour_columns(df.columns)
    date = _row_date(df)
    if not hours or date is None:
        raise ValueError("not a wide day layout")
    station, variable = _station_and_variable(df)
    order = [c for c in ("_seq",) if c in df.columns]
    cells = F.array(
        *[F.struct(F.lit(h).alias("h"), F.col(f"`{c}`").cast("string").alias("v")) for h, c in sorted(hours.items())]
    )
    return (
        df.select(date.alias("_d"), station.alias("station"), variable.alias("variable"), *order, F.inline(cells))
        .filter(F.col("_d").isNotNull() & F.col("station").isNotNull())
        .select(_at_hour(F.col("_d"), F.col("h")).alias("timestamp"), "station", "variable", to_number(F.col("v")).alias("value"), *order)
    )


def long_hours_to_panel(df: DataFrame) -> DataFrame:
    """Rows of (date, hour 0..24, value) → one row per timestamp; hour 24 is midnight of the next day."""
    date = _row_date(df)
    hour = find_column(df.columns, HOUR_ALIASES)
    value = find_column(df.columns, VALUE_ALIASES)
    if date is None or hour is None or value is None:
        raise ValueError("not a long date-hour layout")
    station, variable = _station_and_variable(df)
    order = [c for c in ("_seq",) if c in df.columns]
    return (
        df.select(
            *order, date.alias("_d"), to_number(F.col(f"`{hour}`")).cast("int").alias("_h"), station.alias("station"),
            variable.alias("variable"), to_number(F.col(f"`{value}`")).alias("value"),
        )
        .filter(F.col("_d").isNotNull() & F.col("_h").isNotNull() & F.col("station").isNotNull())
        .select(_at_hour(F.col("_d"), F.col("_h")).alias("timestamp"), "station", "variable", "value", *order)
    )


def _at_hour(day: Column, hour: Column) -> Column:
    return F.date_trunc("day", day) + F.make_interval(hours=hour)


#: Hours that a column of a wide file may name; the 25th is that of the day on which clocks go back.
_HOURS = range(26)
_ROLES = (STATION_ALIASES, DATE_ALIASES, YEAR_ALIASES, MONTH_ALIASES, DAY_ALIASES, VARIABLE_ALIASES, HOUR_ALIASES, VALUE_ALIASES)


def _pick_drop(names: list[str]) -> list[int | None]:
    """Places of station, date, year, month, day, variable, hour, value and of the hour columns."""
    place = {c: i for i, c in reversed(list(enumerate(names)))}
    roles = [None if (c := find_column(names, aliases)) is None else place[c] for aliases in _ROLES]
    hours = {h: place[c] for h, c in hour_columns(names).items()}
    if roles[1] is not None:
        roles[2:5] = [None] * 3  # a date counts before its parts
    elif None in roles[2:5]:
        raise ValueError("no column of dates")
    if not hours and (roles[6] is None or roles[7] is None):
        raise ValueError("neither columns of hours nor an hour and a value")
    return [*roles, *[hours.get(h) for h in _HOURS]]


def drop_folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, layout, problem`` of every file: ``wide``, ``long``, or null where the problem tells why it is skipped."""
    hours = F.exists(F.slice("slots", len(_ROLES) + 1, len(_HOURS)), lambda at: at.isNotNull())
    layout = F.when(F.col("slots").isNotNull(), F.when(hours, "wide").otherwise("long"))
    return file_layouts(spark, folder, pick=_pick_drop).select("path", layout.alias("layout"), "problem")


def ingest_drop_folder(spark: SparkSession, folder: str, stations: Sequence[str] | None = None) -> DataFrame:
    """Folder of mixed wide and long files → ``timestamp, station, variable, value``, last row per key, in one scan.

    Files count in the order of their paths, whatever their layouts, and rows in the order of the file. Files without the
    needed columns are skipped; :func:`drop_folder_files` lists them. Values are found by the names of each file's own header.
    """
    found = stage(file_layouts(spark, folder, pick=_pick_drop), "layouts")
    if found.filter("slots IS NOT NULL").isEmpty():
        raise ValueError(f"no usable file in {folder}")
    text = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    has = lambda i: F.get("cells", F.lit(i)).isNotNull()
    parts = [F.trim(text(i)) for i in (2, 3, 4)]
    by_parts = to_timestamp(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))
    date = F.when(has(1), to_timestamp(text(1), DAY_FIRST_FORMATS + TIMESTAMP_FORMATS)).otherwise(by_parts)
    station = F.when(has(0), F.trim(text(0))).otherwise(station_code_from_file(F.col("_file")))
    variable = F.when(has(5), F.upper(F.trim(text(5)))).otherwise(F.lit("UNKNOWN"))
    cell = lambda h, v: F.struct(h.cast("int").alias("h"), v.alias("v"))
    wide = F.filter(
        F.transform(F.slice("cells", len(_ROLES) + 1, len(_HOURS)), lambda v, h: cell(h, v)), lambda c: c["v"].isNotNull()
    )
    hours = F.when(F.size(wide) > 0, wide).otherwise(F.array(cell(to_number(text(6)), F.get("cells", F.lit(7)))))
    rows = (
        file_rows(spark, folder, found)
        .select(date.alias("_d"), station.alias("station"), variable.alias("variable"), "_seq", F.inline(hours))
        .filter("_d IS NOT NULL AND h IS NOT NULL AND station IS NOT NULL")
        .select(_at_hour(F.col("_d"), F.col("h")).alias("timestamp"), "station", "variable", to_number(F.col("v")).alias("value"), "_seq")
    )
    if stations is not None:
        rows = rows.filter(F.col("station").isin(list(stations)))
    return dedup(rows, ["station", "variable", "timestamp"], ["_seq"], "last").drop("_seq")
