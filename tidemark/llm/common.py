"""Shared pieces of the text and vector operators: tables, bounded Arrow batches, hashed folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship_package

#: Rows handed to Python at once; texts are whole, so this bounds memory together with SLICE_BYTES.
BATCH_ROWS = 2000
#: Bytes of text worked on at once inside a task.
SLICE_BYTES = 4 << 20
#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package to Python workers and bound their Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship_package(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(parts)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes methods treat ASCII alone, as the contracts ask."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Cut a batch into runs of whole texts of about ``most`` characters; null counts as empty. Yields (first row, texts)."""
    start, held, size = 0, [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
