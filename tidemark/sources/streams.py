"""Files opened by tasks and read in pieces of bounded size: first lines, digests, and cells of a line."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read at once.
PIECE = 4 << 20
#: Stores that Python opens like Spark does.
SCHEMES = {"": None, "file": None, "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def openable(files: DataFrame) -> bool:
    """Whether tasks can open all of ``path`` themselves; the driver gets the few different schemes."""
    scheme = F.regexp_extract("path", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return all(r[0] in SCHEMES for r in files.select(scheme.alias("scheme")).distinct().limit(len(SCHEMES) + 1).collect())


def open_file(path: str):
    """A decoded path as Spark lists it, as a binary stream."""
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else ""
    kind = SCHEMES[scheme]
    if kind is None:
        local = path[len(scheme) + 1 :] if scheme else path
        return open("/" + local.lstrip("/") if scheme else local, "rb")
    system, inside = fs.FileSystem.from_uri(f"{kind}:{path.split(':', 1)[1]}")
    return system.open_input_stream(inside)


def pieces(path: str, size: int = PIECE) -> Iterator[bytes]:
    with open_file(path) as file:
        while piece := file.read(size):
            yield piece


def first_line(path: str) -> str:
    """Up to the first line feed, however far that is; nothing behind its piece is read."""
    held = []
    for piece in pieces(path, 1 << 16):
        head, feed, _ = piece.partition(b"\n")
        held.append(head)
        if feed:
            break
    return b"".join(held).decode("utf-8", "replace")


def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, length`` → ``path, length, header``."""
    for batch in batches:
        heads = [first_line(path) for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.string())], names=["path", "length", "header"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, length`` → ``path, size_bytes, sha256``; the size is that of the bytes read."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            digest, size = hashlib.sha256(), 0
            for piece in pieces(path):
                digest.update(piece)
                size += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "size_bytes", "sha256"])


def cells_of(line: str, sep: str) -> list[str]:
    """Cells of one line; quotes may hold separators and doubled quotes, but no line breaks."""
    if '"' not in line:
        return line.split(sep)
    try:
        return next(csv.reader([line], delimiter=sep, strict=True))
    except csv.Error as error:
        if "unexpected end of data" in str(error):
            raise ValueError("a quoted value goes on in the next line, which this reader cannot join") from None
        return next(csv.reader([line], delimiter=sep))  # stray quotes are text
