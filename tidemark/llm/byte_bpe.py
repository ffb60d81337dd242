"""Byte-level BPE over Arrow batches: encoding with offsets, and exact decoding."""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm.common import ready, text_slices

#: Pieces remembered per worker and their longest length in characters; others are encoded each time they occur.
MEMO_PIECES = 400_000
MEMO_CHARS = 48


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others by order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge behind each token of several bytes: what is left of it when only lower ranks have merged."""
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
        while len(parts) > 2:
            rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class Codec:
    """Encoder and decoder of one rank file; a worker keeps one."""

    def __init__(self, data: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        ranks, characters = read_ranks(data), byte_characters()
        self.split = regex.compile(pattern).findall
        spell = lambda token: "".join(characters[b] for b in token)
        self.model = Tokenizer(models.BPE(
            vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)], ignore_merges=True
        ))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        byte_of = {c: b for b, c in enumerate(characters)}
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for token, rank in self.model.get_vocab().items():
            self.bytes_of[rank] = bytes(byte_of[c] for c in token)
        self.text_of = [str(i) for i in range(size)]
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text: every match of the pattern on its own. Pieces not remembered yet are encoded together."""
        gc.disable()  # many small tuples and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        needed = set().union(*split)
        new = [p for p in needed if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo.clear()
            new = list(needed)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, words = found.ids, np.array(found.word_ids)
            ends = np.searchsorted(words, np.arange(len(part)), side="right").tolist()
            self.memo.update((p, tuple(ids[a:b])) for p, a, b in zip(part, [0, *ends], ends, strict=False))
        ids = [list(chain.from_iterable(map(self.memo.__getitem__, pieces))) for pieces in split]
        for piece in new:
            if len(piece) > MEMO_CHARS:
                del self.memo[piece]
        return ids

    def starts(self, text: str) -> list[int]:
        """Character offset of each token: of the character that holds its first byte (a split character counts for all its tokens)."""
        out, at = [], 0
        for piece, encoding in zip(pieces := self.split(text), self.model.encode_batch(pieces, add_special_tokens=False), strict=True):
            out += [at + a for a, _ in encoding.offsets]
            at += len(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a token list. Bytes are joined before any becomes a character, so characters split over tokens come back whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as file:
        return Codec(file.read(), pattern)


def _ship(spark, ranks_path: str) -> str:
    """Give executors the rank file through Spark; its name there."""
    spark.sparkContext.addFile(ranks_path)
    return ranks_path.rstrip("/").rsplit("/", 1)[-1]


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", offsets: bool = False, digests: bool = False, ids: bool = True
) -> DataFrame:
    """``df`` without the text, and the tokens of its whole text (null: empty).

    Adds ``n_tokens`` and, as asked, ``ids`` (array of int), ``starts`` (character offset of each token), and digests:
    ``ids_sha256`` over the decimal ids joined by spaces, ``decoded_sha256`` over the bytes that the ids decode to. A column of
    ``df`` by one of these names is replaced. An empty text has no tokens.
    """
    spark = ready(df.sparkSession)
    name = _ship(spark, ranks_path)
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("starts", T.ArrayType(T.IntegerType()))] * offsets
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests
    new = [f.name for f in added]
    kept = [c for c in df.columns if c != text_col and c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in kept], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            for start, texts in text_slices(batch.column(len(kept)).to_pylist()):
                counts, lists, places, first, second = [], [], [], [], []
                for text, tokens in zip(texts, codec.encode(texts), strict=True):
                    counts.append(len(tokens))
                    if ids:
                        lists.append(tokens)
                    if offsets:
                        places.append(codec.starts(text))
                    if digests:
                        first.append(hashlib.sha256(" ".join(map(codec.text_of.__getitem__, tokens)).encode()).hexdigest())
                        second.append(hashlib.sha256(codec.decode(tokens)).hexdigest())
                part = batch.slice(start, len(texts))
                columns = [*part.columns[: len(kept)], pa.array(counts, pa.int64())]
                columns += [pa.array(lists, pa.list_(pa.int32()))] * ids + [pa.array(places, pa.list_(pa.int32()))] * offsets
                columns += [pa.array(x, pa.string()) for x in (first, second)] if digests else []
                yield pa.RecordBatch.from_arrays(columns, names=kept + new)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` and ``decoded`` (binary): the bytes that a token list stands for. A null list gives null, null ids are left out."""
    spark = ready(df.sparkSession)
    name = _ship(spark, ranks_path)
    kept = [c for c in df.columns if c != "decoded"]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            lists = batch.column(kept.index(ids_col)).to_pylist()
            decoded = [None if x is None else codec.decode([i for i in x if i is not None]) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*kept, "decoded"])

    return source.mapInArrow(run, schema)
