"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ready, words_of
from tidemark.llm.components import connected_components
from tidemark.session import stage

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Groups up to this size list their links; larger ones only a spanning forest.
SMALL_GROUP = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, as an unsigned integer; zero for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(df: DataFrame, text_col: str = "text", name: str = "__fingerprint") -> DataFrame:
    """All columns of ``df`` and the fingerprint as a signed long; a null text counts as empty."""
    ready(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            prints = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


# --- anchors -------------------------------------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a half, and for every syndrome the flips that lead to anchors within two bits.

    The anchors of a 32-bit half are the words whose low 31 bits lie in the perfect Hamming code of that length and whose
    top bit is free: every half is within one bit of an anchor. Bit i of the code has position i + 1.
    """
    syndromes = np.zeros((4, 256), np.int64)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                position = byte * 8 + bit + 1
                if value >> bit & 1 and position <= 31:
                    syndromes[byte, value] ^= position
    free = 1 << 31
    flips, counts = np.zeros((32, 17), np.int64), np.zeros(32, np.int64)
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        found = [home, home | free]
        if s:
            found += [1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, 32) if p != s and p < p ^ s]
        flips[s, : len(found)], counts[s] = found, len(found)
    return syndromes, flips, counts


SYNDROMES, FLIPS, COUNTS = _tables()


def syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.int64)
    for byte in range(4):
        out ^= SYNDROMES[byte][half >> (8 * byte) & 255]
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(anchor key, row)`` for every anchor within covering radius plus threshold of either half.

    At most three differing bits leave at most one in one of the two halves. A half is within one bit of its own anchor, so a
    half that differs in one bit is within two of it. The key holds the number of the half and the anchor.
    """
    keys, rows = [], []
    for number in (0, 1):
        half = (prints.view(np.uint64) >> np.uint64(32 * number) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s = syndrome(half)
        row = np.repeat(np.arange(len(half)), COUNTS[s])
        place = np.arange(len(row)) - np.repeat(np.cumsum(COUNTS[s]) - COUNTS[s], COUNTS[s])
        keys.append((half[row] ^ FLIPS[s[row], place]) | (number << 32))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        keys, rows = anchors(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], names=["anchor", "fp"])


def _forest(prints: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links of one large group: every print is expanded once against those not reached yet."""
    left, queue = prints, []
    while len(left) or queue:
        if queue:
            at = queue.pop()
        else:
            at, left = left[0], left[1:]
        near = np.bitwise_count(left ^ at) <= most
        reached, left = left[near], left[~near]
        yield from ((int(x), int(at)) for x in reached.view(np.int64))
        queue.extend(reached)


def _compare(keys: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal keys (sorted)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    of = np.repeat(sizes, sizes)
    src, dst = [], []
    small = (of > 1) & (of <= SMALL_GROUP)
    k, p = keys[small], prints[small]
    for offset in range(1, SMALL_GROUP):
        if len(k) <= offset:
            break
        hit = (k[offset:] == k[:-offset]) & (np.bitwise_count(p[offset:] ^ p[:-offset]) <= most)
        src.append(p[offset:][hit].view(np.int64))
        dst.append(p[:-offset][hit].view(np.int64))
    for at, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        pairs = np.array([(a, np.uint64(b).view(np.int64)) for a, b in _forest(prints[at : at + size], most)], dtype=np.int64).reshape(-1, 2)
        src.append(pairs[:, 0])
        dst.append(pairs[:, 1])
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _link(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(k, p):
            src, dst = _compare(k, p, most)
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            prints = np.r_[prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on in the next batch
            if cut:
                yield links(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield links(keys, prints)

    return run


def fingerprint_links(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``(src, dst)`` links between distinct fingerprints (column ``fp``) that differ in ``most`` bits or fewer (at most 3).

    Groups of one anchor stream through sorted partitions, so that a task holds one group at a time; large groups give a
    spanning forest, which is all that components need, never all their pairs.
    """
    if not 0 <= most <= 3:
        raise ValueError("two halves cover thresholds up to three bits")
    dealt = prints.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    return dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_link(most), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by links).

    Equal fingerprints are taken together first, so that copies, however many, count once in the search. A null text counts
    as empty, and empty texts have fingerprint zero. Rows with a null id take part and get the smallest id of their component
    (null if none has one). Repeated rows stay repeated; other columns of ``docs`` are ignored.
    """
    rows = stage(
        with_fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", "fp").select("__id", "fp"), "prints"
    )
    return rows.join(components_of(rows, most), "fp").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def components_of(rows: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``(fp, component, component_id)``: the label and the smallest id of the component of every fingerprint in ``rows``."""
    prints = stage(rows.groupBy("fp").agg(F.min("__id").alias("least")), "distinct")
    reach = connected_components(fingerprint_links(prints, most)).withColumnRenamed("node", "fp")
    joined = prints.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return stage(joined.select("fp", "component").join(least, "component").select("fp", "component", "component_id"), "components")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-copies: of every component one row stays, with all columns of ``docs``.

    It is the row with the smallest id (nulls last); where rows share that id, the first by digest of the text.
    """
    digest = F.md5(F.coalesce(text_col, F.lit("")))
    marked = with_fingerprints(docs, text_col, "__fp")
    rows = stage(marked.select(F.col(id_col).alias("__id"), F.col("__fp").alias("fp"), digest.alias("__md5")), "prints")
    counted = rows.groupBy("fp", "__id", "__md5").count().join(components_of(rows).select("fp", "component"), "fp")
    chosen = stage(
        counted.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__md5", "fp", "count")).alias("k"))
        .select(F.col("k.fp").alias("__fp"), F.col("k.__id").alias("__kept"), F.col("k.__md5").alias("__md5"), F.col("k.count").alias("__n")), "chosen",
    )
    marked = marked.withColumn("__md5", digest)
    kept = marked.join(chosen.withColumnsRenamed({"__fp": "__chosen_fp", "__md5": "__chosen_md5"}), (
        (F.col("__fp") == F.col("__chosen_fp")) & (F.col("__md5") == F.col("__chosen_md5")) & F.col(id_col).eqNullSafe(F.col("__kept"))
    ))
    if not chosen.filter("__n > 1").isEmpty():  # the very same row, repeated
        kept = kept.dropDuplicates(["__fp", "__kept", "__md5"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
