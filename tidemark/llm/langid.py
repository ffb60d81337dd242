"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import sampling, subwords
from tidemark.llm.common import fold, ready, text_slices

#: Bound of the training sample: about so many texts in all, and so many of each language at least.
SAMPLE_ROWS, SAMPLE_EACH = 2500, 60
SETTINGS = subwords.Settings(lengths=(2, 3, 4), bits=16, dim=16, epochs=5, rate=0.3)
#: Share of the sample held back to set the temperature and the limit of rejection.
HELD_BACK = 0.2
#: Share of rightly recognized texts that the limit may reject, and its highest value.
REJECTED, HIGHEST = 0.0005, 0.45
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


def learn(rows: list[tuple], settings: subwords.Settings = SETTINGS) -> bytes:
    """Model of ``(id, text, language)`` rows. The last ones calibrate: a temperature, then the limit of the top probability."""
    if not rows:
        return pickle.dumps(([], None, None, 1.0, 0.0, settings))
    names = sorted({r[2] for r in rows})
    labels = np.array([names.index(r[2]) for r in rows], np.int64)
    cut = len(rows) - int(len(rows) * HELD_BACK)
    table, bias = subwords.train([r[1] for r in rows[:cut]], labels[:cut], len(names), settings)
    logits = _logits([r[1] for r in rows[cut:]], table, bias, settings) if cut < len(rows) else np.zeros((0, len(names)))
    scale = subwords.temperature(logits, labels[cut:]) if len(logits) else 1.0
    sure = subwords.softmax(logits * scale)
    right = sure.max(axis=1)[sure.argmax(axis=1) == labels[cut:]] if len(sure) else np.zeros(0)
    limit = min(HIGHEST, float(np.quantile(right, REJECTED))) if len(right) else 0.0
    return pickle.dumps((names, table.astype(np.float32), bias, scale, limit, settings))


def _logits(texts: list[str], table, bias, settings) -> np.ndarray:
    return subwords.means(texts, table, settings) + bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, each: int = SAMPLE_EACH) -> bytes:
    """Learn from a bounded sample of ``docs``; rows without text, letters or language are left out. Without any: no language."""
    ready(docs.sparkSession)
    usable = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")).filter(
        F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}")
    )
    return sampling.fit(sampling.bounded(usable, "__id", "__lang", rows, each), "__id", learn)


def predict(docs: DataFrame, model: bytes, text_col: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``docs`` and three columns: the likeliest language, its calibrated probability, and whether it lies under the limit.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Columns of these names are replaced.
    """
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    new = [lang, score, rejected]
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    names = source.columns
    schema = T.StructType([*source.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, bias, scale, limit, settings = pickle.loads(held.value)
        for batch in batches:
            for start, texts in text_slices(batch.column(names.index(text_col)).to_pylist()):
                known = np.array([bool(languages) and _letter.search(t) is not None for t in texts])
                best, top = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if languages:
                    share = subwords.softmax(_logits(texts, table, bias, settings) * scale)
                    best, top = share.argmax(axis=1), np.where(known, share.max(axis=1), 0.0)
                found = [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                columns = [pa.array(found, pa.string()), pa.array(top), pa.array(~known | (top < limit))]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, *columns], names=[*names, *new])

    return source.mapInArrow(run, schema)


def held_out(docs: DataFrame, parts: int, id_col: str = "doc_id") -> DataFrame:
    return docs.withColumn("held_out", fold(F.col(id_col), parts) == 0)
