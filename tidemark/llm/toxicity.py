"""Toxicity: subword-bag embeddings averaged into a linear softmax, so that misspellings share their character n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import sampling, subwords
from tidemark.llm.common import ready, text_slices
from tidemark.session import stage

#: Bound of the training sample: about so many labelled texts in all, and so many of either label at least.
SAMPLE_ROWS, SAMPLE_EACH = 8_000, 2_500
SETTINGS = subwords.Settings(lengths=(3, 4, 5), bits=18, dim=16, epochs=6, rate=0.5, distinct=True, prior=100.0)
HELD_BACK = 0.15


def learn(rows: list[tuple], settings: subwords.Settings = SETTINGS) -> bytes:
    """Model of ``(id, text, toxic)`` rows; the last ones calibrate the margin by a logistic curve."""
    labels = np.array([int(r[2]) for r in rows], np.int64)
    cut = len(rows) - int(len(rows) * HELD_BACK)
    if not len(set(labels[:cut].tolist())) == 2:  # nothing to tell apart: the share of label 1
        return pickle.dumps((np.zeros((1 << settings.bits, 1), np.float32), 0.0, 0.0, _logit(labels.mean() if len(labels) else 0.0), settings))
    table, bias = subwords.train([r[1] or "" for r in rows[:cut]], labels[:cut], 2, settings)
    margin = (table[:, 1:] - table[:, :1]).astype(np.float32)
    base = float(bias[1] - bias[0])
    slope, offset = _calibrate(_margins([r[1] or "" for r in rows[cut:]], margin, base, settings), labels[cut:])
    return pickle.dumps((margin, base, slope, offset, settings))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _margins(texts: list[str], table: np.ndarray, base: float, settings: subwords.Settings) -> np.ndarray:
    return subwords.means(texts, table, settings)[:, 0] + base


def _calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of ``y`` over ``x`` (a little ridge keeps both finite); identity if one label lacks."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    design, beta = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - y) + 0.1 * (beta - [1.0, 0.0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, each: int = SAMPLE_EACH) -> bytes:
    """Learn from a bounded sample of the labelled texts.

    The sample is drawn from the labels, by id, before any text is read. Null ids and labels are left out, of several labels of
    an id the higher counts, texts that are null count as empty.
    """
    ready(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    drawn = stage(sampling.bounded(known, "__id", "__label", rows, each), "drawn")
    texts = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("__text"))
    return sampling.fit(texts.join(drawn, F.col("__of") == F.col("__id")).select("__id", "__text", "__label"), "__id", learn)


def score(docs: DataFrame, model: bytes, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and the calibrated probability of label 1 (double); null texts count as empty. A column of that name is replaced."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    names = source.columns
    schema = T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base, slope, offset, settings = pickle.loads(held.value)
        for batch in batches:
            for start, texts in text_slices(batch.column(names.index(text_col)).to_pylist()):
                z = np.clip(slope * _margins(texts, table, base, settings) + offset, -500, 500)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(1 / (1 + np.exp(-z)))], names=[*names, name])

    return source.mapInArrow(run, schema)
