"""Corpus pipeline: documents pass the stages in order; every stage works on what its predecessor kept.

All stages but the last return the columns of ``documents``; the last returns one row of tokens per document of the mix.
Empty tables pass through every stage as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, langid, mixing, simhash, toxicity
from tidemark.llm.common import table
from tidemark.session import stage

#: A document goes if its calibrated probability of being toxic is this or more.
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognized stay: text with letters, and a probability not under the calibrated limit."""
    found = langid.predict(docs, langid.fit(docs), lang="__lang", score="__sure", rejected="__rejected")
    return found.filter(~F.col("__rejected")).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not call toxic stay."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")), name="__toxic")
    return scored.filter(F.col("__toxic") < TOXIC).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of SimHash near-copies stays."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources mixed to target weights: a document comes as often as the mix takes it whole; without words it is not taken."""
    mixed = mixing.mix(docs).filter(F.col("__taken") > 0)
    times = F.sequence(F.lit(1).cast("long"), (F.col("__taken") / F.col("__size")).cast("long"))
    return mixed.withColumn("__copy", F.explode(times)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Byte-level BPE tokens of every document of the mix, with digests of the ids and of the bytes they decode to."""
    slim = docs.select("doc_id", "source", "text")
    return byte_bpe.encode(slim, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("toxicity", clean), ("simhash_near_dedup", near_copies), ("mixing", mixture), ("byte_bpe", tokens),
]

#: Learned models decide what stays, which SQL cannot express; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, folder), name)
    return docs
