"""The corpus pipeline: what each stage keeps, and empty and odd tables."""

import os

import corpus_pipeline
import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_pass_documents_on(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(step(spark, kept, FOLDER).collect(), docs.schema)
        assert kept.columns == NAMES and {r.doc_id for r in kept.select("doc_id").collect()} <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert last.count() == kept.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(last.columns)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, None, 0), (1, "a word", "en", "s", 6), (1, "a word", "en", "s", 6)]])
def test_odd_tables_pass(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, FOLDER).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count() == (2 if rows else 0)
