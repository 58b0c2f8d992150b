"""The corpus pipeline on a small table and on an empty one."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from veilspark.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == cp.COLUMNS
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and docs.count() == len(now)
        if name == "pii":
            assert now == before
        before = now
    clean = [d for d in before if d in labels and labels[d].quality == 0]
    assert len(clean) <= 2
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_odd_rows(spark, odd):
    """Nulls, empty, repeated and very long texts, and columns with clashing names, through every stage."""
    docs = odd.withColumns({c: F.lit(7) for c in ("SCORE", "Unit", "h", "kept", "q_words", "group")})
    kept = {}
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d))
    everything = [None, 0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 11, 13]
    # repeated lines, words and windows of words, and one of 3,000 letters
    fine = [0, 1, 2, 3, 4, 7, 8, 9, 11, 11]
    # null, empty and white space are one set; the text that comes twice is one
    once = [0, 3, 4, 7, 8, 9, 11]
    assert kept == {"toxicity": everything, "quality": fine, "near_duplicates": once, "pii": once, "packing": once}
