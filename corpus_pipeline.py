"""The corpus pipeline: documents through five of the operators, one after another.

Every stage takes the documents that its predecessor kept and returns documents; the
last returns packed pieces.  ``run`` writes each stage's result to the shared folder and
reads it again, so a lost executor costs no more than a stage.  Tables without rows and
null or empty texts pass through every stage as its operator defines; very long texts are whole in
all of them, and cut by the last.  Of repeated rows and near copies one stays, that with the least identifier (null
first); ties of packing go as its operator says.  Only the columns of documents are read, whatever others are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import near_copies, packing, pii, quality, toxicity
from veilspark.llm.common import crc_of_id, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CAPACITY = 2048


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; labels of one id in five are left for testing."""
    labels = table(spark, sf_dir, "labels").where(crc_of_id(F.col("doc_id")) % 5 != 0)
    scored = toxicity.predict(docs.select(COLUMNS), toxicity.fit(docs, labels))
    return scored.where("score < 0.5").select(COLUMNS)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; being short is no reason here, as clean documents may be short."""
    rules = {r: c for r, c in quality.RULES.items() if r != "few_words"}
    return quality.judge(docs.select(COLUMNS), rules=rules, counts=False).where("kept").select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least identifier."""
    return near_copies.one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` is that of the new text."""
    masked = pii.pseudonymise(docs.select(COLUMNS), counts=None)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most ``CAPACITY`` ids with their places in sequences."""
    pieces = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=CAPACITY)
    return packing.pack(pieces, docs.count(), CAPACITY)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", without_near_copies),
    ("pii", without_private),
    ("packing", packed),
]

#: SQL can express neither the learned scores nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
