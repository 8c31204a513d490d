"""Corpus pipeline: from raw documents to tokens.

STAGES are applied one after the other; each gets all rows that the one before it kept, as Parquet, and all but the
last return the columns of documents. Null texts are empty documents (the quality classifier decides on them as on any
other), null keys and sources are values of their own, repeated rows end with one row of their near-duplicate group,
empty tables pass through, further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.llm import bpe, cotrain, mixing, near_dedup, pii
from plotwright.llm.common import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects."""
    docs = docs.select(*COLUMNS)
    return cotrain.keep_good(docs, cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each component of near fingerprints."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows."""
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources reach their target weights, in shuffled order."""
    return mixing.mix_sources(docs.select(*COLUMNS), mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.EPOCHS, mixing.SEED).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of the decoded bytes, a row per copy."""
    path, pattern = bpe.public_vocabulary()
    return bpe.round_trip(docs, path, pattern, keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: Co-training and components can't be said in SQL; tests/llm compare run() with its stages one by one, and the operators with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Between stages the rows go to the checkpoint folder, as a run stage by stage writes them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
