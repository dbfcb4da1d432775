"""From raw documents to token ids: toxic texts go, one of each group of near-copies stays, texts that hold a benchmark
item go, personal data is masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; each but the last returns
the columns of its ``docs``.  Nulls, empty and repeated rows fare as the operators' docstrings say; an empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import bpe, compression, decontaminate, forest, pii
from wordloom.llm.common import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the cut; the model learns from those of them that the labels cover."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression.train(docs, labels)
    return compression.below(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, a similarity of 0.8 or more."""
    return forest.one_of_each(docs, k=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data put as its kind."""
    return pii.redact(docs, pii.train(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (array) of every document that is left."""
    return bpe.encode(docs, arrays=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]
#: A trained classifier and a trained labeler are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
