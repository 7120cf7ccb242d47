"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes what the one before it kept, written as Parquet and read again, and all but
the last return the columns of documents:

quality         documents that the quality rules reject go
near_duplicates one document of each SimHash component stays
substrings      words of passages that stand earlier are cut from the texts
mix             each document comes as often as the mix takes it
tokens          doc_id, n_tokens and digests of ids and decoded text of each

Edge cases are those of the operators; a table without rows passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from botledger.llm import bpe, mixing, quality, simhash, substring
from botledger.llm.common import stage_out, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: A trained filter, Hamming components and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_out(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
