"""The training corpus from raw documents, stage by stage.

Each stage takes all that the one before it kept and is written as Parquet before the next one reads it. All but the
last return the columns of the documents. A column of the input named like one that a stage needs for a while is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltmes.llm.language import keep_identified
from voltmes.llm.minhash import drop_near_duplicates
from voltmes.llm.mixing import mixed_documents
from voltmes.llm.packing import packed_documents
from voltmes.llm.queries import tokenizer_path
from voltmes.llm.repetition import keep_unrepetitive
from voltmes.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: the record declares one, the source stands for the host."""
    return keep_identified(docs, declared=F.col("lang"), host=F.col("source"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither short nor made of repeats."""
    return keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: shingles of five words, similarity 0.8."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, whole."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4,096 tokens."""
    return packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: Near-duplicate groups and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
