"""From raw documents to packed token sequences: five stages, each over all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scrubline.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from scrubline.llm.queries import remainder, tokenizer_path
from scrubline.session import shared_dir
from scrubline.sources.tables import table

# Scores come from learned dictionaries and sequences from a linear program, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; the model is learned on the labelled folds of ``documents``."""
    known = table(spark, sf_dir, "labels").where(remainder(3) != 1)
    model = toxicity.train(table(spark, sf_dir, "documents"), known)
    return toxicity.drop_toxic(docs, model, 0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one_per_component(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
