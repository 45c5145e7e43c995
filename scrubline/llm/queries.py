"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    importance,
    jaccard_join,
    language,
    main_text,
    packing,
    private_data,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
)
from scrubline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _registered[fn.__name__] = fn
    return fn


def llm_queries() -> dict[str, Query]:
    return dict(_registered)


def remainder(by: int) -> Column:
    """The fold of a document: crc32 of its doc_id as text; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sharding(spark, folder):
    placed = sharding.shard_documents(table(spark, folder, "documents"), 8)
    return placed.select(
        "*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_packing(spark, folder):
    packed = packing.pack_documents(
        table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json")
    )
    return packed.drop("ids")


@query
def op3_token_counts(spark, folder):
    import public_tokenizers

    return token_counts.count_tokens(
        table(spark, folder, "documents"),
        tokenizer_path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query
def op4_suffix_array_dedup(spark, folder):
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op5_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    known = table(spark, folder, "labels").where(remainder(3) != 1)
    scored = toxicity.score_documents(docs, toxicity.train(docs, known))
    return scored.select(
        "doc_id",
        (remainder(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op6_ngram_jaccard_join(spark, folder):
    return jaccard_join.linked_components(table(spark, folder, "documents"), 4, 85)


@query
def op7_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query
def op8_benchmark_decontamination(spark, folder):
    found = decontaminate.find_leaks(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        decontaminate.leak_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_html_extraction(spark, folder):
    return main_text.extract_main_text(table(spark, folder, "pages")).drop("n_blocks")


@query
def op10_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    prototypes = language.train_prototypes(docs.where(remainder(4) != 2))
    found = language.identify_language(docs, prototypes)
    return found.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query
def op11_pii(spark, folder):
    docs = table(spark, folder, "documents")
    found = private_data.find_private(docs, private_data.train(docs))
    counts = [private_data.count_of(kind).alias(f"n_{kind}") for kind in private_data.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(private_data.listed(F.col("base")), 256).alias("base_sha256"),
        private_data.listed(private_data.all_spans()).alias("spans"),
    )


@query
def op12_tokenizer_alignment(spark, folder):
    return alignment.align(
        table(spark, folder, "documents"),
        tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"),
    )


@query
def op13_importance_resampling(spark, folder):
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
