"""The operators of this folder as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.llm import (
    chat,
    classifier,
    contamination,
    embeddings,
    huffman,
    jaccard,
    language,
    licenses,
    middle,
    mixing,
    packing,
    quality_rules,
    whitening,
)
from tallymix.llm.common import fresh_path, stored, table

SPACED = public_tokenizers.path("byte_bpe_50k.json")
LOWER = public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, d, "embeddings"))


def op2_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"))


def op3_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), SPACED)


def op4_token_binary(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    huffman.write(table(spark, d, "documents"), LOWER, path)
    return huffman.with_starts(stored(huffman.read(spark, path, with_ids=False), "decoded"))


def op5_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_copies(table(spark, d, "documents"))


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.learn(language.training(docs))
    found = language.identified(docs.drop("lang"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.labelled(table(spark, d, "documents"))


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = quality_rules.scored(table(spark, d, "documents"), stored)
    return rows.select("doc_id", *quality_rules.FEATURES, "base_failed", "kept", "p_good")


def op9_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return classifier.quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_chat_format(spark: SparkSession, d: str) -> DataFrame:
    return chat.chats(table(spark, d, "conversations"))


def op11_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whitened(table(spark, d, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    return middle.middle_report(table(spark, d, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_embedding_near_dedup,
        op2_source_mixing,
        op3_best_fit_packing,
        op4_token_binary,
        op5_ngram_jaccard,
        op6_language_id,
        op7_license_scan,
        op8_quality_rules,
        op9_quality_classifier,
        op10_chat_format,
        op11_benchmark_decontamination,
        op12_embedding_whitening,
        op13_fill_in_middle,
    ]
    return {f.__name__: f for f in found}


def all_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.SQL,
        "op10_chat_format": chat.SQL,
        "op11_benchmark_decontamination": contamination.SQL,
        "op13_fill_in_middle": middle.SQL,
    }
