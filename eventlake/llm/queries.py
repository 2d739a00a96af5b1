"""Queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import (
    centroids, chat_format, collocations, decontaminate, jaccard_join, language_model, mixing, quality, spotsigs, substring_dedup, surrogates,
    toxicity, url_rules,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, folder, "documents")).drop("removed_spans")


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents"))


def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, folder, "pages"), url_rules.rule_frame(spark))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents"), surrogates.session_key(spark), count="n_entities").select("doc_id", "n_entities", "text")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.select(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited_pairs(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.read_back(chat_format.format_chats(chat_format.with_hostile(table(spark, folder, "conversations"))))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_model": op2_language_model,
    "op3_url_rules": op3_url_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_surrogates": op6_surrogates,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_spotsigs": op10_spotsigs,
    "op11_collocations": op11_collocations,
    "op12_centroids": op12_centroids,
    "op13_chat_format": op13_chat_format,
}
ORACLE = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_url_rules": url_rules.SQL,
    "op4_jaccard_join": jaccard_join.SQL,
    "op5_mixing": mixing.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_collocations": collocations.SQL,
    "op12_centroids": centroids.SQL,
    "op13_chat_format": chat_format.SQL,
}
