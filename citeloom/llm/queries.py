"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import langid, mixing, neardup, oracles, ppm, secrets, sharding, spelling, substrings, tiling, tokens, topk, turns, warc

SHARDS = 40
TARGETS = {"good": 0.85, "low": 0.15, "toxic": 0.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, topk.divisible(vectors, 50), k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages")).drop("url")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_top_k": op4_top_k,
    "op5_decontamination": op5_decontamination,
    "op6_ppm_scores": op6_ppm_scores,
    "op7_token_counts": op7_token_counts,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_warc": op9_warc,
    "op10_substrings": op10_substrings,
    "op11_conversations": op11_conversations,
    "op12_secrets": op12_secrets,
    "op13_spelling": op13_spelling,
}
ORACLES = {
    "op3_sharding": oracles.SHARDING,
    "op4_top_k": oracles.TOP_K,
    "op8_near_duplicates": oracles.NEAR_DUPLICATES,
    "op9_warc": oracles.WARC,
    "op10_substrings": oracles.SUBSTRINGS,
    "op11_conversations": oracles.CONVERSATIONS,
    "op12_secrets": oracles.SECRETS,
    "op13_spelling": oracles.SPELLING,
}
