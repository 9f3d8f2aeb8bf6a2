"""One query per operator: each runs over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orograph.functions.tables import load


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.pieces import round_trip

    return round_trip(load(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.warc import archive_pages

    return archive_pages(load(spark, sf_dir, "pages")).drop("url")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.tokencounts import token_counts

    return token_counts(load(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.pii import find

    return find(load(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.topk import top_k

    return top_k(load(spark, sf_dir, "embeddings"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.suffixes import drop_repeated_bytes

    return drop_repeated_bytes(load(spark, sf_dir, "documents")).drop("kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.mixing import mix

    return mix(load(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.quality import quality

    return quality(load(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.minhash import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"), shingle=4)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.substrings import drop_repeated_passages

    return drop_repeated_passages(load(spark, sf_dir, "documents")).drop("kept")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.variants import variants

    return variants(load(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.chat import format_digests, with_probe

    return format_digests(with_probe(load(spark, sf_dir, "conversations")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.llm.repair import damaged, repair_report

    return repair_report(damaged(load(spark, sf_dir, "conversations")))


def queries() -> dict:
    made = (op1_sentencepiece, op2_warc, op3_token_counts, op4_pii, op5_topk, op6_suffix_array, op7_mixing, op8_quality, op9_minhash, op10_substrings, op11_variants, op12_chat, op13_repair)
    return {f.__name__: f for f in made}
