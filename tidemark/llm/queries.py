"""The registered queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import oracles
from tidemark.llm.common import prepare, shared_dir

QUERIES: dict = {}
ORACLES: dict = {"op1_substring_dedup": oracles.SUBSTRING, "op2_near_dedup": oracles.NEAR, "llm_base_counts": oracles.BASE_COUNTS, "llm_base_phrases": oracles.BASE_PHRASES}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _register(f):
    QUERIES[f.__name__] = f
    return f


@_register
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import substring

    return substring.report(_read(spark, sf_dir, "documents"))


@_register
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import neardup

    return neardup.report(_read(spark, sf_dir, "documents"), shingle=2)


@_register
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import decontaminate

    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_register
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import quality

    return quality.report(_read(spark, sf_dir, "documents"))


@_register
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import toxicity

    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import tokens

    return tokens.count(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


@_register
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import tokens

    to = shared_dir(spark)
    tokens.write_shards(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), to)
    return tokens.read_shards(spark, to)


@_register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import packing

    return packing.pack_documents(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


@_register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import licenses

    return licenses.report(_read(spark, sf_dir, "documents"))


@_register
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import transcripts

    return transcripts.report(_read(spark, sf_dir, "conversations"))


@_register
def llm_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_quality that SQL can express."""
    from tidemark.llm import quality

    return quality.report(_read(spark, sf_dir, "documents")).drop("kept", "quality")


@_register
def llm_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_license_scan that SQL can express."""
    from tidemark.llm import licenses

    return licenses.report(_read(spark, sf_dir, "documents")).drop("labels", "score")

