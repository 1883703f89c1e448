"""Readers for the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str, prefix: str = "") -> None:
    """Temporary views of the named tables, for statements in SQL text."""
    for n in names or NAMES:
        table(spark, sf_dir, n).createOrReplaceTempView(prefix + n)
