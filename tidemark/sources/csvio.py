"""CSV in and out: headers are fixed by the caller, and every column is text until a query casts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.scratch import scratch

__all__ = ["read_csv", "scratch", "write_csv"]


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]), enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="errorifexists")
