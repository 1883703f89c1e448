"""Statements written once for both engines.

A statement uses Spark's dialect; where the oracle's differs, it carries a mark: {div} for integer division, and
{spark: ...} or {duck: ...} for text that only one of the two gets.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import NAMES, table

_ONLY = re.compile(r"\{(spark|duck):((?:[^{}]|\{div\})*)\}")


def spark_text(sql: str) -> str:
    return _ONLY.sub(lambda m: m[2] if m[1] == "spark" else "", sql).replace("{div}", "div")


def duck_text(sql: str) -> str:
    return _ONLY.sub(lambda m: m[2] if m[1] == "duck" else "", sql).replace("{div}", "//")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a statement over the driver tables that it names (as temporary views, bound when it is analysed)."""
    text = spark_text(sql)
    for n in NAMES:
        if re.search(rf"\b{n}\b", text):
            table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(text)


class Registry:
    """QUERIES and ORACLES of a module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def sql(self, key: str, sql: str) -> None:
        """The same statement in both engines."""
        self.queries[key] = lambda spark, sf_dir: run(spark, sf_dir, sql)
        self.oracles[key] = duck_text(sql)

    def query(self, key: str, oracle: str | None = None):
        """A DataFrame function, and the statement that gives the same rows."""

        def add(f):
            self.queries[key] = f
            if oracle is not None:
                self.oracles[key] = duck_text(oracle)
            return f

        return add
