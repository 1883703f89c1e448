"""Every registered query of the engine, by key, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold QUERIES and ORACLES dictionaries.
MODULES = tuple(f"tidemark.operators.{m}" for m in ("relational", "versioned", "maintenance", "sampling", "lifecycle", "search", "iotrace"))


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(importlib.import_module(m), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merged("ORACLES")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["s34_window_percentiles"](spark, sf_dir)
