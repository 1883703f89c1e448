"""Command line: list queries, run one, ask in SQL, look into a store.

    python -m tidemark list
    python -m tidemark run KEY TABLES [--limit N]
    python -m tidemark sql TABLES "SELECT ..." [--max-rows N]
    python -m tidemark inspect STORE "v bigint, ..."

TABLES is a folder of Parquet tables, STORE the path of a store and the columns of its values. Rows come as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import Row, SparkSession

from tidemark.plans.registry import all_queries
from tidemark.plans.session import MAX_ROWS, QueryError, Session
from tidemark.sources.store import Store, StoreError


def _arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("key")
    run.add_argument("tables")
    run.add_argument("--limit", type=int, default=MAX_ROWS)
    sql = sub.add_parser("sql")
    sql.add_argument("tables")
    sql.add_argument("text")
    sql.add_argument("--max-rows", type=int, default=MAX_ROWS)
    look = sub.add_parser("inspect")
    look.add_argument("store")
    look.add_argument("values")
    return top.parse_args(argv)


def _rows(spark: SparkSession, a: argparse.Namespace) -> list[Row]:
    if a.command == "run":
        return all_queries()[a.key](spark, a.tables).limit(a.limit).collect()
    if a.command == "sql":
        with Session(spark, a.tables) as db:
            return db.all(a.text, max_rows=a.max_rows)
    return Store(spark, a.store, a.values).inspect().collect()


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    a = _arguments(argv)
    if a.command == "list":
        print("\n".join(sorted(all_queries())))
        return 0
    if a.command == "run" and a.key not in all_queries():
        print(f"no query {a.key}", file=sys.stderr)
        return 2
    try:
        for r in _rows(spark or SparkSession.builder.getOrCreate(), a):
            print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))
    except (QueryError, StoreError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
