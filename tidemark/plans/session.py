"""Read-only query sessions: bound parameters, one statement at a time, a row limit, and metrics of each query."""

from __future__ import annotations

import math
import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from tidemark.sources.tables import NAMES, table

#: Roots of logical plans that only read. Unresolved statements keep these names in the parser's output.
READING = frozenset(
    "Project Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Filter Join SubqueryAlias Union Intersect Except Window WithWindowDefinition UnresolvedWith WithCTE CTERelationDef "
    "UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedRelation UnresolvedHaving UnresolvedSubqueryColumnAliases Generate Pivot Unpivot Sample Range UnresolvedTableValuedFunction "
    "DescribeRelation DescribeColumn DescribeQueryCommand ShowTables ShowColumns ShowColumnsCommand ShowFunctions ShowViews ShowNamespaces ExplainCommand UnresolvedOrdinal Tail "
    "NameParameterizedQuery PosParameterizedQuery UnresolvedTableOrView UnresolvedNamespace CurrentNamespace".split()
)
MAX_ROWS = 10_000
_INT64 = (-(2**63), 2**63 - 1)


class QueryError(ValueError):
    pass


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """Whether sql is one statement that gives rows and changes nothing."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False

    def reads(p) -> bool:
        name = p.getClass().getSimpleName().rstrip("$")
        kids = p.children()
        return name in READING and all(reads(kids.apply(i)) for i in range(kids.length()))

    return reads(plan)


def bound(value):
    """A parameter in the session's value range: 64-bit integers, booleans as integers, finite numbers, text, bytes, null."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        if not _INT64[0] <= value <= _INT64[1]:
            raise QueryError(f"integer parameter out of range: {value}")
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise QueryError("numeric parameters must be finite")
        return value
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytearray(value)
    raise QueryError(f"unsupported parameter type: {type(value).__name__}")


_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)


def markers(sql: str) -> tuple[int, set[str]]:
    """Positional markers and named ones outside quotes and comments."""
    bare = _QUOTED.sub(" ", sql)
    return bare.count("?"), set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare))


def arguments(sql: str, params):
    n, names = markers(sql)
    if params is None:
        params = {} if names else []
    if isinstance(params, Mapping):
        if set(params) != names or n:
            raise QueryError(f"named parameters must be exactly {sorted(names)}")
        return {k: bound(v) for k, v in params.items()}
    if isinstance(params, Sequence) and not isinstance(params, (str, bytes)):
        if len(params) != n or names:
            raise QueryError(f"the statement takes {n} parameters")
        return [bound(v) for v in params]
    raise QueryError("parameters are a list or a dict")


@dataclass
class Metrics:
    """Totals of a session, or of one query: what it returned, how long it took, and what its scans read."""

    queries: int = 0
    rows: int = 0
    seconds: float = 0.0
    errors: int = 0
    files: int = 0
    bytes: int = 0
    scanned: int = 0

    def since(self, before: "Metrics") -> "Metrics":
        return Metrics(**{k: v - getattr(before, k) for k, v in vars(self).items()})


def _scans(plan):
    """File scans of a plan that has run, inside adaptive stages too."""
    name = plan.getClass().getSimpleName()
    if name == "FileSourceScanExec":
        yield plan
    elif name == "AdaptiveSparkPlanExec":
        yield from _scans(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _scans(plan.plan())
    else:
        kids = plan.children()
        for i in range(kids.length()):
            yield from _scans(kids.apply(i))


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """files, bytes and rows that the scans of a collected DataFrame read."""
    out = {"files": 0, "bytes": 0, "scanned": 0}
    for scan in _scans(df._jdf.queryExecution().executedPlan()):
        have = scan.metrics()
        for ours, theirs in (("files", "numFiles"), ("bytes", "filesSize"), ("scanned", "numOutputRows")):
            if have.contains(theirs):
                out[ours] += have.apply(theirs).value()
    return out


class Statement:
    def __init__(self, session: "Session", sql: str):
        self.session, self.sql = session, sql

    def all(self, params=None, max_rows: int = MAX_ROWS) -> list[Row]:
        return self.session.all(self.sql, params, max_rows)

    def get(self, params=None) -> Row | None:
        return self.session.get(self.sql, params)


class Session:
    """One connection: statements run one after another, and an error leaves it usable."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self._lock, self._open = spark, threading.RLock(), True
        self.metrics = Metrics()
        self.last = Metrics()
        self._views = dict(tables or {})
        if sf_dir:
            self._dir = sf_dir
        else:
            self._dir = None

    def __enter__(self) -> "Session":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self._open = False

    def _bind(self, sql: str) -> None:
        for n, df in self._views.items():
            df.createOrReplaceTempView(n)
        if self._dir:
            for n in NAMES:
                if n not in self._views and re.search(rf"\b{n}\b", sql):
                    table(self.spark, self._dir, n).createOrReplaceTempView(n)

    def frame(self, sql: str, params=None) -> DataFrame:
        with self._lock:
            if not self._open:
                raise QueryError("the session is closed")
            args = arguments(sql, params)
            if not is_read_only(self.spark, sql):
                raise QueryError("only a single read-only statement is allowed")
            self._bind(sql)
            return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)

    def prepare(self, sql: str) -> Statement:
        if not is_read_only(self.spark, sql):
            raise QueryError("only a single read-only statement is allowed")
        return Statement(self, sql)

    def _counted(self, sql: str, params, take: Callable[[DataFrame], tuple[DataFrame, list[Row]]]) -> list[Row]:
        """Run one query and add it to the metrics; last holds what it alone added."""
        with self._lock:
            before, t = self.stats(), time.perf_counter()
            self.metrics.queries += 1
            try:
                df, rows = take(self.frame(sql, params))
                self.metrics.rows += len(rows)
                for k, v in scan_metrics(df).items():
                    setattr(self.metrics, k, getattr(self.metrics, k) + v)
                return rows
            except (QueryError, PySparkException):
                self.metrics.errors += 1
                raise
            finally:
                self.metrics.seconds += time.perf_counter() - t
                self.last = self.metrics.since(before)

    def all(self, sql: str, params=None, max_rows: int = MAX_ROWS) -> list[Row]:
        """All rows, at most max_rows: one more is asked for, and having it is an error."""

        def take(df: DataFrame):
            df = df.limit(max_rows + 1)
            rows = df.collect()
            if len(rows) > max_rows:
                raise QueryError(f"more than {max_rows} rows")
            return df, rows

        return self._counted(sql, params, take)

    query = all

    def get(self, sql: str, params=None) -> Row | None:
        """The first row, and no more work than it takes."""

        def take(df: DataFrame):
            df = df.limit(1)
            return df, df.collect()

        rows = self._counted(sql, params, take)
        return rows[0] if rows else None

    def objects(self, sql: str, params=None, max_rows: int = MAX_ROWS) -> Iterator[dict]:
        """Rows as dicts; of duplicate names the last one counts."""
        for r in self.all(sql, params, max_rows):
            yield dict(zip(r.__fields__, r))

    def stats(self) -> Metrics:
        return Metrics(**vars(self.metrics))


def pushed_filters(df: DataFrame) -> list[str]:
    """PushedFilters of each scan in the physical plan: the assertion that a predicate reaches the files."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    found = []
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "FileSourceScanExec" and leaf.metadata().contains("PushedFilters"):
            found.append(leaf.metadata().apply("PushedFilters"))
    return found
