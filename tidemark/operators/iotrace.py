"""Read-trace analytics: cache accounting, read-ahead, enclosing ranges, log replay, budgeted eviction.

The trace is events: user = page or object, event_id = clock, value = size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import folds
from tidemark.functions.ordered import running
from tidemark.plans.dialect import Registry
from tidemark.sources.scratch import written
from tidemark.sources.tables import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


_r.sql(
    "m33_cache_accounting",
    """SELECT event_type, count(*) AS reads, count(CASE WHEN seen THEN 1 END) AS hits, count(CASE WHEN NOT seen THEN 1 END) AS misses FROM
       (SELECT event_type, event_id - lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) <= 2000 AND lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) IS NOT NULL AS seen FROM events) t GROUP BY event_type""",
)


def lru_cache(trace: DataFrame, capacity: int) -> DataFrame:
    """kind, hits, misses, evicted of one cache per kind over trace (kind, clock, page).

    A trace is cut into slices of its clock, simulated side by side. What the cache holds where a slice begins are the
    last capacity different pages before it, so each slice says which its own last ones are (capacity rows at most), and
    these are laid over one another from slice to slice.
    """
    dealt = written(trace.select("kind", "clock", "page").repartitionByRange("kind", "clock").withColumn("slice", F.spark_partition_id()))
    last = dealt.groupBy("kind", "slice", "page").agg(F.max("clock").alias("clock"))
    recent = last.withColumn("r", F.row_number().over(W.partitionBy("kind", "slice").orderBy(F.desc("clock")))).where(F.col("r") <= capacity)

    def carry(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        out = []
        for slice_, part in pdf.sort_values(["slice", "clock"]).groupby("slice", sort=True):
            out.append((key[0], slice_, list(held)))
            for p in part["page"].tolist():
                held.pop(p, None)
                held[p] = True
            held = dict.fromkeys(list(held)[-capacity:])
        return pd.DataFrame(out, columns=["kind", "slice", "held"])

    def run(key, part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        h, m, e = folds.lru(part.sort_values("clock")["page"].tolist(), capacity, held["held"].iloc[0])
        return pd.DataFrame({"kind": [key[0]], "hits": [h], "misses": [m], "evicted": [e]})

    kinds = dict(trace.dtypes)
    before = written(recent.select("kind", "slice", "clock", "page").groupBy("kind").applyInPandas(carry, f"kind {kinds['kind']}, slice int, held array<{kinds['page']}>"))
    each = dealt.groupBy("kind", "slice").cogroup(before.groupBy("kind", "slice")).applyInPandas(run, f"kind {kinds['kind']}, hits long, misses long, evicted long")
    return each.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "evicted")])


@_r.query("m33_lru_simulation")
def _lru(spark, sf_dir):
    trace = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("event_id").alias("clock"), F.col("user_id").alias("page"))
    return lru_cache(trace, 64).withColumnRenamed("kind", "event_type")


_WINDOW, _SOON = 64, 200
_r.sql(
    "t17_read_ahead",
    f"""SELECT event_id, CASE WHEN near THEN (start {{div}} {_WINDOW}) * {_WINDOW} ELSE start END AS first_byte, CASE WHEN near THEN least(((start + size + {_WINDOW} - 1) {{div}} {_WINDOW}) * {_WINDOW}, 12000) ELSE start + size END AS end_byte
        FROM (SELECT event_id, start, size, size <= {_WINDOW} {{div}} 8 AND prev_clock IS NOT NULL AND event_id - prev_clock <= {_SOON} AND abs(start - prev_end) <= {_WINDOW} AS near FROM
              (SELECT event_id, start, size, lag(event_id) OVER (PARTITION BY object ORDER BY event_id) AS prev_clock, lag(start + size) OVER (PARTITION BY object ORDER BY event_id) AS prev_end
               FROM (SELECT event_id, user_id AS object, event_id AS start, CAST(floor(value) AS BIGINT) % 16 AS size FROM events) a) b) c""",
)

#: Length of the buckets that a span is listed under, so that containment is an equi-join on (object, bucket).
_BUCKET = 512


def enclosing(requests: DataFrame, spans: DataFrame) -> DataFrame:
    """For each request (id, object, start, end) the shortest span of its object that holds it: id, span, length.

    A span is listed under each bucket it reaches into, a request under its first one: an equi-join instead of all pairs.
    """
    listed = spans.withColumn("bucket", F.explode(F.sequence(F.expr(f"s_start div {_BUCKET}"), F.expr(f"s_end div {_BUCKET}"))))
    j = requests.withColumn("bucket", F.expr(f"start div {_BUCKET}")).join(listed, ["object", "bucket"])
    held = j.where((F.col("s_start") <= F.col("start")) & (F.col("s_end") >= F.col("end")))
    best = held.groupBy("id").agg(F.min(F.struct((F.col("s_end") - F.col("s_start")).alias("length"), "span")).alias("b"))
    return best.select("id", "b.span", "b.length")


_SPANS = "SELECT event_id AS span, user_id % 20 AS object, greatest(event_id - 100, 0) AS s_start, event_id + CAST(floor(value) AS BIGINT) * 3 AS s_end FROM events"
_REQ = "SELECT event_id AS id, user_id % 20 AS object, event_id AS start, event_id + 10 AS stop FROM events"


@_r.query(
    "t18_enclosing_range",
    f"WITH s AS ({_SPANS}), r AS ({_REQ}), j AS (SELECT id, span, s_end - s_start AS length, row_number() OVER (PARTITION BY id ORDER BY s_end - s_start, span) AS rn FROM r JOIN s ON r.object = s.object AND s_start <= start AND s_end >= stop) SELECT id, span, length FROM j WHERE rn = 1",
)
def _enclosing(spark, sf_dir):
    e = _events(spark, sf_dir)
    spans = e.select(F.col("event_id").alias("span"), (F.col("user_id") % 20).alias("object"), F.greatest(F.col("event_id") - 100, F.lit(0)).alias("s_start"), (F.col("event_id") + F.floor("value") * 3).alias("s_end"))
    requests = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("object"), F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("end"))
    return enclosing(requests, spans)


@_r.query(
    "t19_log_replay",
    """SELECT log, key, event_id, value FROM (SELECT log, key, event_id, value, payload_ok, row_number() OVER (PARTITION BY log, key ORDER BY event_id DESC) AS rn FROM
         (SELECT *, min(header_ok) OVER (PARTITION BY log ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix_ok FROM
            (SELECT event_type AS log, user_id AS key, event_id, value, CASE WHEN event_id % 997 = 996 THEN 0 ELSE 1 END AS header_ok, value < 99 AS payload_ok FROM events) a) b WHERE prefix_ok = 1) c WHERE rn = 1 AND payload_ok""",
)
def _replay(spark, sf_dir):
    """The good prefix of a log ends before its first broken header, one row a log; of what is left the last record of
    a key counts, if its payload is whole. Both are partial aggregates: no log is put in order."""
    log = _events(spark, sf_dir).select(F.col("event_type").alias("log"), F.col("user_id").alias("key"), "event_id", "value", (F.col("event_id") % 997 == 996).alias("broken"))
    ends = log.where("broken").groupBy("log").agg(F.min("event_id").alias("stop"))
    good = log.join(ends, "log", "left").where(F.col("stop").isNull() | (F.col("event_id") < F.col("stop")))
    last = good.groupBy("log", "key").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("x"))
    return last.where("x.value < 99").select("log", "key", "x.event_id", "x.value")


@_r.query(
    "t20_lru_compaction",
    """WITH u AS (SELECT user_id AS key, max(event_id) AS used, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS size FROM events GROUP BY user_id),
            t AS (SELECT CAST(sum(size) AS BIGINT) * 6 // 10 AS target FROM u),
            k AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY used DESC, key) AS BIGINT) AS live FROM u)
       SELECT key, size, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) - size AS new_offset FROM k, t WHERE live <= target""",
)
def _compaction(spark, sf_dir):
    """The most recently used entries that fit the target stay, laid out anew in key order."""
    e = _events(spark, sf_dir)
    used = written(e.groupBy(F.col("user_id").alias("key")).agg((-F.max("event_id")).alias("age"), F.sum(F.floor("value").cast("long")).alias("size")))
    target = used.agg(F.expr("sum(size) * 6 div 10").alias("t")).first().t or 0
    kept = running(used, ["age", "key"], "size", "live").where(F.col("live") <= target).select("key", "size")
    return running(kept, ["key"], "size", "upto").select("key", "size", (F.col("upto") - F.col("size")).alias("new_offset"))


@_r.query(
    "x01_session_windows",
    """WITH a AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
       b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a), c AS (SELECT user_id, s, count(*) AS events, max(value) AS top FROM b GROUP BY user_id, s) SELECT events, count(*) AS sessions, max(top) AS top FROM c GROUP BY events""",
)
def _session_windows(spark, sf_dir):
    from tidemark.streaming.runs import batch_sessions

    return batch_sessions(spark, _events(spark, sf_dir))
