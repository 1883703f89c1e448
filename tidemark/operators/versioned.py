"""V family: the algebra of versioned keyed tables as pure functions from DataFrames to DataFrames.

A version is a chain of runs. runs(idx, size) has one row per run, oldest (the checkpoint) first; entries(idx, page, op,
...) has puts and tombstones. Runs are few (a chain is at most 64 long before it is compacted), entries are many: so what
is derived from runs is broadcast, and everything else is one shuffle on page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.plans.dialect import Registry
from tidemark.sources.scratch import written
from tidemark.sources.tables import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

#: Longest chain of runs: bounds what is broadcast.
MAX_RUNS = 64
ZERO = 0.0

# ---- pure functions ----


def fence(runs: DataFrame) -> DataFrame:
    """idx, fence: the smallest size from each run on. A page above it is gone for good, even if the table regrows."""
    return runs.select("idx", F.min("size").over(W.orderBy("idx").rowsBetween(W.currentRow, W.unboundedFollowing)).alias("fence"))


def latest(entries: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Last writer per key: a partial aggregate before the shuffle, no sort."""
    kept = F.max_by(F.struct(order, *values), order).alias("_last")
    return entries.groupBy(*keys).agg(kept).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (order, *values)])


def resolve(entries: DataFrame, runs: DataFrame, values: list[str]) -> DataFrame:
    """page, idx (the run it comes from) and values of the version that the chain ends in."""
    last = latest(entries, ["page"], "idx", ["op", *values])
    alive = last.join(F.broadcast(fence(runs)), "idx").where((F.col("op") == "put") & (F.col("page") <= F.col("fence")))
    return alive.select("page", "idx", *values)


def diff(source: DataFrame, target: DataFrame, target_size, values: list[str]) -> DataFrame:
    """The run that leads from source to target: puts that differ, tombstones for what target lacks below its size."""
    s = source.select("page", F.struct(*values).alias("_s"))
    t = target.select("page", F.struct(*values).alias("_t"))
    j = s.join(t, "page", "full")
    put = F.col("_t").isNotNull() & ~F.col("_s").eqNullSafe(F.col("_t"))
    gone = F.col("_t").isNull() & (F.col("page") <= F.lit(target_size))
    return j.where(put | gone).select("page", F.when(put, "put").otherwise("del").alias("op"), *[F.col(f"_t.{c}").alias(c) for c in values])


def overlay(pages: DataFrame, sealed: DataFrame, active: DataFrame, pending: DataFrame, value: str, sealed_size: int, active_trunc: int, pending_trunc: int) -> DataFrame:
    """What a reader sees of each page: a pending truncation, then active records, then an active truncation, then the
    sealed version. Pages nobody wrote are zero."""
    p = pages.join(sealed.select("page", F.col(value).alias("_sealed")), "page", "left")
    p = p.join(active.select("page", F.col(value).alias("_active")), "page", "left").join(pending.select("page", F.col(value).alias("_pending")), "page", "left")
    zero = F.lit(ZERO)
    seen = (
        F.when(F.col("_pending").isNotNull(), F.col("_pending"))
        .when(F.col("page") > pending_trunc, zero)
        .when(F.col("_active").isNotNull(), F.col("_active"))
        .when(F.col("page") > active_trunc, zero)
        .when(F.col("page") > sealed_size, zero)
        .otherwise(F.coalesce("_sealed", zero))
    )
    return p.select("page", seen.alias(value))


def patch_union(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Right-biased map union: what patch has replaces what base has."""
    return patch.unionByName(base.join(patch.select(*keys), keys, "left_anti"))


def elide_zeros(entries: DataFrame, value: str) -> DataFrame:
    """Puts of an all-zero payload become tombstones."""
    zero = (F.col("op") == "put") & (F.col(value) == ZERO)
    return entries.withColumns({"op": F.when(zero, "del").otherwise(F.col("op")), value: F.when(zero, None).otherwise(F.col(value))})


def page_checksum(tag: str, page: Column, txid: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(tag), page.cast("string"), txid.cast("string"), payload.cast("string")), 256)


#: Pages hashed together below the root.
HASH_FAN = 4096


def content_root(versions: DataFrame) -> DataFrame:
    """One row: root hash over (page, checksum) in page order, as a tree whose nodes all have HASH_FAN children at most."""
    high = versions.agg(F.max("page")).first()[0] or 0
    leaf = versions.groupBy(F.expr(f"page div {HASH_FAN}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("page", "checksum"))).alias("xs"))
    level = leaf.select("node", F.sha2(F.array_join(F.transform("xs", lambda x: F.concat_ws("=", x.page.cast("string"), x.checksum)), ","), 256).alias("h"))

    def joined(by):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "h"))), lambda x: x.h), ","), 256).alias(by)

    high //= HASH_FAN
    while high >= HASH_FAN:
        level = level.groupBy(F.expr(f"node div {HASH_FAN}").alias("up")).agg(joined("h")).withColumnRenamed("up", "node")
        high //= HASH_FAN
    return level.agg(joined("root"))


def run_or_checkpoint(depth: int, entries: int, resolved: int, budget_left: int) -> str:
    """A sparse run while the chain is short, the run smaller than the table and the budget holds; else a checkpoint."""
    return "run" if depth < MAX_RUNS and entries < resolved and budget_left >= 0 else "checkpoint"


def endpoint(manifests: DataFrame) -> DataFrame:
    """Of manifests with the same logical hash and end: widest history, checkpoints first, then the smallest id."""
    order = F.struct("begin", F.col("is_run").cast("int"), "id")
    return manifests.groupBy("hash", "end").agg(F.min_by("id", order).alias("id"))


# ---- the lineitem version log ----

_LOG = """
WITH n AS (SELECT max(l_orderkey) + 1 AS pages FROM lineitem),
runs AS (SELECT i.idx AS idx, CASE i.idx WHEN 3 THEN pages - pages * 4 {div} 15 WHEN 5 THEN pages - pages * 2 {div} 15 ELSE pages END AS size FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) AS i(idx), n),
d AS (SELECT l_orderkey + 1 AS page, l_linenumber - 1 AS idx, l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem),
e AS (SELECT page, d.idx, CASE WHEN l_returnflag = 'R' AND d.idx > 0 THEN 'del' ELSE 'put' END AS op, CASE WHEN l_returnflag = 'R' AND d.idx > 0 THEN NULL ELSE l_extendedprice END AS value
      FROM d JOIN runs ON d.idx = runs.idx WHERE rn = 1 AND page <= size),
f AS (SELECT idx, min(size) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fence FROM runs),
z AS (SELECT page, idx, value FROM (SELECT e.*, row_number() OVER (PARTITION BY page ORDER BY idx DESC) AS last FROM e) t JOIN f USING (idx) WHERE last = 1 AND op = 'put' AND page <= fence),
f3 AS (SELECT idx, min(size) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fence FROM runs WHERE idx <= 3),
z3 AS (SELECT page, idx, value FROM (SELECT e.*, row_number() OVER (PARTITION BY page ORDER BY idx DESC) AS last FROM e WHERE idx <= 3) t JOIN f3 USING (idx) WHERE last = 1 AND op = 'put' AND page <= fence)
"""


def line_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """entries and runs of seven versions of lineitem: page = order, run = line number; two runs truncate, later ones regrow."""
    li = table(spark, sf_dir, "lineitem")
    pages = li.agg((F.max("l_orderkey") + 1).alias("n")).first().n or 0
    runs = spark.createDataFrame([(i, pages - (pages * 4 // 15 if i == 3 else pages * 2 // 15 if i == 5 else 0)) for i in range(7)], "idx int, size long")
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")).alias("x")
    one = li.groupBy((F.col("l_orderkey") + 1).alias("page"), (F.col("l_linenumber") - 1).alias("idx")).agg(first)
    gone = (F.col("x.l_returnflag") == "R") & (F.col("idx") > 0)
    entries = one.join(F.broadcast(runs), "idx").where(F.col("page") <= F.col("size"))
    return entries.select("page", "idx", F.when(gone, "del").otherwise("put").alias("op"), F.when(~gone, F.col("x.l_extendedprice")).alias("value")), runs


@_r.query("v08_latest_per_group", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1")
def _latest(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


@_r.query("v09_truncate_fence", _LOG + "SELECT idx, fence FROM f")
def _fence(spark, sf_dir):
    return fence(line_log(spark, sf_dir)[1])


@_r.query("v10_resolve", _LOG + "SELECT page, idx, value FROM z")
def _resolve(spark, sf_dir):
    return resolve(*line_log(spark, sf_dir), ["value"])


def _third(spark, sf_dir):
    entries, runs = line_log(spark, sf_dir)
    return resolve(entries.where("idx <= 3"), runs.where("idx <= 3"), ["value"]), resolve(entries, runs, ["value"]), runs


_DIFF = """SELECT coalesce(z3.page, z.page) AS page, CASE WHEN z.page IS NOT NULL THEN 'put' ELSE 'del' END AS op, z.value AS value FROM z3 FULL JOIN z ON z3.page = z.page
           WHERE (z.page IS NOT NULL AND (z3.page IS NULL OR z3.value IS DISTINCT FROM z.value)) OR (z.page IS NULL AND z3.page <= (SELECT size FROM runs WHERE idx = 6))"""


@_r.query("v11_diff", _LOG + _DIFF)
def _diff(spark, sf_dir):
    source, target, runs = _third(spark, sf_dir)
    return diff(source, target, runs.where("idx = 6").first().size, ["value"])


@_r.query("v11_round_trip", _LOG + "SELECT page, value FROM z")
def _round_trip(spark, sf_dir):
    """source followed by diff(source, target) resolves to target."""
    source, target, runs = _third(spark, sf_dir)
    size3, size6 = (runs.where(F.col("idx") == i).first().size for i in (3, 6))
    run = diff(source, target, size6, ["value"])
    entries = source.select("page", F.lit(0).alias("idx"), F.lit("put").alias("op"), "value").unionByName(run.select("page", F.lit(1).alias("idx"), "op", "value"))
    return resolve(entries, spark.createDataFrame([(0, size3), (1, size6)], "idx int, size long"), ["value"]).select("page", "value")


@_r.query(
    "v12_overlay",
    _LOG
    + """, a AS (SELECT page, value FROM e WHERE idx = 4 AND op = 'put'), p AS (SELECT page, value FROM e WHERE idx = 5 AND op = 'put' AND page % 3 = 0)
      SELECT g.page, CASE WHEN p.page IS NOT NULL THEN p.value WHEN g.page > (SELECT pages * 14 // 15 FROM n) THEN 0.0 WHEN a.page IS NOT NULL THEN a.value
        WHEN g.page > (SELECT pages * 12 // 15 FROM n) THEN 0.0 WHEN g.page > (SELECT size FROM runs WHERE idx = 3) THEN 0.0 ELSE coalesce(z3.value, 0.0) END AS value
      FROM (SELECT unnest(range(1, (SELECT pages + 1 FROM n))) AS page) g LEFT JOIN z3 ON z3.page = g.page LEFT JOIN a ON a.page = g.page LEFT JOIN p ON p.page = g.page""",
)
def _overlay(spark, sf_dir):
    entries, runs = line_log(spark, sf_dir)
    sizes = {r.idx: r.size for r in runs.collect()}
    pages = sizes[6]
    sealed = resolve(entries.where("idx <= 3"), runs.where("idx <= 3"), ["value"])
    put = entries.where("op = 'put'")
    return overlay(spark.range(1, pages + 1).select(F.col("id").alias("page")), sealed, put.where("idx = 4"), put.where("idx = 5 AND page % 3 = 0"), "value", sizes[3], pages * 12 // 15, pages * 14 // 15)


@_r.query("v14_truncate_regrow", _LOG + "SELECT count(*) AS resurrected FROM z WHERE page > (SELECT min(size) FROM runs WHERE idx > z.idx)")
def _regrow(spark, sf_dir):
    """No page that a later truncation cut off comes back when the table regrows: the count is 0."""
    entries, runs = line_log(spark, sf_dir)
    later = runs.select("idx", F.min("size").over(W.orderBy("idx").rowsBetween(1, W.unboundedFollowing)).alias("low"))
    return resolve(entries, runs, ["value"]).join(F.broadcast(later), "idx").agg(F.count(F.when(F.col("page") > F.col("low"), 1)).alias("resurrected"))


@_r.query("v14_regrown_pages", _LOG + "SELECT idx, count(*) AS pages, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total FROM z GROUP BY idx")
def _by_run(spark, sf_dir):
    return resolve(*line_log(spark, sf_dir), ["value"]).groupBy("idx").agg(F.count(F.lit(1)).alias("pages"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@_r.query("v15_zero_elision", "SELECT l_discount = 0 AS zero, CASE WHEN l_discount = 0 THEN 'del' ELSE 'put' END AS op, count(*) AS n FROM lineitem GROUP BY l_discount = 0")
def _elide(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit("put").alias("op"), F.col("l_discount").alias("value"))
    return elide_zeros(e, "value").groupBy(F.col("value").isNull().alias("zero"), "op").agg(F.count(F.lit(1)).alias("n"))


@_r.query(
    "v17_run_or_checkpoint",
    _LOG
    + """, c AS (SELECT runs.idx AS idx, count(e.page) AS entries FROM runs LEFT JOIN e ON e.idx = runs.idx GROUP BY runs.idx),
      r AS (SELECT runs.idx, (SELECT count(DISTINCT page) FROM e WHERE e.idx <= runs.idx) AS resolved FROM runs)
      SELECT c.idx, c.entries, r.resolved, CASE WHEN c.idx < 64 AND c.entries < r.resolved THEN 'run' ELSE 'checkpoint' END AS choice FROM c JOIN r ON c.idx = r.idx""",
)
def _choice(spark, sf_dir):
    entries, runs = line_log(spark, sf_dir)
    counts = runs.join(entries.groupBy("idx").agg(F.count(F.lit(1)).alias("entries")), "idx", "left").select("idx", F.coalesce("entries", F.lit(0)).alias("entries"))
    born = entries.groupBy("page").agg(F.min("idx").alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("born"))
    grown = runs.join(born, "idx", "left").select("idx", F.sum(F.coalesce("born", F.lit(0))).over(W.orderBy("idx")).alias("resolved"))
    choice = F.when((F.col("idx") < MAX_RUNS) & (F.col("entries") < F.col("resolved")), "run").otherwise("checkpoint")
    return counts.join(grown, "idx").select("idx", "entries", "resolved", choice.alias("choice"))


@_r.query(
    "v19_endpoint_lookup",
    """SELECT o_custkey AS hash, o_orderstatus AS "end", arg_min(o_orderkey, (o_orderkey // 100, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END, o_orderkey)) AS id FROM orders GROUP BY o_custkey, o_orderstatus""",
)
def _endpoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return endpoint(o.select(F.col("o_custkey").alias("hash"), F.col("o_orderstatus").alias("end"), F.expr("o_orderkey div 100").alias("begin"), (F.col("o_orderpriority") < "3").alias("is_run"), F.col("o_orderkey").alias("id")))


_SUM = "sha256(concat_ws(':', 'page', {0}::VARCHAR, {1}::VARCHAR, {2}::VARCHAR))"


@_r.query("v21_page_checksum", f"SELECT o_orderkey AS page, {_SUM.format('o_orderkey', 'o_custkey', 'o_orderstatus')} AS checksum FROM orders")
def _checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), page_checksum("page", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("checksum"))


@_r.query(
    "v20_content_root",
    f"""WITH c AS (SELECT o_orderkey AS page, {_SUM.format('o_orderkey', 'o_custkey', 'o_orderstatus')} AS checksum FROM orders),
        l AS (SELECT page // 4096 AS node, sha256(string_agg(concat_ws('=', page::VARCHAR, checksum), ',' ORDER BY page)) AS h FROM c GROUP BY page // 4096)
        SELECT sha256(string_agg(h, ',' ORDER BY node)) AS root FROM l""",
)
def _root(spark, sf_dir):
    return content_root(_checksum(spark, sf_dir))


def verify_checksums(recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """page, found ('missing', 'unrecorded' or 'differs') of pages whose recorded checksum isn't that of what is stored."""
    j = recorded.select("page", F.col("checksum").alias("_a")).join(stored.select("page", F.col("checksum").alias("_b")), "page", "full")
    found = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unrecorded").when(F.col("_a") != F.col("_b"), "differs")
    return j.select("page", found.alias("found")).where("found IS NOT NULL")


@_r.query(
    "v22_verify",
    "SELECT found, count(*) AS pages FROM (SELECT CASE WHEN o_orderkey % 1000 = 7 THEN 'differs' WHEN o_orderkey % 1000 = 8 THEN 'missing' END AS found FROM orders UNION ALL SELECT 'unrecorded') t WHERE found IS NOT NULL GROUP BY found",
)
def _verify(spark, sf_dir):
    """Checksums are written down first; then some stored pages are damaged, lost or added, and verification finds them."""
    recorded = written(_checksum(spark, sf_dir))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), "o_custkey", "o_orderstatus")
    extra = o.agg((F.max("page") + 1).alias("page")).select("page", F.lit(0).cast("long").alias("o_custkey"), F.lit("?").alias("o_orderstatus"))
    damaged = o.where("page % 1000 <> 8").withColumn("o_orderstatus", F.when(F.col("page") % 1000 == 7, "x").otherwise(F.col("o_orderstatus")))
    stored = written(damaged.unionByName(extra))
    again = stored.select("page", page_checksum("page", F.col("page"), F.col("o_custkey"), F.col("o_orderstatus")).alias("checksum"))
    return verify_checksums(recorded, again).groupBy("found").agg(F.count(F.lit(1)).alias("pages"))


@_r.query(
    "v23_catalog_lsm",
    """WITH r AS (SELECT user_id AS key, event_id % 16 AS run, event_id, CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events),
       x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC, event_id DESC) AS rn FROM r) SELECT key, run, event_id, v FROM x WHERE rn = 1 AND v IS NOT NULL""",
)
def _lsm(spark, sf_dir):
    """Newest run first, the first writer of a key wins, a null value is a tombstone."""
    e = table(spark, sf_dir, "events")
    v = F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), None).otherwise(F.col("value"))
    rows = e.select(F.col("user_id").alias("key"), F.struct((F.col("event_id") % 16).alias("run"), "event_id").alias("at"), v.alias("v"))
    won = rows.groupBy("key").agg(F.max_by(F.struct("at", "v"), "at").alias("w"))
    return won.where("w.v IS NOT NULL").select("key", "w.at.run", "w.at.event_id", "w.v")


@_r.query(
    "v29_page_txid_map",
    _LOG
    + """, a AS (SELECT page, value FROM e WHERE idx = 4 AND op = 'put')
      SELECT g.page, CASE WHEN a.page IS NOT NULL THEN CASE WHEN a.value = 0 THEN 0 ELSE 5 END WHEN g.page > (SELECT pages * 12 // 15 FROM n) THEN 0 ELSE coalesce(z3.idx + 1, 0) END AS txid
      FROM (SELECT unnest(range(1, (SELECT pages + 1 FROM n))) AS page) g LEFT JOIN z3 ON z3.page = g.page LEFT JOIN a ON a.page = g.page""",
)
def _txids(spark, sf_dir):
    """Sealed versions, then what truncation cut at 0, then active pages at the head's id (0 where all zero)."""
    entries, runs = line_log(spark, sf_dir)
    pages = runs.where("idx = 6").first().size
    sealed = resolve(entries.where("idx <= 3"), runs.where("idx <= 3"), ["value"]).select("page", (F.col("idx") + 1).alias("t"))
    active = entries.where("op = 'put' AND idx = 4").select("page", F.when(F.col("value") == 0, 0).otherwise(5).alias("a"))
    all_ = spark.range(1, pages + 1).select(F.col("id").alias("page")).join(sealed, "page", "left").join(active, "page", "left")
    return all_.select("page", F.coalesce("a", F.when(F.col("page") > pages * 12 // 15, 0), "t", F.lit(0)).alias("txid"))


@_r.query("v33_patch_union", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'patched' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT max(o_orderkey) + 1, 'new' FROM orders")
def _patch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    patch = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("patched").alias("status")).unionByName(o.agg((F.max("o_orderkey") + 1).alias("o_orderkey")).withColumn("status", F.lit("new")))
    return patch_union(base, patch, ["o_orderkey"])


_r.sql(
    "v06_placement_join",
    """SELECT p.page, f.frame, f.pack, b.blob, b.at + f.inside AS position FROM (SELECT o_orderkey AS page, o_orderkey {div} 8 AS frame FROM orders) p
       JOIN (SELECT DISTINCT o_orderkey {div} 8 AS frame, o_orderkey {div} 64 AS pack, o_orderkey {div} 8 % 8 * 4096 AS inside FROM orders) f ON p.frame = f.frame
       JOIN (SELECT DISTINCT o_orderkey {div} 64 AS pack, o_orderkey {div} 512 AS blob, o_orderkey {div} 64 % 8 * 65536 AS at FROM orders) b ON f.pack = b.pack""",
)


@_r.query("v07_anti_join", _LOG + "SELECT page, 'added' AS side FROM z WHERE page NOT IN (SELECT page FROM z3) UNION ALL SELECT page, 'removed' AS side FROM z3 WHERE page NOT IN (SELECT page FROM z)")
def _anti(spark, sf_dir):
    a, b, _ = _third(spark, sf_dir)
    return b.join(a, "page", "left_anti").select("page", F.lit("added").alias("side")).unionByName(a.join(b, "page", "left_anti").select("page", F.lit("removed").alias("side")))


_r.sql(
    "v31_seal_schedule",
    """SELECT event_id, CASE WHEN value > 95 THEN 0 WHEN event_type = 'view' THEN NULL WHEN value >= 80 THEN 0 WHEN user_id % 9 = 0 THEN NULL ELSE least(event_id + 30, user_id * 10 + 600) END AS due FROM events""",
)
