"""Queries over the persistent store: writes, seals, branches, pins and maintenance, with the rows they must lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.dialect import Registry
from tidemark.sources.scratch import scratch
from tidemark.sources.store import ChunkedImport, Store, StoreError, check_ranges, export_table, import_table
from tidemark.sources.tables import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_VALUES = "customer bigint, status string, price double"
_BASE = "WITH b AS (SELECT o_orderkey + 1 AS page, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price FROM orders) "
_ALL = "SELECT page, customer, status, price FROM b"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("page"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def _store(spark, sf_dir) -> Store:
    return import_table(spark, _orders(spark, sf_dir), scratch(spark), _VALUES)


@_r.query("v01_import", _BASE + _ALL)
def _import(spark, sf_dir):
    return _store(spark, sf_dir).view().resolve()


@_r.query("v02_export", _BASE + _ALL)
def _export(spark, sf_dir):
    to = scratch(spark)
    export_table(_store(spark, sf_dir), to)
    return spark.read.parquet(to)


@_r.query("v03_chunked_import", _BASE + "SELECT page, CASE WHEN page % 1000 = 7 THEN -1 ELSE customer END AS customer, CASE WHEN page % 1000 = 7 THEN 'live' ELSE status END AS status, price FROM b")
def _chunked(spark, sf_dir):
    """Four chunks with a pause between; live writes made first win over the source."""
    src = _orders(spark, sf_dir)
    pages = src.agg(F.max("page")).first()[0]
    store = Store(spark, scratch(spark), _VALUES)
    store.put(src.where("page % 1000 = 7").withColumns({"customer": F.lit(-1).cast("long"), "status": F.lit("live")}))
    store.seal()
    job = ChunkedImport(store, src, pages)
    job.step(-(-pages // 4))
    job.pause()
    if job.step(1):
        raise StoreError("a paused import went on")
    job = ChunkedImport(Store(spark, store.backend.path, _VALUES), src, pages)  # as another process would go on
    job.resume()
    store = job.store
    while job.step(-(-pages // 4)):
        pass
    return store.view().resolve()


@_r.query("v04_object_backend", "SELECT * FROM (VALUES ('first', true, 5, 'hello'), ('again', false, 5, 'hello'), ('range', true, 3, 'ell')) AS t(step, created, size, content)")
def _backend(spark, sf_dir):
    store = Store(spark, scratch(spark), _VALUES)
    b = store.backend
    rows = [("first", b.put_new("root.x", b"hello"), b.stat("root.x"), b.read("root.x").decode())]
    rows += [("again", b.put_new("root.x", b"other"), b.stat("root.x"), b.read("root.x").decode())]
    piece = b.read_ranges("root.x", [(1, 3)])[0].decode()
    return spark.createDataFrame([*rows, ("range", True, len(piece), piece)], "step string, created boolean, size int, content string")


@_r.query("v05_request_rules", "SELECT * FROM (VALUES ('whole', 'ok'), ('empty', 'ok'), ('4096 ranges', 'ok'), ('4097 ranges', 'refused'), ('beyond the end', 'refused'), ('negative', 'refused'), ('fraction', 'refused'), ('64 MiB', 'ok'), ('64 MiB and a byte', 'refused')) AS t(batch, outcome)")
def _rules(spark, sf_dir):
    """What a batch of range reads may ask for, of an object of 100 MiB."""
    batches = {
        "whole": [(0, 1 << 20)],
        "empty": [],
        "4096 ranges": [(i, 1) for i in range(4096)],
        "4097 ranges": [(i, 1) for i in range(4097)],
        "beyond the end": [((100 << 20) - 1, 2)],
        "negative": [(-1, 1)],
        "fraction": [(0.5, 1)],
        "64 MiB": [(0, 32 << 20), (0, 32 << 20)],
        "64 MiB and a byte": [(0, 32 << 20), (0, (32 << 20) + 1)],
    }

    def outcome(ranges) -> str:
        try:
            check_ranges(ranges, 100 << 20)
        except StoreError:
            return "refused"
        return "ok"

    return spark.createDataFrame([(n, outcome(x)) for n, x in batches.items()], "batch string, outcome string")


_CHANGED = (
    _BASE
    + """SELECT page, customer, CASE WHEN page % 7 = 0 THEN 'X' ELSE status END AS status, CASE WHEN page % 5 = 0 THEN 1.5 ELSE price END AS price FROM b WHERE page % 11 <> 3
       UNION ALL SELECT (SELECT max(page) FROM b) + 1, 77, 'new', 9.25"""
)


def _changed(spark, sf_dir, seals: bool = True) -> Store:
    """Import; update, delete and insert; one seal for each if seals."""
    s = _store(spark, sf_dir)
    top = s.size
    s.update(F.col("page") % 7 == 0, status=F.lit("X"))
    if seals:
        s.seal()
    s.update(F.col("page") % 5 == 0, price=F.lit(1.5))
    if seals:
        s.seal()
    s.delete_where(F.col("page") % 11 == 3)
    s.insert(spark.createDataFrame([(top + 1, 77, "new", 9.25)], f"page long, {_VALUES}"))
    s.seal()
    return s


@_r.query("v16_seal_runs", _CHANGED)
def _seals(spark, sf_dir):
    return _changed(spark, sf_dir).view().resolve()


@_r.query("v18_compact", _CHANGED)
def _compact(spark, sf_dir):
    s = _changed(spark, sf_dir)
    s.compact()
    if len(s.view().manifest["runs"]) != 1:
        raise StoreError("compaction left a chain")
    return s.view().resolve()


@_r.query("v13_publish_log", "SELECT * FROM (VALUES (1, 'checkpoint', 1), (2, 'run', 2), (3, 'run', 3), (4, 'run', 4), (4, 'checkpoint', 1)) AS t(txid, kind, runs)")
def _log(spark, sf_dir):
    """One manifest per seal, in order of transaction ids, and the compaction's at the same end."""
    s = _changed(spark, sf_dir)
    s.compact()
    return spark.createDataFrame([(m["end"], m["kind"], len(m["runs"])) for m in s.root["manifests"].values()], "txid int, kind string, runs int")


@_r.query("v24_root_swap", "SELECT * FROM (VALUES ('first', 'applied'), ('second', 'stale'), ('third', 'applied')) AS t(writer, outcome)")
def _swap(spark, sf_dir):
    s = Store(spark, scratch(spark), _VALUES)
    a = s.swap_at(0, s.root)
    b = s.swap_at(0, s.root)
    c = s.swap_at(1, s.root)
    return spark.createDataFrame([("first", a), ("second", b), ("third", c)], "writer string, outcome string")


@_r.query("v25_snapshot_reader", _BASE + _ALL)
def _reader(spark, sf_dir):
    """A view opened before later seals and a compaction keeps its rows."""
    s = _store(spark, sf_dir)
    view = s.view()
    s.update(F.col("page") % 2 == 0, status=F.lit("later"))
    s.seal()
    s.compact()
    return view.resolve()


@_r.query("v26_retained_version", _BASE + "SELECT 'old' AS pin, count(*) AS pages, count(CASE WHEN status = 'later' THEN 1 END) AS changed FROM b UNION ALL SELECT 'now', count(*), count(CASE WHEN page % 2 = 0 THEN 1 END) FROM b")
def _retain(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.retain("old")
    s.retain("now")
    token = s.root["pins"]["now"]["token"]
    s.update(F.col("page") % 2 == 0, status=F.lit("later"))
    s.seal()
    s.advance_retention("now", token)
    s.collect(100)
    out = None
    for pin in ("old", "now"):
        one = s.open_retained(pin).resolve().agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("status") == "later", 1)).alias("changed")).select(F.lit(pin).alias("pin"), "pages", "changed")
        out = one if out is None else out.unionByName(one)
    return out


@_r.query("v27_forks", _BASE + "SELECT 'main' AS head, count(*) AS pages, count(CASE WHEN page % 3 = 0 THEN 1 END) AS m, 0::BIGINT AS f FROM b UNION ALL SELECT 'branch', count(*), 0, count(CASE WHEN page % 4 = 0 THEN 1 END) FROM b")
def _forks(spark, sf_dir):
    """Two branches from one seal change apart from each other."""
    s = _store(spark, sf_dir)
    f = s.fork("branch")
    s.update(F.col("page") % 3 == 0, status=F.lit("m"))
    s.seal()
    f.refresh()
    f.update(F.col("page") % 4 == 0, status=F.lit("f"))
    f.seal()
    s.refresh()

    def counts(store: Store, name: str) -> DataFrame:
        c = lambda v: F.count(F.when(F.col("status") == v, 1)).alias(v)
        return store.view().resolve().agg(F.count(F.lit(1)).alias("pages"), c("m"), c("f")).select(F.lit(name).alias("head"), "pages", "m", "f")

    return counts(s, "main").unionByName(counts(f, "branch"))


@_r.query("v28_open_sealed", _BASE + _ALL)
def _open(spark, sf_dir):
    """Opening again restores the last sealed version; what was staged and not sealed is ignored."""
    s = _store(spark, sf_dir)
    s.update(F.col("page") > 0, status=F.lit("unsealed"))
    return Store(spark, s.backend.path, _VALUES).view().resolve()


@_r.query(
    "v30_inspect",
    _BASE
    + """, top AS (SELECT max(page) AS n FROM b) SELECT 0 AS idx, 1::BIGINT AS txid, n AS size, (SELECT count(*) FROM b) AS puts, 0::BIGINT AS tombstones FROM top UNION ALL SELECT 1, 2, n, (SELECT count(*) FROM b WHERE page % 7 = 0), 0 FROM top
       UNION ALL SELECT 2, 3, n, (SELECT count(*) FROM b WHERE page % 5 = 0), 0 FROM top UNION ALL SELECT 3, 4, n + 1, 1, (SELECT count(*) FROM b WHERE page % 11 = 3) FROM top""",
)
def _inspect(spark, sf_dir):
    return _changed(spark, sf_dir).inspect()


@_r.query("v32_relocate", _CHANGED)
def _relocate(spark, sf_dir):
    s = _changed(spark, sf_dir)
    if not s.relocate(1 << 40):
        raise StoreError("nothing was moved")
    return s.view().resolve()


@_r.query("v35_maintain", _CHANGED)
def _maintain(spark, sf_dir):
    """Upkeep of a chain that has grown to its configured length: the same rows from a single run."""
    s = _changed(spark, sf_dir)
    s.configure(max_runs=4, collect_budget=100)
    if s.maintain()["action"] != "compact" or len(s.view().manifest["runs"]) != 1 or s.maintain()["action"] != "idle":
        raise StoreError("maintenance left a chain")
    return s.view().resolve()


@_r.query("v34_dictionary_adoption", "SELECT 'd2' AS dictionary, 4 AS txid, true AS same_runs")
def _dictionary(spark, sf_dir):
    s = _changed(spark, sf_dir)
    before = s.view().manifest
    s.adopt_dictionary("d2")
    after = s.view().manifest
    return spark.createDataFrame([(after["dictionary"], after["end"], after["runs"] == before["runs"])], "dictionary string, txid int, same_runs boolean")


# ---- writes as runs ----


@_r.query("s47_insert_select", _BASE + "SELECT page, customer, status, price FROM b UNION ALL SELECT page + (SELECT max(page) FROM b), customer, 'copy', price FROM b WHERE page <= 100")
def _insert(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.insert(_orders(spark, sf_dir).where("page <= 100").withColumns({"page": F.col("page") + s.size, "status": F.lit("copy")}))
    s.seal()
    return s.view().resolve()


@_r.query("s48_update", _BASE + "SELECT page, customer + 1 AS customer, concat(status, '!') AS status, price FROM b WHERE page % 3 = 1 UNION ALL SELECT page, customer, status, price FROM b WHERE page % 3 <> 1")
def _update(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.update(F.col("page") % 3 == 1, customer=F.col("customer") + 1, status=F.concat("status", F.lit("!")))
    s.seal()
    return s.view().resolve()


@_r.query("s49_delete", _BASE + "SELECT page, customer, status, price FROM b WHERE NOT (status = 'F' AND page % 2 = 0)")
def _delete(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.delete_where((F.col("status") == "F") & (F.col("page") % 2 == 0))
    s.seal()
    return s.view().resolve()


@_r.query("s50_upsert", _BASE + "SELECT page, customer, CASE WHEN page % 10 = 0 THEN 'up' ELSE status END AS status, price FROM b UNION ALL SELECT (SELECT max(page) FROM b) + 5, 1, 'up', 2.5")
def _upsert(spark, sf_dir):
    s = _store(spark, sf_dir)
    new = spark.createDataFrame([(s.size + 5, 1, "up", 2.5)], f"page long, {_VALUES}")
    s.upsert(_orders(spark, sf_dir).where("page % 10 = 0").withColumn("status", F.lit("up")).unionByName(new))
    s.seal()
    return s.view().resolve()


@_r.query("s51_insert_or_ignore", _BASE + "SELECT page, customer, status, price FROM b UNION ALL SELECT (SELECT max(page) FROM b) + 1, 5, 'new', 0.5")
def _ignore(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.insert_or_ignore(spark.createDataFrame([(1, 5, "clash", 0.5), (s.size + 1, 5, "new", 0.5)], f"page long, {_VALUES}"))
    s.seal()
    return s.view().resolve()


@_r.query("s52_insert_or_replace", _BASE + "SELECT page, customer, status, price FROM b WHERE page <> 1 UNION ALL SELECT 1, 5, 'clash', 0.5")
def _replace(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.replace(spark.createDataFrame([(1, 5, "clash", 0.5)], f"page long, {_VALUES}"))
    s.seal()
    return s.view().resolve()


@_r.query("s53_savepoints", _BASE + "SELECT page, customer, CASE WHEN page % 2 = 0 THEN 'a' ELSE status END AS status, price FROM b WHERE page % 9 <> 4")
def _savepoints(spark, sf_dir):
    """Changes after a nested savepoint are rolled back; those before and after it stay."""
    s = _store(spark, sf_dir)
    s.update(F.col("page") % 2 == 0, status=F.lit("a"))
    s.savepoint("inner")
    s.update(F.col("page") > 0, status=F.lit("gone"))
    s.delete_where(F.col("page") > 0)
    s.rollback_to("inner")
    s.delete_where(F.col("page") % 9 == 4)
    s.seal()
    return s.view().resolve()


@_r.query("s54_restore_exactly", "SELECT 3 AS seals, 2 AS fingerprints, true AS restored")
def _restore(spark, sf_dir):
    s = _store(spark, sf_dir)
    first = s.fingerprint().first().root
    old = s.view().resolve().where("page % 6 = 0")
    s.update(F.col("page") % 6 == 0, price=F.col("price") + 1)
    s.seal()
    second = s.fingerprint().first().root
    s.put(old)
    s.seal()
    third = s.fingerprint().first().root
    return spark.createDataFrame([(3, len({first, second, third}), first == third)], "seals int, fingerprints int, restored boolean")


@_r.query(
    "s55_integrity",
    """SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) d) AS duplicate_keys, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans""",
)
def _integrity(spark, sf_dir):
    dup = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    orphans = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return dup.crossJoin(orphans)  # one row each


@_r.query("s57_pushed_filters", "SELECT true AS key_pushed, true AS range_pushed")
def _pushed(spark, sf_dir):
    from tidemark.plans.session import pushed_filters

    o = table(spark, sf_dir, "orders")
    a, b = pushed_filters(o.where("o_orderkey = 5")), pushed_filters(o.where("o_orderkey >= 5 AND o_custkey < 9"))
    return spark.createDataFrame([(any("EqualTo(o_orderkey" in x for x in a), any("GreaterThanOrEqual(o_orderkey" in x and "LessThan(o_custkey" in x for x in b))], "key_pushed boolean, range_pushed boolean")
