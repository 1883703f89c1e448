"""S family: scans, filters, joins, aggregates, windows, sorts, sets and scalar functions.

Each query is registered under the key of its inventory line. Money columns are summed as decimals, so that sums don't
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.functions.ordered import positions, running
from tidemark.plans.dialect import Registry
from tidemark.sources.scratch import scratch
from tidemark.sources.tables import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

# ---- scans and sources ----

_r.sql("s01_full_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey")
_r.sql("s02_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 417 ORDER BY o_orderkey LIMIT 32")
_r.sql("s03_range_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 1200 ORDER BY o_orderkey LIMIT 32")
_r.sql(
    "s04_or_of_ranges",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 10 AND 40 OR o_orderkey BETWEEN 300 AND 330 OR o_orderkey BETWEEN 700 AND 720 OR o_orderkey BETWEEN 1100 AND 1111",
)
_r.sql("s05_in_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 17, 60, 99, 140)")


@_r.query("s06_generator", "WITH RECURSIVE n(x) AS (VALUES (1) UNION ALL SELECT x + 1 FROM n WHERE x < 1000) SELECT x::BIGINT AS x, (x * x % 97)::BIGINT AS y FROM n")
def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 1001).select(F.col("id").alias("x"), (F.col("id") * F.col("id") % 97).alias("y"))


_r.sql("s06_recursive_cte", "WITH RECURSIVE n(x) AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM n WHERE x < 90) SELECT x FROM n")
_r.sql("s07_values", "SELECT * FROM (VALUES (1, 'alpha'), (2, 'beta'), (3, 'gamma')) AS t(id, label)")

_KIND = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}


@_r.query(
    "s08_schema_introspection",
    """SELECT table_name, column_name, ordinal_position::BIGINT AS position, data_type FROM information_schema.columns
       WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part') AND table_schema = 'main'""",
)
def schema_introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (n, f.name, i + 1, _KIND.get(f.dataType.simpleString(), f.dataType.simpleString().upper()))
        for n in ("region", "nation", "customer", "supplier", "part")
        for i, f in enumerate(table(spark, sf_dir, n).schema)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, position long, data_type string")


@_r.query("s09_cross_database", "SELECT n.n_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def cross_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two databases of the catalog, each with a table of its own, read under qualified names in one statement."""
    for db, name in (("tidemark_main", "customer"), ("tidemark_other", "nation")):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{scratch(spark)}'")
        spark.sql(f"DROP TABLE IF EXISTS {db}.{name}")
        spark.catalog.createTable(f"{db}.{name}", path=f"{sf_dir}/{name}.parquet", source="parquet")
    return spark.sql("SELECT n.n_name, count(*) AS customers FROM tidemark_main.customer c JOIN tidemark_other.nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")


# ---- projection, filters, predicates ----

_r.sql("s12_projection", "SELECT p_partkey AS id, p_name AS title, p_retailprice AS price, p_size + 1 AS next_size FROM part")
_r.sql("s13_modulo_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 = 3 AND (o_custkey % 2 = 0 OR o_orderstatus <> 'O') AND o_orderkey > 5")
_r.sql(
    "s14_null_tests",
    """SELECT count(*) AS n, count(CASE WHEN supplied IS NULL THEN 1 END) AS missing, count(CASE WHEN supplied IS NOT NULL THEN 1 END) AS present
       FROM (SELECT n_nationkey, s.s_nationkey AS supplied FROM nation n LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) s ON n.n_nationkey = s.s_nationkey) t""",
)
_r.sql("s15_like_escape", r"SELECT count(*) AS n, sum(CASE WHEN lower(text) LIKE lower('%The!_%') ESCAPE '!' THEN 1 ELSE 0 END){duck:::BIGINT} AS with_mark, sum(CASE WHEN lower(text) LIKE '%THE%' THEN 1 ELSE 0 END){duck:::BIGINT} AS upper_only, sum(CASE WHEN lower(text) LIKE lower('%THE%') ESCAPE '!' THEN 1 ELSE 0 END){duck:::BIGINT} AS folded FROM documents")
_r.sql("s16_nocase", "SELECT doc_id, source FROM documents WHERE {spark:source COLLATE UTF8_LCASE = 'SRC3'}{duck:lower(source) = lower('SRC3')}")
_r.sql(
    "s17_case_buckets",
    """SELECT doc_id, CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 2000 THEN '500-2000' WHEN n_chars <= 8000 THEN '2000-8000' ELSE '>8000' END AS size_bucket FROM documents""",
)
_r.sql("s18_correlated_scalar", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem s WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem t WHERE t.l_orderkey = s.l_orderkey)")


@_r.query("s19_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 160 AND o_orderstatus = 'O'")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and positional markers bind values, never text."""
    from tidemark.plans.session import Session

    with Session(spark, sf_dir) as db:
        return db.frame("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN :lo AND :hi AND o_orderstatus = :status", {"lo": 100, "hi": 160, "status": "O"})


@_r.query(
    "s20_read_only_gate",
    """SELECT * FROM (VALUES ('select', true), ('with', true), ('values', true), ('describe', true), ('show', true), ('insert', false), ('drop', false), ('set', false), ('create', false), ('two', false), ('cache', false)) AS t(name, allowed)""",
)
def read_only_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.session import is_read_only

    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    texts = {
        "select": "SELECT 1",
        "with": "WITH a AS (SELECT 1 AS x) SELECT x FROM a",
        "values": "VALUES (1), (2)",
        "describe": "DESCRIBE nation",
        "show": "SHOW TABLES",
        "insert": "INSERT INTO nation VALUES (1, 'x', 1)",
        "drop": "DROP TABLE nation",
        "set": "SET spark.sql.ansi.enabled = false",
        "create": "CREATE VIEW v AS SELECT 1",
        "two": "SELECT 1; SELECT 2",
        "cache": "CACHE TABLE nation",
    }
    return spark.createDataFrame([(k, is_read_only(spark, v)) for k, v in texts.items()], "name string, allowed boolean")


# ---- joins ----

_r.sql("s21_inner_join", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
_ROLES = """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_name, s.s_name, nc.n_name AS customer_nation, ns.n_name AS supplier_nation, r.r_name AS customer_region
            FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
            LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation nc ON c.c_nationkey = nc.n_nationkey LEFT JOIN nation ns ON s.s_nationkey = ns.n_nationkey LEFT JOIN region r ON nc.n_regionkey = r.r_regionkey"""
_r.sql("s22_role_playing_joins", f"SELECT customer_region, customer_nation, supplier_nation, count(*) AS n, count(p_name) AS parts, min(s_name) AS first_supplier FROM ({_ROLES}) t GROUP BY customer_region, customer_nation, supplier_nation")
@_r.query(
    "s24_catalog_join",
    """SELECT t.table_name AS name, count(*) AS columns, count(CASE WHEN c.data_type = 'VARCHAR' THEN 1 END) AS text_columns FROM information_schema.tables t JOIN information_schema.columns c ON t.table_name = c.table_name AND t.table_schema = c.table_schema
       WHERE t.table_schema = 'main' AND t.table_name IN ('orders', 'nation', 'region', 'customer') GROUP BY t.table_name""",
)
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's list of tables joined to the columns that its catalog has for each."""
    names = ("orders", "nation", "region", "customer")
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    tables = spark.sql("SHOW TABLES").where(F.col("tableName").isin(*names)).select(F.col("tableName").alias("name")).distinct()
    columns = spark.createDataFrame([(n, c.name, c.dataType) for n in names for c in spark.catalog.listColumns(n)], "name string, column string, type string")
    return tables.join(columns, "name").groupBy("name").agg(F.count(F.lit(1)).alias("columns"), F.count(F.when(F.col("type") == "string", 1)).alias("text_columns"))


_r.sql("s25_comma_join", "SELECT a.n AS tables, b.n AS rows_in_region FROM (SELECT count(*) AS n FROM nation) a, (SELECT count(*) AS n FROM region) b")

# ---- aggregation ----

_r.sql(
    "s26_global_aggregates",
    """SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS total, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 4) AS mean_price, min(l_discount) AS low, max(l_tax) AS high FROM lineitem""",
)
_r.sql(
    "s27_group_by_ratio",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity,
              round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / greatest(1, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE)), 3) AS price_per_unit
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
_r.sql("s28_having", "SELECT count(*) AS conversations FROM (SELECT conv_id, count(*) AS members FROM conversations GROUP BY conv_id HAVING count(*) = max(turn) + 1 AND count(*) > 3) t")
_r.sql("s29_count_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
_r.sql(
    "s30_conditional_aggregation",
    """SELECT event_type, max(CASE WHEN user_id % 2 = 0 THEN value END) AS max_even, count(CASE WHEN value > 50 THEN 1 END) AS high FROM events GROUP BY event_type""",
)
_r.sql(
    "s31_safe_ratio",
    """SELECT o_orderpriority, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / greatest(1, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)), 3) AS price_per_partial FROM orders GROUP BY o_orderpriority""",
)
@_r.query(
    "s32_nearest_rank",
    """SELECT pos, value FROM (SELECT value, row_number() OVER (ORDER BY value, event_id) AS pos, count(*) OVER () AS total FROM events) t
       WHERE pos IN (greatest(1, total // 2), greatest(1, total * 9 // 10), greatest(1, total * 99 // 100), total)""",
)
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at four places of the whole order: values are counted, and counts summed along it."""
    counts = table(spark, sf_dir, "events").groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    upto = running(counts, ["value"], "c", "upto")
    total = table(spark, sf_dir, "events").count()
    wanted = sorted({max(1, total // 2), max(1, total * 9 // 10), max(1, total * 99 // 100), total}) if total else []
    at = upto.select("value", "upto", "c", F.explode(F.array(*[F.lit(w).cast("long") for w in wanted] or [F.lit(0).cast("long")])).alias("pos"))
    return at.where("pos <= upto AND pos > upto - c").select("pos", "value")


_r.sql(
    "s33_bucket_group",
    """SELECT CASE WHEN n_chars <= 500 THEN 'small' WHEN n_chars <= 4000 THEN 'middle' ELSE 'large' END AS bucket, lang, count(*) AS n, {spark:sum(n_chars)}{duck:sum(n_chars)::BIGINT} AS chars
       FROM documents GROUP BY CASE WHEN n_chars <= 500 THEN 'small' WHEN n_chars <= 4000 THEN 'middle' ELSE 'large' END, lang""",
)

# ---- windows ----


@_r.query(
    "s34_window_percentiles",
    """
    WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS pos,
                      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n)::BIGINT AS n,
           round(avg(CASE WHEN pos IN ((n + 1) // 2, (n + 2) // 2) THEN value END), 6) AS median_value,
           max(CASE WHEN pos = (95 * n + 99) // 100 THEN value END) AS p95_value
    FROM o GROUP BY event_type""",
)
def window_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of each group by position. Values are counted first, so a group's window runs over
    its distinct values with running counts instead of all its rows."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    part = W.partitionBy("event_type")
    ranked = counts.withColumns({"upto": F.sum("c").over(part.orderBy("value")), "n": F.sum("c").over(part)})

    def holds(pos: str):
        return F.expr(f"upto >= {pos} AND upto - c < {pos}")

    low, high, p95 = "(n + 1) div 2", "(n + 2) div 2", "(95 * n + 99) div 100"
    return ranked.groupBy("event_type").agg(
        F.max("n").alias("n"),
        F.round((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2, 6).alias("median_value"),
        F.max(F.when(holds(p95), F.col("value"))).alias("p95_value"),
    )


_r.sql("s35_unpartitioned_window", "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS pos, count(*) OVER () AS total FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) t")

# ---- sort, limit, top-k ----

_r.sql("s36_multi_key_order", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey ASC")


def clamped_page(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of df in the given order; a page beyond the end is the last one. Only the page's rows are sorted out."""
    last = max(0, -(-df.count() // size) - 1)
    page = max(0, min(page, last))
    return df.orderBy(*order).offset(page * size).limit(size)


@_r.query("s37_paging", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 80")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clamped_page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 4, 20)


@_r.query("s37_page_clamped", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 20 OFFSET 20")
def page_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clamped_page(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 99, 20)


@_r.query(
    "s38_positional_sample",
    """SELECT item_id, pos FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark) t
       WHERE pos IN (SELECT (i * (SELECT count(*) - 1 FROM benchmark)) // 15 FROM range(16) r(i))""",
)
def positional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen evenly spaced places of the ordered keys."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    n = b.count()
    wanted = sorted({i * (n - 1) // 15 for i in range(16)}) if n else []
    return positions(b, ["item_id"]).where(F.col("pos").isin(wanted))


@_r.query("s39_deterministic_shuffle", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('seed-7:', CAST(doc_id AS VARCHAR))), doc_id) AS place, lang FROM documents")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same order each time, from a digest of seed and key; places are numbered per slice, as languages are few."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("seed-7:"), F.col("doc_id").cast("string"))).alias("digest"))
    return positions(d, ["digest", "doc_id"], ["lang"]).select("doc_id", (F.col("pos") + 1).alias("place"), "lang")


@_r.query("s40_max_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 50")
def max_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query under the row limit gives its rows; over it, the session raises (tested)."""
    from tidemark.plans.session import Session

    with Session(spark, sf_dir) as db:
        rows = db.all("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 50", max_rows=10_000)
    return spark.createDataFrame([tuple(r) for r in rows], "o_orderkey long, o_custkey long")


@_r.query(
    "s41_case_order",
    "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) AS place, o_orderstatus FROM orders",
)
def case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all orders in an order of own making."""
    o = table(spark, sf_dir, "orders").withColumn("own", F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3))
    return positions(o.select("own", "o_orderkey", "o_orderpriority", "o_orderstatus"), ["own", "o_orderkey"]).select("o_orderkey", "o_orderpriority", (F.col("pos") + 1).alias("place"), "o_orderstatus")


# ---- sets and scalars ----

_r.sql("s42_union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name AS name, 'region' AS kind FROM region")
_r.sql(
    "s43_strings",
    """SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS joined, substr(c_name, 3, 5) AS part_of, length(c_name) AS n, instr(c_name, '0') AS first_zero, lower(c_mktsegment) AS low,
              {spark:hex(c_name)}{duck:hex(encode(c_name))} AS hexed, coalesce(NULL, c_mktsegment) AS given, {spark:char(65 + CAST(c_custkey % 26 AS INT))}{duck:chr(65 + (c_custkey % 26)::INT)} AS letter, repeat('x', CAST(c_custkey % 4 AS INT)) AS filled,
              {spark:format_string('%05d', c_custkey)}{duck:printf('%05d', c_custkey)} AS padded FROM customer""",
)
_r.sql(
    "s44_blobs",
    """SELECT n_nationkey, {spark:hex(CAST(n_name AS BINARY))}{duck:hex(n_name::BLOB)} AS as_blob, {spark:octet_length(unhex(repeat('00', n_nationkey)))}{duck:octet_length(unhex(repeat('00', n_nationkey)))} AS zero_bytes, {spark:hex(X'00ff10')}{duck:hex('\\x00\\xFF\\x10'::BLOB)} AS literal FROM nation""",
)
_r.sql(
    "s45_numeric",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey {div} 7 AS whole, l_orderkey % 7 AS rest, CAST(round(l_extendedprice * 100) AS BIGINT) {div} greatest(1, CAST(l_quantity AS BIGINT)) AS unit_cents, round(CAST(l_partkey AS DOUBLE) / 8, 3) AS eighth, greatest(l_quantity, 10.0E0) AS at_least_ten, CAST(l_quantity AS INT) AS quantity, CAST(l_partkey AS DOUBLE) / 4 AS quarter FROM lineitem""",
)
_r.sql("s46_affinity", "SELECT v, {spark:coalesce(try_cast(v AS DOUBLE), 0D)}{duck:coalesce(try_cast(v AS DOUBLE), 0)} / 1048576.0E0 AS mib FROM (VALUES ('1048576'), ('2097152.5'), ('junk')) AS t(v)")

# ---- CSV ----


@_r.query("s10_csv_import", "SELECT event_type, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS over_ten FROM events GROUP BY event_type")
def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns come in as text and are cast in the query."""
    from tidemark.sources.csvio import read_csv, write_csv

    path = scratch(spark)
    write_csv(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    rows = read_csv(spark, path, ["event_id", "event_type", "value"])
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value").cast("double") > 10, 1).otherwise(0)).alias("over_ten"))


@_r.query("s11_csv_sink", "SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, 'o_orderkey,o_orderpriority' AS header FROM orders")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.csvio import write_csv

    path = scratch(spark)
    write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), path)
    lines = spark.read.text(path)
    header = F.lit("o_orderkey,o_orderpriority")
    key = F.split("value", ",")[0].try_cast(T.LongType())
    return lines.agg(F.count(F.when(F.col("value") != header, 1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.max(F.when(F.col("value") == header, header)).alias("header"))
