"""M family: reachability, occupancy, repack planning, range coalescing and reports over storage metadata.

The fixture is lineitem as an inventory: pack = part, frame = (part, order), page = line, live while the line is open.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import blocks, folds
from tidemark.functions.ordered import positions
from tidemark.plans.dialect import Registry
from tidemark.sources.scratch import written
from tidemark.sources.tables import NAMES, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

# ---- distributions ----

_r.sql(
    "m01_frame_distribution",
    """SELECT decoded_bytes, count(*) AS frames, count(CASE WHEN raw = 1 THEN 1 END) AS raw_frames, count(CASE WHEN raw = 0 THEN 1 END) AS dictionary_frames, CAST(sum(stored) AS BIGINT) AS stored_bytes
       FROM (SELECT count(*) * 4096 AS decoded_bytes, max(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS raw, sum(CAST(l_quantity AS BIGINT) * 40) AS stored FROM lineitem GROUP BY l_partkey, l_orderkey) t GROUP BY decoded_bytes""",
)
_r.sql("m02_live_pages", "SELECT l_partkey AS pack, count(*) AS live_pages FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey")


def by_position(df: DataFrame, keys: str | list[str], value: str, wanted: dict[str, str]) -> DataFrame:
    """Values at positions (SQL over n, from 1) of each key's sorted values, from counts per distinct value."""
    keys = [keys] if isinstance(keys, str) else keys
    part = W.partitionBy(*keys)
    ranked = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")).withColumns({"upto": F.sum("c").over(part.orderBy(value)), "n": F.sum("c").over(part)})
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.expr(f"max(CASE WHEN upto >= {pos} AND upto - c < {pos} THEN {value} END)").alias(name) for name, pos in wanted.items()])


@_r.query(
    "m03_three_points",
    """SELECT event_type, max(CASE WHEN pos = (n - 1) * 50 // 100 THEN value END) AS p50, max(CASE WHEN pos = (n - 1) * 95 // 100 THEN value END) AS p95, max(CASE WHEN pos = (n - 1) * 99 // 100 THEN value END) AS p99
       FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY event_type""",
)
def _three(spark, sf_dir):
    return by_position(table(spark, sf_dir, "events"), "event_type", "value", {f"p{p}": f"(n - 1) * {p} div 100 + 1" for p in (50, 95, 99)}).drop("n")


@_r.query(
    "m04_upper_median",
    "SELECT event_type, max(CASE WHEN pos = n // 2 THEN value END) AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY event_type",
)
def _upper(spark, sf_dir):
    return by_position(table(spark, sf_dir, "events"), "event_type", "value", {"upper_median": "n div 2 + 1"}).drop("n")


# ---- reachability and collection ----

_ROOTS = """
WITH roots AS (SELECT o_custkey AS manifest, CASE WHEN o_orderkey % 3 = 0 THEN 'current' WHEN o_orderkey % 3 = 1 THEN 'named' ELSE 'leased' END AS kind FROM orders WHERE o_orderkey % 11 = 0),
deps AS (SELECT o.o_custkey AS manifest, l.l_partkey AS object FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
reached AS (SELECT DISTINCT kind, object FROM roots JOIN deps USING (manifest))
"""


def trace(roots: DataFrame, deps: DataFrame) -> DataFrame:
    """kind, object: what each kind of root reaches. Roots are made distinct first, so a manifest is expanded once per kind."""
    return roots.distinct().join(deps.distinct(), "manifest").select("kind", "object").distinct()


def _roots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "current").when(F.col("o_orderkey") % 3 == 1, "named").otherwise("leased")
    roots = o.where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("manifest"), kind.alias("kind"))
    deps = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("manifest"), F.col("l_partkey").alias("object"))
    return roots, deps


@_r.query("m09_reachability", _ROOTS + "SELECT kind, object FROM reached")
def _trace(spark, sf_dir):
    return trace(*_roots(spark, sf_dir))


def classify(inventory: DataFrame, reached: DataFrame, uncertain: DataFrame, budget: int) -> DataFrame:
    """key, bytes, class, deletable: current, else retained (named, then leased, then uncertain), else collectible; the
    first budget collectibles in key order may be deleted. The sets are one flag row per object before they are joined."""
    flags = reached.groupBy("object").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("current", "named", "leased")])
    j = inventory.join(flags, inventory.key == flags.object, "left").join(uncertain.select(F.col("object").alias("_u")).distinct(), F.col("key") == F.col("_u"), "left")
    cls = F.when(F.col("current") == 1, "current").when(F.col("named") == 1, "named").when(F.col("leased") == 1, "leased").when(F.col("_u").isNotNull(), "uncertain").otherwise("collectible")
    named = j.select("key", "bytes", cls.alias("class"))
    first = named.where("class = 'collectible'").orderBy("key").limit(budget).select(F.col("key").alias("_d"))
    return named.join(F.broadcast(first), F.col("key") == F.col("_d"), "left").select("key", "bytes", "class", F.col("_d").isNotNull().alias("deletable"))


@_r.query(
    "m10_gc_classification",
    _ROOTS
    + """, j AS (SELECT p_partkey AS key, p_size::BIGINT AS bytes, CASE WHEN p_partkey IN (SELECT object FROM reached WHERE kind = 'current') THEN 'current' WHEN p_partkey IN (SELECT object FROM reached WHERE kind = 'named') THEN 'named'
      WHEN p_partkey IN (SELECT object FROM reached WHERE kind = 'leased') THEN 'leased' WHEN p_partkey % 13 = 0 THEN 'uncertain' ELSE 'collectible' END AS class FROM part)
      SELECT key, bytes, class, class = 'collectible' AND row_number() OVER (PARTITION BY class ORDER BY key) <= 8 AS deletable FROM j""",
)
def _gc(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return classify(p.select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("bytes")), trace(*_roots(spark, sf_dir)), p.where("p_partkey % 13 = 0").select(F.col("p_partkey").alias("object")), 8)


_r.sql(
    "m08_set_algebra",
    """SELECT (SELECT count(*) FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) u) AS in_either,
              (SELECT count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) i) AS in_both,
              (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) d) AS only_customers,
              (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation) e) = 0 AS subset""",
)


@_r.query(
    "m11_dead_extents",
    """SELECT count(*) AS extents, sum(length)::BIGINT AS bytes FROM (SELECT DISTINCT l_suppkey AS blob, l_partkey AS start, l_partkey % 97 + 1 AS length FROM lineitem
       WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.05) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) t""",
)
def _dead(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    reachable = li.where("l_linestatus = 'O' AND l_discount > 0.05").select("l_partkey").distinct()
    physical = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    dead = li.select("l_suppkey", "l_partkey").distinct().join(reachable, "l_partkey", "left_anti").join(physical, "l_suppkey", "left_semi")
    return dead.agg(F.count(F.lit(1)).alias("extents"), F.sum(F.col("l_partkey") % 97 + 1).alias("bytes"))


class BrokenReference(ValueError):
    pass


def require_complete(deps: DataFrame, inventory: DataFrame) -> None:
    """Fail closed: a dependency that the inventory lacks, or whose length differs, stops everything before a delete."""
    j = deps.select("object", "bytes").distinct().join(inventory.select(F.col("key").alias("object"), F.col("bytes").alias("have")), "object", "left")
    bad = j.where("have IS NULL OR have <> bytes").take(1)
    if bad:
        raise BrokenReference(f"object {bad[0].object}: {bad[0].have} bytes in the inventory, {bad[0].bytes} expected")


@_r.query("m12_fail_closed", "SELECT (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS missing, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans")
def _closed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    b = li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return a.crossJoin(b)  # one row each


# ---- occupancy and repacking ----

_OCC = """
WITH fr AS (SELECT l_partkey AS pack, l_orderkey AS frame, count(*) AS pages, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS live, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY l_partkey, l_orderkey),
oc AS (SELECT pack, CAST(sum(pages) AS BIGINT) AS pages_total, CAST(sum(live) AS BIGINT) AS pages_live, count(CASE WHEN live = pages THEN 1 END) AS frames_live, count(CASE WHEN live > 0 AND live < pages THEN 1 END) AS frames_partial,
       count(CASE WHEN live = 0 THEN 1 END) AS frames_dead, CAST(sum(bytes) AS BIGINT) AS frame_bytes, CAST(sum(CASE WHEN live = pages THEN bytes ELSE 0 END) AS BIGINT) AS live_frame_bytes,
       CAST(sum(CASE WHEN live > 0 AND live < pages THEN bytes ELSE 0 END) AS BIGINT) AS partial_frame_bytes, CAST(sum(CASE WHEN live = 0 THEN bytes ELSE 0 END) AS BIGINT) AS dead_frame_bytes,
       CAST(sum(CASE WHEN live > 0 THEN bytes ELSE 0 END) AS BIGINT) AS live_record_bytes, CAST(sum(CASE WHEN live > 0 THEN bytes * (pages - live) {div} pages ELSE 0 END) AS BIGINT) AS partial_reclaim FROM fr GROUP BY pack)
"""
_r.sql("m13_pack_occupancy", _OCC + "SELECT pack, pages_total, pages_live, frames_live, frames_partial, frames_dead, live_frame_bytes, partial_frame_bytes, dead_frame_bytes FROM oc")
_r.sql("m14_reclaimable", _OCC + "SELECT pack, CASE WHEN pages_total = 0 THEN frame_bytes ELSE frame_bytes * (pages_total - pages_live) {div} pages_total END AS reclaimable FROM oc")
_r.sql("m15_repack_estimate", _OCC + "SELECT pack, frame_bytes - live_record_bytes + partial_reclaim AS estimate FROM oc")
_r.sql(
    "m17_copy_or_decode",
    _OCC + "SELECT CASE WHEN live = pages THEN 'copy' WHEN live = 0 THEN 'skip' ELSE 'decode' END AS action, count(*) AS frames, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(live) AS BIGINT) AS live_pages FROM fr GROUP BY CASE WHEN live = pages THEN 'copy' WHEN live = 0 THEN 'skip' ELSE 'decode' END",
)


def select_repack(packs: DataFrame, budget: int) -> DataFrame:
    """Packs to rewrite: more than half reclaimable, best reclaim per live byte first, greedy with skip.

    The order compares exact integer products, as decimals. Packs are range-dealt in that order, so the first slices hold
    the best ones; a driver walk over the slices takes what fits from each, and stops where nothing is left of the budget.
    At most one slice is in the driver at a time, and of it only packs that fit what is left.
    """
    eligible = packs.where((F.col("reclaimable") * 2 > F.col("frame_bytes")) & (F.col("live_bytes") <= budget))
    ratio = -(F.col("reclaimable").cast("decimal(38,18)") / F.greatest(F.col("live_bytes"), F.lit(1)).cast("decimal(20,0)"))
    dealt = written(eligible.select(ratio.alias("o"), "pack", "live_bytes").repartitionByRange("o", "pack").withColumn("slice", F.spark_partition_id()))
    taken: list[int] = []
    low = dealt.groupBy("slice").agg(F.min("live_bytes").alias("low")).orderBy("slice").collect()
    for r in low:
        if r.low <= budget:
            for x in dealt.where((F.col("slice") == r.slice) & (F.col("live_bytes") <= budget)).orderBy("o", "pack").toLocalIterator():
                if x.live_bytes <= budget:
                    budget -= x.live_bytes
                    taken.append(x.pack)
    return packs.sparkSession.createDataFrame(list(enumerate(taken)), "place int, pack long")


#: The greedy choice is a fold over the packs in order: a recursive statement, one pack a step.
_GREEDY = (
    _OCC
    + """, el AS (SELECT pack, live_record_bytes AS live, row_number() OVER (ORDER BY -((frame_bytes - live_record_bytes + partial_reclaim)::DECIMAL(38, 9) / greatest(live_record_bytes, 1)::DOUBLE), pack) AS k
                  FROM oc WHERE (frame_bytes - live_record_bytes + partial_reclaim) * 2 > frame_bytes AND live_record_bytes <= 5000),
      walk AS (SELECT 0::BIGINT AS k, 5000::BIGINT AS room, NULL::BIGINT AS pack, false AS took
               UNION ALL SELECT el.k, CASE WHEN el.live <= room THEN room - el.live ELSE room END, el.pack, el.live <= room FROM walk JOIN el ON el.k = walk.k + 1)
      SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS place, pack FROM walk WHERE took"""
).replace("\nWITH fr", "\nWITH RECURSIVE fr", 1)


@_r.query("m16_repack_selection", _GREEDY)
def _select(spark, sf_dir):
    from tidemark.plans.dialect import run

    packs = run(spark, sf_dir, _OCC + "SELECT pack, frame_bytes, live_record_bytes AS live_bytes, frame_bytes - live_record_bytes + partial_reclaim AS reclaimable FROM oc")
    return select_repack(packs, 5000)


# ---- range coalescing ----


def _ranges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("blob"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"))


#: Fixed value: ranges of a slice, which is what one task sorts.
SLICE = 500_000


def islands(ranges: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Overlapping or adjacent ranges of a blob become one: blob, start, end, parts.

    Ranges are range-dealt in order into slices, whose number follows the rows, and walked once in each; a blob may go over
    many slices. Islands of a slice that an earlier slice's greatest end still reaches go to the last island before.
    """
    whole = F.col("blob").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    seen = ranges.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~whole, 1)).alias("odd")).first()
    if not seen.odd:
        return _islands_by_slice(ranges, -(-seen.n // slice_rows))
    odd = F.broadcast(ranges.where(~whole).select(F.col("blob").alias("_b")).distinct())
    same = F.col("blob").eqNullSafe(F.col("_b"))
    return _islands_by_slice(ranges.join(odd, same, "left_anti"), -(-seen.n // slice_rows)).unionByName(_islands_by_window(ranges.join(odd, same, "left_semi")))


def _islands_by_window(ranges: DataFrame) -> DataFrame:
    """The same with a blob in a task, for blobs with ranges whose start or end is missing."""
    by = W.partitionBy("blob").orderBy("start", "end")
    prev = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.distinct().withColumn("new", F.when(prev.isNull() | (F.col("start") > prev), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("island")


def _islands_by_slice(ranges: DataFrame, slices: int) -> DataFrame:
    order, names = ["blob", "start", "end"], ["blob", "start", "end", "parts"]
    dealt = ranges.select("blob", F.col("start").cast("long"), F.col("end").cast("long")).repartitionByRange(max(1, slices), *order).sortWithinPartitions(*order)
    local = written(dealt.mapInArrow(blocks.islands, f"blob {dict(dealt.dtypes)['blob']}, start long, end long, parts long").withColumn("slice", F.spark_partition_id()))
    if slices < 2:
        return local.select(*names)
    # a border between two slices cuts one blob at most: what follows about cut blobs has two rows a border
    cut = F.broadcast(local.groupBy("blob").agg(F.min("slice").alias("a"), F.max("slice").alias("b")).where("a < b").select("blob"))
    mine = local.join(cut, "blob", "left_semi")
    before = W.partitionBy("blob").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    reach = mine.groupBy("blob", "slice").agg(F.max("end").alias("top")).withColumn("reach", F.max("top").over(before))
    marked = mine.join(F.broadcast(reach.drop("top")), ["blob", "slice"]).withColumn("head", F.col("reach").isNull() | (F.col("start") > F.col("reach")))
    heads = marked.where("head")
    facts = marked.groupBy("blob", "slice").agg(F.max(F.when(F.col("head"), F.col("start"))).alias("at"), F.max(F.when(~F.col("head"), F.col("end"))).alias("_end"), F.sum(F.when(~F.col("head"), F.col("parts"))).alias("_parts"))
    more = facts.withColumn("start", F.max("at").over(before)).where("_parts IS NOT NULL").groupBy("blob", "start").agg(F.max("_end").alias("_end"), F.sum("_parts").alias("_parts"))
    joined = heads.join(F.broadcast(more), ["blob", "start"], "left").select("blob", "start", F.greatest("end", "_end").alias("end"), (F.col("parts") + F.coalesce("_parts", F.lit(0))).alias("parts"))
    return local.join(cut, "blob", "left_anti").select(*names).unionByName(joined)


@_r.query(
    "m19_islands",
    """WITH r AS (SELECT DISTINCT l_suppkey AS blob, l_orderkey AS start, l_orderkey + l_quantity::BIGINT AS stop FROM lineitem),
       m AS (SELECT *, max(stop) OVER (PARTITION BY blob ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
       g AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY blob ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
       SELECT blob, min(start) AS start, max(stop) AS "end", count(*) AS parts FROM g GROUP BY blob, island""",
)
def _islands(spark, sf_dir):
    return islands(_ranges(spark, sf_dir))


def coalesce_ranges(ranges: DataFrame, gap: int, window: int, factor: int | None = None, single: int | None = None) -> DataFrame:
    """Bounded merging of each blob's ranges, as one ordered fold per blob."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = folds.coalesce_bounded(zip(pdf["start"].tolist(), pdf["end"].tolist()), gap, window, factor, single)
        return pd.DataFrame({"blob": [key[0]] * len(merged), "start": [m[0] for m in merged], "end": [m[1] for m in merged], "parts": [m[2] for m in merged]})

    return ranges.select("blob", "start", "end").distinct().groupBy("blob").applyInPandas(run, "blob long, start long, end long, parts long")


#: A fold in order, one range of each blob a step, all blobs at once.
_COALESCE = """WITH RECURSIVE r AS (SELECT DISTINCT l_suppkey AS blob, l_orderkey AS a, l_orderkey + l_quantity::BIGINT AS b FROM lineitem),
     o AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY a, b) AS k FROM r),
     w AS (SELECT blob, k, a AS lo, b AS hi, b - a AS held, 1 AS island FROM o WHERE k = 1
           UNION ALL SELECT blob, k, CASE WHEN fits THEN lo ELSE a END, CASE WHEN fits THEN greatest(hi, b) ELSE b END, CASE WHEN fits THEN joint ELSE b - a END, island + (NOT fits)::INTEGER
           FROM (SELECT o.blob, o.k, w.lo, w.hi, o.a, o.b, w.island, w.held + greatest(0, o.b - greatest(o.a, w.hi)) AS joint,
                        o.a <= w.hi + {gap} AND greatest(w.hi, o.b) - w.lo <= {window} AND greatest(w.hi, o.b) - w.lo <= {factor} * (w.held + greatest(0, o.b - greatest(o.a, w.hi))) AS fits
                 FROM w JOIN o ON o.blob = w.blob AND o.k = w.k + 1) s)
     SELECT blob, min(lo) AS start, max(hi) AS "end", count(*) AS parts FROM w GROUP BY blob, island"""


@_r.query("m18_maintenance_ranges", _COALESCE.format(gap=64, window=8192, factor=4))
def _maintenance(spark, sf_dir):
    return coalesce_ranges(_ranges(spark, sf_dir), gap=64, window=8192, factor=4, single=16_384)


@_r.query("m20_request_groups", _COALESCE.format(gap=8, window=256, factor=1 << 40))
def _requests(spark, sf_dir):
    return coalesce_ranges(_ranges(spark, sf_dir), gap=8, window=256)


def _fold(df: DataFrame, key: str, order: list[str], columns: list[str], name: str, f) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**{name: f(pdf)})[[key, *order, name]]

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [key, *order]) + f", {name} int")


def _frames(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pack"), F.col("l_orderkey").alias("frame"))
    return f.agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"))


#: Groups of a pack's frames in order: cut says whether a frame opens a new one, more what it adds to the open one.
_STEPS = """WITH RECURSIVE f AS (SELECT l_suppkey AS pack, l_orderkey AS frame, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY l_suppkey, l_orderkey),
     o AS (SELECT *, frame // 4 AS page, row_number() OVER (PARTITION BY pack ORDER BY frame) AS k FROM f),
     w AS (SELECT pack, frame, k, page, bytes AS held, 1 AS n, 0 AS g FROM o WHERE k = 1
           UNION ALL SELECT pack, frame, k, page, CASE WHEN cut THEN bytes ELSE held + more END, CASE WHEN cut THEN 1 ELSE n + 1 END, g + cut::INTEGER
           FROM (SELECT *, {cut} AS cut FROM (SELECT o.pack, o.frame, o.k, o.page, o.bytes, w.held, w.n, w.g, {more} AS more FROM w JOIN o ON o.pack = w.pack AND o.k = w.k + 1) s) t)
     SELECT pack, frame, g AS {name} FROM w"""


@_r.query("m30_pack_rollover", _STEPS.format(cut="held >= 1000", more="o.bytes", name="file"))
def _rollover(spark, sf_dir):
    return _fold(_frames(spark, sf_dir), "pack", ["frame"], ["bytes"], "file", lambda p: folds.rollover(p["bytes"].tolist(), 1000))


@_r.query("m31_bounded_batches", _STEPS.format(cut="held > 0 AND held + more > 1000", more="o.bytes", name="batch"))
def _batches(spark, sf_dir):
    return _fold(_frames(spark, sf_dir), "pack", ["frame"], ["bytes"], "batch", lambda p: folds.bounded_batches(p["bytes"].tolist(), 1000))


@_r.query("m32_prefetch_split", _STEPS.format(cut="n >= 256 OR held + more > 2000", more="CASE WHEN o.page = w.page THEN 0 ELSE o.bytes END", name="batch"))
def _prefetch(spark, sf_dir):
    return _fold(_frames(spark, sf_dir), "pack", ["frame"], ["bytes"], "batch", lambda p: folds.prefetch_batches(zip((p["frame"] // 4).tolist(), p["bytes"].tolist()), 256, 2000))


@_r.query(
    "m29_frame_chunks",
    """SELECT pack, chunk, count(*) AS pages, min(page) AS first_page, max(page) AS last_page FROM
       (SELECT l_suppkey AS pack, l_orderkey AS page, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1) // 16 AS chunk FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_discount > 0) q) t GROUP BY pack, chunk""",
)
def _chunks(spark, sf_dir):
    """Sixteen pages of a pack to a frame, in page order."""
    pages = table(spark, sf_dir, "lineitem").where("l_discount > 0").select(F.col("l_suppkey").alias("pack"), F.col("l_orderkey").alias("page")).distinct()
    placed = positions(pages, ["page"], ["pack"]).groupBy("pack", F.expr("pos div 16").alias("chunk"))
    return placed.agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


# ---- reports ----

_r.sql("m34_cache_size", "SELECT s_suppkey, least(CAST(round(s_acctbal * 100) AS BIGINT) {div} 5, 250000 {div} 2) AS cache_bytes FROM supplier")
#: The sum of 48-bit digests outgrows a BIGINT from about 65,000 rows of a group on, where the statement has no value in
#: DuckDB: it is taken as a decimal, then modulo 2 ** 64 as a signed number, which is the sum itself wherever that fits.
_r.sql(
    "m35_typed_fingerprint",
    """SELECT o_orderstatus, count(*) AS n, CAST(sum(length(r)) AS BIGINT) AS bytes, CAST({spark:pmod(sum(CAST(conv(substr(md5(r), 1, 12), 16, 10) AS DECIMAL(15, 0))) + 9223372036854775808, 18446744073709551616) - 9223372036854775808}{duck:sum(('0x' || substr(md5(r), 1, 12))::BIGINT)} AS BIGINT) AS fingerprint
       FROM (SELECT o_orderstatus, concat('3|i', length(CAST(o_orderkey AS {spark:STRING}{duck:VARCHAR})), ':', o_orderkey, '|i', length(CAST(o_custkey AS {spark:STRING}{duck:VARCHAR})), ':', o_custkey, '|t', length(o_orderpriority), ':', o_orderpriority) AS r FROM orders) t GROUP BY o_orderstatus""",
)


@_r.query(
    "m37_coverage",
    """SELECT table_name AS name, count(*) AS columns, count(CASE WHEN k THEN 1 END) AS access_paths, 2 * count(CASE WHEN k THEN 1 END) AS cases,
              CASE WHEN count(CASE WHEN k THEN 1 END) = 0 THEN 'no integer key' ELSE 'tested' END AS reason
       FROM (SELECT table_name, data_type IN ('BIGINT', 'INTEGER') AND (ends_with(column_name, 'key') OR ends_with(column_name, '_id')) AS k FROM information_schema.columns
             WHERE table_schema = 'main' AND table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')) t GROUP BY table_name""",
)
def _coverage(spark, sf_dir):
    """From the catalog: of each table its integer keys, each tried by a point and a range, or why it is skipped."""
    fields = [(n, f.name, f.dataType.simpleString()) for n in NAMES for f in table(spark, sf_dir, n).schema]
    key = F.col("type").isin("bigint", "int") & (F.col("column").endswith("key") | F.col("column").endswith("_id"))
    paths = F.count(F.when(key, 1))
    c = spark.createDataFrame(fields, "name string, column string, type string").groupBy("name").agg(F.count(F.lit(1)).alias("columns"), paths.alias("access_paths"))
    return c.select("name", "columns", "access_paths", (F.col("access_paths") * 2).alias("cases"), F.when(F.col("access_paths") == 0, "no integer key").otherwise("tested").alias("reason"))


@_r.query("m36_differential_check", "SELECT o_orderstatus, true AS same FROM orders GROUP BY o_orderstatus")
def _differential(spark, sf_dir):
    """The fingerprints of one statement run by two plans (SQL text; functions over 64 shares of the keys, then their sums) agree."""
    a = QUERIES["m35_typed_fingerprint"](spark, sf_dir)
    typed = [F.concat(F.lit(f"{t}"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for t, c in (("3|i", "o_orderkey"), ("|i", "o_custkey"), ("|t", "o_orderpriority"))]
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 64).alias("share"), F.concat(*typed).alias("r"))
    value = F.conv(F.substring(F.md5("r"), 1, 12), 16, 10).cast("decimal(15,0)")
    shares = rows.groupBy("o_orderstatus", "share").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("r")).alias("bytes"), F.sum(value).alias("fingerprint"))
    sums = shares.groupBy("o_orderstatus").agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "fingerprint")])
    low = F.pmod("fingerprint", F.expr("18446744073709551616"))
    signed = F.when(low >= F.expr("9223372036854775808"), low - F.expr("18446744073709551616")).otherwise(low)
    return agreement(a, sums.withColumn("fingerprint", signed.cast("long")))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """o_orderstatus, same: whether count, bytes and fingerprint of two plans are equal; a group that one lacks is not."""
    facts = ["n", "bytes", "fingerprint"]
    x, y = (d.select(F.col("o_orderstatus").alias(f"k{i}"), F.struct(*facts).alias(f"f{i}")) for i, d in enumerate((a, b)))
    both = x.join(y, F.col("k0").eqNullSafe(F.col("k1")), "full")
    return both.select(F.coalesce("k0", "k1").alias("o_orderstatus"), F.col("f0").eqNullSafe(F.col("f1")).alias("same"))


_r.sql(
    "m39_churn_patterns",
    """SELECT e AS epoch, i AS row_no, i AS repeated, e * 16 + i AS append, (i * 17 + e * 3) % 256 AS shifting, i * 8 + e % 8 AS grouped, CAST((i * 2654435761 + e * 40503) % 4096 AS BIGINT) AS scattered
       FROM {spark:(SELECT id AS e FROM range(8)) a, (SELECT id AS i FROM range(16)) b}{duck:(SELECT range AS e FROM range(8)) a, (SELECT range AS i FROM range(16)) b}""",
)
_r.sql(
    "m40_object_changes",
    """SELECT 'new' AS side, count(*) AS objects, CAST(sum(p_size) AS BIGINT) AS bytes FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 = 0
       UNION ALL SELECT 'removed', count(*), CAST(sum(p_size) AS BIGINT) FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0""",
)
_r.sql(
    "m41_work_ladder",
    """SELECT event_id, CASE WHEN value > 95 THEN 'busy' WHEN event_type = 'view' AND value > 80 THEN 'source_chunk' WHEN event_id % 7 = 0 THEN 'seal' WHEN event_id % 11 = 0 THEN 'dictionary' WHEN user_id % 5 = 0 THEN 'repack' ELSE 'idle' END AS work,
              event_id % 8 = 0 OR user_id % 5 = 0 AS armed FROM events""",
)

# ---- top-k screening ----

_r.sql("m06_top_four", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_retailprice / p_size, p_partkey LIMIT 4")
_r.sql("m07_argmin", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice * p_size, p_partkey LIMIT 1")

# ---- the replay summary suite, over events in the shape of its read log ----

_READS = "(SELECT event_type AS profile, CASE WHEN event_id % 3 = 0 THEN 'gc' WHEN event_id % 3 = 1 THEN 'rollup' ELSE 'replay' END AS phase, user_id % 10 AS workload, CAST(round(value * 100) AS BIGINT) AS ns, event_id % 64 AS fetched, user_id % 32 AS requested, event_id {div} 1000 AS seal, event_id FROM events) reads"
def _reads(spark, sf_dir) -> DataFrame:
    """events as a read log: profile, phase, workload, ns, fetched, requested."""
    phase = F.element_at(F.array(F.lit("gc"), F.lit("rollup"), F.lit("replay")), (F.col("event_id") % 3 + 1).cast("int"))
    ns = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("profile"), phase.alias("phase"), (F.col("user_id") % 10).alias("workload"), ns.alias("ns"), (F.col("event_id") % 64).alias("fetched"), (F.col("user_id") % 32).alias("requested")
    )


@_r.query(
    "m38_reads_by_phase",
    f"""WITH t AS (SELECT profile, phase, count(*) AS queries, sum(ns)::DOUBLE AS ns, sum(fetched)::DOUBLE AS got, sum(requested)::DOUBLE AS asked FROM {_READS} GROUP BY ALL)
        SELECT profile, phase, queries, round(ns / 1000, 3) AS query_seconds, round(got / greatest(asked, 1), 3) AS fetch_per_request FROM t""",
)
def _reads_by_phase(spark, sf_dir):
    """Totals of a phase: queries, their time, and pages fetched for each one asked for."""
    total = lambda c: F.sum(c).cast("double")
    sums = _reads(spark, sf_dir).groupBy("profile", "phase").agg(F.count(F.lit(1)).alias("queries"), total("ns").alias("ns"), total("fetched").alias("got"), total("requested").alias("asked"))
    return sums.select("profile", "phase", "queries", F.round(F.col("ns") / 1000, 3).alias("query_seconds"), F.round(F.col("got") / F.greatest("asked", F.lit(1.0)), 3).alias("fetch_per_request"))


@_r.query(
    "m38_latency",
    f"""WITH v AS (SELECT profile, phase, workload, list_sort(list(ns)) AS xs FROM {_READS} GROUP BY ALL)
        SELECT profile, phase, workload, len(xs) AS samples, round((xs[(len(xs) + 1) // 2] + xs[(len(xs) + 2) // 2]) / 2 / 1000, 3) AS median_us, round(xs[(95 * len(xs) + 99) // 100] / 1000, 3) AS p95_us FROM v""",
)
def _latency(spark, sf_dir):
    """Median and 95th percentile of each workload by position, from counts per distinct time: no group is sorted whole."""
    at = by_position(_reads(spark, sf_dir), ["profile", "phase", "workload"], "ns", {"low": "(n + 1) div 2", "high": "(n + 2) div 2", "p95": "(95 * n + 99) div 100"})
    us = lambda x: F.round(x / 1000, 3)
    return at.select("profile", "phase", "workload", F.col("n").alias("samples"), us((F.col("low") + F.col("high")) / 2).alias("median_us"), us(F.col("p95")).alias("p95_us"))


_r.sql("m38_connections", f"SELECT profile, phase, count(*) AS fresh_connections, CAST(sum(requested) AS BIGINT) AS cases_sum, round(CAST(sum(ns) AS DOUBLE) / count(*) / 1000, 3) AS mean_open_us FROM {_READS} WHERE workload = 0 GROUP BY profile, phase")
_r.sql("m38_batches", f"SELECT profile, count(*) AS batches, CAST(sum(ns) AS BIGINT) AS open_ns, CAST(sum(fetched) AS BIGINT) AS page_writes, CAST(sum(requested) AS BIGINT) AS spills FROM {_READS} GROUP BY profile")
_r.sql("m38_operations", f"SELECT profile, phase, round(CAST(sum(ns) AS DOUBLE) / 1000, 3) AS operation_us, round(CAST(sum(fetched) AS DOUBLE) / 1024, 3) AS new_kib, round(CAST(sum(requested) AS DOUBLE) / 1024, 3) AS removed_kib FROM {_READS} GROUP BY profile, phase")
_r.sql(
    "m38_last_seal",
    f"WITH s AS (SELECT profile, phase, seal, event_id, round(ns / 1024.0E0, 3) AS complete_kib FROM {_READS}) SELECT profile, phase, seal, event_id, complete_kib FROM s WHERE seal = (SELECT max(seal) FROM s x WHERE x.profile = s.profile)",
)
_r.sql(
    "m38_frame_sizes",
    f"""SELECT profile, CASE WHEN ns <= 2500 THEN 'S' WHEN ns <= 5000 THEN 'M' WHEN ns <= 7500 THEN 'L' ELSE 'XL' END AS frame_size, CAST(sum(fetched) AS BIGINT) AS frames, round(CAST(sum(ns) AS DOUBLE) / 1024, 3) AS payload_kib
        FROM {_READS} GROUP BY profile, CASE WHEN ns <= 2500 THEN 'S' WHEN ns <= 5000 THEN 'M' WHEN ns <= 7500 THEN 'L' ELSE 'XL' END""",
)
_r.sql("m38_gc_layout", f"SELECT profile, phase, count(DISTINCT workload) AS packs, CAST(sum(CASE WHEN fetched = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dead_frames, row_number() OVER (PARTITION BY profile ORDER BY CASE phase WHEN 'rollup' THEN 1 WHEN 'gc' THEN 2 ELSE 3 END) AS place FROM {_READS} GROUP BY profile, phase")
_r.sql("m38_gc_objects", f"SELECT profile, phase, round(CAST(sum(CASE WHEN requested < 8 THEN ns ELSE 0 END) AS DOUBLE) / 1024, 3) AS current_kib, round(CAST(sum(CASE WHEN requested >= 24 THEN ns ELSE 0 END) AS DOUBLE) / 1024, 3) AS collectible_kib, count(*) AS objects FROM {_READS} WHERE phase IN ('gc', 'rollup') GROUP BY profile, phase")
_r.sql("m38_coverage", f"SELECT workload, count(DISTINCT profile) AS kinds, count(*) AS cases FROM {_READS} GROUP BY workload")
