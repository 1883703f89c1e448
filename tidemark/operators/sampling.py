"""Deterministic, mergeable samples and dictionary scoring (M05, M21-M28)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import blocks
from tidemark.plans.dialect import Registry
from tidemark.sources.tables import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

#: Leading hex digits of a digest that the cutoff histogram looks at.
_PREFIX = 4
#: Sizes that a dictionary may have, in KiB.
DICTIONARY_KIB = (8, 16, 32, 64, 128, 256, 512, 768)


def reservoir(rows: DataFrame, budget: int) -> DataFrame:
    """The lowest digests whose running length stays within budget (rows: digest, len, one per digest).

    A histogram over digest prefixes finds where the budget is used up, so only rows up to that prefix are ordered: what
    reaches the one ordered window is the sample itself, not the table.
    """
    hist = rows.groupBy(F.substring("digest", 1, _PREFIX).alias("p")).agg(F.sum("len").alias("n"))
    before = hist.select("p", (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("b"))
    cut = before.where(F.col("b") <= budget).agg(F.max("p").alias("cut"))
    near = rows.join(F.broadcast(cut), F.substring("digest", 1, _PREFIX) <= F.col("cut"), "left_semi")
    return near.withColumn("running", F.sum("len").over(W.orderBy("digest"))).where(F.col("running") <= budget)


def _texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("len"))


def _distinct(d: DataFrame) -> DataFrame:
    return d.groupBy("digest").agg(F.min("len").alias("len"))


_D = "WITH d AS (SELECT md5(text) AS digest, min(length(text))::BIGINT AS len FROM documents WHERE text IS NOT NULL GROUP BY md5(text)), s AS (SELECT digest, len, (sum(len) OVER (ORDER BY digest))::BIGINT AS running FROM d)"


@_r.query("m05_running_budget", _D + " SELECT digest, len, running FROM s WHERE running <= 100000")
@_r.query("m21_reservoir_sample", _D + " SELECT digest, len, running FROM s WHERE running <= 100000")
def _sample(spark, sf_dir):
    return reservoir(_distinct(_texts(spark, sf_dir)), 100_000)


def union_sample(rows: DataFrame, budget: int) -> DataFrame:
    """Bounded sample of a union, with the origins of each digest."""
    one = rows.groupBy("digest").agg(F.min("len").alias("len"), F.array_sort(F.collect_set("origin")).alias("origins"))
    return reservoir(one, budget)


@_r.query(
    "m22_union_sample",
    "WITH d AS (SELECT md5(text) AS digest, min(length(text))::BIGINT AS len, string_agg(DISTINCT source, ',' ORDER BY source) AS origins FROM documents WHERE text IS NOT NULL GROUP BY md5(text)), s AS (SELECT *, (sum(len) OVER (ORDER BY digest))::BIGINT AS running FROM d) SELECT digest, len, origins, running FROM s WHERE running <= 100000",
)
def _union(spark, sf_dir):
    out = union_sample(_texts(spark, sf_dir).withColumnRenamed("source", "origin"), 100_000)
    return out.select("digest", "len", F.array_join("origins", ",").alias("origins"), "running")


@_r.query("m23_hold_out", _D + " SELECT digest, (row_number() OVER (ORDER BY digest) - 1) % 5 = 0 AS held_out FROM s WHERE running <= 100000")
def _hold(spark, sf_dir):
    return _sample(spark, sf_dir).select("digest", ((F.row_number().over(W.orderBy("digest")) - 1) % 5 == 0).alias("held_out"))


def dictionary_sizes(training: int, ceiling: int) -> list[int]:
    """The two largest sizes, 8 to 768 KiB, of at most a hundredth of the training bytes and of the ceiling."""
    return sorted(s for s in (k << 10 for k in DICTIONARY_KIB) if s <= min(training // 100, ceiling))[-2:]


@_r.query(
    "m24_dictionary_tiers",
    "WITH t AS (SELECT lang, sum(length(text))::BIGINT * 10 AS training FROM documents GROUP BY lang), c AS (SELECT lang, size, row_number() OVER (PARTITION BY lang ORDER BY size DESC) AS rn FROM t, (VALUES (8192), (16384), (32768), (65536), (131072), (262144), (524288), (786432)) AS s(size) WHERE size <= least(training // 100, 524288)) SELECT lang, size::BIGINT AS size FROM c WHERE rn <= 2",
)
def _tiers(spark, sf_dir):
    t = table(spark, sf_dir, "documents").groupBy("lang").agg((F.sum(F.length("text")) * 10).alias("training"))
    sizes = F.array(*[F.lit(k << 10).cast("long") for k in DICTIONARY_KIB])
    return t.select("lang", F.explode(F.slice(F.reverse(F.filter(sizes, lambda s: s <= F.least(F.expr("training div 100"), F.lit(524288)))), 1, 2)).alias("size"))


def compressed(data: bytes, dictionary: bytes | None = None) -> int:
    """Bytes after compression by zstandard at level 3, with the dictionary as raw content."""
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return len(zstandard.ZstdCompressor(level=3, dict_data=d).compress(data))


def probe_windows(length: int) -> list[tuple[int, int]]:
    """Four windows of min(length / 16, 1024) bytes, evenly spread."""
    w = min(length // 16, 1024)
    return [((length - w) * i // 3, w) for i in range(4)]


def worth_compressing(data: bytes) -> bool:
    """From 4 KiB on, a sample of windows decides; smaller payloads are always tried."""
    if len(data) < 4096:
        return True
    sample = b"".join(data[s : s + w] for s, w in probe_windows(len(data)))
    return compressed(sample) < len(sample)


def encoding(data: bytes, dictionary: bytes | None) -> tuple[str, int]:
    """raw unless compression (with 32 bytes for a dictionary's reference) is smaller."""
    if not worth_compressing(data):
        return "raw", len(data)
    n = compressed(data, dictionary) + (32 if dictionary else 0)
    return ("dictionary" if dictionary else "plain", n) if n < len(data) else ("raw", len(data))


#: Fixed value: bytes of text that a worker compresses at once.
_BLOCK = 1 << 20


def each_text(df: DataFrame, f, names: list[str], kinds: str, keep: int) -> DataFrame:
    """The first columns of df (keep of them) and what f makes of the bytes of its last one, a text: a tuple of names.
    Arrow batches and what is held of them are bounded, however many rows a partition has."""

    def run(batches):
        for b in blocks.gathered(batches, blocks.text_sizes(keep), _BLOCK):
            made = [f(x or b"") for x in b.column(keep).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *map(pa.array, zip(*made))], [*b.schema.names[:keep], *names])

    blocks.bounded(df.sparkSession)
    held = "".join(f"`{c}` {t}, " for c, t in df.dtypes[:keep])
    return df.mapInArrow(run, held + kinds)


def encode_choice(df: DataFrame, dictionary: bytes | None) -> DataFrame:
    rows = df.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), "text")
    return each_text(rows, lambda x: encoding(x, dictionary), ["encoding", "stored"], "encoding string, stored long", 2)


@_r.query("m27_compressibility_probe")
def _probe(spark, sf_dir):
    return each_text(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda x: (worth_compressing(x),), ["worth"], "worth boolean", 1)


@_r.query("m28_encode_choice")
def _encode(spark, sf_dir):
    return encode_choice(table(spark, sf_dir, "documents"), None)


#: Bytes of the deterministic sample that dictionaries are cut from.
SAMPLE_BYTES = 1 << 20


def sampled_dictionary(spark, sf_dir, size: int = 1 << 16) -> bytes:
    """Raw content for a dictionary: the texts of the reservoir sample in digest order, their last size bytes (what
    stands last is the cheapest to refer to). The sample is bounded, so it may come to the driver."""
    picked = reservoir(_distinct(_texts(spark, sf_dir)), SAMPLE_BYTES).select("digest")
    d = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    rows = d.join(F.broadcast(picked), "digest").groupBy("digest").agg(F.first("text").alias("text")).orderBy("digest").collect()
    return "".join(r.text for r in rows).encode()[-size:]


@_r.query("m28_dictionary_encode")
def _with_dictionary(spark, sf_dir):
    """Each text by a dictionary cut from the sample, or raw where that saves nothing."""
    return encode_choice(table(spark, sf_dir, "documents"), sampled_dictionary(spark, sf_dir))


@_r.query("m25_trained_dictionary")
def _trained(spark, sf_dir):
    """Four dictionaries of 8 to 64 KiB from one sample; what each makes of the texts that were not sampled is measured
    on the executors, and the cheapest is taken if it saves a twentieth of what no dictionary costs."""
    whole = sampled_dictionary(spark, sf_dir)
    sampled = reservoir(_distinct(_texts(spark, sf_dir)), SAMPLE_BYTES).select("digest")
    rest = table(spark, sf_dir, "documents").where("text is not null").withColumn("digest", F.md5(F.col("text").cast("binary"))).join(F.broadcast(sampled), "digest", "left_anti")
    names = {s: whole[-s:] for s in (1 << 13, 1 << 14, 1 << 15, 1 << 16)}

    columns = ["plain", "s13", "s14", "s15", "s16"]
    sizes = each_text(rest.select("text"), lambda x: (compressed(x), *[compressed(x, d) for d in names.values()]), columns, ", ".join(f"{c} long" for c in columns), 0)
    r = sizes.agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n")).first()
    rows = [(n, r[f"s{n.bit_length() - 1}"] or 0, 1, 1, len(d)) for n, d in names.items()]
    costs = spark.createDataFrame(rows, "id long, payload long, logical long, heldout long, added long")
    return select_dictionary(costs, r.plain or 0)


def select_dictionary(costs: DataFrame, previous: int) -> DataFrame:
    """Cheapest candidate by (cost, id), if it saves 5 % at least; costs: id, payload, added, logical, heldout."""
    cost = F.col("payload") * F.col("logical") + F.col("added") * F.col("heldout")
    best = costs.select("id", cost.alias("cost")).agg(F.min(F.struct("cost", "id")).alias("b"))
    return best.select("b.id", "b.cost", (F.col("b.cost") * 100 <= previous * 95).alias("accepted"))


_r.sql("m25_dictionary_selection_cost", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 1000 + CAST(p_partkey % 50 AS BIGINT) * 20 AS cost, (CAST(p_size AS BIGINT) * 1000 + CAST(p_partkey % 50 AS BIGINT) * 20) * 100 <= 20000 * 95 AS accepted FROM part ORDER BY 2, 1 LIMIT 1")


@_r.query("m25_dictionary_selection", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 1000 + CAST(p_partkey % 50 AS BIGINT) * 20 AS cost, (CAST(p_size AS BIGINT) * 1000 + CAST(p_partkey % 50 AS BIGINT) * 20) * 100 <= 20000 * 95 AS accepted FROM part ORDER BY 2, 1 LIMIT 1")
def _pick(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    costs = p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("payload"), (F.col("p_partkey") % 50).alias("added"), F.lit(1000).cast("long").alias("logical"), F.lit(20).cast("long").alias("heldout"))
    return select_dictionary(costs, 20_000)


def seed_scores(sizes: DataFrame, target_raw: int) -> DataFrame:
    """Related-seed estimate: payload * baseline / plain + dictionary bytes, baseline = plain * target / raw. Four
    finalists by (ratio, id) are kept; the smallest estimate that saves 5 % wins. sizes: id, raw, plain, payload, dict."""
    finalists = sizes.withColumn("ratio", F.col("payload") / F.col("plain")).orderBy("ratio", "id").limit(4)
    baseline = F.expr(f"plain * {target_raw} div raw")
    return finalists.select("id", F.expr(f"payload * (plain * {target_raw} div raw) div plain + dict").alias("estimate"), baseline.alias("baseline")).withColumn("accepted", F.col("estimate") * 100 <= F.col("baseline") * 95)


_SEED = "SELECT p_partkey AS id, 1000 + p_size::BIGINT * 20 AS raw, 500 + p_size::BIGINT * 7 AS plain, 200 + (p_partkey * 37) % 400 AS payload, (p_partkey % 64)::BIGINT AS dict FROM part"


@_r.query(
    "m26_seed_scoring",
    f"WITH s AS ({_SEED}), f AS (SELECT * FROM s ORDER BY payload / plain, id LIMIT 4) SELECT id, payload * (plain * 100000 // raw) // plain + dict AS estimate, plain * 100000 // raw AS baseline, (payload * (plain * 100000 // raw) // plain + dict) * 100 <= (plain * 100000 // raw) * 95 AS accepted FROM f",
)
def _seeds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = F.col("p_size").cast("long")
    sizes = p.select(F.col("p_partkey").alias("id"), (1000 + s * 20).alias("raw"), (500 + s * 7).alias("plain"), (200 + (F.col("p_partkey") * 37) % 400).alias("payload"), (F.col("p_partkey") % 64).alias("dict"))
    return seed_scores(sizes, 100_000)
