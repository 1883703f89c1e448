"""Findings on larger or odd tables: figures that must not outgrow their types, tasks or batches."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from tidemark.functions import blocks, textual
from tidemark.operators import maintenance, sampling, search
from tidemark.plans.registry import all_queries

QUERIES = all_queries()


def orders(spark, path, n):
    rows = spark.range(1, n + 1).selectExpr("id AS o_orderkey", "id % 1000 AS o_custkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus")
    rows.write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_fingerprint_beyond_a_long(spark, tmp_path):
    """m35: sums of more than 2 ** 63 are taken modulo 2 ** 64."""
    n, total = 90_000, 0
    for k in range(1, n + 1):
        r = f"3|i{len(str(k))}:{k}|i{len(str(k % 1000))}:{k % 1000}|t8:1-URGENT"
        total += int(hashlib.md5(r.encode()).hexdigest()[:12], 16)
    assert total >= 1 << 63
    df = QUERIES["m35_typed_fingerprint"](spark, orders(spark, tmp_path, n))
    row = df.first()
    assert dict(df.dtypes)["fingerprint"] == "bigint"
    assert row.n == n and row.fingerprint == (total + (1 << 63)) % (1 << 64) - (1 << 63)


def test_differential_beyond_a_long(spark, tmp_path):
    """m36: both plans carry sums of more than 2 ** 63, and agree."""
    path = orders(spark, tmp_path, 90_000)
    assert [tuple(r) for r in QUERIES["m36_differential_check"](spark, path).select("o_orderstatus", "same").collect()] == [("F", True)]


def odd_documents(spark, path):
    """Texts with keys that stand twice or not at all, characters beyond 16 bits, and a file of a text a row."""
    r = random.Random(5)
    rows = [(i, "".join(r.choice("aAb éÉ\U0001f600中") for _ in range(r.randint(0, 60)))) for i in range(600)]
    rows += [(3, "abab"), (3, "AB a"), (7, None), (None, "abab"), (None, "zzzz"), (1000, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{path}/documents.parquet")
    return rows, str(path)


def test_trigrams_of_odd_documents(spark, tmp_path):
    rows, path = odd_documents(spark, tmp_path)
    want = defaultdict(set)
    for d, t in rows:
        t = (t or "").lower()
        for i in range(len(t) - 2):
            want[t[i : i + 3]].add(d)
    df = QUERIES["t12_trigrams"](spark, path)
    assert {r.gram: r.docs for r in df.collect()} == {g: len(d - {None}) for g, d in want.items()}


def test_trigrams_are_counted_before_they_are_shuffled(spark, tmp_path):
    """t12: what is shuffled follows the different trigrams of a block, not trigrams times documents."""
    spark.range(2000).selectExpr("id AS doc_id", "repeat('the same words again and again ', 40) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["t12_trigrams"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Expand" not in plan


def test_blocks_are_bounded_and_whole():
    texts = ["ab" * r for r in range(60)] + [None, "", "x" * 500] + ["c"] * 90
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 25])], ["t"]) for i in range(0, len(texts), 25)]
    got = [b.column(0).to_pylist() for b in blocks.gathered(batches, blocks.text_sizes(0), 200)]
    assert sum(got, []) == texts and all(len(g) == 1 or sum(len(t or "") for t in g) <= 200 for g in got)


def test_trigrams_of_a_wide_alphabet():
    """More different characters than three of them and a text's number fit in 63 bits: texts are halved."""
    every = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i::16]) for i in range(16)]
    seen = {(g, t) for runs, offs, of in blocks.grams(pa.array(texts)) for k, g in enumerate(runs) for t in of[offs[k] : offs[k + 1]].tolist()}
    assert seen == {(t[i : i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}


def test_stored_trigrams_are_lists_by_block(spark, tmp_path):
    """t12: a stored row is a trigram of a block with all its texts, and a search over them is a scan's result."""
    rows, path = odd_documents(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stored = search.trigrams(docs, "doc_id", "text")
    assert dict(stored.dtypes) == {"gram": "string", "docs": "array<bigint>"}
    pairs = sorted((r.gram, d is None, d or 0) for r in stored.collect() for d in r.docs)
    assert pairs == sorted((g, d is None, d or 0) for d, t in rows for g in {(t or "").lower()[i : i + 3] for i in range(len(t or "") - 2)})
    for needle in ("bé\U0001f600", "ABA", "a中 ", "ab"):
        want = {d for d, t in rows if needle.lower() in (t or "").lower()}
        near = {r.doc for r in search.substring_search(docs, "doc_id", "text", needle, stored).collect()}
        assert near == want


def test_islands_over_many_slices(spark):
    """m19: slices' number follows the rows, and a blob, a long range or a missing value may lie over any border."""
    r = random.Random(2)
    rows = [(b, s, s + r.choice([-5, 0, 3, 8, 400])) for b in (1, 1, 1, 2, 3, 4) for s in [r.randint(0, 9000) for _ in range(150)]]
    rows += [(1, 0, 2500), (5, 10, 10), (5, 10, 10)] + [(6, 3, 9)] * 40
    want = []
    for b in {x[0] for x in rows}:
        top = None
        for _, s, e in sorted({x for x in rows if x[0] == b}):
            if top is None or s > top:
                want.append([b, s, e, 0])
            want[-1][2:] = [max(want[-1][2], e), want[-1][3] + 1]
            top = e if top is None else max(top, e)
    d = spark.createDataFrame(rows, "blob long, start long, end long")
    for slice_rows in (7, 60, 10_000):
        assert sorted(map(list, maintenance.islands(d, slice_rows).collect())) == sorted(want)
    odd = [(None, 5, 9), (None, 7, 12), (7, None, 5), (7, 1, None)]
    got = maintenance.islands(d.unionByName(spark.createDataFrame(odd, d.schema)), 60).collect()
    assert sorted(list(x) for x in got if x.blob is not None and x.blob < 7) == sorted(want) and (None, 5, 12, 2) in map(tuple, got)


def test_islands_of_batches_of_any_size():
    r = random.Random(3)
    rows = sorted((b, s, s + r.choice([-2, 0, 5, 90])) for b in range(5) for s in [r.randint(0, 600) for _ in range(80)])
    whole = None
    for size in (1, 3, 64, 1000):
        cuts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], ["blob", "start", "end"]) for i in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in blocks.islands(cuts) for x in b.to_pylist()]
        whole = whole or got
        assert got == whole and sum(x[3] for x in got) == len(set(rows))


def test_vocabulary_of_odd_documents(spark, tmp_path):
    """t05, t13: keys that stand twice or not at all; words are counted in blocks before they are shuffled."""
    rows, path = odd_documents(spark, tmp_path)
    for name, how in (("t05_vocabulary", str), ("t13_folded_vocabulary", textual.fold)):
        docs, instances = defaultdict(set), Counter()
        for d, t in rows:
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                docs[how(w)].add(d)
                instances[how(w)] += 1
        df = QUERIES[name](spark, path)
        assert {r.term: (r.docs, r.instances) for r in df.collect()} == {w: (len(d - {None}), instances[w]) for w, d in docs.items()}
    spark.createDataFrame([(i, "Été one two two") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/plain/documents.parquet")
    df = QUERIES["t13_folded_vocabulary"](spark, f"{tmp_path}/plain")
    assert sorted(map(tuple, df.collect())) == [("ete", 20, 20), ("one", 20, 20), ("two", 20, 40)]
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_compressed_in_bounded_batches(spark, tmp_path):
    """m27, m28: no worker gets the 10,000 rows that a batch has by default, and empty, missing and long texts stay."""
    rows = [(0, None), (1, ""), (2, "ab" * 700_000), *[(i, f"text {i} " * (i % 90)) for i in range(3, 900)]]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("m28_encode_choice", "m27_compressibility_probe"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        df = QUERIES[name](spark, str(tmp_path))
        assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
        got = {r.doc_id: r for r in df.collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            data = (t or "").encode()
            want = (d, sampling.worth_compressing(data)) if name.startswith("m27") else (d, None if t is None else len(data), *sampling.encoding(data, None))
            assert tuple(got[d]) == want
