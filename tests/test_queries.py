"""Every registered query of the engine against its statement in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tidemark.plans.registry import all_oracles, all_queries
from tidemark.sources.tables import NAMES

QUERIES, ORACLES = all_queries(), all_oracles()


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{small}/{n}.parquet'")
    yield con
    con.close()


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == set(HELD)


# ---- queries beyond SQL, each against plain Python over the same tables ----


def read(spark, small, name):
    return spark.read.parquet(f"{small}/{name}.parquet").collect()


def held_lru(spark, small, rows, cols):
    want = []
    for kind in {e.event_type for e in read(spark, small, "events")}:
        trace = [e.user_id for e in sorted(read(spark, small, "events"), key=lambda e: e.event_id) if e.event_type == kind]
        cache, hits = [], 0
        for p in trace:
            if p in cache:
                cache.remove(p)
                hits += 1
            cache.append(p)
            cache = cache[-64:]
        want.append({"event_type": kind, "hits": hits, "misses": len(trace) - hits, "evicted": len(trace) - hits - len(cache)})
    assert rows == sorted((tuple(w[c] for c in cols) for w in want), key=repr)


def held_probe(spark, small, rows, cols):
    import zstandard

    def worth(data):
        w = min(len(data) // 16, 1024)
        sample = b"".join(data[(len(data) - w) * i // 3 :][:w] for i in range(4))
        return len(data) < 4096 or len(zstandard.ZstdCompressor(level=3).compress(sample)) < len(sample)

    assert rows == sorted(((d.doc_id, worth((d.text or "").encode())) for d in read(spark, small, "documents")), key=repr) and cols == ["doc_id", "worth"]


def held_encoding(spark, small, rows, cols):
    import zstandard

    texts = {d.doc_id: (d.text or "").encode() for d in read(spark, small, "documents")}
    assert len(rows) == len(texts) and cols == ["bytes", "doc_id", "encoding", "stored"]
    for size, d, how, stored in rows:
        packed = len(zstandard.ZstdCompressor(level=3).compress(texts[d]))
        assert size == len(texts[d]) and stored <= size and (how, stored) in (("raw", size), ("plain", packed)) and (how == "raw" or packed < size)


def held_dictionary(spark, small, rows, cols):
    import zstandard

    from tidemark.operators.sampling import sampled_dictionary

    texts = {d.doc_id: (d.text or "").encode() for d in read(spark, small, "documents")}
    raw = zstandard.ZstdCompressionDict(sampled_dictionary(spark, small), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    assert len(rows) == len(texts) and any(r[2] == "dictionary" for r in rows)
    for size, d, how, stored in rows:
        packed = len(zstandard.ZstdCompressor(level=3, dict_data=raw).compress(texts[d])) + 32
        assert size == len(texts[d]) and (how, stored) in (("raw", size), ("dictionary", packed)) and stored <= size


def held_trained(spark, small, rows, cols):
    """The cheapest by cost and size, from texts that were not sampled."""
    assert cols == ["accepted", "cost", "id"] and len(rows) == 1 and rows[0][1] > 0 and rows[0][2] in (8192, 16384, 32768, 65536)


def held_snippets(spark, small, rows, cols):
    texts = {d.doc_id: " ".join((d.text or "").split()) for d in read(spark, small, "documents")}
    assert cols == ["after", "before", "doc", "hits", "text"]
    assert sorted(r[2] for r in rows) == sorted(d for d, t in texts.items() if "licen" in t.lower())
    for after, before, d, hits, text in rows:
        t, words = texts[d], [text[a:b].lower() for a, b in hits]
        assert text in t and len(text) <= 300 and after == (not t.endswith(text)) | (after and t.count(text) > 1) and before == (not t.startswith(text)) | (before and t.count(text) > 1)
        assert all(w.startswith(("license", "under")) for w in words) and (words or not any(w.startswith(("license", "under")) for w in t.lower().split()))


def held_html(spark, small, rows, cols):
    import html
    import re

    pages = {p.page_id: p.html for p in read(spark, small, "pages")}
    assert len(rows) == len(pages)
    for page, text in rows:
        raw = pages[page] or ""
        raw = raw.decode("utf-8", "replace") if isinstance(raw, (bytes, bytearray)) else raw
        bare = " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", raw)).split())
        assert set(re.findall(r"\w+", text)) <= set(re.findall(r"\w+", bare)) | set(re.findall(r"\w+", re.sub(r"(?s)<[^>]*>", "", html.unescape(raw)))) and "<script" not in text


HELD = {
    "m33_lru_simulation": held_lru,
    "m27_compressibility_probe": held_probe,
    "m28_encode_choice": held_encoding,
    "m28_dictionary_encode": held_dictionary,
    "m25_trained_dictionary": held_trained,
    "t10_snippets": held_snippets,
    "t11_html_to_text": held_html,
}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows(spark, small, duck, key):
    df = QUERIES[key](spark, small)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if key not in ORACLES:
        HELD[key](spark, small, rows, cols)
        return
    rel = duck.sql(ORACLES[key])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(x[i]) for i in at) for x in rel.fetchall()), key=repr)
