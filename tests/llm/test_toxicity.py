"""Toxicity: the forward pass by hand, what is learned from, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, toxicity


@pytest.fixture(autouse=True)
def _prepared(spark):
    common.prepare(spark)


M64 = 2**64 - 1


def mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M64
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M64
    return x ^ (x >> 33)


def bucket(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h + ord(c)) * 0x9E3779B97F4A7C15 & M64
    return mix((h + len(gram)) & M64) % toxicity.BUCKETS


def test_forward_pass_by_hand():
    r = np.random.Generator(np.random.PCG64(2))
    model = toxicity.Model(r.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.25, 1.5, -0.5)
    words = ["a", "é", "scum", "sc0m", "trashes", "ßü漢", "x" * 40]
    for w, got in zip(words, model.words(words)):
        marked = f"<{w}>"
        all_ = [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        assert got == pytest.approx(np.mean([model.gram_logit[bucket(g)] for g in all_]) + 0.25, abs=1e-4)
    text = "Scum scum, trashes! 12 a1 -- SC0M"
    logits = sorted(model.words(toxicity.bag(text)).tolist())
    assert sorted(toxicity.bag(text)) == ["a1", "sc0m", "scum", "trashes"]
    want = 1 / (1 + np.exp(-(1.5 * (0.7 * logits[-1] + 0.3 * logits[-2]) - 0.5)))
    assert model.probability(np.array([toxicity.doc_logit(logits)]))[0] == pytest.approx(want)


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(d % 400, f"text {d} " + "x" * (d % 7), "n", 1.0) for d in range(1200)], "doc_id long, text string, label string, score double")
    lab = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    texts, toxic = toxicity.sample(docs, lab, bound=50)
    ids = [int(t.split()[1]) % 400 for t in texts]
    assert toxic.count(0) == toxic.count(1) == 50 and len(set(ids)) == 100
    assert all(zlib.crc32(str(d).encode()) % 5 for d in ids) and [int(d % 3 == 0) for d in ids] == toxic
    short, kinds = toxicity.sample(docs, lab, bound=50, chars=200)
    assert set(short) <= set(texts) and max(sum(len(t) for t, k in zip(short, kinds) if k == x) for x in (0, 1)) <= 200


def test_held_out_accuracy_and_odd_rows(spark, small):
    """Labels of the driver's documents are noisy: some toxic ones hold no toxic word."""
    at = small.replace("sf0.001", "sf0.1")
    docs, lab = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.report(docs, lab).join(lab, "doc_id").where("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    bad, good = [x for x in rows if x.toxic], [x for x in rows if not x.toxic]
    assert sum(x.predicted for x in bad) >= 0.9 * len(bad) and sum(x.predicted for x in good) <= 0.05 * len(good)
    order = np.argsort([x.score for x in rows], kind="stable")
    place = np.empty(len(rows))
    place[order] = np.arange(len(rows))
    mine = place[[i for i, x in enumerate(rows) if x.toxic]]
    assert (mine.sum() - len(bad) * (len(bad) - 1) / 2) / (len(bad) * len(good)) > 0.93


def test_long_texts_and_repeats(spark):
    r = random.Random(1)
    clean = " ".join("".join(r.choice("aeinrst") for _ in range(6)) for _ in range(20_000))
    model = toxicity.Model(np.where(np.arange(toxicity.BUCKETS) == bucket("qqq"), 90.0, 0.0).astype(np.float32), -3.0, 1.0, 0.0)
    rows = [(1, clean), (2, clean + " qqq"), (2, clean + " qqq"), (2, None), (None, "QQQ"), (None, "QQQ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "held_out": F.lit(1)})
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and sum(x.predicted for x in got) == 4 and not any(x.held_out for x in got if x.doc_id is None)
