"""The pipeline's stages, each against brute force on what its predecessor kept."""

import importlib.util
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidemark.llm import common, quality  # noqa: E402

_spec = importlib.util.spec_from_file_location("brute", __file__.replace("test_pipeline", "test_text_operators"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)


def make(spark, path):
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(600)]
    item = [r.choice(vocab) for _ in range(30)]
    shared = [r.choice(vocab) for _ in range(70)]
    texts = []
    for i in range(40):
        w = [r.choice(vocab) for _ in range(r.choice([20, 90, 150]))]
        if i % 6 == 0:
            w[40:40] = item
        if i % 7 == 1:
            w[10:10] = shared
        if i % 8 == 3:
            w = [x + "###" for x in w]
        texts.append(" ".join(w))
    texts += [texts[2], texts[4] + " tail", None, ""]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return item


def test_stages(spark, tmp_path):
    item = make(spark, f"file://{tmp_path}")
    sf_dir = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    out = {}
    common.prepare(spark)
    good = {r.doc_id for r in quality.report(docs).where("kept").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialise(stage(spark, before, sf_dir))
        out[name] = after
        rows = {r.doc_id: r.text for r in before.collect()}
        if name != "packing":
            assert after.columns == columns
            left = {r.doc_id: r.text for r in after.collect()}
        if name == "quality rules":
            assert set(left) == good and all(len((rows[d] or "").split()) >= 50 for d in left)
        elif name == "near dedup":
            assert set(left) == {d for d, (_, c) in brute.brute_near(list(rows.items()), 5).items() if c == d}
        elif name == "substring dedup":
            want = brute.brute_substring(list(rows.items()))
            assert left == {d: (want[d][3] if want[d][1] else t) for d, t in rows.items()} and any(v[1] for v in want.values())
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.ASCII_LOW))
            hit = {d for d, t in rows.items() if min(brute.decontaminate.myers([hash(x) for x in item], [hash(x) for x in words(t)]), default=99) <= 4}
            assert set(left) == set(rows) - hit and hit
        else:
            from tokenizers import Tokenizer

            tok, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), after.toPandas()
            for d, t in rows.items():
                ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
                assert got[got.doc_id == d].sort_values("piece").ids_crc32.tolist() == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in range(0, len(ids), 2048)]
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == out["packing"].count()
