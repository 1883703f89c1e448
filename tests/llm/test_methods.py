"""The methods themselves: Viterbi against all paths, the forest's prefixes and its recall on the driver's documents,
packing against its lower bound, base columns against SQL, and odd rows that other files leave out."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, neardup, packing, quality, substring, transcripts
from tidemark.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def _prepared(spark):
    common.prepare(spark)


@pytest.mark.parametrize("key", ["llm_base_counts", "llm_base_phrases"])
def test_base_columns_are_those_of_sql(spark, small, key):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = QUERIES[key](spark, small)
    names = sorted(got.columns)
    want = con.sql(ORACLES[key])
    assert sorted(want.columns) == names
    rows = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[key]}) t").fetchall()
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(rows) or sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, rows))


def test_viterbi_against_all_paths():
    r = np.random.Generator(np.random.PCG64(4))
    n = 2 * len(transcripts.ROLES)
    for _ in range(20):
        emit = r.integers(-(1 << 26), 0, (5, n))

        def score(path):
            s = int(transcripts._START[path[0]] + emit[0, path[0]])
            return s + sum(int(transcripts._MOVE[a, b] + emit[t, b]) for t, (a, b) in enumerate(itertools.pairwise(path), 1))

        best = max(map(score, itertools.product(range(n), repeat=5)))
        path = transcripts.viterbi(emit)
        assert score(path) == best
        for cut in (1, 3):  # in two pieces, the state carried over
            before, _ = transcripts._forward(emit[:cut])
            tail = transcripts.viterbi(emit[cut:], before)
            assert tail == path[cut:]


def test_chat_columns_that_clash_and_long_lines(spark):
    d = spark.createDataFrame([("User: " + "hi " * 100_000 + "\nAssistant: ok", 1, "x", "y"), (None, 2, "x", "y")], "text string, n_turns int, roles string, keep string")
    out = transcripts.format_transcripts(d)
    assert sorted(out.columns) == ["keep", "n_turns", "rendered", "roles", "turns"]
    assert sorted((x.n_turns, x.roles) for x in out.collect()) == [(0, ""), (2, "user,assistant")]


def test_forest_prefixes():
    r = np.random.Generator(np.random.PCG64(1))
    sig = r.integers(0, 3, (50, neardup.HASHES)).astype(np.uint16)
    import pyarrow as pa

    (out,) = neardup._orders([pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array([x.tobytes() for x in sig], pa.binary())], ["rep", "sig"])])
    tree, k1, k2, doc = (out.column(i).to_numpy() for i in range(4))
    order = np.lexsort((doc, k2, k1, tree))
    tree, k1, k2, doc = (x[order] for x in (tree, k1, k2, doc))
    for back in (1, 2, 8):
        got = neardup._prefix(tree, k1, k2, back)
        for i, g in enumerate(got.tolist()):
            a, b = i, i + back
            want = 0
            if tree[a] == tree[b]:
                x, y = (sig[doc[k], neardup._ORDER[tree[a]]] for k in (a, b))
                want = int(np.argmin(np.append(x == y, False)))
            assert g == want
    pairs = {(x, y) for b in neardup._neighbours([pa.RecordBatch.from_arrays([pa.array(x) for x in (tree, k1, k2, doc)], ["tree", "k1", "k2", "doc"])]) for x, y, t in zip(*(b.column(c).to_pylist() for c in ("a", "b", "tree"))) if t is None}
    for i in range(1, len(doc)):
        if neardup._prefix(tree[i - 1 : i + 1], k1[i - 1 : i + 1], k2[i - 1 : i + 1], 1)[0] >= neardup.DEPTH:
            assert (doc[i - 1], doc[i]) in pairs


def exact_links(texts, size, percent=80):
    """All links between different sets, by rarest-first prefixes and full comparison."""
    sets = {}
    for d, t in texts:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    often = collections.Counter(g for s in sets.values() for g in s)
    by, links = collections.defaultdict(list), []
    for d, s in sets.items():
        if not s:
            continue
        rare = sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-percent * len(s) // 100) + 1]
        for e in {e for g in rare for e in by[g]}:
            if 100 * min(len(s), len(sets[e])) >= percent * max(len(s), len(sets[e])):
                both = len(s & sets[e])
                union = len(s) + len(sets[e]) - both
                if 100 * both >= percent * union:
                    links.append((e, d, both / union))
        for g in rare:
            by[g].append(d)
    return links


@pytest.mark.parametrize("size", [2, 5])
def test_recall_on_the_drivers_documents(spark, small, size):
    """Every exact link of 10,000 documents joins, in each band of similarity, and nothing else does."""
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.1") + "/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    links = exact_links(texts, size)
    got = {r.doc_id: r.component_id for r in neardup.report(docs, shingle=size).collect()}
    bands = collections.Counter((min(3, int(s * 20) - 16), got[a] == got[b]) for a, b, s in links)
    assert len(links) > 1000 and not [b for b in bands if not b[1]] and len({b for b, _ in bands}) >= 3
    label = {d: d for d, _ in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b, _ in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    assert got == {d: root(d) for d in label}


def test_crowded_regions(spark):
    """Large groups of near copies and a chain of texts, each like the next only: the classes of all exact links."""
    r = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        for _ in range(150):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(w))
    w = [f"c{i}" for i in range(60)]
    for i in range(40):
        w = w[2:] + [f"d{i}", f"e{i}"]
        rows.append(" ".join(w))
    texts = list(enumerate(rows))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    label = {d: d for d, _ in texts}
    for a, b, _ in exact_links(texts, 5):
        x, y = label[a], label[b]
        for k, v in label.items():
            if v in (x, y):
                label[k] = min(x, y)
    for kw in ({}, {"block_shingles": 3000, "block_rows": 20}):
        assert {x.doc_id: x.component_id for x in neardup.classes(docs, **kw).collect()} == label


def test_packing_weights_and_odd_rows(spark):
    r = np.random.Generator(np.random.PCG64(3))
    n = np.clip(r.lognormal(5.5, 1.2, 6000).astype(np.int64) + 1, 1, 2048)
    seq, off = packing.pack(n, packing.Capacity())
    used, docs = np.bincount(seq, n), np.bincount(seq)
    assert used.max() <= 2048 and docs.max() <= 64 and seq.max() + 1 <= -(-n.sum() // 2048) * 1.01 + 1
    tight = packing.pack(np.ones(1000, np.int64), packing.Capacity())[0]
    assert np.bincount(tight).max() == 64  # the document limit binds where pieces are short
    rows = [(None, 0, 5, "s", 1), (None, 0, 5, "s", 1), (3, 0, 2048, "s", 1), (3, 0, 1, "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string, offset int")
    got = packing.pack_pieces(common.materialise(d)).collect()
    assert sorted(x.length for x in got) == [1, 5, 5, 2048] and len({x.sequence_id for x in got}) == 2 and got[0].asDict().keys() >= {"sequence_id", "offset"}


def test_quality_repeated_null_and_long_rows(spark):
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [(None, long, 1), (None, long, 1), (4, None, 2), (4, None, 2), (4, "", 3)]
    got = quality.report(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert sorted((x.doc_id or -1, x.n_words, x.n_repeat_words, x.base_failed) for x in got) == [(-1, 60_000, 60_000, True)] * 2 + [(4, 0, 0, True)] * 3


def test_hot_keys_meet_their_facts(spark):
    rows = spark.createDataFrame([(i % 5000 if i % 3 else 7, i) for i in range(9000)], "k long, v long")
    facts = common.materialise(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low")))
    got = common.join_hot(rows, facts, ["k"], 9000)
    assert got.columns == ["k", "v", "low"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts.drop("n"), "k").collect()))


def test_tables_go_when_they_have_served(spark):
    import os

    a = common.materialise(spark.range(5))
    path = a._tm_path.removeprefix("file://")
    common.hold(spark, a)
    common.release(a.where("id > 1"))  # it is still read
    assert os.path.exists(path) and a.count() == 5
    common.release(spark.range(3))
    assert not os.path.exists(path)


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    text = lambda n=80: " ".join(r.choice("abcdefgh") + str(r.randrange(4000)) for _ in range(n))
    a, b, c = text(), text(), text()
    rows = [(None, a), (None, b), (3, c), (3, text()), (3, c), (5, None), (None, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "never found here at all")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = {"near dedup": 7, "substring dedup": 8, "decontamination": 8}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(docs)
        out = common.materialise(stage(spark, docs, f"file://{tmp_path}"))
        if name in kept:
            assert out.count() == kept[name], name
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0, name
    assert substring.report(docs).count() == 8
