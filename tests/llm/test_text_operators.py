"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables
and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, licenses, neardup, packing, quality, substring, tokens, toxicity, transcripts

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: doc_id, text and columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, n_words long, label string, kept boolean, n_chars long"


@pytest.fixture(autouse=True)
def _prepared(spark):
    common.prepare(spark)


def corpus(seed=0):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgéü") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = [r.choice(vocab) for _ in range(80)]
    texts = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([3, 20, 60, 120, 300]))]
        if i % 5 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 10) : r.randint(60, 80)]
        if i % 9 == 4:
            w = w[:2] + ["loop", "it", "now"] * 15 + w[2:]
        texts.append("".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w))
    base = texts[7]
    for k in range(12):  # a group of near copies around one text
        w = base.split(" ")
        for _ in range(max(1, len(w) // 30)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], "", None, "   ", "x", "X", " ".join(vocab * 40), "A b", "a  B"]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "l", True, len(t or "")) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def brute_substring(rows, window=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substring(docs, rows, none):
    want = brute_substring(rows)
    got = substring.report(docs).collect()
    assert len(got) == len(rows) and sum(v[1] for v in want.values()) > 200
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3], r.doc_id
    assert substring.report(none).count() == 0
    cut = {r.doc_id: r for r in substring.cut_repeats(docs).collect()}
    for d, t in rows:
        assert cut[d].text == (want[d][3] if want[d][1] else t) and cut[d].n_words == 1
        assert cut[d].n_chars == (len(want[d][3]) if want[d][1] else len(t or ""))


def test_substring_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(70))
    rows = [(1, t), (1, t), (2, t + " end"), (None, t)]
    got = collections.Counter((r.doc_id, r.n_removed) for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 0): 2, (2, 70): 1, (None, 70): 1}


def test_cover_has_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def brute_near(rows, size, percent=80):
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(ASCII_LOW))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, none, size):
    want = brute_near(rows, size)
    got = {r.doc_id: r for r in neardup.report(docs, shingle=size).collect()}
    assert len(got) == len(rows)
    for d, (n, c) in want.items():
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n, c, c == d), d
    assert len({c for _, c in want.values()}) < len(rows) - (10 if size == 2 else 5)
    if size == 5:
        kept = sorted(r.doc_id for r in neardup.keep_first(docs).collect())
        assert kept == sorted(d for d, (_, c) in want.items() if c == d)
        assert neardup.report(none, shingle=2).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice("abcdefgh") + str(r.randrange(900)) for _ in range(60))
    near = lambda t: t + " tail"
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (None, near(a)), (None, b), (None, c), (None, near(c)), (None, b), (5, d), (5, e), (5, d), (6, near(e)), (None, None), (None, " "), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(x) for x in neardup.keep_first(docs).collect())
    one = next(t for t in (c, near(c)) if (None, t) in got)
    assert got == collections.Counter([(1, a), (None, b), (None, one), (5, d), (5, e), (None, None), (None, " "), (None, "")])
    out = neardup.report(docs).collect()
    assert len(out) == len(rows) and all(x.component_id == 5 and not x.kept for x in out if x.doc_id == 6)
    assert sorted((x.component_id or 0, x.kept) for x in out if x.doc_id is None and x.n_shingles) == [(0, False), (0, True), (0, True), (0, True), (1, False)]


def test_near_duplicates_of_a_large_region(docs, rows):
    """Regions of many blocks, joined by rounds of pivots, have the same classes as regions of one."""
    want = brute_near(rows, 2)
    got = {r.doc_id: r.component_id for r in neardup.classes(docs, shingle=2, block_shingles=300, block_rows=4).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    label = {n: n for e in edges for n in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    want = {n: root(n) for a, b in edges if a != b for n in (a, b)}
    got = {x.node: x.label for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_quality_base(docs, rows, none):
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, t = words(t), t or ""
        n = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.report(none).count() == 0
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(d for d in got if got[d].kept)


def test_quality_repeats_many_and_few(spark):
    """Both ways of finding repeated windows give the same counts."""
    r = random.Random(4)
    texts = [" ".join(r.choice("ab cd ef gh".split()) for _ in range(n)) for n in (3, 10, 80, 400)] + [" ".join(str(i % 90) for i in range(300))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r_ in quality.report(d).collect():
        w = texts[r_.doc_id].split()
        n = collections.Counter(zip(w, w[1:], w[2:]))
        assert r_.n_repeat_words == len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_quality_finds_junk(spark, small):
    """The posterior, learned without labels, agrees with them on documents that pass the base."""
    at = small.replace("sf0.001", "sf0.01")
    lab = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", F.col("quality").alias("mark"))
    got = quality.report(spark.read.parquet(f"{at}/documents.parquet")).join(lab, "doc_id").where("not base_failed").select("mark", "kept").collect()
    bad, good = [r.kept for r in got if r.mark == 0], [r.kept for r in got if r.mark == 1]
    assert sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.97 * len(good)


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in tokens.count(docs, path).collect()}
    for d, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), n, n > 512)
    assert tokens.count(none, path).count() == 0


#: White space of every kind, contractions, special strings, marks, and letters that change with case or composition.
PARTS = ["a", "B", "é", "1", "²", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "​", "　", "﻿", "'s", "'ll", "!", "<|endoftext|>", "<|startoftext|>", "漢", "ß", "İ", "Σ", "é", "́", "👍🏽", "\x00", "|", "_", "ſ"]


@pytest.mark.parametrize("file,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_chunks_encode_as_the_library(file, kind):
    from tokenizers import Tokenizer

    r = random.Random(9)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(8000)]
    table, tok = tokens.Chunks(P.path(file), kind), Tokenizer.from_file(P.path(file))
    ids, offs = table.encode(pa.array(texts), 7)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(texts))] == [w + [7] for w in want]
    assert table.counts(pa.array(texts)).tolist() == [len(w) for w in want]


def test_grammar_round_trip():
    r = np.random.Generator(np.random.PCG64(3))
    for n, v in ((0, 5), (1, 5), (50, 2), (5000, 9), (20000, 300)):
        seq = r.integers(0, v, n).astype(np.uint32)
        offs = np.unique(np.concatenate([[0, n], r.integers(0, n + 1, 9)])).astype(np.int64)
        sym, at, rules, lens = tokens.grammar(seq.copy(), offs, 1000)
        wide = rules.astype(np.int64)
        assert (tokens.expand(sym, wide, 1000) == seq).all() and len(at) == len(offs)
        for i in range(len(offs) - 1):  # random access: a document from its own symbols
            assert (tokens.expand(sym[at[i] : at[i + 1]], wide, 1000) == seq[offs[i] : offs[i + 1]]).all()
        for k, ln in enumerate(lens):
            assert len(tokens.expand(np.array([1000 + k]), wide, 1000)) == ln
        assert len(sym) < 0.7 * n or v != 9


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    to = common.shared_dir(spark)
    tokens.write_shards(docs, path, to, shard_ids=3000)
    got = {r.doc_id: r for r in tokens.read_shards(spark, to).collect()}
    start = 0
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    to = common.shared_dir(spark)
    tokens.write_shards(none, path, to)
    assert tokens.read_shards(spark, to).count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    cap = packing.Capacity(tokens=256)
    got = packing.pack_documents(docs, path, cap).toPandas()
    total = 0
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(i, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for i, s in enumerate(range(0, len(ids), 256))]
        mine = got[got.doc_id == d].sort_values("piece")
        assert list(zip(mine.piece, mine.start, mine.length, mine.ids_crc32)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 256 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= -(-total // 256) * 1.02 + 1
    assert packing.pack_documents(none, path, cap).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    r = np.random.Generator(np.random.PCG64(5))
    n = r.integers(1, 101, 800)
    cap = packing.Capacity(tokens=100, documents=4, cost=6000 if rule == "norm" else None, weights=(1.0, 0.3, 0.3), rule=rule)
    n = n[n**2 <= (cap.cost or 10**9)]
    seq, off = packing.pack(n, cap)
    for s in np.unique(seq):
        k = n[seq == s]
        assert k.sum() <= 100 and len(k) <= 4 and (k**2).sum() <= (cap.cost or 10**9)
        assert sorted(off[seq == s].tolist()) == [0, *np.cumsum(k[np.argsort(off[seq == s])])[:-1].tolist()]


def test_myers_against_a_table():
    r = random.Random(6)
    for _ in range(150):
        p, t = [r.randint(0, 3) for _ in range(r.randint(1, 9))], [r.randint(0, 3) for _ in range(r.randint(0, 15))]
        row = list(range(len(p) + 1))
        want = []
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            want.append(row[-1])
        assert decontaminate.myers(p, t) == want


def test_decontamination(spark, none):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate((40, 25, 12, 5, 40, 1))]
    items[5] = (5, "onlyword")
    text, want = [], {}
    for d in range(40):
        w = [r.choice(vocab) for _ in range(120)]
        if d % 2:
            i = r.randrange(5)
            x = items[i][1].split()
            for _ in range(r.choice([0, decontaminate.budget(len(x))])):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], ["new"], [x[k], "more"]])
            w[60:60] = [y.upper() + "," for y in x]
        text.append((d, " ".join(w)))
    text += [(40, None), (41, ""), (42, "... OnlyWord!")]

    def near(p, t, k):
        return min(decontaminate.myers(p, t), default=len(p)) <= k

    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(ASCII_LOW))
    for d, t in text:
        tw = low(t)
        want[d] = sorted(i for i, s in items if near([hash(x) for x in low(s)], [hash(x) for x in tw], decontaminate.budget(len(low(s)))))
    docs = spark.createDataFrame([(d, t, "x") for d, t in text], "doc_id long, text string, items string")
    bench = spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert sum(map(bool, want.values())) >= 20
    for d in want:
        assert (got[d].items, got[d].contaminated) == (",".join(map(str, want[d])), bool(want[d])), d
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [d for d in want if not want[d]]
    assert decontaminate.report(none, bench).count() == 0
    assert not decontaminate.report(docs, bench.limit(0)).where("contaminated").count()


def test_toxicity(spark, none):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeghinorst") for _ in range(r.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for d in range(900):
        w = [r.choice(vocab) for _ in range(r.randint(3, 80))]
        bad = d % 6 == 0
        if bad:
            for x in ("kwyjib", "zuplonk"):
                w[r.randrange(len(w))] = x + r.choice(["", "s", "ed", "ish", "!!"])
        rows.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    rows += [(900, None), (901, ""), (902, "zzuplonky")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.report(docs, spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")).collect()}
    for d, x in got.items():
        assert x.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
    held = [(x, t) for (d, t) in labels if (x := got[d]).held_out]
    assert sum(x.predicted == t for x, t in held) / len(held) > 0.97
    assert got[902].predicted == 1 and got[900].predicted == 0 and got[901].score == got[900].score
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.report(none, lab).count() == 0
    assert {x.score for x in toxicity.report(docs, lab.limit(0)).collect()} == {0.0}


def test_licenses(docs, rows, none, spark):
    extra = [
        (0, "x CC-BY 4.0 y"),
        (1, "GNU General Public License, version 3."),
        (2, "Licensed under the Apache Licence, Version 2.0"),
        (3, "All rigths reserved"),
        (4, "é all rights reserved é cc, by"),
        (5, None),
        (6, ""),
        (7, "Releasd under the MIT License."),
    ]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(extra, "doc_id long, text string")).collect()}
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(ASCII_LOW))
    for d, t in extra:
        w = low(t)
        at = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "gpl-3.0" in got[1].labels and "gpl-2.0" not in got[1].labels and got[2].labels == "apache-2.0" and got[3].labels == "reserved" and got[7].labels == "mit"
    assert got[5].score == got[6].score == 0 and 0 < got[3].score < 1 and got[0].score == 1
    spans = licenses.scan(spark.createDataFrame(extra[3:4], "doc_id long, text string")).first().hits
    assert [(h.label, h.start, h.end) for h in spans][0][0] == "reserved" and spans[0].edits <= 2
    assert licenses.report(docs).count() == len(rows) and licenses.report(none).count() == 0


def test_transcripts(spark, none):
    assert transcripts.parse("System: be kind\nUser: hi\nmore\nAssistant: hello\n\nUser: bye?") == [("system", "be kind"), ("user", "hi\nmore"), ("assistant", "hello"), ("user", "bye?")]
    assert transcripts.parse("Q: one?\n\nan answer without a marker\nQ: two?") == [("user", "one?"), ("assistant", "an answer without a marker"), ("user", "two?")]
    assert transcripts.parse(None) == transcripts.parse(" \n ") == []
    r = random.Random(1)
    rows, want = [], {}
    for c in range(30):
        n = r.randint(1, 9)
        for t in range(n):
            rows.append((c, t, ["user", "assistant"][t % 2], " ".join(r.choice(["red", "blue", "Green."]) for _ in range(r.randint(3, 60))), 0))
        want[c] = [x[2] for x in rows if x[0] == c]
    rows += [rows[0], (99, None, None, None, 0), (None, 0, "user", "hello there", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    got = transcripts.report(df).collect()
    right = sum(r.roles.split(",") == want.get(r.conv_id) for r in got)
    assert right >= 28 and len(got) == 32
    one = next(r for r in got if r.conv_id == 0)
    assert one.rendered.count("<|end|>") == one.n_turns
    assert transcripts.report(df.limit(0)).count() == 0


def test_transcripts_are_bounded(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(300)]
    got = transcripts.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.block for r in got) == [0, 1, 2, 3, 4]


def test_transcripts_carry_the_state_over_cuts(spark, monkeypatch):
    """Rows of long and crowded conversations, joined in order, are the turns of the unsplit transcript."""
    r = random.Random(4)
    rows = []
    for c in (0, 1, 2, 3, 4, None):
        for t in range(140):
            body = r.choice(["so it is", "why is that?", "yes", "a line\nand another\n", "\n", "word " * 30])
            rows.append((c, r.choice([t, t, None, 7]), r.choice(["user", "assistant", "System"]), body))
    rows = list(dict.fromkeys(rows))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    monkeypatch.setattr(transcripts, "TURNS", 10**6)
    whole = {x.conv_id: x for x in transcripts.report(d).collect()}
    monkeypatch.setattr(transcripts, "TURNS", 64)
    monkeypatch.setattr(transcripts, "ROWS", 9)
    got = collections.defaultdict(list)
    for x in transcripts.report(d).collect():
        got[x.conv_id].append(x)
    assert set(got) == set(whole) and min(len(v) for v in got.values()) > 5
    for c, v in got.items():
        v.sort(key=lambda x: (x.block, x.part))
        assert "".join(x.rendered for x in v) == whole[c].rendered and sum(x.n_turns for x in v) == whole[c].n_turns
        assert ",".join(x.roles for x in v if x.roles) == whole[c].roles


def test_very_long_text(spark):
    """One text of some megabytes beside short ones, through the scanners that work in blocks."""
    r = random.Random(2)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 10**6)) for _ in range(250_000))
    d = spark.createDataFrame([(0, long), (1, "tail " + long[-2000:]), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in substring.report(d).collect()}
    assert got[0].n_words == 250_000 and got[1].n_removed > 100
    assert {x.doc_id: x.component_id for x in neardup.report(d, shingle=2).collect()} == {0: 0, 1: 1, 2: 2}
    assert {x.doc_id: x.n_words for x in licenses.report(d).collect()}[0] == 250_000
