"""Token tables and token files against the tokenizers library: special strings, table turnover, odd ids, random access."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, tokens

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(autouse=True)
def _prepared(spark):
    common.prepare(spark)


def library(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_many_special_strings_and_separators_in_a_text():
    for name, kind in (("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")):
        tok, table = library(name), tokens.Chunks(P.path(name), kind)
        texts = ["<|endoftext|> a " * 1500, "7 " * 900, "7a 77 x7", "\n" * 700, "x" * 70_000 + " y", "<" * 50, "a\n 7 \nb", ""]
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        ids, offs = table.encode(pa.array(texts), 3)
        assert [ids[a : b - 1].tolist() for a, b in zip(offs, offs[1:])] == want
        assert table.counts(pa.array(texts)).tolist() == list(map(len, want))


def test_table_turnover_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_CHUNKS", 40)
    r = random.Random(3)
    texts = [" ".join(r.choice("aeiou") * r.randint(1, 9) + str(r.randint(0, 30)) for _ in range(30)) for _ in range(40)]
    tok, table = library("byte_bpe_50k.json"), tokens.Chunks(P.path("byte_bpe_50k.json"), "bytes")
    for t in texts:
        ids, _ = table.encode(pa.array([t]), 9)
        assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 9]
        assert table.table.n <= 40 + 70


def test_grammar_uses_up_its_room_or_its_pairs():
    r = np.random.Generator(np.random.PCG64(5))
    for vocab, n, room in ((40, 30_000, 400), (500, 20_000, 1 << 16), (90_000, 20_000, 1 << 24), (3, 1, 10)):
        passage = r.integers(0, vocab, 300)
        seq = np.concatenate([r.integers(0, vocab, n), *[passage] * 40])
        offs = np.concatenate([[0], n + 300 * np.arange(41)])
        sym, at, rules, lens = tokens.grammar(seq, offs, vocab, room)
        assert (tokens.expand(sym, rules.astype(np.int64), vocab) == seq).all()
        for a, b, x, y in zip(offs, offs[1:], at, at[1:]):
            assert (tokens.expand(sym[x:y], rules.astype(np.int64), vocab) == seq[a:b]).all()
        for k, (a, b) in enumerate(rules.tolist()[:50]):
            assert lens[k] == len(tokens.expand(np.array([vocab + k]), rules.astype(np.int64), vocab)) and a < vocab + k and b < vocab + k
        inside = np.ones(max(0, len(sym) - 1), bool)
        inside[at[1:-1] - 1] = False
        left = np.unique(np.stack([sym[:-1][inside], sym[1:][inside]]), axis=1, return_counts=True)[1] if inside.any() else np.zeros(1)
        assert len(rules) == room - vocab or left.max(initial=0) < 12  # overlapping runs of one id count double before they are cut
        if room > 400 and n > 1:
            assert lens.max() > 100  # the passage became deep rules
        for a, b in ((0, 5), (n - 3, n + 700), (len(seq) - 4, len(seq) + 9), (7, 7)):
            got = tokens.expand_range(sym, rules.astype(np.int64), lens, vocab, a, b)
            assert (got == seq[a:b]).all()


def test_files_with_odd_ids_and_long_documents(spark, tmp_path):
    tok = library("byte_bpe_50k.json")
    r = random.Random(1)
    words = ["".join(r.choice("abcde") for _ in range(5)) for _ in range(50)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 900, 40, 60)]
    rows = [(2, texts[0], "x"), (None, texts[1], "x"), (2, texts[0], "x"), (2, texts[2], "x"), (7, None, "x"), (5, "", "x"), (-3, texts[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    to = f"file://{tmp_path}/shards"
    tokens.write_shards(docs, P.path("byte_bpe_50k.json"), to, shard_ids=100)
    got = tokens.read_shards(spark, to).orderBy("start").collect()
    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for x, (d, t) in zip(got, order, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    whole = [*tok.encode(texts[3], add_special_tokens=False).ids, 2]
    assert [x.ids for x in tokens.read_documents(spark, to, [-3]).collect()] == [whole]
    assert [x.ids for x in tokens.read_documents(spark, to, [-3], 5, 11).collect()] == [whole[5:16]]
    assert sorted(x.doc_id for x in tokens.read_documents(spark, to, [2, 5, 99]).collect()) == [2, 2, 2, 5]
    assert tokens.read_documents(spark, to, []).count() == 0
