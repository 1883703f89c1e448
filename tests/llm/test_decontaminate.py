"""Decontamination over many blocks of items, places of hits, odd rows: against plain dynamic programming over words."""

import random
import re

import pytest

from tidemark.llm import common, decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(autouse=True)
def _prepared(spark):
    common.prepare(spark)


def search(pattern, text):
    """(edits, first, end) of the best stretch: fewest edits, then the earliest end, then the shortest."""
    best = None
    for end in range(len(text) + 1):
        row = list(range(len(pattern) + 1))
        for n, word in enumerate([None, *text[:end][::-1]]):
            if n:
                new = [n]
                for j, p in enumerate(pattern[::-1], 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != word)))
                row = new
            if end and (best is None or row[-1] < best[0]) and n:
                best = (row[-1], end - n, end)
    return best


def test_items_in_blocks_and_odd_rows(spark, monkeypatch):
    r = random.Random(12)
    vocab = ["w%d" % i for i in range(60)]
    items = [[r.choice(vocab) for _ in range(r.choice([4, 9, 15, 24]))] for _ in range(7)]
    texts = []
    for k in range(40):
        body = [r.choice(vocab) for _ in range(r.choice([5, 30, 60]))]
        if k % 2:
            x = list(r.choice(items))
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[], ["zz"], [x[at], "zz"]])
            at = r.randint(0, len(body))
            body[at:at] = x
        texts.append(" ".join(body).title())
    rows = [(i % 9 if i % 4 else None, t, i, "x") for i, t in enumerate([*texts, texts[1], texts[1], None, "", "word " * 50_000 + " ".join(items[0])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int, _tm_hits string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, "a b"), (9, None)], "item_id long, text string")
    one = decontaminate.matches(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    many = decontaminate.matches(docs, bench).collect()
    key = lambda x: x.edits
    assert sorted(one, key=key) == sorted(many, key=key) and len(many) == len(rows)
    got = {x.edits: {h.item_id: (h.edits, h.first_word) for h in x._tm_hits} for x in many}
    hits = 0
    for _, t, i, _ in rows[:-1]:
        w = WORDS.findall((t or "").translate(LOW))
        for k, x in enumerate(items):
            best = search(x, w)
            if best is None or best[0] > decontaminate.budget(len(x)):
                assert k not in got[i]
            else:
                hits += 1
                assert got[i][k] == best[:2], (w, x)
    assert hits > 15 and got[len(rows) - 1][0] == (0, 50_000)
    assert decontaminate.report(docs, bench).count() == len(rows)
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and all(x._tm_hits == "x" for x in kept.collect()) and sorted(x.edits for x in kept.collect()) == sorted(i for i, h in got.items() if not h)
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)
