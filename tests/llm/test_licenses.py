"""License notices: true labels of near names, hits against a dynamic-programming search, repeated rows and overlaps."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex

from tidemark.llm import common, licenses

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(autouse=True)
def _prepared(spark):
    common.prepare(spark)


LINES = {
    "Licensed under the ISC License": "isc",
    "Released under the ISC license.": "isc",
    "Released under the BSD License": "bsd",
    "Licensed under the XYZ License": "",
    "Licensed under CC BY ND 4.0": "cc-by,cc-by-nd",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Licenced under the MIT Licence": "mit",
    "Released under teh MIT Lizense, see LICENSE": "mit",
    "GNU General Public License, version 2": "gpl,gpl-2.0",
    "GNU Genral Public Licence, version 3": "gpl-3.0",
    "GNU Lesser General Public License": "gpl,lgpl",
    "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa",
    "Apache License 1.1": "",
    "all rights": "",
    "": "",
}


def test_near_names_keep_their_labels(spark):
    docs = spark.createDataFrame([(i % 3, t, "x") for i, t in enumerate([*LINES, None, *LINES])], "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    assert len(got) == 2 * len(LINES) + 1
    assert sorted(x.labels for x in got) == sorted([*LINES.values(), "", *LINES.values()])


def sellers(pattern: str, text: str) -> int:
    """Least edits of pattern against any stretch of text."""
    row = np.zeros(len(text) + 1, int)
    for i, p in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t))
        row = new
    return int(row.min())


def test_hits_are_those_of_a_full_search():
    r = random.Random(6)
    table = [licenses.Notice(n.text, n.label, n.edits, n.seeds, frozenset()) for n in licenses.notices() if len(n.text) < 50]
    compiled = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in table]
    texts = []
    for _ in range(24):
        n = r.choice(table)
        x = list(n.text)
        for _ in range(r.randint(0, n.edits + 2)):
            k = r.randrange(len(x))
            x[k] = r.choice(["", "q", x[k] + "é", "z"])
        texts.append("Some words, " + "".join(x).title() + " ünd möre.")
    w = common.words(*common.buffers(pa.array(texts)), lower=True, alnum=True)
    found = licenses._fuzzy(*licenses._normal(w), table, compiled)
    hit = 0
    for i, t in enumerate(texts):
        plain = " ".join(WORDS.findall(t.translate(LOW)))
        for j, n in enumerate(table):
            least = sellers(n.text, plain)
            got = found.get((i, j))
            assert (got is not None) == (least <= n.edits), (plain, n.text)
            if got:
                hit += 1
                assert min(e for _, _, e in got) == least
                for a, b, e in got:
                    assert sellers(n.text, plain[a:b]) <= e and 0 <= a < b <= len(plain)
    assert hit > 20


def test_overlapping_hits_leave_one():
    mk = lambda a, b, e, x: {"label": x, "start": a, "end": b, "edits": e, "of": 20}
    hits = [mk(0, 20, 1, "a"), mk(5, 15, 0, "b"), mk(5, 18, 0, "c"), mk(30, 40, 2, "d"), mk(35, 41, 2, "e"), mk(40, 50, 2, "f")]
    assert sorted(h["label"] for h in licenses._best(hits)) == ["c", "d", "f"]


def test_very_long_line_is_scanned_whole(spark):
    text = "word " * 60_000 + "Released under the MIT License " + "tail " * 60_000 + "all rights reserved"
    (got,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (got.labels, got.base_labels, got.n_base, got.first_word, got.n_words) == ("mit,reserved", "reserved", 1, 120_005, 120_008)
