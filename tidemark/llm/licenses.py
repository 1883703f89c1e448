"""License scans: exact short phrases, and fuzzy notices by pigeonhole seeds and bounded-error matching.

Texts are read as lower-cased words of letters, digits and characters beyond ASCII. Base phrases are counted wherever
their words stand in a row. A notice of n characters may differ by n // 10 edits (one at least from 12 characters on,
two from 16, four at most): of its edits-plus-one seeds one must occur unchanged, which locates candidates; the regex library's bounded-error
matching then verifies the whole notice there and gives its span and edits. The words that tell a license from others
(mit, bsd, a version) must stand unchanged inside that span, so that edits never turn one license into another.

Edge cases: null and empty texts have no words, no labels and score 0; of overlapping hits the best one counts (fewest
edits, then the longest, the first, the label in order); an empty table gives no rows; repeated rows get a row each;
other input columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, text_blocks, words

#: Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Most edits of a notice: with more, seeds of long notices would be short enough to occur in any prose.
MOST_EDITS = 4
#: Notices in normal form (lower case, words joined by one space), their labels, and the words that tell
#: them from the notices of other licenses; edits never touch these.
NOTICES = {
    "licensed under the apache license version 2 0": ("apache-2.0", "2"),
    "apache license version 2 0": ("apache-2.0", "2"),
    "apache license 2 0": ("apache-2.0", "2"),
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": ("apache-2.0", ""),
    "released under the mit license": ("mit", "mit"),
    "licensed under the mit license": ("mit", "mit"),
    "mit license": ("mit", "mit"),
    "spdx license identifier mit": ("mit", "mit"),
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit", ""),
    "licensed under the isc license": ("isc", "isc"),
    "released under the isc license": ("isc", "isc"),
    "isc license": ("isc", "isc"),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", ""),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", ""),
    "licensed under the bsd license": ("bsd", "bsd"),
    "released under the bsd license": ("bsd", "bsd"),
    "bsd 2 clause license": ("bsd", "bsd 2"),
    "bsd 3 clause license": ("bsd", "bsd 3"),
    "gnu general public license v3": ("gpl-3.0", "v3"),
    "gnu general public license v2": ("gpl-2.0", "v2"),
    "gnu general public license version 3": ("gpl-3.0", "3"),
    "gnu general public license version 2": ("gpl-2.0", "2"),
    "gnu general public license": ("gpl", ""),
    "gnu lesser general public license": ("lgpl", ""),
    "gnu affero general public license": ("agpl", ""),
    "gnu free documentation license": ("gfdl", ""),
    "mozilla public license version 2 0": ("mpl-2.0", "2"),
    "eclipse public license version 2 0": ("epl-2.0", "2"),
    "european union public licence": ("eupl", ""),
    "boost software license version 1 0": ("bsl-1.0", "1"),
    "sil open font license version 1 1": ("ofl-1.1", "1"),
    "do what the fuck you want to public license": ("wtfpl", ""),
    "licensed under cc by 4 0": ("cc-by", "cc by 4"),
    "licensed under cc by nc 4 0": ("cc-by-nc", "cc by nc 4"),
    "licensed under cc by sa 4 0": ("cc-by-sa", "cc by sa 4"),
    "licensed under cc by nd 4 0": ("cc-by-nd", "cc by nd 4"),
    "licensed under cc by nc sa 4 0": ("cc-by-nc-sa", "cc by nc sa 4"),
    "licensed under cc by nc nd 4 0": ("cc-by-nc-nd", "cc by nc nd 4"),
    "creative commons attribution": ("cc-by", ""),
    "creative commons attribution noncommercial": ("cc-by-nc", ""),
    "creative commons attribution sharealike": ("cc-by-sa", ""),
    "creative commons attribution noderivatives": ("cc-by-nd", ""),
    "creative commons zero": ("cc0", "zero"),
    "this is free and unencumbered software released into the public domain": ("unlicense", ""),
    "dedicated to the public domain": ("public-domain", ""),
    "all rights reserved": ("reserved", ""),
}


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[bytes, int], ...]
    must: frozenset[str]


def notices(table: dict[str, tuple[str, str]] = NOTICES) -> list[Notice]:
    out = []
    for text, (label, must) in table.items():
        n = len(text)
        k = min(max(n // 10, 2 if n >= 16 else 1 if n >= 12 else 0), MOST_EDITS)
        cuts = [n * i // (k + 1) for i in range(k + 2)]
        out.append(Notice(text, label, k, tuple((text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])), frozenset(must.split())))
    return out


def _normal(w) -> tuple[bytes, np.ndarray]:
    """Words of all rows, each followed by a space, each row by a line feed; and where every row starts."""
    lens = w.ends - w.starts
    n_rows = len(w.row_at) - 1
    row = np.repeat(np.arange(n_rows), np.diff(w.row_at))
    to = np.concatenate([[0], np.cumsum(lens + 1)])[:-1] + row if len(lens) else np.zeros(0, np.int64)
    out = np.full(int(lens.sum()) + len(lens) + n_rows, 32, np.uint8)
    src = np.repeat(w.starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    out[np.repeat(to - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))] = w.data[src]
    size = np.zeros(n_rows, np.int64)
    np.add.at(size, row, lens + 1)
    row_start = np.concatenate([[0], np.cumsum(size + 1)])
    out[row_start[1:] - 1] = 10
    return out.tobytes(), row_start


def _fuzzy(text: bytes, row_start: np.ndarray, table: list[Notice], compiled: list):
    """(row, notice, start, end, edits) in characters of the row's normal form."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for j, notice in enumerate(table):
        places = set()
        for seed, inside in notice.seeds:
            at = text.find(seed)
            while at >= 0:
                places.add((at, inside))
                at = text.find(seed, at + 1)
        if not places:
            continue
        at = np.array(sorted(places), np.int64)
        rows = np.searchsorted(row_start, at[:, 0], "right") - 1
        done: dict[int, int] = {}
        for (p, inside), r in zip(at.tolist(), rows.tolist()):
            lo, hi = int(row_start[r]), int(row_start[r + 1]) - 1
            # seeds are ASCII; what surrounds them may not be: up to 4 bytes a character
            a, b = max(lo, p - inside - 4 * notice.edits), min(hi, p - inside + len(notice.text) + 4 * notice.edits)
            if done.get(r, -1) >= b:
                continue
            while a < p and text[a] & 0xC0 == 0x80:
                a += 1
            while b < hi and text[b] & 0xC0 == 0x80:
                b += 1
            near = text[a:b].decode("utf-8", "replace")
            m = compiled[j].search(near)
            if m and notice.must <= _words_at(near, m.start(), m.end()):
                start = len(text[lo:a].decode("utf-8", "replace")) + m.start()
                found.setdefault((r, j), []).append((start, start + m.end() - m.start(), sum(m.fuzzy_counts)))
                done[r] = b
    return found


def _words_at(text: str, start: int, end: int) -> set[str]:
    """The words that lie in text[start:end], whole ones at both ends."""
    start, end = text.rfind(" ", 0, start + 1) + 1, text.find(" ", max(start, end - 1))
    return set(text[start : end if end >= 0 else len(text)].split())


def _best(hits: list[dict]) -> list[dict]:
    """Hits that overlap no better one: fewer edits first, then the longer notice, the earlier place, the label."""
    kept: list[dict] = []
    for h in sorted(hits, key=lambda h: (h["edits"], h["start"] - h["end"], h["start"], h["label"])):
        if not any(k["start"] < h["end"] and h["start"] < k["end"] for k in kept):
            kept.append(h)
    return kept


def scan(docs: DataFrame, base: dict[str, str] = BASE, table: dict[str, tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and hits: array of
    (label, start, end, edits), places in the normal form of the whole text."""
    fuzzy = notices(table)
    phrase_words = {p: p.split(" ") for p in base}

    def run(batches):
        import regex

        compiled = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in fuzzy]
        known = {x: words(*buffers(pa.array([x]))).hash[0] for p in phrase_words.values() for x in p}
        for rows, data, offs in text_blocks(batches):
            w = words(data, offs, lower=True, alnum=True)
            n_rows, n = rows.num_rows, len(w.hash)
            row = np.repeat(np.arange(n_rows), np.diff(w.row_at))
            count = np.zeros(n_rows, np.int64)
            first, last = np.full(n_rows, -1, np.int64), np.full(n_rows, -1, np.int64)
            exact: list[set] = [set() for _ in range(n_rows)]
            for p, parts in phrase_words.items():
                size = len(parts)
                at = np.flatnonzero(w.hash[: max(0, n - size + 1)] == known[parts[0]])
                for k in range(1, size):
                    at = at[w.hash[at + k] == known[parts[k]]]
                at = at[row[at] == row[at + size - 1]]
                for r, pos in zip(row[at].tolist(), (at - w.row_at[:-1][row[at]]).tolist()):
                    count[r] += 1
                    first[r] = pos if first[r] < 0 else min(first[r], pos)
                    last[r] = max(last[r], pos)
                    exact[r].add(base[p])
            text, row_start = _normal(w)
            hits: list[list] = [[] for _ in range(n_rows)]
            for (r, j), spans in _fuzzy(text, row_start, fuzzy, compiled).items():
                for s, e, k in spans:
                    hits[r].append({"label": fuzzy[j].label, "start": s, "end": e, "edits": k, "of": len(fuzzy[j].text)})
            hits = [_best(x) for x in hits]
            score = [1.0 if exact[r] else max((1 - h["edits"] / h["of"] for h in hits[r]), default=0.0) for r in range(n_rows)]
            labels = [",".join(sorted(exact[r] | {h["label"] for h in hits[r]})) for r in range(n_rows)]
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
            none = first < 0
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(w.row_at)),
                    pa.array(count),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in exact]),
                    pa.array(labels),
                    pa.array(score, pa.float64()),
                    pa.array([[{k: v for k, v in h.items() if k != "of"} for h in sorted(x, key=lambda h: (h["start"], h["label"]))] for x in hits], span),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits array<struct<label: string, start: long, end: long, edits: int>>"
    )


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("hits")
