"""Benchmark decontamination by pigeonhole edit matching.

Words are lower-cased runs of letters, digits and characters beyond ASCII. An item of m words may stand in a document
with up to k = m * 15 // 100 word edits (insertions, deletions, replacements). Its words are split into k + 1 pieces, one
of which must then occur unchanged: exact piece hits (by hash, then by the words' hashes in place) give places, and
Myers' bit-parallel search confirms the whole item there.

Edge cases: null or empty texts and items match nothing; an item of under 7 words must occur exactly; repeated items
and rows are each answered; an empty benchmark leaves every document clean; other input columns are ignored by the
report and kept by the filter. Texts of any length are searched whole. Of equally good places of an item in a text the
first counts. Items go through in blocks of bounded size, in one reading of the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _Q, buffers, mix, run_hashes, text_blocks, words

#: Items of a block; a block's words are all the driver holds at a time.
BLOCK_ITEMS = 20_000


def budget(m: int, percent: int = 15) -> int:
    return m * percent // 100


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Least edits of the whole pattern against any stretch of text that ends at each place (bit-parallel); anchored:
    against the one that starts where the text does."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ((ph << 1) | anchored) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        out.append(score)
    return out


class Items:
    """The items of a block, cut into pieces; plain lists, as they travel with the task."""

    def __init__(self, ids: list[int], texts: list[str], percent: int):
        w = words(*buffers(pa.array(texts, pa.string())), lower=True, alnum=True)
        self.ids, self.words, self.edits = [], [], []
        lens: dict[int, list[tuple[int, int, int]]] = {}
        for r, i in enumerate(ids):
            h = w.hash[w.row_at[r] : w.row_at[r + 1]]
            m = len(h)
            if not m:
                continue
            k, at = budget(m, percent), len(self.ids)
            self.ids.append(i)
            self.words.append(h)
            self.edits.append(k)
            cuts = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                lens.setdefault(b - a, []).append((int(_piece(h, np.array([a]), b - a)[0]), at, a))
        self.pieces = {}
        for n, rows in lens.items():
            rows.sort()
            self.pieces[n] = (np.array([x[0] for x in rows], np.uint64), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]))


def _piece(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return mix(run_hashes(h, at, at + n, _Q))


def _hits(w, items: Items):
    """(row, item, first word, edits) of confirmed places, the best one of each row and item: fewest edits, then first."""
    n_words = len(w.hash)
    row_of = np.repeat(np.arange(len(w.row_at) - 1), np.diff(w.row_at))
    places: set[tuple[int, int, int]] = set()
    for n, (hashes, item, inside) in items.pieces.items():
        if n_words < n:
            continue
        at = np.arange(n_words - n + 1)
        at = at[row_of[at] == row_of[at + n - 1]]
        h = _piece(w.hash, at, n)
        lo = np.searchsorted(hashes, h)
        for k in np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h).tolist():
            j = int(lo[k])
            while j < len(hashes) and hashes[j] == h[k]:
                places.add((int(row_of[at[k]]), int(item[j]), int(at[k] - inside[j])))
                j += 1
    best: dict[tuple[int, int], tuple[int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for row, item, start in sorted(places):
        k, m = items.edits[item], len(items.words[item])
        if done.get((row, item), -1) >= start + m + k:
            continue
        lo, hi = max(int(w.row_at[row]), start - 2 * k), min(int(w.row_at[row + 1]), start + m + 2 * k)
        scores = myers(items.words[item].tolist(), w.hash[lo:hi].tolist())
        if not scores or (low := min(scores)) > k:
            continue
        end = lo + scores.index(low) + 1
        # where the stretch starts: the same distance, read backwards from its end (the shortest such stretch)
        back = [m, *myers(items.words[item].tolist()[::-1], w.hash[lo:end].tolist()[::-1], anchored=True)]
        first = end - back.index(low) - int(w.row_at[row])
        if (row, item) not in best or (low, first) < best[row, item]:
            best[row, item] = (low, first)
        done[row, item] = hi
    return [(r, i, f, e) for (r, i), (e, f) in best.items()]


_HITS = "array<struct<item_id: long, first_word: long, edits: int>>"


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 15, name: str = "_tm_hits") -> DataFrame:
    """Each row of docs, with its columns, and name (which takes the place of a column so called): array of (item_id,
    first_word, edits), by item and place.

    Texts are read once: each block of items adds its hits to the rows that pass through it, and takes what the blocks
    before have added along.
    """
    names = [c for c in docs.columns if c != name]
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    blocks = max(1, -(-bench.count() // BLOCK_ITEMS))
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast(_HITS).alias(name))
    schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int32())]))
    for k in range(blocks):
        part = bench if blocks == 1 else bench.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks})") == k)
        rows = part.orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows], percent)

        def run(batches, items=items):
            for rows, data, offs in text_blocks(batches):
                w = words(data, offs, lower=True, alnum=True)
                found = [x or [] for x in rows.column(name).to_pylist()]
                for r, i, first, edits in _hits(w, items):
                    found[r].append({"item_id": items.ids[i], "first_word": first, "edits": edits})
                hits = pa.array([sorted(x, key=lambda h: (h["item_id"], h["first_word"], h["edits"])) for x in found], kind)
                yield pa.RecordBatch.from_arrays([hits if n == name else rows.column(n) for n in rows.schema.names], rows.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, percent: int = 15) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, ascending, comma-joined), least edits and first word of the best hit."""
    m = matches(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, percent).drop("text")
    hits = F.array_sort(F.transform("_tm_hits", lambda h: F.struct(h.edits, h.first_word, h.item_id)))
    ids = F.array_sort(F.array_distinct(F.transform("_tm_hits", lambda h: h.item_id)))
    best = F.get(hits, F.lit(0))
    return m.select(
        "doc_id",
        (F.size("_tm_hits") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("items"),
        best["edits"].alias("edits"),
        best["first_word"].alias("first_word"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 15) -> DataFrame:
    """docs without the rows in which an item stands."""
    name = "_tm_hits"
    while name in docs.columns:
        name += "_"
    return matches(docs, benchmark, percent, name).where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
