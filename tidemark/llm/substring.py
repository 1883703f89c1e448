"""Substring dedup by difference-cover anchors.

A word goes if a window of 50 consecutive words that covers it also starts in a document with a smaller doc_id. Only
windows of 20 words at cover positions modulo 31 are hashed for every text: the positions {1, 5, 11, 24, 25, 27} have
every difference modulo 31, so two equal 50-word windows, wherever they stand, share an equal anchor at the same place
inside both. Anchors that occur in two different texts are then extended: each 50-word window that holds one is
compared by its full hash (128 bits) with all others of its kind.

Edge cases: null and empty texts have no words; an empty table gives no rows; texts of fewer than 50 words stay whole;
rows that repeat a doc_id are one another's equals (nothing goes on their account) and each gets its own row; further
input columns are ignored by the report and kept by the filter, with text and n_chars replaced where words went.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _Q, _R, as_long, discard, hold, join_hot, materialise, mix, run_hashes, text_blocks, words

#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
PERIOD = 31


def _window_hashes(h: np.ndarray, at: np.ndarray, size: int, base: int) -> np.ndarray:
    return mix(run_hashes(h, at, at + size, base))


def _whole(w, lo: int, hi: int) -> bytes:
    """Words of one text joined by single spaces."""
    s, e = w.starts[lo:hi], w.ends[lo:hi]
    if hi <= lo:
        return b""
    piece = w.data[s[0] : e[-1]]
    keep = np.zeros(len(piece) + 1, np.int8)
    np.add.at(keep, s - s[0], 1)
    np.add.at(keep, e - s[0], -1)
    inside = np.cumsum(keep[:-1]) > 0
    inside[(e - s[0])[:-1]] = True  # one separator after each word but the last
    out = piece[inside].copy()
    lens = e - s
    out[np.cumsum(lens + 1)[:-1] - 1] = 32
    return out.tobytes()


def _profile(batches):
    """A row for each text: its word count and the digest of its words."""
    for rows, data, offs in text_blocks(batches):
        w = words(data, offs, hashed=False)
        sha = [hashlib.sha256(_whole(w, a, b)).hexdigest() for a, b in zip(w.row_at[:-1].tolist(), w.row_at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_tm_t"), as_long(np.diff(w.row_at)), pa.array(sha, pa.string())], ["doc_id", "_tm_t", "n_words", "sha"])


def _anchors(batches, window: int):
    """Anchor hashes of every text at the cover positions of its own word count from 0."""
    size = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for rows, data, offs in text_blocks(batches):
        w = words(data, offs)
        n = np.diff(w.row_at)
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(row)) - w.row_at[:-1][row]
        at = np.flatnonzero(cover[pos % PERIOD] & (pos + size <= n[row]) & (n[row] >= window))
        if len(at):
            ids, t = rows.column("doc_id").to_numpy(zero_copy_only=False), rows.column("_tm_t").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [as_long(_window_hashes(w.hash, at, size, _Q)), pa.array(ids[row[at]]), pa.array(t[row[at]]), pa.array(pos[at].astype(np.int32))], ["hash", "doc_id", "_tm_t", "pos"]
            )


def _windows(batches, window: int):
    """Both hashes of each window that holds a shared anchor; column at: a text's shared anchor positions."""
    for rows, data, offs in text_blocks(batches):
        w = words(data, offs)
        start, at, t, docs = [], rows.column("at").to_pylist(), rows.column("_tm_t").to_numpy(zero_copy_only=False), rows.column("doc_id").to_numpy(zero_copy_only=False)
        owner = []
        for r, anchors in enumerate(at):
            n = int(w.row_at[r + 1] - w.row_at[r])
            flag = np.zeros(n + 1, np.int32)
            a = np.asarray(anchors, np.int64)
            np.add.at(flag, np.maximum(a - (PERIOD - 1), 0), 1)
            np.add.at(flag, np.minimum(a + 1, n), -1)
            hit = np.flatnonzero(np.cumsum(flag)[: max(0, n - window + 1)] > 0)
            start.append(w.row_at[r] + hit)
            owner.append(np.full(len(hit), r))
        s = np.concatenate(start) if start else np.zeros(0, np.int64)
        if len(s):
            o = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [as_long(_window_hashes(w.hash, s, window, _Q)), as_long(_window_hashes(w.hash, s, window, _R)), pa.array(docs[o]), pa.array(t[o]), pa.array((s - w.row_at[:-1][o]).astype(np.int32))],
                ["h1", "h2", "doc_id", "_tm_t", "pos"],
            )


def _cut(batches, window: int, keep_text: bool):
    """What stays of each text; column at: first words of the windows that go."""
    for rows, data, offs in text_blocks(batches):
        w = words(data, offs)
        gone, sha, texts = [], [], []
        for r, at in enumerate(rows.column("at").to_pylist()):
            a, b = int(w.row_at[r]), int(w.row_at[r + 1])
            flag = np.zeros(b - a + 1, np.int32)
            p = np.asarray(at, np.int64)
            np.add.at(flag, p, 1)
            np.add.at(flag, np.minimum(p + window, b - a), -1)
            out = np.cumsum(flag[:-1]) > 0
            kept = np.flatnonzero(~out) + a
            body = b" ".join(w.data[x:y].tobytes() for x, y in zip(w.starts[kept].tolist(), w.ends[kept].tolist()))
            gone.append(int(out.sum()))
            sha.append(hashlib.sha256(body).hexdigest())
            texts.append(body.decode("utf-8", "replace") if keep_text else None)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_tm_t"), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["doc_id", "_tm_t", "n_removed", "kept_sha256", "kept"])


_NOTHING = hashlib.sha256(b"").hexdigest()


_KEY = ["doc_id", "_tm_t"]
#: A null doc_id stands after all others.
_LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _tm_t (hash of the text) and text: rows with the same of all three are one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("_tm_t"), text.alias("text"))


def removals(docs: DataFrame, window: int = 50, keep_text: bool = False) -> DataFrame:
    """For each different row of _keyed(docs): doc_id, _tm_t, n_words, n_removed, kept_sha256, kept.

    kept is the text that stays, only where words went and keep_text is set.
    """
    if window < PERIOD:
        raise ValueError(f"a window must have {PERIOD} words at least")
    base = _keyed(docs)
    counted = F.count(F.lit(1)).alias("n")
    raw = materialise(base.mapInArrow(_profile, "doc_id long, _tm_t long, n_words long, sha string"))
    # Whole copies: every window of theirs also starts in the first of them, so they go without comparing windows.
    first = raw.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), counted).where("first < last").drop("last")
    first = materialise(first)
    copies = materialise(join_hot(raw, first, ["sha"], raw.count()).where("doc_id > first").select(*_KEY).distinct())
    profile = materialise(raw.dropDuplicates(_KEY).join(copies.withColumn("copy", F.lit(True)).hint("merge"), _KEY, "left").withColumn("copy", F.coalesce("copy", F.lit(False))))
    discard(raw, first, copies)
    anchors = materialise(base.mapInArrow(lambda it: _anchors(it, window), "hash long, doc_id long, _tm_t long, pos int"))
    shared = materialise(anchors.groupBy("hash").agg(F.min("_tm_t").alias("a"), F.max("_tm_t").alias("b"), counted).where("a < b").select("hash", "n"))
    at = join_hot(anchors, shared, ["hash"], anchors.count()).groupBy(*_KEY).agg(F.collect_set("pos").alias("at"))
    at = materialise(at.join(profile.where("not copy").select(*_KEY).hint("merge"), _KEY, "left_semi"))
    discard(anchors, shared)
    affected = materialise(base.join(at.hint("merge"), _KEY))
    discard(at)
    found = materialise(affected.mapInArrow(lambda it: _windows(it, window), "h1 long, h2 long, doc_id long, _tm_t long, pos int"))
    owners = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), counted).where("first < last").drop("last")
    owners = materialise(owners)
    gone = materialise(join_hot(found, owners, ["h1", "h2"], found.count()).where("doc_id > first").groupBy(*_KEY).agg(F.collect_set("pos").alias("at")))
    discard(found, owners)
    cut = affected.drop("at").join(gone.hint("merge"), _KEY).mapInArrow(lambda it: _cut(it, window, keep_text), "doc_id long, _tm_t long, n_removed long, kept_sha256 string, kept string")
    cut = materialise(cut.dropDuplicates(_KEY))
    discard(affected, gone)
    hold(docs.sparkSession, profile, cut)
    out = profile.join(cut.hint("merge"), _KEY, "left")
    return out.select(
        *_KEY,
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def report(docs: DataFrame, window: int = 50) -> DataFrame:
    rows = _keyed(docs).select(*_KEY)
    out = rows.join(removals(docs, window).drop("kept"), _KEY)
    return out.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the repeated words taken out of text (and n_chars brought up to date); texts that lose nothing stay as they are."""
    cut = removals(docs, window, keep_text=True).where("n_removed > 0").select(F.col("doc_id").alias("_tm_d"), "_tm_t", F.col("kept").alias("_tm_kept"))
    rows = docs.withColumns({"_tm_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "_tm_t": F.xxhash64(F.coalesce("text", F.lit("")))})
    # always a merge join: what is cut is a share of all documents, which outgrows any broadcast
    out = rows.join(cut.hint("merge"), ["_tm_d", "_tm_t"], "left")
    new = {"text": F.coalesce("_tm_kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_tm_kept").isNotNull(), F.length("_tm_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
