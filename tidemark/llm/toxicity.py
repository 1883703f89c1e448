"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's bag holds its hashed character 3- to 5-grams (with boundary marks); the mean of their vectors goes through a
two-class linear softmax. Vectors and softmax weights are learned together on the words of a bounded sample of labelled
texts, each word weighted by how often it occurs under either label; misspellings share n-grams with what was seen. A
text is as toxic as its worst words: the largest word logits are averaged and calibrated on the sample.

Edge cases: null and empty texts have no words and get the score of the calibration's lowest logit; rows without a
label are scored all the same; an empty table gives no rows; without labelled rows of both kinds every score is 0;
repeated rows get a row each, and one of a doc_id's texts is learned from; other input columns are ignored; texts of any
length are scored whole. Scores use text alone. Words are in a set, so ties and repeats in a text change nothing.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import mix

BUCKETS, DIM = 1 << 18, 8
GRAMS = (3, 4, 5)
#: Bounds of the training sample: at most so many labelled texts of each kind, the first by hash of doc_id, of so many
#: characters in all.
SAMPLE, SAMPLE_CHARS = 1500, 16_000_000
#: Word logits kept by a worker.
MEMO = 400_000
#: Runs of letters and digits with a letter among them: numbers say nothing.
_WORD = re.compile(r"\d*[^\W\d_][^\W_]*")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every word, and where each word's grams start (words + 1)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    end_of = np.repeat(ends, lens)
    owner = np.repeat(np.arange(len(words)), lens)
    at, who = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        step = np.zeros(len(codes), np.uint64)
        step[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h + step) * np.uint64(0x9E3779B97F4A7C15)
        if n in GRAMS:
            k = np.flatnonzero(np.arange(len(codes)) + n <= end_of)
            at.append((mix(h[k] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
            who.append(owner[k])
    at, who = np.concatenate(at), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return at[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))])


def bag(text: str) -> list[str]:
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def doc_logit(values: list[float]) -> float:
    """Mean of the two largest word logits (of one, where there is one)."""
    if not values:
        return -10.0
    if len(values) == 1:
        return values[0]
    top = sorted(values)[-2:]
    return 0.7 * top[1] + 0.3 * top[0]


class Model:
    """Per-bucket logits (class vectors folded into the embeddings), bias, and the calibration of text logits."""

    def __init__(self, gram_logit: np.ndarray, bias: float, scale: float, shift: float):
        self.gram_logit, self.bias, self.scale, self.shift = gram_logit, bias, scale, shift

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        at, starts = grams(words)
        return np.add.reduceat(self.gram_logit[at], starts[:-1]) / np.diff(starts) + self.bias

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def train(texts: list[str], toxic: list[int], epochs: int = 6, seed: int = 1) -> Model | None:
    """Adagrad over words: gradients reach the n-gram vectors and the softmax weights together."""
    y = np.asarray(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return None
    bags = [bag(t) for t in texts]
    pos, neg = Counter(), Counter()
    for b, t in zip(bags, toxic):
        (pos if t else neg).update(b)
    vocab = sorted(pos.keys() | neg.keys())
    n1, n0 = np.array([pos[w] for w in vocab], np.float32), np.array([neg[w] for w in vocab], np.float32)
    at, starts = grams(vocab)
    sizes = np.diff(starts)
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = (np.full(x.shape, 1e-6, np.float32) for x in (emb, soft, bias))
    weight = np.log1p(n1 + n0)
    share = n1 / (n1 + n0)
    # one word of a toxic text need not be toxic: single sightings say little
    target = np.where(n1 + n0 >= 3, share, share * 0.5)
    # sharper where a word is hardly ever seen in clean texts
    target = np.where((n0 <= 0.02 * n1) & (n1 >= 3), 1.0, np.where(share < 0.6, 0.0, target)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(vocab))
        for lo in range(0, len(order), 2048):
            k = order[lo : lo + 2048]
            lens = sizes[k]
            idx = at[np.repeat(starts[k] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))]
            mean = np.add.reduceat(emb[idx], np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0) / lens[:, None]
            z = mean @ soft + bias
            p1 = 1 / (1 + np.exp(-np.clip(z[:, 1] - z[:, 0], -30, 30)))
            d = (p1 - target[k]) * weight[k] / 4
            dz = np.stack([-d, d], axis=1).astype(np.float32)
            d_soft, d_bias, d_mean = mean.T @ dz, dz.sum(axis=0), dz @ soft.T
            rows, inv = np.unique(idx, return_inverse=True)
            each = np.repeat(d_mean / lens[:, None], lens, axis=0)
            d_emb = np.stack([np.bincount(inv, each[:, k], len(rows)) for k in range(DIM)], axis=1).astype(np.float32)
            g_emb[rows] += d_emb**2
            emb[rows] -= 0.3 * d_emb / np.sqrt(g_emb[rows])
            g_soft += d_soft**2
            soft -= 0.05 * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= 0.05 * d_bias / np.sqrt(g_bias)
    diff = soft[:, 1] - soft[:, 0]
    model = Model((emb @ diff).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    logit = dict(zip(vocab, model.words(vocab).tolist()))
    x = np.array([doc_logit([logit[w] for w in b]) for b in bags])
    a, c = 1.0, 0.0
    for _ in range(400):  # calibration: clean texts weigh three times as much, as they are far more in any corpus
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        e = (p - y) * np.where(y == 1, 0.25 / max(1, (y == 1).sum()), 0.75 / max(1, (y == 0).sum()))
        a, c = max(0.05, a - 0.5 * float((e * x).sum())), c - 0.5 * float(e.sum())
    model.scale, model.shift = a, c
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: never rows held out; at most bound of each kind and chars of their characters, by
    hash of doc_id."""
    lab = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    picked = None
    for kind in (0, 1):
        part = lab.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    # a doc_id with several texts gives one of them; picked has 2 * bound rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    upto = F.sum(F.length("text")).over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = texts.withColumn("upto", upto).where(F.col("upto") <= chars).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    return [r.text for r in rows], [r.toxic for r in rows]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    def run(batches):
        memo: dict[str, float] = {}
        for b in batches:
            ids, out = b.column("doc_id"), []
            for t in b.column("text"):
                t = t.as_py() or ""
                if model is None:
                    out.append(None)
                    continue
                ws = set(_WORD.findall(t.lower()))
                new = [w for w in ws if w not in memo]
                if new:
                    if len(memo) > MEMO:
                        memo = {}
                        new = list(ws)
                    memo.update(zip(new, model.words(new).tolist()))
                out.append(doc_logit([memo[w] for w in ws]))
            p = np.zeros(len(out)) if model is None else model.probability(np.array(out, float))
            yield pa.RecordBatch.from_arrays([ids, b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    return score(docs, train(*sample(docs, labels, bound)))
