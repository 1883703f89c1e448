"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every text becomes its set of word shingles; texts with equal sets are one class and one node,
   represented by its first row in the order of doc_id and text hash.
2. A forest sorts the representatives by the values of their signature, in 32 orders of eight values each. In each order
   a representative's two neighbours on either side are candidates if their longest common prefix is long enough, and how
   long depends on the region: four values where few others share so many, five or six where it is crowded. Candidates
   stay linear in rows, however large a region is.
3. Candidates whose signatures agree far too little (6 standard deviations below the threshold) are dropped; what
   remains joins into regions of similar texts (connected components).
4. Links are decided on the full sets, so that two similar texts need not have been neighbours. A region is dealt out in
   blocks of bounded size (most regions are one), and each block is linked in itself. Then rounds of pivots join the
   blocks of a region: every component's best connected texts are compared with all texts of other components, until
   each text outside the region's largest component has been a pivot. No link inside a region is left out that could
   still join two components.

Edge cases: texts without words (null, empty) have an empty set and link with nothing, also not with each other; texts
with fewer words than a shingle are one shingle; an empty table gives no rows; rows equal in doc_id and text are one
document, each row answered; a doc_id with several texts is several documents, which link by their texts only; a null
doc_id counts as the largest, and rows without one are told apart by their texts. Of several texts of a component the
first in the order of doc_id and text hash is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import _Q, _R, as_long, discard, hold, join_hot, materialise, mix, text_blocks, words

TREES, DEPTH, DEEPER = 32, 6, 2
HASHES = TREES * DEPTH
#: Least common prefix of neighbours in a sparse region, and how many rows behind share it in a crowded one.
SHALLOW, CROWD = 4, 8
#: Shingles (8 bytes each) and rows of a block.
BLOCK_SHINGLES, BLOCK_ROWS = 200_000, 128
#: Pivots of a region in the first round, and in any.
PIVOTS, MOST_PIVOTS = 64, 4096
_LAST = 2**63 - 1

_g = np.random.Generator(np.random.PCG64(7))
_A = _g.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _g.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Order of the hash functions in each tree: its own six first, then others.
_ORDER = np.stack([np.concatenate([np.arange(t * DEPTH, (t + 1) * DEPTH), _g.permutation(np.delete(np.arange(HASHES), np.s_[t * DEPTH : (t + 1) * DEPTH]))[:DEEPER]]) for t in range(TREES)])


def shingle_sets(w, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    h = w.hash
    roll = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        roll = roll * np.uint64(_Q) + h[k : len(h) - size + 1 + k]
    roll = mix(roll)
    for a, b in zip(w.row_at[:-1].tolist(), w.row_at[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(np.unique(roll[a : b - size + 1]))
        elif n:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = x * np.uint64(_R) + h[k]
            out.append(mix(x + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each minimum."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    lo, hi = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(s), 256):
        v = lo[k : k + 256, None] * _A
        v ^= hi[k : k + 256, None]
        v *= _B
        np.minimum(best, v.min(axis=0), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sign(batches, size: int):
    for rows, data, offs in text_blocks(batches):
        sets = shingle_sets(words(data, offs, lower=True), size)
        d1 = np.array([int(np.bitwise_xor.reduce(mix(s + np.uint64(_R)))) if len(s) else 0 for s in sets], np.uint64)
        d2 = np.array([int(np.add.reduce(mix(s ^ np.uint64(_Q)))) if len(s) else 0 for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("_tm_t"), pa.array([len(s) for s in sets], pa.int64()), as_long(d1), as_long(d2), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
            ["doc_id", "_tm_t", "n_shingles", "d1", "d2", "sig"],
        )


def _orders(batches):
    """A row for each tree: its first eight signature values in two longs, by which the order goes."""
    for b in batches:
        ids = b.column("rep").to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(len(ids), HASHES)
        # big-endian, so that the longs compare as the values do one after another
        longs = np.ascontiguousarray(sig[:, _ORDER].transpose(1, 0, 2)).astype(">u2").view(">i8").astype(np.int64)
        tree = np.repeat(np.arange(TREES, dtype=np.int8), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(longs[:, :, 0].ravel()), pa.array(longs[:, :, 1].ravel()), pa.array(np.tile(ids, TREES))], ["tree", "k1", "k2", "doc"])


def _common(x: np.ndarray) -> np.ndarray:
    """Leading 16-bit values that are zero, of four."""
    x = x.view(np.uint64)
    return sum((x >> np.uint64(k) == 0).astype(np.int8) for k in (48, 32, 16, 0))


def _prefix(tree, k1, k2, back: int) -> np.ndarray:
    """Longest common prefix of each row from back on with the row back places before it."""
    one = _common(k1[back:] ^ k1[:-back])
    both = one + np.where(one == 4, _common(k2[back:] ^ k2[:-back]), 0)
    return np.where(tree[back:] == tree[:-back], both, 0)


def _neighbours(batches):
    """Of rows in an order's sequence: pairs with the row before and the one before that, where their common prefix has
    the region's depth; and the first and last row of the partition, as the region may go on in the next one."""
    held, first = None, None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "k1", "k2", "doc")]
        if first is None:
            first = [x[0] for x in new]
        seen = 0 if held is None else len(held[0])
        tree, k1, k2, doc = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        held = [x[-CROWD:] for x in (tree, k1, k2, doc)]
        n = len(doc)
        need = np.full(n, SHALLOW)
        if n > CROWD:
            need[CROWD:] = np.clip(_prefix(tree, k1, k2, CROWD) + 1, SHALLOW, DEPTH)
        a, c = [], []
        for back in (1, 2):
            if n > back:
                at = np.flatnonzero((_prefix(tree, k1, k2, back) >= need[back:]) & (doc[back:] != doc[:-back])) + back
                at = at[at >= seen]
                a.append(doc[at - back])
                c.append(doc[at])
        if a and sum(map(len, a)):
            a, c = np.concatenate(a), np.concatenate(c)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.nulls(len(a), pa.int8()), none, none], ["a", "b", "tree", "k1", "k2"])
    if first is not None:
        ends = [first, [x[-1] for x in held]]
        col = lambda i, t: pa.array([int(x[i]) for x in ends], t)
        yield pa.RecordBatch.from_arrays([col(3, pa.int64()), pa.nulls(2, pa.int64()), col(0, pa.int8()), col(1, pa.int64()), col(2, pa.int64())], ["a", "b", "tree", "k1", "k2"])


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), HASHES) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over edges (a, b), for every node of an edge.

    Each node points to its smallest smaller neighbour, pointers are followed by jumping (paths halve), and edges are
    contracted to what still joins two labels. Edges are read once or twice in all, not once for each step of a path.
    """
    live = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = materialise(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    while not live.isEmpty():
        point = materialise(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"), F.lit(True).alias("moved")))
        while True:
            far = point.select(F.col("node").alias("hub"), F.col("label").alias("far"))
            step = materialise(point.drop("moved").join(far, point.label == far.hub, "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")))
            discard(point)
            point = step
            if step.where("moved").isEmpty():
                break
        to = point.select(F.col("node").alias("old"), F.col("label").alias("new"))
        grown = materialise(labels.join(to, labels.label == to.old, "left").select("node", F.coalesce("new", "label").alias("label")))
        left = live.join(to, live.a == to.old, "left").select(F.coalesce("new", "a").alias("a"), "b")
        both = left.join(to, left.b == to.old, "left").select("a", F.coalesce("new", "b").alias("b"))
        rest = materialise(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(live, labels, point)
        live, labels = rest, grown
    discard(live)
    return labels


class _Block:
    """The sets of some texts, with which one set is compared at a time: a mark for each of its shingles, summed by text."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.known, self.place = np.unique(flat, return_inverse=True)
        self.starts = np.cumsum(self.size) - self.size
        self.mark = np.zeros(len(self.known), np.int32)

    def like(self, x: np.ndarray) -> np.ndarray:
        """Whether each text's similarity to the set x reaches the threshold."""
        at = np.searchsorted(self.known, x)
        at[at == len(self.known)] = 0
        at = at[self.known[at] == x]
        self.mark[at] = 1
        both = np.add.reduceat(self.mark[self.place], self.starts)
        self.mark[at] = 0
        return 100 * both >= self.percent * (self.size + len(x) - both)


def _unpack(col) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in col]


def _link_block(docs: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels (smallest doc of the component) of one block, breadth first. No set is empty."""
    block, label, open_ = _Block(sets, percent), docs.copy(), np.ones(len(docs), bool)
    for seed in np.argsort(docs, kind="stable").tolist():
        if not open_[seed]:
            continue
        open_[seed], queue = False, [seed]
        while queue and open_.any():
            hit = np.flatnonzero(open_ & block.like(sets[queue.pop()]))
            label[hit], open_[hit] = docs[seed], False
            queue += hit.tolist()
    return label


def _across(members: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """doc, label of regions of several blocks, from members (region, block, n_blocks, doc, set) and the state after each
    block was linked in itself (region, doc, label, degree).

    A round compares pivots with all texts of their region that have another label, block by block: of each component
    outside the region's largest one the best connected texts first. A found link joins two labels. It ends when every
    text outside the largest component has been a pivot, so that no link between components is missed.
    """

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(left) and len(right):
            block, label = _Block(_unpack(left["set"]), percent), left["label"].to_numpy()
            for mine, s in zip(right["label"], _unpack(right["set"])):
                for other in np.unique(label[block.like(s) & (label != mine)]).tolist():
                    a.append(mine)
                    b.append(other)
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    state, per = materialise(state.withColumn("used", F.lit(False))), PIVOTS
    while True:
        sizes = state.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
        top = sizes.groupBy("region").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("top"))
        outside = state.join(top, "region").where("not used and label <> top")
        inner = outside.withColumn("r", F.row_number().over(W.partitionBy("region", "label").orderBy(F.desc("degree"), "doc"))).where(F.col("r") <= per)
        pivots = inner.withColumn("k", F.row_number().over(W.partitionBy("region").orderBy("r", F.desc("degree"), "doc"))).where(F.col("k") <= per)
        pivots = materialise(pivots.select("region", "doc", "label"))
        if pivots.isEmpty():
            return state.select(F.col("doc").alias("node"), "label")
        open_ = pivots.select("region").distinct()
        here = members.join(open_, "region", "left_semi").join(state.select("doc", "label"), "doc")
        sets = materialise(members.join(pivots, ["region", "doc"]).select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), "label", "set"))
        found = here.select("region", "block", "label", "set").groupBy("region", "block").cogroup(sets.groupBy("region", "block")).applyInPandas(compare, "a long, b long")
        joined = components(found)
        now = pivots.select("doc", F.lit(True).alias("now"))
        old = state.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").join(now, "doc", "left")
        new = materialise(old.select("region", "doc", F.coalesce("new", "label").alias("label"), "degree", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used")))
        discard(state, pivots, sets, joined)
        state, per = new, min(4 * per, MOST_PIVOTS)


def _identity() -> list:
    """doc_id and the hash of the text: rows equal in both are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tm_t")]


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id (null: the largest long), _tm_t (hash of the text), n_shingles, component_id
    (the smallest doc_id of the component) and kept (true for the component's first doc_id and _tm_t)."""
    base = docs.select(*_identity(), "text")
    signed = materialise(base.mapInArrow(lambda it: _sign(it, shingle), "doc_id long, _tm_t long, n_shingles long, d1 long, d2 long, sig binary"))
    keys = ["n_shingles", "d1", "d2"]
    full = signed.where("n_shingles > 0")
    # a class is a node by the hash of its set: doc_ids may be null or repeat
    reps = full.groupBy(*keys).agg(F.min(F.struct("doc_id", "_tm_t")).alias("first"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    reps = materialise(reps.withColumn("rep", F.xxhash64(*keys)))
    forest = reps.select("rep", "sig").mapInArrow(_orders, "tree byte, k1 long, k2 long, doc long")
    order = ["tree", "k1", "k2", "doc"]
    near = materialise(forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "a long, b long, tree byte, k1 long, k2 long"))
    # Regions that go on from one partition to the next: its end rows, two a partition at most, are neighbours as well.
    ends = W.orderBy("tree", "k1", "k2", "a")
    met = near.where("b is null").select("tree", "k1", "a", F.lag("tree").over(ends).alias("t0"), F.lag("k1").over(ends).alias("k0"), F.lag("a").over(ends).alias("b"))
    across = met.where("tree = t0 and k1 = k0 and a <> b").select("a", "b")
    pairs = near.where("b is not null").select("a", "b").unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sigs = reps.select("rep", "sig")
    agree = F.pandas_udf(_agreement, "double")
    floor = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5
    left = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    edges = materialise(left.where(agree("sa", "sb") >= floor).select("a", "b").distinct())
    discard(near)
    regions = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("degree"))
    nodes = regions.select(F.col("node").alias("doc"), F.col("label").alias("region")).join(degree, "doc")
    nodes = materialise(nodes.join(reps.select(F.col("rep").alias("doc"), "first.*", "n_shingles"), "doc"))
    blocks = F.ceil(F.greatest(F.sum("n_shingles") / block_shingles, F.count(F.lit(1)) / block_rows)).cast("long")
    sizes = materialise(nodes.groupBy("region").agg(F.count(F.lit(1)).alias("n"), blocks.alias("n_blocks")))
    dealt = materialise(join_hot(nodes.drop("n_shingles"), sizes, ["region"], nodes.count()).withColumn("block", F.expr("pmod(xxhash64(doc, 1), n_blocks)")))
    discard(edges, regions, nodes, sizes)

    def sets(batches):
        for rows, data, offs in text_blocks(batches):
            found = shingle_sets(words(data, offs, lower=True), shingle)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("region", "block", "n_blocks", "doc", "degree")), pa.array([s.tobytes() for s in found], pa.binary())], ["region", "block", "n_blocks", "doc", "degree", "set"])

    # always a merge join: the rows wanted are a share of all documents, which outgrows any broadcast
    texts = base.join(dealt.hint("merge"), ["doc_id", "_tm_t"]).select("region", "block", "n_blocks", "doc", "degree", "text").dropDuplicates(["doc"])
    members = materialise(texts.mapInArrow(sets, "region long, block long, n_blocks long, doc long, degree long, set binary"))
    discard(dealt)

    def link(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["region", "n_blocks", "doc", "degree"]].assign(label=_link_block(pdf["doc"].to_numpy(), _unpack(pdf["set"]), percent))

    linked = materialise(members.groupBy("region", "block").applyInPandas(link, "region long, n_blocks long, doc long, degree long, label long"))
    several = linked.where("n_blocks > 1").select("region", "doc", "label", "degree")
    labels = linked.where("n_blocks = 1").select(F.col("doc").alias("node"), "label")
    if not several.isEmpty():
        labels = labels.unionByName(_across(members.where("n_blocks > 1"), several, percent))
    labels = materialise(labels.join(reps.select(F.col("rep").alias("node"), "first"), "node"))
    discard(members, linked)
    heads = labels.groupBy("label").agg(F.min("first").alias("head"))
    heads = labels.select("node", "label").join(heads, "label").select("node", "head")
    of = reps.join(heads, reps.rep == heads.node, "left").select(*keys, "n", F.coalesce("head", "first").alias("head"))
    of = materialise(of)
    discard(reps, labels)
    hold(docs.sparkSession, signed, of)
    own = F.struct("doc_id", "_tm_t")
    headed = join_hot(full.drop("sig"), of, keys, signed.count()).unionByName(signed.where("n_shingles = 0").drop("sig").withColumn("head", own))
    return headed.select("doc_id", "_tm_t", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col("head") == own).alias("kept"))


def report(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    out = classes(docs, shingle, percent)
    return out.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(_LAST)).alias("component_id"), "kept")


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of a group but its first document. Of rows equal in doc_id and text one stays; rows without
    doc_id and words have nothing to be told apart or compared by, and all stay."""
    key, names = ["_tm_d", "_tm_t"], [F.col(f"`{c}`") for c in docs.columns]
    bare = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keep = classes(docs.where(~bare), shingle, percent).where("kept").select(F.col("doc_id").alias("_tm_d"), "_tm_t").distinct()
    rows = docs.where(~bare).withColumns(dict(zip(key, _identity())))
    return rows.join(keep.hint("merge"), key, "left_semi").dropDuplicates(key).select(*names).unionByName(docs.where(bare))
