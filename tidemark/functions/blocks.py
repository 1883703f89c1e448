"""Arrow batches of bounded size, and what is counted in them before anything becomes a row of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch that goes to a Python worker; texts are long, so the default of 10,000 rows is too much.
ROWS, BYTES = 256, 16 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))


def gathered(batches, sizes: Callable[[pa.RecordBatch], pa.Array], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose sizes add up to limit at most; a larger row stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(sizes(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = int(np.searchsorted(ends, before + limit - size, "right"))
            if not held:
                hi = max(hi, lo + 1)
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1] - before)
                lo = hi
            if lo < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def text_sizes(at: int) -> Callable[[pa.RecordBatch], pa.Array]:
    return lambda batch: pc.binary_length(batch.column(at))


def list_sizes(at: int) -> Callable[[pa.RecordBatch], pa.Array]:
    return lambda batch: pc.list_value_length(batch.column(at))


def _first(x: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array is the first of its kind."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def grams(column: pa.Array, base: int = 0) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Different runs of three characters of some texts: the runs, offsets, and the numbers (from base) of the texts that
    have each, once a text. Characters become ranks in the block's own alphabet, so that run and text fit one number and
    one sort finds all; texts with too many different characters for that are halved."""
    n = len(column)
    data = pc.fill_null(column, "").cast(pa.large_binary())
    offs = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=at[1:])
    offs = at[offs - offs[0]]
    chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(chars) < 3:
        return
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    k = len(alphabet)
    if n > 1 and k**3 * n >= 1 << 63:
        yield from grams(column.slice(0, n // 2), base)
        yield from grams(column.slice(n // 2), base + n // 2)
        return
    rank = (np.cumsum(seen) - 1)[chars]
    text = np.repeat(np.arange(n), np.diff(offs))
    whole = text[:-2] == text[2:]
    key = ((((rank[:-2] * k + rank[1:-1]) * k + rank[2:]) * n) + text[:-2])[whole]
    key.sort()
    key = key[_first(key)]
    if not len(key):
        return
    code = key // n
    starts = np.flatnonzero(_first(code))
    runs = code[starts]
    shown = np.ascontiguousarray(alphabet[np.stack([runs // (k * k), runs // k % k, runs % k], 1)]).tobytes().decode("utf-32-le")
    yield [shown[i : i + 3] for i in range(0, len(shown), 3)], np.append(starts, len(key)), base + (key - code * n)


def counts(lists: pa.Array, how: Callable[[str], str] | None, known: dict[str, str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of some lists (in the form that how gives them), in how many lists each is, and how often. known
    keeps forms from block to block."""
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if how is not None:
        if len(known) > 1 << 19:
            known.clear()
        places: dict[str, int] = {}
        form = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            if (f := known.get(w)) is None:
                f = known[w] = how(w)
            form[i] = places.setdefault(f, len(places))
        words, codes = list(places), form[codes]
    n = len(lists)
    of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    pairs = codes * n + of
    pairs.sort()
    pairs = pairs[_first(pairs)]
    return words, np.bincount(pairs // max(n, 1), minlength=len(words)), np.bincount(codes, minlength=len(words))


def islands(batches) -> Iterator[pa.RecordBatch]:
    """blob, start, end, parts of overlapping or adjacent ranges, from batches (blob, start, end) in that order: one island
    and the greatest end of its blob are carried from batch to batch. Equal ranges count once."""
    names = ["blob", "start", "end", "parts"]
    open_ = None  # blob, start, end, parts of the open island, greatest end of its blob, last range
    for b in batches:
        if not b.num_rows:
            continue
        blob, start, end = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
        fresh = np.ones(len(start), bool)
        fresh[1:] = pc.not_equal(blob.slice(1), blob.slice(0, len(blob) - 1)).to_numpy(zero_copy_only=False)
        held = pa.array([], blob.type) if open_ is None else pa.array([open_[0]], blob.type)
        last = None
        if open_ is not None:
            fresh[0] = blob[0].as_py() != open_[0]
            last = open_[5]
        again = np.zeros(len(start), bool)
        again[1:] = ~fresh[1:] & (start[1:] == start[:-1]) & (end[1:] == end[:-1])
        again[0] = not fresh[0] and last == (start[0], end[0])
        of = np.cumsum(fresh)[~again]
        last = (start[-1], end[-1])
        start, end, blob = start[~again], end[~again], blob.filter(pa.array(~again))
        ones = np.ones(len(start), np.int64)
        reach = end
        if open_ is not None:
            of, start, end, ones, reach = (np.append(np.int64(x), y) for x, y in zip((0, open_[1], open_[2], open_[3], open_[4]), (of, start, end, ones, end)))
        n = len(start)
        order = np.argsort(reach, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        upto = reach[order[np.maximum.accumulate(of * n + rank) - of * n]]  # a greater of starts the maximum anew
        new = np.ones(n, bool)
        new[1:] = (of[1:] != of[:-1]) | (start[1:] > upto[:-1])
        heads = np.flatnonzero(new)
        all_blobs = pa.concat_arrays([held, blob])
        tops, parts = np.maximum.reduceat(end, heads), np.add.reduceat(ones, heads)
        if len(heads) > 1:
            done = heads[:-1]
            yield pa.RecordBatch.from_arrays([all_blobs.take(pa.array(done)), pa.array(start[done]), pa.array(tops[:-1]), pa.array(parts[:-1])], names)
        h = heads[-1]
        open_ = (all_blobs[int(h)].as_py(), start[h], tops[-1], parts[-1], upto[-1], last)
        kind = blob.type
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_[0]], kind), *[pa.array([int(x)], pa.int64()) for x in open_[1:4]]], names)
