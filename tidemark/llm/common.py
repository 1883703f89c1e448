"""What the training-data operators share: session set-up, shared storage, word scanning and hashing over Arrow buffers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import weakref
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to a Python worker; texts are long, so the default of 10,000 would need too much memory.
ARROW_ROWS = 256
#: Bytes of text that the numpy scanners handle at once.
BLOCK_BYTES = 1 << 20

_shipped: weakref.WeakSet = weakref.WeakSet()
_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, and bound the Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("tidemark", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; a temporary one only where that setting is
    absent and driver and executors are one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _dirs:
            _dirs[app] = tempfile.mkdtemp(prefix="tidemark-shared-")
        base = "file://" + _dirs[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read again: cuts the lineage, and no executor's loss takes the rows."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tm_path = path
    sweep(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: whatever was made from them has been written itself."""
    for df in tables:
        path = getattr(df, "_tm_path", None)
        if path:
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_held: dict[str, list[DataFrame]] = {}


def hold(spark: SparkSession, *tables: DataFrame) -> None:
    """Tables that a result still reads: they stay until release()."""
    _held.setdefault(spark.sparkContext.applicationId, []).extend(tables)


def release(docs: DataFrame) -> None:
    """Delete held tables, unless docs reads one of them. Called by a pipeline's stage on its input, which has been
    written and read again: what the stages before held has served."""
    held = _held.get(docs.sparkSession.sparkContext.applicationId, [])
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    reads = " ".join(leaves.apply(i).toString() + _roots(leaves.apply(i)) for i in range(leaves.length()))
    if not any(getattr(t, "_tm_path", "?").rsplit("/", 1)[-1] in reads for t in held):
        discard(*held)
        held.clear()


def _roots(leaf) -> str:
    """Paths that a leaf of a plan reads."""
    if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return ""
    return leaf.relation().location().rootPaths().mkString(" ")


#: A key that holds a thousandth of a table's rows or more is hot: there are a thousand of them at most.
HOT = 1000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined to facts (one row a key, with n, its number of rows): hot keys' rows stay where they are and meet their
    facts by broadcast, which HOT bounds; only the others are shuffled."""
    hot = F.col("n") * HOT >= total
    there = rows.join(F.broadcast(facts.where(hot).drop("n")), keys)
    rest = rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti")
    return there.unionByName(rest.join(facts.where(~hot).drop("n").hint("merge"), keys))


#: Seconds between sweeps: steps that take less leave little behind.
SWEEP_EVERY = 8.0
_swept = [0.0]


def sweep(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of plans that nothing refers to any more."""
    now = time.monotonic()
    if now - _swept[0] >= SWEEP_EVERY:
        _swept[0] = now
        gc.collect()
        spark.sparkContext._jvm.System.gc()


# ---- words of UTF-8 buffers ----

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of words of letters, digits and everything beyond ASCII.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_R = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << int(n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, the same wherever the run stands."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of some rows: first byte, end byte, row, and hash; row_at[r] : row_at[r + 1] are the words of row r."""

    __slots__ = ("data", "starts", "ends", "row_at", "hash")


def _scan(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = w[1:] != w[:-1]
    edge[0] = len(w) > 0 and w[0]
    edge[-1] = len(w) > 0 and w[-1]
    flips = np.flatnonzero(edge)
    starts, ends = flips[0::2], flips[1::2]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cuts = np.unique(inner[w[inner] & w[inner - 1]]) if len(inner) else inner
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, alnum: bool = False, hashed: bool = True) -> Words:
    """Whole texts, scanned in pieces cut between words so that memory stays bounded by the piece."""
    if lower:
        data = _LOWER[data]
    out = Words()
    out.data = data
    out.starts, out.ends = _scan(data, offs, _ALNUM if alnum else ~_SPACE)
    out.row_at = np.searchsorted(out.starts, offs)
    if hashed:
        n, lo, parts = len(out.starts), 0, []
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(out.ends, out.starts[lo] + BLOCK_BYTES, "right")))
            at = out.starts[lo]
            piece = data[at : out.ends[hi - 1]]
            s, e = out.starts[lo:hi] - at, out.ends[lo:hi] - at
            parts.append(mix(run_hashes(_BYTE[piece], s, e, _P) + (e - s).astype(np.uint64) * np.uint64(_R)))
            lo = hi
        out.hash = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return out


def spans(offs: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges of about limit bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def text_blocks(batches, text: str = "text", limit: int = BLOCK_BYTES):
    """(batch slice, bytes, offsets) of bounded size from an iterator of record batches."""
    for batch in batches:
        data, offs = buffers(batch.column(text))
        for lo, hi in spans(offs, limit):
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
