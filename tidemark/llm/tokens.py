"""Token counts, binary token files (Re-Pair grammars) and token pieces, all with the tokenizers library's own ids.

A text is split at white space the way the tokenizer itself splits it, so that every chunk is encoded alone with the
same ids as in place; each distinct chunk (a pre-token with its leading space) goes through the tokenizer once for each
bounded table, and texts are then sums or concatenations over that table.

Edge cases: null texts are empty ones (no ids besides the end id, where one is added); an empty table gives no rows;
repeated rows and doc_ids give a row each, in (doc_id, text) order in the files, null doc_ids first; other input columns
are ignored. Texts of any length, and special strings however often they stand in one, are encoded whole; a document
longer than a shard is a shard of its own.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import _BYTE, _P, _Q, _R, buffers, mix, run_hashes, spans, sweep, text_blocks

#: The tokenizer's white space (the Unicode property White_Space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White-space level of the byte-level pattern: an optional space and what follows it, or a run of white space that leaves its last character.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: What keeps a text from the fast way to split it: white space at its ends, runs of it, and any but spaces and line feeds.
_ODD = "\\A[ \n]|[ \n]\\z|  | \n|\n |\n\n|[\0\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Distinct chunks of a worker's table; a fuller one drops the half that has gone unused for longest, which changes no result.
TABLE_CHUNKS = 1_000_000
#: Chunks that go through the tokenizer as one text, with a separator after each.
JOINED = 64
#: Bytes of a chunk from which on it is encoded wherever it stands, without the table.
LONG = 1 << 16


class Table:
    """Ids of chunks by 64-bit hash, with 32 bits of a second hash to compare: open addressing over flat arrays, looked
    up and filled for many chunks at once. An entry costs about 50 bytes, a fifth of what strings in a dictionary do."""

    def __init__(self, ids: np.dtype, limit: int):
        self.limit = limit
        self.bits = max(10, (2 * limit).bit_length())
        self._clear(ids)

    def _clear(self, ids: np.dtype) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.n = self.clock = 0
        self.hash, self.check, self.size, self.used = (np.zeros(0, t) for t in (np.uint64, np.uint32, np.int32, np.int32))
        self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, ids)
        self.n_flat = 0

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            k = self.key[slot]
            same = k == h[left]
            out[left[same]] = self.entry[slot[same]]
            go = ~same & (k != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        hit = np.flatnonzero(out >= 0)
        out[hit[self.check[out[hit]] != check[hit]]] = -1
        self.clock += 1
        self.used[out[out >= 0]] = self.clock
        return out

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, len(x) + len(x) // 2 + 1024) - len(x), x.dtype)])

    def fill(self, h: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray, used: np.ndarray) -> None:
        """Enter different chunks, of so many ids each, behind those that are there."""
        while 3 * (self.n + len(h)) > 2 * len(self.key):  # one block alone may hold more than the limit
            self.bits += 1
            self.key, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(self.hash[: self.n], np.arange(self.n, dtype=np.int32))
        n, m = self.n + len(h), self.n_flat + len(flat)
        self.hash, self.check, self.size, self.used, self.start = (self._room(x, n) for x in (self.hash, self.check, self.size, self.used, self.start))
        self.flat = self._room(self.flat, m)
        new = slice(self.n, n)
        self.hash[new], self.check[new], self.size[new], self.used[new] = h, check, size, used
        self.start[new] = self.n_flat + np.cumsum(size, dtype=np.int64) - size
        self.flat[self.n_flat : m] = flat
        self._place(h, np.arange(self.n, n, dtype=np.int32))
        self.n, self.n_flat = n, m

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[free]  # of several for one place the last stays, the others go on
            won = free & (self.key[slot] == h)
            self.entry[slot[won]] = entry[won]
            h, entry, slot = h[~won], entry[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def forget(self) -> None:
        used = self.used[: self.n]
        keep = np.sort(np.argpartition(-used, self.n // 2)[: self.n // 2])
        old = self.hash[keep], self.check[keep], self.size[keep], self.ids(keep), used[keep]
        clock = self.clock
        self._clear(self.flat.dtype)
        self.fill(*old)
        self.clock = clock

    def ids(self, entries: np.ndarray) -> np.ndarray:
        """Ids of the entries, one after another."""
        size = self.size[entries].astype(np.int64)
        ends = np.cumsum(size)
        src = np.repeat(self.start[entries] - (ends - size), size)
        src += np.arange(len(src))
        return self.flat[src]


class Chunks:
    """Ids of distinct chunks; kept by the worker process from task to task.

    New chunks are encoded many at once: each followed by a separator that the tokenizer always splits off as one id and
    that no chunk holds. Should separators come out in another number, chunks are encoded one by one.
    """

    _own: dict = {}

    @classmethod
    def of(cls, path: str, kind: str) -> "Chunks":
        if (path, kind) not in cls._own:
            cls._own[path, kind] = cls(path, kind)
        return cls._own[path, kind]

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = kind
        specials = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        special = "|".join(map(re.escape, specials))
        self.special = re.compile(f"({special})") if specials else None
        self.odd = f"{_ODD}|{special}" if specials else _ODD
        self.type = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) < 1 << 16 else "<u4")
        # white space but for the byte-level kind leaves no id: there a digit stands alone
        self.sep, self.bar = ("\n", "\n") if kind == "bytes" else (" 7 ", "7")
        got = self._plain([self.sep])[0]
        self.sep_id = int(got[0]) if len(got) == 1 else None
        self.table = Table(self.type, TABLE_CHUNKS)

    def split(self, text: str) -> list[str]:
        if self.kind == "words":  # white space yields no ids in this vocabulary: any split there will do
            return text.replace("\n", " ").split(" ")
        if self.special is not None and self.special.search(text):  # an added token ends the text before it
            parts = self.special.split(text)
            return [c for i, x in enumerate(parts) for c in ((x,) if i % 2 else _CHUNK.findall(x))]
        return _CHUNK.findall(text)

    def _split_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Chunks of all texts, where each text's begin (texts + 1), and which text that is: those that can be split at
        every space and line feed stand first."""
        if self.kind == "words":
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            return lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), np.arange(len(texts))
        odd = pc.match_substring_regex(texts, self.odd)
        cut = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(cut, "\0")
        flags = odd.to_numpy(zero_copy_only=False)
        rest = [self.split(texts[i].as_py()) for i in np.flatnonzero(flags).tolist()]
        flat = pa.concat_arrays([lists.flatten(), pa.array([c for x in rest for c in x], pa.string())])
        n = np.concatenate([np.diff(lists.offsets.to_numpy()), np.fromiter(map(len, rest), np.int64, len(rest))])
        return flat, np.concatenate([[0], np.cumsum(n)]), np.concatenate([np.flatnonzero(~flags), np.flatnonzero(flags)])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._plain(chunks)
        return np.array(list(map(len, ids)), np.int32), np.concatenate([np.zeros(0, self.type), *ids])

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids; none of the chunks holds a separator or a special string."""
        if self.sep_id is None or not new:
            return self._each(new)
        groups = (new[i : i + JOINED] for i in range(0, len(new), JOINED))
        ids = np.concatenate(self._plain([self.sep.join([*g, ""]) for g in groups]))
        bar = ids == self.sep_id
        at = np.flatnonzero(bar)
        return ((np.diff(at, prepend=-1) - 1).astype(np.int32), ids[~bar]) if len(at) == len(new) else self._each(new)

    def _entries(self, chunks: pa.Array) -> np.ndarray:
        """Entry of each of these different chunks (LONG bytes at most) in the table, where new ones are entered."""
        h, check = _hashes(*buffers(chunks))
        at = self.table.find(h, check)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            if self.table.n and self.table.n + len(gaps) > self.table.limit:  # entries move: look all up again after that
                self.table.forget()
                at = self.table.find(h, check)
                gaps = np.flatnonzero(at < 0)
            new = _strings(chunks.take(pa.array(gaps)))
            alone = np.array([not c or self.bar in c or (self.special is not None and "<" in c) for c in new])
            for which, how in ((~alone, self._encode), (alone, self._each)):
                k = gaps[which]
                if len(k):
                    size, flat = how([new[i] for i in np.flatnonzero(which).tolist()])
                    at[k] = self.table.n + np.arange(len(k))
                    self.table.fill(h[k], check[k], size, flat, np.full(len(k), self.table.clock, np.int32))
        return at

    def _distinct(self, texts: pa.Array):
        """Sizes and ids of the different chunks of these texts, the chunks of all texts as places among them, and where
        each text's begin, as _split_all has it."""
        flat, begin, row = self._split_all(texts)
        coded = flat.dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy()
        long = np.flatnonzero(pc.binary_length(words).to_numpy() > LONG)
        if not len(long):
            at = self._entries(words)
            return self.table.size[at].astype(np.int64), self.table.ids(at), place, begin, row
        short = np.setdiff1d(np.arange(len(words)), long)
        at, (size, ids) = self._entries(words.take(pa.array(short))), self._each([words[i].as_py() for i in long.tolist()])
        order = np.argsort(np.concatenate([short, long]), kind="stable")
        sizes = np.concatenate([self.table.size[at], size]).astype(np.int64)
        both, ends = np.concatenate([self.table.ids(at), ids]), np.cumsum(sizes)
        n = sizes[order]
        src = np.repeat((ends - sizes)[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return n, both[src], place, begin, row

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text: the chunks' counts joined to the text's own frequencies of them, without its ids."""
        size, _, place, begin, row = self._distinct(texts)
        out = np.zeros(len(texts), np.int64)
        for i, a, b in zip(row.tolist(), begin, begin[1:]):
            which, times = np.unique(place[a:b], return_counts=True)
            out[i] = size[which] @ times
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end, and their offsets (texts + 1)."""
        size, ids, place, begin, row = self._distinct(texts)
        width = self.type.itemsize
        offs = np.concatenate([[0], np.cumsum(size)]) * width
        stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(ids)])
        data, at = _bytes(stored.take(pa.array(place)))
        at = at[begin].tolist()
        rows: list = [b""] * len(texts)
        for i, a, b in zip(row.tolist(), at, at[1:]):
            rows[i] = data[a:b]
        close = np.array([end], self.type).tobytes()
        out = b"".join([x for r in rows for x in (r, close)])
        ends = np.cumsum([len(r) + width for r in rows], dtype=np.int64) // width
        return np.frombuffer(out, self.type).astype(np.uint32), np.concatenate([[0], ends])


def _hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each string, the first never 0."""
    h, check = np.empty(len(offs) - 1, np.uint64), np.empty(len(offs) - 1, np.uint32)
    for lo, hi in spans(offs):
        piece, s, e = _BYTE[data[offs[lo] : offs[hi]]], offs[lo:hi] - offs[lo], offs[lo + 1 : hi + 1] - offs[lo]
        h[lo:hi] = mix(run_hashes(piece, s, e, _P) + (e - s).astype(np.uint64) * np.uint64(_R)) | np.uint64(1)
        check[lo:hi] = (mix(run_hashes(piece, s, e, _Q) ^ np.uint64(_R)) >> np.uint64(32)).astype(np.uint32)
    return h, check


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, which makes strings one by one."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "\0")[0].as_py()
    out = whole.split("\0") if len(column) else []
    return out if len(out) == len(column) else column.to_pylist()


def _bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Data of a large_binary column and the offsets of its rows (n + 1)."""
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), at


#: Bytes of text that go through the table at once: the larger, the fewer different chunks a byte.
GATHERED = 3 << 20


def _texts(batches):
    """(rows, texts without nulls) of about GATHERED bytes, a row at least."""
    held, size = [], 0
    for rows, data, _ in text_blocks(batches, limit=GATHERED):
        held.append(rows)
        size += len(data)
        if size >= GATHERED:
            yield _whole(held)
            held, size = [], 0
    if held:
        yield _whole(held)


def _whole(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, pa.Array]:
    rows = pa.concat_batches(held)
    return rows, rows.column("text").fill_null("")


def count(docs: DataFrame, path: str, limit: int = 512, kind: str = "bytes") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def run(batches):
        table = Chunks.of(path, kind)
        for rows, texts in _texts(batches):
            n = pa.array(table.counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def pieces(docs: DataFrame, path: str, length: int, end: int, kind: str = "words") -> DataFrame:
    """Each document's ids and end id, cut only where longer than length: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        table = Chunks.of(path, kind)
        for rows, texts in _texts(batches):
            flat, offs = table.encode(texts, end)
            ids = rows.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i, d in enumerate(ids):
                a, b = int(offs[i]), int(offs[i + 1])
                for k, s in enumerate(range(a, b, length)):
                    e = min(b, s + length)
                    for col, v in zip(out, (d, k, s - a, e - s, zlib.crc32(flat[s:e].tobytes()))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- Re-Pair shards ----

#: Ids of a shard: one grammar each, small enough to build and to decode in a task's memory.
SHARD_IDS = 1 << 20
#: A round of pair replacement takes this share of the nonterminals left, or so many at least: few rounds, and late
#: ones can still pair what early ones made.
SHARE, FLOOR = 4, 1024
#: Places of the table by which a round finds its pairs; of two pairs in one place the rarer waits for a later round.
SLOTS = 1 << 18


def grammar(seq: np.ndarray, offs: np.ndarray, first: int, room: int = 1 << 16, least: int = 6):
    """Re-Pair: in each round the most frequent id pairs become nonterminals (first, first + 1, ...), leftmost and more
    frequent occurrences before others, until no pair occurs least times or the nonterminals below room are used up.
    Pairs never cross a document's end. Returns symbols, document offsets in symbols, rules (n, 2), and the expansion
    length of each rule."""
    seq, offs = seq.astype(np.uint32), offs.astype(np.int64)
    rules: list[np.ndarray] = []
    lens = np.ones(first, np.int64)
    n_rules = 0
    bits, kind = (16, np.uint32) if room <= 1 << 16 else (32, np.uint64)
    none = kind(np.iinfo(kind).max)
    spread, down = kind(0x9E3779B1 if bits == 16 else 0x9E3779B97F4A7C15), kind(2 * bits - SLOTS.bit_length() + 1)
    while len(seq) > least and n_rules < room - first:
        code = (seq[:-1].astype(kind) << kind(bits)) | seq[1:]
        last = offs[1:-1] - 1
        code[last[(last >= 0) & (last < len(code))]] = none
        s = np.sort(code)
        often = s[: len(s) - least + 1][s[least - 1 :] == s[: len(s) - least + 1]]
        often = often[often != none]
        if not len(often):
            break
        edge = np.flatnonzero(np.concatenate([[True], often[1:] != often[:-1]]))
        n, often = np.diff(np.append(edge, len(often))), often[edge]
        left = room - first - n_rules
        budget = min(left, max(FLOOR, left // SHARE))
        # twice as many as may stay: overlaps with more frequent pairs leave some without use
        chosen = often[np.argsort(-n, kind="stable")[: 2 * budget]]
        unused = len(chosen)
        table = np.full(SLOTS, unused - 1, np.int32)
        table[((chosen * spread) >> down)[::-1]] = np.arange(unused - 1, -1, -1)
        at = table[(code * spread) >> down]
        rank = np.full(len(code) + 2, unused, np.int32)
        rank[1:-1][chosen[at] == code] = at[chosen[at] == code]
        pos = np.flatnonzero(rank[1:-1] < unused)
        own = rank[pos + 1]
        free = (own < rank[pos]) & (own <= rank[pos + 2])  # of overlapping occurrences, never two
        pos, own = pos[free], own[free]
        hits = np.bincount(own, minlength=unused)
        used = np.flatnonzero(hits >= 3)  # a rule costs as much as two symbols
        if len(used) > budget:
            used = np.sort(used[np.argsort(-hits[used], kind="stable")[:budget]])
        if not len(used):
            break
        new = np.full(unused, -1, np.int64)
        new[used] = first + n_rules + np.arange(len(used))
        symbol = new[own]
        pos, symbol = pos[symbol >= 0], symbol[symbol >= 0]
        seq[pos] = symbol
        keep = np.ones(len(seq), bool)
        keep[pos + 1] = False
        offs = offs - np.searchsorted(pos + 1, offs)
        seq = seq[keep]
        pair = np.stack([chosen[used] >> kind(bits), chosen[used] & kind((1 << bits) - 1)], axis=1).astype(np.uint32)
        rules.append(pair)
        lens = np.concatenate([lens, lens[pair[:, 0]] + lens[pair[:, 1]]])
        n_rules += len(used)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return seq, offs, flat, lens[first:]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of any run of symbols. What each rule stands for is written out once (a rule names earlier ones only, so each
    pass replaces nonterminals by their pairs), and symbols then pick their stretch of it."""
    s = symbols.astype(np.int64)
    if not (s >= first).any():
        return s.astype(np.uint32)
    flat, ends = rules.astype(np.int64).ravel(), 2 * np.arange(1, len(rules) + 1)
    while (big := flat >= first).any():
        grown = np.cumsum(1 + big)
        at = grown - 1 - big
        out = np.empty(int(grown[-1]), np.int64)
        pair = rules[flat[big] - first]
        out[at[~big]] = flat[~big]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        flat, ends = out, grown[ends - 1]
    # ids stand for themselves: a table of all of them before the rules' stretches
    table = np.concatenate([np.arange(first, dtype=np.uint32), flat.astype(np.uint32)])
    start = np.concatenate([np.arange(first), first + ends - np.diff(ends, prepend=0)]).astype(np.int32)
    size = np.concatenate([np.ones(first, np.int32), np.diff(ends, prepend=0).astype(np.int32)])
    n = size[s]
    upto = np.cumsum(n, dtype=np.int64)
    src = np.repeat((start[s] - (upto - n)).astype(np.int64), n)
    src += np.arange(len(src))
    return table[src]


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, a: int, b: int) -> np.ndarray:
    """Ids a to b of what the symbols stand for: expansion lengths tell which symbols to expand, the others stay as they are."""
    s = symbols.astype(np.int64)
    size = np.ones(len(s), np.int64)
    size[s >= first] = lengths[s[s >= first] - first]
    ends = np.cumsum(size)
    b = min(b, int(ends[-1]) if len(ends) else 0)
    if a >= b:
        return np.zeros(0, np.uint32)
    lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
    skip = a - int(ends[lo] - size[lo])
    return expand(s[lo:hi], rules, first)[skip : skip + b - a]


_SHARD = "part int, shard int, first long, n_ids long, width int, doc_ids array<long>, n_tokens array<int>, symbol_at array<int>, rules binary, lengths binary, symbols binary"


def write_shards(docs: DataFrame, path: str, to: str, end: int = 2, kind: str = "bytes", shard_ids: int = SHARD_IDS) -> None:
    """Encode documents in ascending doc_id order and write grammar shards below the path to, one row each:
    part and shard (their order), first (first nonterminal), document ids, token counts and symbol offsets, rules,
    expansion lengths and symbols as little-endian integers of width bytes. Spark's committer keeps one copy of a
    retried task's shards."""

    def run(batches):
        from pyspark import TaskContext

        table, part, shard = Chunks.of(path, kind), TaskContext.get().partitionId(), 0
        first = table.tok.get_vocab_size(with_added_tokens=True)
        names = [x.split()[0] for x in _SHARD.split(", ")]
        held: list = []

        def flush():
            nonlocal shard
            ids = [d for h in held for d in h[0]]
            seq = np.concatenate([h[1] for h in held])
            n = np.concatenate([np.diff(h[2]) for h in held])
            offs = np.concatenate([[0], np.cumsum(n)])
            width = 2 if first < 1 << 16 else 4
            sym, at, rules, lens = grammar(seq, offs, first, 1 << (16 if width == 2 else 24))
            put = lambda x: x.astype(f"<u{width}").tobytes()
            row = (part, shard, first, len(seq), width, ids, n.tolist(), at.tolist(), put(rules), lens.astype("<u4").tobytes(), put(sym))
            shard += 1
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        size = 0
        for rows, texts in _texts(batches):
            flat, offs = table.encode(texts, end)
            held.append((rows.column("doc_id").to_pylist(), flat, offs))
            size += len(flat)
            if size >= shard_ids:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, _SHARD).write.parquet(to)
    sweep(docs.sparkSession)


def read_documents(spark, at: str, doc_ids: list[int], start: int = 0, length: int | None = None) -> DataFrame:
    """Random access: doc_id and ids (from start on, length of them at most) of the named documents. Of a shard that
    holds one, only that document's symbols are expanded, and of these only what the range needs."""
    wanted = sorted(set(doc_ids))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                kind = f"<u{r['width']}"
                rules, sym = np.frombuffer(r["rules"], kind).reshape(-1, 2).astype(np.int64), np.frombuffer(r["symbols"], kind)
                lens = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                hit = [i for i, d in enumerate(r["doc_ids"]) if d in keep]
                end = [r["n_tokens"][i] if length is None else start + length for i in hit]
                ids = [expand_range(sym[r["symbol_at"][i] : r["symbol_at"][i + 1]], rules, lens, r["first"], start, e).tolist() for i, e in zip(hit, end)]
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][i] for i in hit], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    keep = set(wanted)
    files = spark.read.parquet(at).where(F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast("long") for d in wanted])) if wanted else F.lit(False))
    return files.mapInArrow(run, "doc_id long, ids array<long>")


def read_shards(spark, at: str) -> DataFrame:
    """Decode shard files: doc_id, start, n_tokens, ids_crc32 for every document, in the files' order."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                kind = f"<u{r['width']}"
                rules, sym = np.frombuffer(r["rules"], kind).reshape(-1, 2).astype(np.int64), np.frombuffer(r["symbols"], kind)
                ids = expand(sym, rules, r["first"])
                offs = np.concatenate([[0], np.cumsum(r["n_tokens"])]).astype(np.int64)
                if int(offs[-1]) != len(ids):
                    raise ValueError(f"shard {r['part']}/{r['shard']} decodes to {len(ids)} ids, its index has {offs[-1]}")
                crc = [zlib.crc32(ids[offs[i] : offs[i + 1]].tobytes()) for i in range(len(offs) - 1)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(offs[:-1]), pa.array(r["n_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(at)
    heads = files.select("part", "shard", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    shards = heads.select("part", "shard", (F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("shard_start"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    rows = files.mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
