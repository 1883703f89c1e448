"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

States are (role, first line of a turn or a further line). A line is observed as its speaker marker (of some role, or
none), its length, a question mark at its end, and whether a blank line stands before it. Viterbi finds the likeliest
states of a transcript's lines; a turn starts at each first-line state, its marker is taken off, and turns are rendered
in one canonical form.

Edge cases: null or empty transcripts have no turns; blank lines belong to no turn's edge; unknown roles are written as
users'; an empty table gives no rows; rows of a conversation that repeat in turn, role and text are one turn; ties in
turn stand in order of role and text; null turns come first, null texts are empty. A row holds at most 64 turn numbers
(null: with the first) and 4096 rows of a conversation, contiguous in order; a long conversation is many rows, decoded as
one transcript: the state is carried over the cuts, and a turn stands whole in the row where it starts. Lines of any
length are one observation. Of equally likely paths the one with the smallest states, from the end back, counts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import materialise

ROLES = ("system", "user", "assistant")
#: Names that speakers go by.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model"),
}
_ROLE = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
_MARK = re.compile(r"^\s*(?:[#>*\[(<|]+\s*)?(" + "|".join(sorted(_ROLE, key=len, reverse=True)) + r")\s*(?:[\])|*]+\s*)?(?:[:>]|\s-\s)\s*", re.IGNORECASE)

_N = len(ROLES)


def _logs(rows):
    """In whole steps of 2 ** -24: sums are exact, so that a transcript decoded in pieces has the states of the whole."""
    return np.rint(np.log(np.array(rows, float)) * 2**24).astype(np.int64)


# States 0..2: first line of a role's turn; 3..5: further lines.
_START = _logs([0.2, 0.72, 0.05, 0.01, 0.01, 0.01])
_MOVE = _logs(
    [
        # to: S, U, A first; S, U, A further
        [0.01, 0.57, 0.06, 0.36, 1e-9, 1e-9],
        [0.01, 0.02, 0.47, 1e-9, 0.50, 1e-9],
        [0.01, 0.40, 0.02, 1e-9, 1e-9, 0.57],
        [0.01, 0.57, 0.06, 0.36, 1e-9, 1e-9],
        [0.01, 0.02, 0.47, 1e-9, 0.50, 1e-9],
        [0.01, 0.40, 0.02, 1e-9, 1e-9, 0.57],
    ]
)
# Markers seen: S, U, A, none.
_MARKER = _logs([[0.9, 0.003, 0.003, 0.094], [0.003, 0.85, 0.003, 0.144], [0.003, 0.003, 0.85, 0.144], [0.002, 0.002, 0.002, 0.994], [0.002, 0.002, 0.002, 0.994], [0.002, 0.002, 0.002, 0.994]])
# Length: up to 80, up to 300, more characters.
_LENGTH = _logs([[0.5, 0.4, 0.1], [0.4, 0.45, 0.15], [0.25, 0.4, 0.35], [0.5, 0.4, 0.1], [0.4, 0.45, 0.15], [0.25, 0.4, 0.35]])
_QUESTION = _logs([[0.98, 0.02], [0.7, 0.3], [0.94, 0.06], [0.98, 0.02], [0.85, 0.15], [0.95, 0.05]])
_BLANK = _logs([[0.3, 0.7], [0.3, 0.7], [0.3, 0.7], [0.93, 0.07], [0.93, 0.07], [0.93, 0.07]])


def _forward(emit: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the last line's states, and for each line and state the likeliest state before it; before: the scores
    of the line before the first."""
    back = np.zeros((len(emit), 2 * _N), np.int8)
    best = before
    for t in range(len(emit)):
        if best is None:
            best = _START + emit[t]
            continue
        via = best[:, None] + _MOVE
        back[t] = via.argmax(axis=0)
        best = via[back[t], np.arange(2 * _N)] + emit[t]
    return best, back


def viterbi(emit: np.ndarray, before: np.ndarray | None = None, last: int | None = None) -> list[int]:
    """Likeliest states for emission log-probabilities (lines, 6), which may go on from scores and end in a state."""
    n = len(emit)
    if not n:
        return []
    best, back = _forward(emit, before)
    path = [int(best.argmax()) if last is None else last]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


def _transfer(emit: np.ndarray) -> np.ndarray:
    """Best scores (7, 6) over all lines from each state before them, or from the start, to each state of the last."""
    best = np.vstack([_MOVE, _START]) + emit[0]
    for e in emit[1:]:
        best = (best[:, :, None] + _MOVE).max(axis=1) + e
    return best


def _observe(text: str | None, blank: bool = True):
    """Lines that are not blank, their markers and emissions; blank: whether a blank line stands before the text."""
    lines, marks, emit = [], [], []
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = True
            continue
        m = _MARK.match(line)
        marks.append(m)
        lines.append(line)
        seen = _ROLE[m[1].lower()] if m else _N
        size = 0 if len(line) <= 80 else 1 if len(line) <= 300 else 2
        emit.append(_MARKER[:, seen] + _LENGTH[:, size] + _QUESTION[:, int(line.rstrip().endswith("?"))] + _BLANK[:, int(blank)])
        blank = False
    return lines, marks, np.array(emit, np.int64).reshape(-1, 2 * _N)


def _turns(lines, marks, path, going_on: bool = False) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Lines that belong to a turn before the text (if it goes on), and role and lines of each turn."""
    head: list[str] = []
    turns: list[tuple[str, list[str]]] = []
    for state, line, m in zip(path, lines, marks):
        if state < _N or not (turns or going_on):
            role = state % _N
            own = m is not None and _ROLE[m[1].lower()] == role
            turns.append((ROLES[role], [line[m.end() :] if own else line]))
        elif turns:
            turns[-1][1].append(line)
        else:
            head.append(line)
    return head, turns


def parse(text: str | None) -> list[tuple[str, str]]:
    """(role, content) of each turn of a raw transcript."""
    lines, marks, emit = _observe(text)
    return [(r, "\n".join(x).strip()) for r, x in _turns(lines, marks, viterbi(emit))[1]]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{c}\n<|end|>\n" for r, c in turns)


def format_transcripts(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its transcript column, and turns (array of role, content), n_turns, roles, rendered, which take the
    place of columns so called."""
    new = ("turns", "n_turns", "roles", "rendered")
    names = [c for c in df.columns if c != text and c not in new]

    def run(batches):
        kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
        for b in batches:
            turns = [parse(t.as_py()) for t in b.column("_tm_text")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(c) for c in names],
                    pa.array([[{"role": r, "content": c} for r, c in t] for t in turns], kind),
                    pa.array([len(t) for t in turns], pa.int64()),
                    pa.array([",".join(r for r, _ in t) for t in turns], pa.string()),
                    pa.array([render(t) for t in turns], pa.string()),
                ],
                [*names, "turns", "n_turns", "roles", "rendered"],
            )

    schema = "".join(f"`{c}` {t}, " for c, t in df.dtypes if c in names) + "turns array<struct<role: string, content: string>>, n_turns long, roles string, rendered string"
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_tm_text")).mapInArrow(run, schema)


TURNS, ROWS = 64, 4096


def _in_ranges(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """rows with part: crowded blocks in contiguous ranges of ROWS rows by turn, role and text, numbered per range slice."""
    here = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    calm = rows.join(crowded, here, "left_anti").withColumn("part", F.lit(0).cast("long"))
    order, group = ["turn", "role", "text"], ["conv_id", "block"]
    dealt = rows.join(crowded, here, "left_semi").repartitionByRange(*group, *order)
    dealt = materialise(dealt.withColumn("slice", F.spark_partition_id()))
    sizes = dealt.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("slice").alias("_s"), (F.sum("n").over(W.partitionBy(*group).orderBy("slice")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("rn", F.row_number().over(W.partitionBy(*group, "slice").orderBy(*order)) - 1)
    placed = inside.join(before, here & (F.col("slice") == F.col("_s"))).withColumn("part", F.expr(f"(before + rn) div {ROWS}"))
    return calm.unionByName(placed.select(*calm.columns))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts (conv_id, block, text) as they are found in the wild: marker styles differ by conversation, and
    in one style of four each third turn has no marker, only a blank line before it."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    rows = rows.withColumn("block", F.expr(f"coalesce(turn, 0) div {TURNS}"))
    crowded = rows.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b")).agg(F.count(F.lit(1)).alias("n")).where(f"n > {ROWS}").drop("n")
    crowded = materialise(crowded)
    if not crowded.isEmpty():
        rows = _in_ranges(materialise(rows), crowded)
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    lower = F.lower("role")
    colon = F.concat(F.initcap("role"), F.lit(": "))
    letters = F.when(lower == "user", F.lit("Q: ")).when(lower == "assistant", F.lit("A: ")).otherwise(F.concat(F.lit("["), lower, F.lit("]: ")))
    names = F.when(lower == "user", F.lit("Human> ")).when(lower == "assistant", F.lit("AI> ")).otherwise(F.concat(F.lit("### "), F.initcap("role"), F.lit(": ")))
    some = F.when(F.coalesce(F.col("turn"), F.lit(0)) % 3 == 2, F.lit("\n")).otherwise(colon)
    raw = F.concat(F.when(style == 0, colon).when(style == 1, letters).when(style == 2, names).otherwise(some), "text")
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text", raw.alias("raw"))))
    return rows.groupBy("conv_id", "block", "part").agg(F.array_join(F.transform(lines, lambda x: x.raw), "\n").alias("text"))


_KEY = ["conv_id", "block", "part"]
_KEYS = "conv_id long, block long, part long"


def _each(df: DataFrame, f, schema: str) -> DataFrame:
    """A row of the keys and f(row) for each row."""

    def run(batches):
        for b in batches:
            got = [f(r) for r in b.to_pylist()]
            keys = [b.column(c) for c in _KEY]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array([g[k] for g in got], t) for k, t in enumerate(target)]], [*_KEY, *names])

    names = [c.split(":")[0] for c in schema.split()]
    sql = {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "turns": pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))}
    target = [sql[c.split(":")[1]] for c in schema.split()]
    told = ", ".join(c.replace(":", " ") for c in schema.split()).replace("turns turns", "turns array<struct<role: string, content: string>>")
    return df.mapInArrow(run, f"{_KEYS}, {told}")


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    r = right.withColumnsRenamed({"conv_id": "_c", "block": "_b", "part": "_p"})
    return left.join(r, left.conv_id.eqNullSafe(r["_c"]) & (left.block == r["_b"]) & (left.part == r["_p"]), how).drop("_c", "_b", "_p")


def _emitted(text, blank):
    return _observe(text, blank)[2]


def _scores(x):
    return np.frombuffer(x, np.int64) if x else None


def decode_pieces(pieces: DataFrame) -> DataFrame:
    """_KEY and turns of pieces (_KEY, text) of conversations, each conversation decoded as one transcript.

    Pieces give their max-plus matrices; composed in order these give the scores before each piece, and with them the
    state before it for each state at its end; from the last piece back these give the state each piece ends in.
    """

    def matrices(r):
        e = [_emitted(r["text"], b) for b in (False, True)]
        return b"".join(_transfer(x).tobytes() for x in e) if len(e[0]) else b"", not r["text"].rsplit("\n", 1)[-1].strip()

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "part"])
        v, blank, scores, blanks = None, True, [], []
        for m, tail in zip(pdf["m"], pdf["tail"]):
            scores.append(b"" if v is None else v.tobytes())
            blanks.append(blank)
            if m:
                x = np.frombuffer(m, np.int64).reshape(2, 2 * _N + 1, 2 * _N)[int(blank)]
                v = x[-1] if v is None else (v[:, None] + x[:-1]).max(axis=0)
            blank = bool(tail)
        return pdf[_KEY].assign(scores=scores, blank=blanks)

    def ways(r):
        e = _emitted(r["text"], r["blank"])
        if not len(e):
            return b"", 0
        best, back = _forward(e, _scores(r["scores"]))
        at = np.arange(2 * _N)
        for t in range(len(e) - 1, -1, -1):
            at = back[t, at]
        return at.astype(np.int8).tobytes(), int(best.argmax())

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "part"], ascending=False)
        state, out = None, []
        for way, best in zip(pdf["way"], pdf["best"]):
            state = best if state is None and way else state
            out.append(-1 if state is None else state)
            state = int(np.frombuffer(way, np.int8)[state]) if way else state
        return pdf[_KEY].assign(last=out)

    def decode(r):
        lines, marks, emit = _observe(r["text"], r["blank"])
        head, turns = _turns(lines, marks, viterbi(emit, _scores(r["scores"]), r["last"]), bool(r["scores"]))
        return "\n".join(head) if head else None, [{"role": a, "content": "\n".join(x)} for a, x in turns]

    v = materialise(_each(pieces, matrices, "m:binary tail:boolean").groupBy("conv_id").applyInPandas(compose, f"{_KEYS}, scores binary, blank boolean"))
    pieces = materialise(_with(pieces, v))
    last = _each(pieces, ways, "way:binary best:long").groupBy("conv_id").applyInPandas(ends, f"{_KEYS}, last long")
    out = materialise(_each(_with(pieces, last), decode, "head:string turns:turns"))
    # lines of a turn that starts in an earlier piece go there
    place = F.struct("block", "part")
    owner = F.last(F.when(F.size("turns") > 0, place), ignorenulls=True).over(W.partitionBy("conv_id").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1))
    moved = out.select(*_KEY, "head", owner.alias("owner")).where("head is not null")
    more = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "head"))), lambda x: x.head), "\n")
    moved = moved.groupBy("conv_id", F.col("owner.block").alias("block"), F.col("owner.part").alias("part")).agg(more.alias("more"))
    return _with(out.drop("head"), moved, "left")


def _finish(r):
    turns = [[t["role"], t["content"]] for t in r["turns"]]
    if r["more"] is not None:
        turns[-1][1] += "\n" + r["more"]
    turns = [(a, c.strip()) for a, c in turns]
    return len(turns), ",".join(a for a, _ in turns), render(turns)


def report(conversations: DataFrame) -> DataFrame:
    pieces = materialise(transcripts(conversations))
    place = F.struct("block", "part")
    cut = materialise(pieces.groupBy(F.col("conv_id").alias("_c")).agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("_c"))
    if cut.isEmpty():
        return format_transcripts(pieces).drop("turns")
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    whole = format_transcripts(pieces.join(cut, same, "left_anti")).drop("turns")
    return whole.unionByName(_each(decode_pieces(materialise(pieces.join(cut, same, "left_semi"))), _finish, "n_turns:long roles:string rendered:string"))
