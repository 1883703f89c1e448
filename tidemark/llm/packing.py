"""Best-fit packing of token pieces into sequences under several capacities at once.

Vector best-fit: a sequence has a residual vector (tokens, documents, attention cost, each as a share of its capacity);
pieces, longest first, go to the open sequence that fits on every capacity and leaves the smallest weighted residual
norm, or has the largest weighted dot product with the piece. Groups of bounded size are packed side by side: which
group a piece falls into is a hash, so no key can make one group large, and a group of thousands of pieces leaves
almost nothing to gain by joining groups.

Edge cases: empty texts (null ones are empty) are their end id alone; an empty table gives no rows; repeated rows and
doc_ids, null ones too, are packed once each; texts longer than a sequence are cut into pieces; of equally good sequences
the one opened first takes the piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import materialise


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, and what each residual weighs in the choice of a sequence.

    Attention cost is the sum of squared piece lengths; None: the square of the token limit, the least that lets a full
    piece in. documents None: no limit.
    """

    tokens: int = 2048
    documents: int | None = 64
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"  # or "dot"


#: Pieces of a group that is packed by one task.
GROUP_PIECES = 16_384


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    n = len(lengths)
    limit = np.array([cap.tokens, cap.documents or cap.tokens, cap.cost or cap.tokens**2], float)
    w = np.array(cap.weights)
    seq, off = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    room = np.empty((1024, 3))
    name = np.empty(1024, np.int64)
    filled = np.empty(1024, np.int64)
    n_open = n_seq = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if n_open:
            r = room[:n_open]
            fits = (r[:, 0] >= need[0]) & (r[:, 1] >= need[1]) & (r[:, 2] >= need[2])
            at = np.flatnonzero(fits)
        else:
            at = np.zeros(0, np.int64)
        if len(at):
            left = room[at]
            score = ((left - need) / limit) ** 2 @ w if cap.rule == "norm" else -((left / limit) * (need / limit)) @ w
            k = at[int(np.argmin(score))]
        else:
            if n_open == len(room):
                room, name, filled = np.concatenate([room, room]), np.concatenate([name, name]), np.concatenate([filled, filled])
            k = n_open
            room[k], name[k], filled[k] = limit, n_seq, 0
            n_open, n_seq = n_open + 1, n_seq + 1
        seq[i], off[i] = name[k], filled[k]
        room[k] -= need
        filled[k] += lengths[i]
        if room[k, 0] < 1 or room[k, 1] < 1 or room[k, 2] < 1:  # full: the last open one takes its place
            n_open -= 1
            room[k], name[k], filled[k] = room[n_open], name[n_open], filled[n_open]
    return seq, off


def pack_pieces(pieces: DataFrame, cap: Capacity = Capacity(), group: int = GROUP_PIECES) -> DataFrame:
    """pieces (with a column length) and, for each, sequence_id and offset, which take the place of columns so called.
    pieces must read the same rows each time."""
    pieces = pieces.drop("sequence_id", "offset")
    n = pieces.count()
    groups = max(1, -(-n // group))
    names = pieces.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seq, off = pack(pdf["length"].to_numpy(np.int64), cap)
        return pdf[names].assign(sequence_id=(int(key[0]) << 32) + seq, offset=off)

    dealt = pieces.withColumn("_tm_row", F.monotonically_increasing_id()).withColumn("_tm_group", F.expr(f"pmod(xxhash64(_tm_row), {groups})"))
    return dealt.select("_tm_group", *names).groupBy("_tm_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, cap: Capacity = Capacity(), end: int = 0, group: int = GROUP_PIECES) -> DataFrame:
    cut = materialise(tokens.pieces(docs, path, cap.tokens, end))
    return pack_pieces(cut, cap, group)
