"""Best-fit packing of documents into sequences under several capacities.

A document is its token ids and an end id.  One longer than a sequence is cut
into full pieces, the first taking the remainder; nothing else is cut.  Pieces
are dealt by hash into groups of about ``GROUP`` pieces, so that a long
document or a hot source spreads, and every group is packed on its own by
vector best-fit decreasing: a bin has residual tokens, documents and attention
cost (sum of squared lengths); among the bins where a piece fits in every
dimension it goes to the one with the largest weighted dot product of residual
and demand, or with the smallest weighted norm of what would be left; if none
fits it opens a bin.  A group closes all but at most a few bins tightly, so
groups cost about one sequence in several thousand.

Rows: a null or empty text is just the end id.  Rows that repeat a ``doc_id``
are separate documents (their pieces repeat); null ids are kept.  An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, tokens, worker

GROUP = 30_000
PIECE_SCHEMA = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and how the dimensions weigh in the choice.
    ``None`` stands for the most that its tokens allow: one document a token,
    and the attention cost of one document.  These never keep a piece out, but
    take part in the choice of its bin."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"  # or "dot"

    def limits(self) -> np.ndarray:
        most = (self.tokens, self.documents or self.tokens, self.attention or self.tokens**2)
        return np.array(most, float)


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece and its offset there.

    Pieces go in order of falling length.  Bins with equal residual vectors
    are alike, so the choice looks at the distinct vectors only; full bins
    leave the list."""
    limit = cap.limits()
    weight = np.array(cap.weights) / limit**2
    demands = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    if (demands > limit).any():
        raise ValueError("a piece is larger than an empty sequence")
    bins, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    kinds, live = np.zeros((64, len(limit))), np.zeros(64, bool)
    held: list[list[int]] = []  # open bins of each kind of residual
    index: dict[tuple, int] = {}
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        need, n = demands[i], len(held)
        fits = np.flatnonzero(live[:n] & (kinds[:n] >= need).all(1))
        if len(fits):
            room = kinds[fits]
            score = ((room - need) ** 2 * weight).sum(1) if cap.rule == "norm" else -(room * need * weight).sum(1)
            pick = int(fits[score.argmin()])
            b, rest = held[pick].pop(), kinds[pick] - need
            live[pick] = bool(held[pick])
        else:
            b, rest = len(used), limit - need
            used.append(0)
        bins[i], offset[i] = b, used[b]
        used[b] += int(lengths[i])
        if (rest < 1).any():
            continue
        at = index.setdefault(tuple(rest), n)
        if at == n:
            held.append([])
            if n == len(kinds):
                kinds, live = np.concatenate([kinds, np.zeros_like(kinds)]), np.concatenate([live, np.zeros_like(live)])
            kinds[n] = rest
        held[at].append(b)
        live[at] = True
    return bins, offset


def pieces(docs: DataFrame, paths: tuple[str, str], limit: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Pieces of every document with the CRC-32 of their ids (PIECE_SCHEMA)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokens.byte_tokens(*paths).ids
        for b in batches:
            out = []
            for doc, copy, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = np.append(ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
                cuts = [0, *range(len(raw) % limit or limit, len(raw), limit), len(raw)]
                out += [(doc, copy, p, s, e - s, zlib.crc32(raw[s:e].tobytes())) for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    # the copy number only keeps repeated rows apart
    light = docs.select(F.col(id_col).cast("long"), F.monotonically_increasing_id(), F.col(text_col).cast("string"))
    return worker.map_batches(light, rows, PIECE_SCHEMA)


def pack_documents(docs: DataFrame, cap: Capacity = Capacity(), paths: tuple[str, str] | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    cut = common.stash(pieces(docs, paths or tokens.default_paths(), cap.tokens, id_col, text_col), "pieces")
    groups = cut.count() // GROUP + 1
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "ids_crc32", "piece", "copy"), F.lit(groups)))

    def fill(rows: pa.Table) -> pa.Table:
        # the order within a group must not depend on how the shuffle arrived
        rows = rows.sort_by([(c, "descending") for c in ("length", "doc_id", "piece", "ids_crc32", "copy")])
        bins, offset = pack(rows["length"].to_numpy(), cap)
        made = {"sequence_id": (rows["g"][0].as_py() << 32) + bins, "offset": offset}
        for name, values in made.items():
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows.drop_columns(["copy", "g"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInArrow(worker.per_group(fill), schema)
