"""Token ids written in training order as fixed-stride shards.

Sequences are stored once as they are scanned, each with the number of its
partition and its place there; a running sum over one row per partition turns
that into dense ordinals 0..N-1.  A keyed Feistel permutation of the smallest
even power of two that holds N, walked until it falls below N (cycle-walking),
turns the ordinal into the global slot: a permutation of 0..N-1 that needs no
sort, no state and can be inverted.

The ids then move once, straight to the file of their slot range, and are
written as rows of one block each: ``block`` holds slots [block * BLOCK,
(block + 1) * BLOCK), ``data`` their ids as little-endian 16-bit integers,
``stride`` ids a sequence, padded.  The place of a slot is therefore arithmetic
(block, byte offset), and a reader resumes at any slot by reading on from its
block (``read_slots``).  The order is a function of the key and the scan, so
the same files read with the same split size give the same order.

Rows: a null or empty text has just the end id, one sequence.  Rows that
repeat a ``doc_id`` are separate documents; null ids are kept as null.  An empty
table writes no block.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common, tokens, worker

STRIDE = 512
BLOCK = 512
FILE_BLOCKS = 64
ROUNDS = 4
CODEC = "zstd"  # ids are too even for the lighter codecs


def _mix(half: np.ndarray, key: int, r: int, mask: np.uint64) -> np.ndarray:
    x = half ^ np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def permute(ordinals: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1 applied to ``ordinals``."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    out = np.asarray(ordinals).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _mix(left, key, r, mask), left
            else:
                left, right = right, left ^ _mix(right, key, r, mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]  # cycle-walking: step again until inside
    return out.astype(np.int64)


def two_bytes(ids: np.ndarray) -> np.ndarray:
    """Ids as stored, two bytes each; a larger vocabulary does not fit."""
    if ids.max() > 0xFFFF:
        raise ValueError(f"token id {ids.max()} does not fit into the two bytes an id has in a shard")
    return ids.astype("<u2")


def sequences(docs: DataFrame, paths: tuple[str, str], stride: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, part, nth, seq, length, ids binary): every document's ids and
    an end id 0, cut into pieces of ``stride``; nth counts within part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nth = tokens.byte_tokens(*paths).ids, itertools.count()
        for b in batches:
            out = []
            for doc, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = two_bytes(np.append(ids(text.as_py() or ""), np.uint32(0)))
                out += [(doc, part, next(nth), k, min(stride, len(raw) - at), raw[at : at + stride].tobytes()) for k, at in enumerate(range(0, len(raw), stride))]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "part", "nth", "seq", "length", "ids"])

    light = docs.select(F.col(id_col).cast("long"), F.spark_partition_id(), F.col(text_col).cast("string"))
    return worker.map_batches(light, rows, "doc_id long, part int, nth long, seq int, length int, ids binary")


def with_slots(seqs: DataFrame, key: int) -> tuple[DataFrame, int]:
    """``seqs`` (stored, with part and nth) with ``slot``; and their number."""
    sizes = seqs.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = common.stash(sizes.select("part", "n", before.alias("base")).coalesce(1), "parts")  # one row per partition
    total = bases.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(ordinal: pd.Series) -> pd.Series:
        return pd.Series(permute(ordinal.to_numpy(), total, key))

    placed = seqs.join(common.bounded(bases.select("part", "base"), 24), "part")
    return placed.withColumn("slot", slot(F.col("base") + F.col("nth"))).drop("part", "nth", "base"), total


def place(slot: Column, stride: int = STRIDE) -> tuple[Column, Column]:
    """Block of a slot and its byte offset there."""
    return F.floor(slot / BLOCK).cast("long"), (F.pmod(slot, F.lit(BLOCK)) * (2 * stride)).cast("long")


def materialise(docs: DataFrame, out: str, key: int = 20, stride: int = STRIDE, paths=None, id_col="doc_id", text_col="text") -> DataFrame:
    """Write the shards to ``out``; return the ledger: doc_id, seq, length,
    slot, block, byte_offset, ids_crc32."""
    seqs = common.stash(sequences(docs, paths or tokens.default_paths(), stride, id_col, text_col), "sequences", CODEC)
    slotted, total = with_slots(seqs, key)
    if total:
        _write(slotted, out, total, stride)
    block, offset = place(F.col("slot"), stride)
    return slotted.select("doc_id", "seq", "length", "slot", block.alias("block"), offset.alias("byte_offset"), F.crc32("ids").alias("ids_crc32"))


def _write(slotted: DataFrame, out: str, total: int, stride: int) -> None:
    span = FILE_BLOCKS * BLOCK  # slots of a file
    file = F.floor(F.col("slot") / span).cast("int")
    ordered = slotted.select("slot", "ids").repartitionById((total - 1) // span + 1, file).sortWithinPartitions("slot")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for slot, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rows and slot // BLOCK != at:
                    yield _block(at, rows)
                    rows = []
                at = slot // BLOCK
                rows.append(ids.ljust(2 * stride, b"\0"))
        if rows:
            yield _block(at, rows)

    def _block(at: int, rows: list[bytes]) -> pa.RecordBatch:
        data = b"".join(rows)
        cols = [pa.array([x], t) for x, t in ((at, pa.int64()), (len(rows), pa.int32()), (zlib.crc32(data), pa.int64()), (data, pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, ["block", "sequences", "crc32", "data"])

    worker.map_batches(ordered, blocks, "block long, sequences int, crc32 long, data binary").write.option("compression", CODEC).parquet(out)


def read_slots(spark: SparkSession, out: str, start: int, count: int, stride: int = STRIDE) -> DataFrame:
    """(slot, ids) of slots [start, start + count) in training order: only
    the row groups of the blocks needed are read."""
    first, last = start // BLOCK, (start + count - 1) // BLOCK

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(data, "<u2").reshape(n, stride).astype(np.int32)
                slots = block * BLOCK + np.arange(n)
                ok = (slots >= start) & (slots < start + count)
                yield pa.RecordBatch.from_arrays([pa.array(slots[ok]), pa.array(list(ids[ok]), pa.list_(pa.int32()))], ["slot", "ids"])

    found = spark.read.parquet(out).where(F.col("block").between(first, last)).select("block", "sequences", "data")
    return worker.map_batches(found, rows, "slot long, ids array<int>").orderBy("slot")
