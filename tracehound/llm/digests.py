"""Document fingerprints: quartile bucket digests.

In every window of four bytes three triplets (bytes 1-2-3, 1-2-4, 1-3-4) are
hashed to one of ``BUCKETS`` buckets and counted; a last window of three bytes
gives its one triplet.  A bucket's code is 0 to 3, the quartile of all buckets
its count falls into.  The digest is hexadecimal text: two digits for the
length (eighths of an octave), then the codes, two to a digit.

Two digests differ by the sum of their code differences, at most as much as
unrelated digests with the same code frequencies differ on average; a share of
that bound is taken from 1, and up to half of the rest for the lengths.  So
``likeness`` is 1 for equal digests and near 0 for unrelated ones.  Texts of
under three bytes have no triplet: they are alike if their digests are equal.

``with_edits`` needs each text's follower in id order.  Rows are range
partitioned and sorted once, so each task sees followers in turn; only the
first and last row of each task meet in a second small join.

Rows: a null text is the empty text.  The order is descending id, null ids
last, rows of one id by a hash of the text; whole-row repeats follow each
other (they are split over tasks, so a row repeated without end is no hot
group).  A single row is its own follower.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import common, worker

BUCKETS = 256
BLOCK = 1 << 20
FACTOR = np.uint32(2654435761)
FLUSH = 500


def bucket_counts(data: bytes) -> np.ndarray:
    """Triplets in each bucket; long texts go block by block."""
    out = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, len(raw) - 2, BLOCK):
        a = raw[lo : lo + BLOCK + 3].astype(np.uint32)
        first, second, third, fourth = a << np.uint32(16), a << np.uint32(8), a, a[3:]
        n, m = min(len(a) - 2, BLOCK), min(len(a) - 3, BLOCK)
        kinds = [first[:n] | second[1 : n + 1] | third[2 : n + 2]]
        if m > 0:
            kinds.append((first[:m] | second[1 : m + 1] | fourth[:m]) + np.uint32(1 << 24))
            kinds.append((first[:m] | second[2 : m + 2] | fourth[:m]) + np.uint32(2 << 24))
        for t in kinds:
            out += np.bincount((t * FACTOR) >> np.uint32(24), minlength=BUCKETS)
    return out


def length_code(n: int) -> int:
    """Logarithm of n + 1 in eighths of an octave, 0 to 255."""
    e = (n + 1).bit_length() - 1
    return min(255, 8 * e + (((n + 1) << 3 >> e) & 7))


def digest(data: bytes) -> str:
    """The digest of a text's UTF-8 bytes."""
    c = bucket_counts(data)
    s = np.sort(c)
    code = sum((c > s[k * BUCKETS // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))
    four = code.reshape(-1, 4)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return f"{length_code(len(data)):02x}{packed.tobytes().hex()}"


def codes(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).reshape(-1).astype(np.int64)


_STEP = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :])


def likeness(a: str, b: str) -> float:
    """Of two digests, 0 to 1."""
    x, y = codes(a), codes(b)
    apart = int(np.abs(x - y).sum())
    unrelated = int(np.bincount(x, minlength=4) @ _STEP @ np.bincount(y, minlength=4))
    if unrelated == 0:
        return float(a == b)
    lengths = min(abs(int(a[:2], 16) - int(b[:2], 16)), 64)
    return (1.0 - min(1.0, BUCKETS * apart / unrelated)) * (1.0 - lengths / 128.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [digest((x.as_py() or "").encode()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    light = light.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return worker.map_batches(light, rows, f"doc_id {light.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edited(text: str, follower: str) -> str:
    """The last third (rounded down) replaced by the follower's beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


def _compare(row: tuple, follower: tuple) -> tuple:
    key, text, mark = row
    other = edited(text, follower[1]).encode()
    changed = digest(other)
    return key, len(text), hashlib.sha256(other).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, follower[2])


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited (likeness to its edited text) and
    near_next (likeness to its follower)."""
    light = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    # the last key only spreads whole-row repeats, which may swap places freely
    keyed = light.withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("nth")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = f"{made}, part int, edge string, edge_text string"

    def batch(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
        types = [like, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.string(), pa.string()]
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, out, like = TaskContext.get().partitionId(), None, [], None
        for b in batches:
            like = b.schema.field(0).type
            for key, text in zip(b.column(0), b.column(1)):
                t = text.as_py()
                row = (key.as_py(), t, digest(t.encode()))
                if last is None:
                    out.append((row[0], *[None] * 6, part, "first", t))
                else:
                    out.append((*_compare(last, row), part, None, None))
                last = row
                if len(out) >= FLUSH:
                    yield batch(out, like)
                    out = []
        if last is not None:
            yield batch([*out, (last[0], *[None] * 6, part, "last", last[1])], like)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, follower in zip(*b.columns):
                a, c = text.as_py(), follower.as_py()
                row = _compare((key.as_py(), a, digest(a.encode())), (None, c, digest(c.encode())))
                yield batch([(*row, None, None, None)], b.schema.field(0).type)

    done = common.stash(worker.map_batches(dealt, followed, schema), "digests", "zstd")
    firsts, lasts = done.where("edge = 'first'"), done.where("edge = 'last'")
    # one row per task that had rows; the last task's follower is the first's
    parts = firsts.select("part").withColumn("next", F.lead("part").over(W.orderBy("part")))
    parts = parts.withColumn("next", F.coalesce("next", F.min("part").over(W.partitionBy())))
    heads = firsts.select(F.col("part").alias("next"), F.col("edge_text").alias("follower"))
    edges = lasts.select("doc_id", "edge_text", "part").join(parts, "part").join(heads, "next").select("doc_id", "edge_text", "follower")
    names = [c.split()[0] for c in made.split(", ")]
    return done.where("edge IS NULL").select(names).unionByName(worker.map_batches(edges, joined, schema).select(names))
