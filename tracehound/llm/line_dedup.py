"""Incremental, reversible line de-duplication.

State lives in the shared folder as three tables, sharded by key hash:

* **refs** – one row per (line key, document): the exact references;
* **counts** – one row per key: how many documents hold it and the largest of
  them (exact reference counts, derived from the references);
* **filters** – per shard one cuckoo filter over the keys whose count has
  reached ``min_docs`` ("common" keys).  A cuckoo filter can forget a key, so
  deleting documents takes back what inserting them did.

A line is first looked up in its shard's filter; only hits go on to the exact
join with the counts, which removes false positives.  All other lines (nearly
all) never reach that join.  ``delete`` drops a document's references,
recounts the keys it held and deletes from the filters those that are no
longer common: state and decisions are then those of never having inserted it.

A key is the line without white space at both ends, A-Z lower-cased; keys of
fewer than ``min_chars`` code points never count.  Keys are 128-bit hashes.

Rows: a null or empty text is one empty line.  Rows that share a ``doc_id``
are one document; a null ``doc_id`` is a document smaller than any other.  A
key repeated within a document counts once, and in the document that keeps it
all its lines stay.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common, worker

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 32768
GROUP_ROWS = 200_000
REF_SCHEMA = "k1 long, k2 long, doc_id long"


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128-bit key of a line, or None if it is too short to count."""
    key = line.strip(common.WHITE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    d = xxhash.xxh3_128_digest(key.lower())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, partial-key cuckoo hashing.
    ``add`` returns False when full; the caller rebuilds at twice the size."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.n = buckets
        self.cells = np.zeros((buckets, self.SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(buckets, self.SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (cls.SLOTS * 0.85))))))

    @staticmethod
    def _spread(fp: np.ndarray) -> np.ndarray:
        return (fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        fp = ((k2.astype(np.int64).view(np.uint64) % np.uint64(65535)) + np.uint64(1)).astype(np.uint16)
        mask = np.uint64(self.n - 1)
        a = (k1.astype(np.int64).view(np.uint64) >> np.uint64(20)) & mask
        return fp, a, (a ^ self._spread(fp)) & mask

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(k1, k2)
        return (self.cells[a] == fp[:, None]).any(1) | (self.cells[b] == fp[:, None]).any(1)

    def add(self, k1: int, k2: int) -> bool:
        fp, a, b = (x[0] for x in self.places(np.array([k1]), np.array([k2])))
        for at in (a, b):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = fp
                return True
        at = a
        for kick in range(self.KICKS):
            slot = (int(fp) + kick) % self.SLOTS
            fp, self.cells[at, slot] = self.cells[at, slot], fp
            at = (at ^ self._spread(np.array([fp]))[0]) & np.uint64(self.n - 1)
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = fp
                return True
        return False

    def remove(self, k1: int, k2: int) -> bool:
        fp, a, b = (x[0] for x in self.places(np.array([k1]), np.array([k2])))
        for at in (a, b):
            here = np.flatnonzero(self.cells[at] == fp)
            if len(here):
                self.cells[at, here[0]] = 0
                return True
        return False


def filled(k1, k2) -> CuckooFilter:
    """A filter that holds all the keys, grown until they fit."""
    f = CuckooFilter.sized(len(k1))
    while not all(f.add(a, b) for a, b in zip(k1, k2, strict=True)):
        f = CuckooFilter(2 * f.n)
    return f


def line_refs(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id): the distinct counting keys of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int | None]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                out += [(*k, doc) for k in {line_key(x, min_chars) for x in raw.split(b"\n")} - {None}]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k1", "k2", "doc_id"])

    return worker.map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, REF_SCHEMA)


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = filled(pdf.k1.to_numpy(), pdf.k2.to_numpy())
    return pd.DataFrame({"shard": pdf.shard[:1], "buckets": [f.n], "cells": [f.cells.tobytes()]})


FILTER_SCHEMA = "shard int, buckets long, cells binary"


@dataclass
class LineIndex:
    """References, counts and filters of the documents inserted so far."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def build(cls, docs: DataFrame, id_col="doc_id", text_col="text", min_docs=MIN_DOCS, min_chars=MIN_CHARS) -> LineIndex:
        """Index of a first batch.  The number of shards follows the number of
        common keys, so that a shard's filter stays within one task."""
        refs = common.stash(line_refs(docs, id_col, text_col, min_chars).groupBy("k1", "k2", "doc_id").agg(F.lit(1)).select("k1", "k2", "doc_id"), "line-refs")
        counts = common.stash(_counted(refs), "line-counts")
        shards = counts.where(F.col("n_docs") >= min_docs).count() // SHARD_KEYS + 1
        return cls._filtered(refs, counts, shards, min_docs, min_chars)

    @classmethod
    def _filtered(cls, refs: DataFrame, counts: DataFrame, shards: int, min_docs: int, min_chars: int) -> LineIndex:
        """The index of stored references and counts, with its filters built."""
        index = cls(refs, counts, None, shards, min_docs, min_chars)
        index.filters = common.stash(index._common(counts).groupBy("shard").applyInPandas(_build, FILTER_SCHEMA), "line-filters")
        return index

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int"))

    def _common(self, counts: DataFrame) -> DataFrame:
        return self._sharded(counts.where(F.col("n_docs") >= self.min_docs).select("k1", "k2"))

    def _moved(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index after the references became ``refs``; only ``touched``
        keys are counted again and only their shards' filters edited, unless
        the common keys have outgrown the shards: then all are built anew."""
        key = ["k1", "k2"]
        fresh = _counted(refs.join(touched, key, "left_semi"))
        counts = common.stash(self.counts.join(touched, key, "left_anti").unionByName(fresh), "line-counts")
        shards = counts.where(F.col("n_docs") >= self.min_docs).count() // SHARD_KEYS + 1
        if shards > self.shards:
            return LineIndex._filtered(refs, counts, shards, self.min_docs, self.min_chars)
        was, now = self._common(self.counts), self._common(counts)
        edits = now.join(was, key, "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, key, "left_anti").withColumn("add", F.lit(False)))

        def edit(_, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = int((old if len(old) else new).shard.iloc[0])
            f = CuckooFilter(int(old.buckets.iloc[0]), old.cells.iloc[0]) if len(old) else CuckooFilter.sized(len(new))
            for k1, k2 in new.loc[~new["add"], key].itertuples(index=False):
                f.remove(k1, k2)
            ok = all(f.add(k1, k2) for k1, k2 in new.loc[new["add"], key].itertuples(index=False))
            return pd.DataFrame({"shard": [shard], "buckets": [f.n if ok else 0], "cells": [f.cells.tobytes()]})

        filters = common.stash(self.filters.groupBy("shard").cogroup(edits.groupBy("shard")).applyInPandas(edit, FILTER_SCHEMA), "line-filters")
        full = filters.where("buckets = 0").select("shard")  # overfull: built anew, larger
        if not full.isEmpty():
            again = now.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, FILTER_SCHEMA)
            filters = common.stash(filters.where("buckets > 0").unionByName(again), "line-filters")
        return LineIndex(refs, counts, filters, self.shards, self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame, id_col="doc_id", text_col="text") -> LineIndex:
        new = common.stash(line_refs(docs, id_col, text_col, self.min_chars).distinct(), "line-refs")
        refs = common.stash(self.refs.unionByName(new).distinct(), "line-refs")
        return self._moved(refs, new.select("k1", "k2").distinct())

    def delete(self, ids: DataFrame, id_col="doc_id") -> LineIndex:
        """Forget the documents whose ids ``ids`` holds."""
        gone = ids.select(F.col(id_col).cast("long").alias("gone")).distinct()
        match = F.col("doc_id").eqNullSafe(F.col("gone"))
        touched = common.stash(self.refs.join(gone, match, "left_semi").select("k1", "k2").distinct(), "line-touched")
        refs = common.stash(self.refs.join(gone, match, "left_anti"), "line-refs")
        return self._moved(refs, touched)

    def drops(self, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, k1, k2): lines to drop.  Filter probes run on groups of one
        shard and one salt, so neither a common key nor a large shard meets
        in one task; the exact join follows."""
        refs = self._sharded(self.refs if refs is None else refs)
        salts = refs.count() // (self.shards * GROUP_ROWS) + 1
        dealt = refs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "k2"), F.lit(salts)))
        copies = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))

        def probe(lines: pa.Table, blob: pa.Table) -> pa.Table:
            lines = lines.select(["k1", "k2", "doc_id"])
            if not blob.num_rows or not lines.num_rows:
                return lines.slice(0, 0)
            f = CuckooFilter(blob["buckets"][0].as_py(), blob["cells"][0].as_py())
            return lines.filter(pa.array(f.has(lines["k1"].to_numpy(), lines["k2"].to_numpy())))

        hits = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(worker.per_group(probe), REF_SCHEMA)
        exact = self.counts.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "max_doc")
        return hits.join(exact, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc"))).select("doc_id", "k1", "k2")

    def rewrite(self, docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
        """``docs`` with the text replaced by its remaining lines (null texts
        stay null) and columns n_lines, n_dropped, kept_sha256 added."""
        gone = self.drops().groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("_drop"))
        gone = common.stash(gone.withColumnRenamed("doc_id", "_doc"), "line-drops")
        # a row of 16-byte keys, at most one per line; the sum is counted
        held = gone.agg(F.sum(F.size("_drop"))).first()[0] or 0
        gone = common.bounded(gone, 40, rows=held)
        docs = docs.drop("n_lines", "n_dropped", "kept_sha256", "_drop", "_doc")
        joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_doc")), "left").drop("_doc")
        at, min_chars = docs.columns.index(text_col), self.min_chars
        schema = docs.schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

        def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, lines, dropped, digests = [], [], [], []
                for text, drop in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    parts = raw.split(b"\n")
                    n = len(parts)
                    if drop.is_valid:
                        bad = {(x["k1"], x["k2"]) for x in drop.as_py()}
                        parts = [x for x in parts if line_key(x, min_chars) not in bad]
                        raw = b"\n".join(parts)
                    lines.append(n)
                    dropped.append(n - len(parts))
                    digests.append(hashlib.sha256(raw).hexdigest())
                    texts.append(raw if text.is_valid else None)
                cols = [b.column(i) for i in range(b.num_columns - 1)]
                cols[at] = pa.array(texts, pa.binary()).cast(b.column(at).type)
                cols += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

        return worker.map_batches(joined, edit, schema)


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_docs=MIN_DOCS, min_chars=MIN_CHARS) -> DataFrame:
    """Index all documents and rewrite them."""
    return LineIndex.build(docs, id_col, text_col, min_docs, min_chars).rewrite(docs, id_col, text_col)


