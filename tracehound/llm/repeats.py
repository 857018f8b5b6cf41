"""Repeated passages through a sparse suffix array.

A passage is a run of at least ``MIN_WORDS`` words (A-Z lower-cased) that two
different documents share.

1. **Sparse suffixes.**  Of the suffixes of a text only those at minimisers
   stay: positions whose ``GRAM``-word hash is the smallest of the ``WINDOW``
   positions from some start on.  Every MIN_WORDS-word window has one, chosen
   by its own words alone, so at the same place in every copy; from there at
   least ``RIGHT`` words belong to the window.  Suffixes are filed under the hash
   of their first RIGHT words, and only files of two documents go on.
2. **Sort and compare.**  The candidates are extended in their texts, left to
   the start of each window that chose them and right to its end.  Within a
   file the extended suffixes are sorted (by hash) and neighbours compared:
   equal neighbours of different documents are a passage of MIN_WORDS words.
3. **Extension.**  The windows found around one suffix, and those of the next
   suffixes, are joined into maximal spans left and right.

The result is exact: the words covered are those of all MIN_WORDS-word windows
that occur in two documents.  Documents with equal word sequences form a class
and only the smallest id goes through the steps; its members get their whole
text as one span.  A file of more than ``HOT`` suffixes is not gathered in one
task: its windows are compared by a grouped minimum and maximum instead, which
combines on the map side.

Rows: null, empty and shorter texts have no spans.  A null ``doc_id`` takes no
part.  Rows that share a ``doc_id`` are texts of one document and no repeat of
each other.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, words, worker

MIN_WORDS = 50
GRAM = 8
WINDOW = 26
RIGHT = MIN_WORDS - WINDOW + 1
HOT = 20_000
BUCKET_ROWS = 60_000


def chosen(h: np.ndarray) -> np.ndarray:
    """For the start of every MIN_WORDS-word window: the position in its first
    WINDOW positions with the smallest GRAM-word hash, the leftmost of equals."""
    starts = len(h) - MIN_WORDS + 1
    if starts <= 0:
        return np.empty(0, np.int64)
    g = words.window_hashes(h, GRAM)
    best, width = np.arange(len(g)), 1
    while width < WINDOW:  # doubling, the last step overlapping
        step = min(width, WINDOW - width)
        a, b = best[:-step], best[step:]
        best = np.where(g[a] <= g[b], a, b)
        width += step
    return best[:starts]


def _indexed(docs: DataFrame) -> DataFrame:
    """Per row: doc, n (words), k1, k2 (hash of the word sequence), at, file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in words.texts(b, 1):
                h = words.word_hashes(text)
                at = np.unique(chosen(h))
                file = words.window_hashes(h, RIGHT)[at].view(np.int64) if len(at) else at
                for c, v in zip(cols, (len(h), *words.sequence_key(h), at.astype(np.int32), file), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n", "k1", "k2", "at", "file"])

    return worker.map_batches(docs, rows, "doc long, n long, k1 long, k2 long, at array<int>, file array<long>")


def _candidates(texts: DataFrame) -> DataFrame:
    """(doc, file, first, win) of rows (doc, text, k1, at array, file array):
    the starts and hashes of the windows that chose each candidate suffix, in
    the text that has key k1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(words.texts(b, 1)):
                h = words.word_hashes(text)
                if words.sequence_key(h)[0] != b.column(2)[k].as_py():
                    continue
                at = b.column(3)[k].values.to_numpy()
                pick, win = chosen(h), words.window_hashes(h, MIN_WORDS).view(np.int64)
                lo, hi = np.searchsorted(pick, at, "left"), np.searchsorted(pick, at, "right")
                ends = np.concatenate([[0], np.cumsum(hi - lo)])
                flat = np.repeat(lo - ends[:-1], hi - lo) + np.arange(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(win[flat]))
                doc = pa.array([b.column(0)[k].as_py()] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([doc, b.column(4)[k].values, pa.array(lo, pa.int64()), lists], ["doc", "file", "first", "win"])

    return worker.map_batches(texts, rows, "doc long, file long, first long, win array<long>")


def _compare(rows: pa.Table) -> pa.Table:
    """Spans (doc, start, end, first_doc) of files that fit in a task: sort the
    extended suffixes and compare neighbours."""
    rows = rows.combine_chunks()
    win = rows["win"].combine_chunks()
    sizes = np.diff(win.offsets.to_numpy())
    doc, file = (np.repeat(rows[c].to_numpy(), sizes) for c in ("doc", "file"))
    start = np.repeat(rows["first"].to_numpy() - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    w = win.flatten().to_numpy()
    order = np.lexsort((doc, w, file))
    doc, file, w, start = doc[order], file[order], w[order], start[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (file[1:] != file[:-1])])[: len(w)]
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(w)]])[: len(head)] - 1
    hit = (doc[head] < doc[tail])[group]  # sorted by doc within a group
    first = doc[head][group][hit]
    return _joined(pa.table({"doc": doc[hit], "start": start[hit], "end": start[hit] + MIN_WORDS, "first_doc": first}))


def _joined(spans: pa.Table) -> pa.Table:
    """Spans of a document that overlap or touch, as one."""
    doc, start, end, first = (spans[c].to_numpy() for c in ("doc", "start", "end", "first_doc"))
    if not len(doc):
        return spans
    order = np.lexsort((end, start, doc))
    doc, start, end, first = doc[order], start[order], end[order], first[order]
    # the furthest end so far within the document; ends are small against 2**40
    reach = np.maximum.accumulate(end + (np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 40)) & ((1 << 40) - 1)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    head = np.flatnonzero(new)
    return pa.table({"doc": doc[head], "start": start[head], "end": np.maximum.reduceat(end, head), "first_doc": np.minimum.reduceat(first, head)})


def _merged(spans: pa.Table) -> pa.Table:
    return _joined(spans.drop_columns(["part"]))


SPANS = "doc long, start long, end long, first_doc long"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal span: doc_id, start_word, end_word (exclusive),
    first_doc (the smallest document that shares part of it)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")
    index = common.stash(_indexed(docs), "suffix-index")
    long = index.where(F.col("n") >= MIN_WORDS)
    light = long.select("doc", "n", "k1", "k2")
    classes = light.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.max("doc").alias("last"))
    members = common.stash(light.join(classes.where("rep < last"), ["k1", "k2"]).select("doc", "n", "k1", "k2", "rep").distinct(), "suffix-copies")
    copies = common.bounded(members.where("doc > rep").select("doc", "k1", "k2"), 32)
    reps = long.join(copies, ["doc", "k1", "k2"], "left_anti")

    suffixes = reps.select("doc", "k1", F.explode(F.arrays_zip("at", "file")).alias("s")).select("doc", "k1", "s.at", "s.file")
    shared = suffixes.groupBy("file").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("size")).where("a < b").select("file", "size")
    shared = common.stash(shared, "suffix-files")
    found = suffixes.join(shared, "file").groupBy("doc", "k1").agg(F.collect_list(F.struct("at", "file")).alias("s"))
    found = common.stash(found.select("doc", "k1", F.col("s.at").alias("at"), F.col("s.file").alias("file")), "suffix-candidates")
    texts = docs.join(found, "doc").select("doc", "text", "k1", "at", "file")
    rows = common.stash(_candidates(texts), "suffix-windows")

    hot = F.broadcast(shared.where(F.col("size") > HOT).select("file"))  # at most suffixes / HOT rows
    total = rows.count()
    calm = rows.join(hot, "file", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(total // BUCKET_ROWS + 1)))
    spans = calm.groupBy("bucket").applyInArrow(worker.per_group(_compare), SPANS)
    single = rows.join(hot, "file", "left_semi").select("doc", "file", "first", F.posexplode("win").alias("l", "w"))
    both = single.groupBy("file", "w").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("b")).where("first_doc < b")
    start = F.col("first") + F.col("l")
    spans = spans.unionByName(single.join(both, ["file", "w"]).select("doc", start.alias("start"), (start + MIN_WORDS).alias("end"), "first_doc"))
    whole = members.select("doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.col("rep").alias("first_doc"))
    part = F.pmod(F.xxhash64("doc"), F.lit(total // BUCKET_ROWS + 1))
    merged = spans.unionByName(whole).withColumn("part", part).groupBy("part").applyInArrow(worker.per_group(_merged), SPANS)
    return merged.select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "first_doc")
