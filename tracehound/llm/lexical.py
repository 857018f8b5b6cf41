"""Ranked lexical search without a document index.

The terms of all items form one Aho-Corasick automaton per block of items,
each term between two guards.  A document's text is lower-cased, every
character that belongs to no term becomes a guard, and one pass of the
automaton over it yields the tf of every item term it holds.  Two passes over
the documents: the first counts documents, terms and df, the second scores and
keeps each item's best documents of the task; the best of those follow.

What is broadcast is bounded: items are dealt by a hash into blocks of about
``BLOCK_BYTES`` of terms, each with an automaton and passes of its own (one
item is never split: its terms must fit a worker).  What a task returns is
bounded by items of the block x k.

Rows: a null or empty text has no terms.  Rows of one item id are one item,
whose terms add up; a null id is an id.  Every document row is a document by
itself, also with an id that occurs twice; a null doc_id comes after equal
scores.  Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import common, worker, words as w

#: A term's characters, as the search defines them.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GUARD = " "
_INSIDE = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes to lower case, or to the guard; bytes from 0x80 on stay.
TABLE = bytes(c if c >= 0x80 else (bytes([c]).lower()[0] if c in _INSIDE else ord(GUARD)) for c in range(256))
BLOCK_BYTES = 2 << 20
PAIR_BYTES = 24
SALTS = 32
DOCS, TERMS = -1, -2


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, times)."""
    low = common.ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


class Block:
    """The automaton of some items' terms, and the items of each term."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        terms = sorted({t for _, t, _ in rows})
        number = {t: i for i, t in enumerate(terms)}
        self.items = list(dict.fromkeys(i for i, _, _ in rows))
        place = {x: i for i, x in enumerate(self.items)}
        rows = sorted((number[t], place[i], n) for i, t, n in rows)
        self.of = np.array([r[1] for r in rows], np.int64)
        self.times = np.array([r[2] for r in rows], np.int64)
        self.first = np.searchsorted(np.array([r[0] for r in rows]), np.arange(len(terms) + 1))
        self.size = len(terms)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in number.items():
            self.automaton.add_word(GUARD + t + GUARD, i)
        self.automaton.make_automaton()

    def read(self, text: bytes) -> tuple[int, Counter]:
        """All terms of a text, and the tf of the items' terms by number."""
        low = text.translate(TABLE)
        n = len(low.split())
        return n, Counter(map(itemgetter(1), self.automaton.iter(f" {low.decode()} "))) if n else Counter()

    def scores(self, numbers: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Per item, the worth of its terms; ``worth`` of the term numbers."""
        lo, n = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, self.of[at], np.repeat(worth, n) * self.times[at])
        return out


class Best:
    """Each item's k best (score, doc_id) of a task."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below cannot enter

    def offer(self, scores: np.ndarray, key) -> None:
        for i in np.flatnonzero(scores >= self.least).tolist():
            held = self.held[i]
            held.append((-int(scores[i]), key is None, key))
            if len(held) >= 4 * self.k:
                self.cut(i)

    def cut(self, i: int) -> None:
        # null ids are equal; the second field keeps them from being compared with others
        self.held[i] = sorted(self.held[i], key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[: self.k]
        if len(self.held[i]) == self.k:
            self.least[i] = -self.held[i][-1][0]


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _statistics(docs: DataFrame, block) -> dict[int, int]:
    """df by term number, and the totals DOCS and TERMS."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, held, n_docs, n_terms = block.value, np.zeros(block.value.size, np.int64), 0, 0
        for batch in batches:
            for text in w.texts(batch, 1):
                n, tf = b.read(text)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                if tf:
                    held[np.fromiter(tf, np.int64, len(tf))] += 1
        some = np.flatnonzero(held)
        key, val = np.append(some, [DOCS, TERMS]), np.append(held[some], [n_docs, n_terms])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(val, pa.int64())], ["term", "n"])

    counted = worker.map_batches(docs, rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counted.collect()}


def _ranked(docs: DataFrame, block, weights, n_docs: int, n_terms: int, k: int, item_type: DataType) -> DataFrame:
    """Each task's best documents of each item of the block."""
    doc_type, item_arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(item_type)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, value, like = block.value, weights.value, None
        best = Best(len(b.items), k)
        for batch in batches:
            like = batch.schema.field(0).type
            for key, text in zip(batch.column(0), w.texts(batch, 1)):
                n, found = b.read(text)
                if not found:
                    continue
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                numbers = np.fromiter(found.keys(), np.int64, len(found))
                tf = np.fromiter(found.values(), np.int64, len(found))
                worth = value[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                best.offer(b.scores(numbers, worth), key.as_py())
        if like is None:
            return
        for i in range(len(b.items)):
            best.cut(i)
        flat = [(b.items[i], key, -s) for i, held in enumerate(best.held) for s, _, key in held]
        out = pa.schema([("item_id", item_arrow), ("doc_id", like), ("score", pa.int64())])
        for lo in range(0, len(flat), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat[lo : lo + 10_000]), out)], schema=out)

    return worker.map_batches(docs, rows, f"item_id {item_type.simpleString()}, doc_id {doc_type}, score long")


def _top(found: DataFrame, k: int, *extra: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("item_id", *extra).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents."""
    spark = docs.sparkSession
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    terms = common.stash(item_terms(items, item_col, item_text), "item-terms")
    item_type = terms.schema["item_id"].dataType
    size = terms.agg(F.sum(F.octet_length("term") + PAIR_BYTES)).first()[0] or 0
    blocks, parts, totals = max(1, math.ceil(size / block_bytes)), [], None
    for i in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).select("item_id", "term", "times")
        listed = [tuple(r) for r in rows.collect()]
        if not listed:
            continue
        made = Block(listed)
        block = spark.sparkContext.broadcast(made)
        counts = _statistics(light, block)
        totals = totals or (counts.get(DOCS, 0), counts.get(TERMS, 0))
        values = np.array([weight(totals[0], counts.get(t, 0)) for t in range(made.size)], np.int64)
        parts.append(_ranked(light, block, spark.sparkContext.broadcast(values), *totals, k, item_type))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {light.schema['doc_id'].dataType.simpleString()}, score long")
    found = reduce(DataFrame.unionByName, parts)
    # in two steps, so that the tasks' lists of one item do not all meet at once
    found = _top(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "salt").drop("salt", "rank")
    return _top(found, k).select("item_id", "rank", "doc_id", "score")
