"""Periodic runs of words, found by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least max(6, 4 q) that no neighbouring word
extends keeping the period.  Each word of a run occurs at least four times in
it.  So a word that occurs less often within the current segment can be in no
run there, and splits it; the parts are counted anew until nothing splits.

Surviving segments are scanned lag by lag.  A run of period q holds four
multiples of q, so a lag first compares only the words at multiples of q, and
extends word by word where three such comparisons in a row hold.  All lags of
a segment of m words cost about m log m comparisons.  Multiples of a run's
period inside that run are passed over: such a stretch has the run's period.

Words are compared as they are, case included.  A null or empty text has no
words and no runs.  Every row is treated by itself, so repeated rows, null ids
and an empty table need no care; other columns are ignored.  A text is held
whole by one task, as its words' numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import worker, words as w

TIMES = 4
SHORTEST = 6
FLUSH_BYTES = 8 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretches(keep: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(lo, hi) of the stretches of true ``keep`` of a sufficient length; a
    true ``new`` starts another one."""
    on = np.concatenate([[False], keep, [False]])
    cut = np.concatenate([new, [True]])
    starts = np.flatnonzero(on[1:-1] & (~on[:-2] | cut[:-1]))
    ends = np.flatnonzero(on[1:-1] & (~on[2:] | cut[1:])) + 1
    long = ends - starts >= SHORTEST
    return np.stack([starts[long], ends[long]], axis=1)


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches in which every word occurs at least ``TIMES`` times."""
    out, pending = [], [(0, len(ids))] if len(ids) >= SHORTEST else []
    while pending:
        spans = np.array(pending)
        at = np.concatenate([np.arange(a, b) for a, b in pending])
        which = np.repeat(np.arange(len(spans)), spans[:, 1] - spans[:, 0])
        key = ids[at] if len(spans) == 1 else np.unique(which * (int(ids.max()) + 1) + ids[at], return_inverse=True)[1]
        often = np.bincount(key)[key] >= TIMES
        whole = np.bincount(which, weights=~often, minlength=len(spans)) == 0
        out += [s for s, ok in zip(pending, whole) if ok]
        new = np.concatenate([[True], which[1:] != which[:-1]])
        parts = _stretches(often & ~whole[which], new)
        pending = [(int(at[a]), int(at[b - 1]) + 1) for a, b in parts]
    return sorted(out)


def _right(seg: np.ndarray, q: int, x: int) -> int:
    """First i >= x whose word differs from the one q later."""
    end, step = len(seg) - q, 64
    while x < end:
        stop = min(x + step, end)
        differ = seg[x:stop] != seg[x + q : stop + q]
        if differ.any():
            return x + int(differ.argmax())
        x, step = stop, step * 4
    return end


def _left(seg: np.ndarray, q: int, x: int) -> int:
    """Least s such that words s to x - 1 equal those q later."""
    step = 64
    while x > 0:
        stop = max(x - step, 0)
        differ = seg[stop:x] != seg[stop + q : x + q]
        if differ.any():
            return x - int(differ[::-1].argmax())
        x, step = stop, step * 4
    return 0


def _primes(q: int) -> Iterator[int]:
    d = 2
    while d * d <= q:
        if q % d == 0:
            yield d
            while q % d == 0:
                q //= d
        d += 1
    if q > 1:
        yield q


def _smallest(seg: np.ndarray, s: int, e: int, q: int) -> bool:
    """No part of q is a period of the stretch.  At four periods or more a
    smaller period always divides q."""
    return not any(_right(seg[s:e], q // f, 0) == e - s - q // f for f in _primes(q))


def scan(seg: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a segment."""
    m, out = len(seg), []
    period, upto = np.zeros(m, np.int64), np.zeros(m, np.int64)  # of the first run found over a word
    for q in range(1, m // TIMES + 1):
        s = seg[::q]
        same = s[1:] == s[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        k = 0
        while k < len(hits):
            x = int(hits[k]) * q
            p, end = int(period[x]), int(upto[x])
            if p and q % p == 0 and end > x + q:
                k = max(k + 1, int(np.searchsorted(hits, -(-(end - q) // q))))
                continue
            lo, hi = _left(seg, q, x), _right(seg, q, x)
            length = hi - lo + q
            if length >= max(SHORTEST, TIMES * q) and _smallest(seg, lo, hi + q, q):
                out.append((lo, length, q))
                free = period[lo : hi + q] == 0
                upto[lo : hi + q][free] = hi + q
                period[lo : hi + q][free] = q
            k = max(k + 1, int(np.searchsorted(hits, -(-hi // q))))
    return out


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start, then period."""
    if len(words) < SHORTEST:
        return []
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words))
    if len(words) - len(seen) < TIMES - 1:
        return []
    return sorted((lo + s, n, q) for lo, hi in segments(ids) for s, n, q in scan(ids[lo:hi]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what any run repeats after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, q in runs:
            keep[s + q : s + n] = False
        words = [x for x, k in zip(words, keep) if k]
    return b" ".join(words)


Edit = Callable[[object, list[bytes]], list[bytes]]


def repeat_tail(key, words: list[bytes]) -> list[bytes]:
    """An ``Edit`` that makes runs in about one row of ten: from some word on,
    the words up to some other one come again and again, both set by the
    CRC-32 of the id.  Rows with a null id stay as they are."""
    h, n = zlib.crc32(b"" if key is None else str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> (word
    numbers from 0, by start, then period) and the collapsed text of every
    row.  ``edit`` may change a row's words (given its id) before the search."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lengths, found, texts, size = [], [], [], [], 0
            for key, text in zip(b.column(0), w.texts(b, 1)):
                listed = text.split()
                if edit:
                    listed = edit(key.as_py(), listed)
                runs = find_runs(listed)
                ids.append(key)
                lengths.append(len(listed))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(collapsed(listed, runs))
                size += len(texts[-1])
                if size >= FLUSH_BYTES:
                    yield batch(ids, lengths, found, texts, b.schema.field(0).type)
                    ids, lengths, found, texts, size = [], [], [], [], 0
            if ids:
                yield batch(ids, lengths, found, texts, b.schema.field(0).type)

    def batch(ids, lengths, found, texts, like) -> pa.RecordBatch:
        cols = [pa.array([i.as_py() for i in ids], like), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return worker.map_batches(light, rows, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the
    first.  Null if there is none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def runs_digest(runs: Column) -> Column:
    """SHA-256 of one ``start,length,period`` line a run."""
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)
