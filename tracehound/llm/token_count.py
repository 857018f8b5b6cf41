"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte (the last one carrying the end-of-word
mark).  The symbols form a linked list; a heap holds the adjacent pairs that
have a merge rank.  Popping the lowest (rank, position) again and again merges
a pair, unlinks its right symbol and pushes the two new neighbours; a popped
pair that no longer exists is skipped.  The count is the number of initial
symbols minus the number of merges: no identifier is ever produced.

Words are what the vocabulary's own split gives after NFC and lower-casing;
no word spans white space, so counts are kept by white-space chunk.  The
caches of a worker are emptied when they reach ``CACHE`` entries.

Special strings of the vocabulary count one token each and split the text,
as is the library's default.  A null or empty text has no tokens.  Each row is
counted by itself, so repeated rows, null ids and an empty table need no care.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import worker

CACHE = 400_000
#: The word split of the vocabulary file, and what str.split()
#: takes for white space although the file's own pattern does not.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NOT_WHITE = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable bytes stand for themselves, the others take the
    code points from 256 on in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache(dict):
    """A dict that computes missing values and empties itself when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


class TokenCounter:
    """Counts tokens of whole texts for a word-end byte-pair vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbol = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.words = Cache(self._word)
        self.chunks = Cache(self._chunk)

    def _word(self, word: str) -> int:
        """Heap-and-linked-list merging of one word: symbols minus merges."""
        sym = [self.symbol[b] for b in word.encode()]
        n = len(sym)
        sym[-1] += self.end
        rank = self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if sym[i] else n
            if j >= n or rank((sym[i], sym[j])) != r:
                continue  # one of the two was merged meanwhile
            sym[i] += sym[j]
            sym[j] = ""
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (q, h))
        return n - merges

    def _chunk(self, chunk: str) -> int:
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk]
        return sum(map(self.words.__getitem__, self.split.findall(chunk)))

    def _plain(self, text: str) -> int:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower-casing goes character by character: no final sigma
        text = text.replace("Σ", "σ").lower()
        if any(c in text for c in NOT_WHITE):
            return sum(map(self.words.__getitem__, self.split.findall(text)))
        return sum(map(self.chunks.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter a worker process and file; its caches outlive a task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row.  ``vocabulary`` is a file
    that every executor has (an installed package's)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n = pa.array([count(x.as_py()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    light = docs.select(F.col(id_col), F.col(text_col).cast("string"), size.alias("b"))
    out = worker.map_batches(light, rows, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
