"""Word hashing shared by the shingle and suffix operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from . import worker

CACHE = 150_000
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hash of a word; emptied when full, since it is only a cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = worker.cache(_Words())


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs without ASCII white space), A-Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chain(seed: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of a sequence extended by one element."""
    return mix(seed * _M3 + nxt)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every position on."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = chain(out, h[k : k + m])
    return out


_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            have = _POWERS[k]
            _POWERS[k] = np.concatenate([have, have * (have[-1] * base)])
    return _POWERS[0], _POWERS[1]


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every position on, in time that does not
    depend on n: differences of one running polynomial sum."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(h))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[: len(h)], dtype=np.uint64)])
    return mix((run[n:] - run[:-n]) * up[:m] + np.uint64(n))


def sequence_key(values: np.ndarray) -> tuple[int, int]:
    """128-bit hash of an array as two signed 64-bit integers."""
    d = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def texts(b: pa.RecordBatch, column: int) -> Iterator[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(column))
