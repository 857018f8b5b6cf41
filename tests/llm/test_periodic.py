"""Periodic runs against the definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracehound.llm import periodic


def plain_runs(words):
    """All lags, all stretches, smallest period by trying each."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60)
BLOCKS = st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), min_size=1, max_size=6), st.integers(1, 9)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(WORDS)
def test_small_alphabet(words):
    assert periodic.find_runs(words) == plain_runs(words)


@settings(max_examples=400, deadline=None)
@given(BLOCKS)
def test_planted_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert periodic.find_runs(words) == plain_runs(words)


def test_nested_runs():
    inner = [b"x", b"y"] * 5 + [b"z"]
    words = [b"p"] + inner * 5 + [b"q"] * 9 + [b"a", b"b", b"b"] * 4
    got = periodic.find_runs(words)
    assert got == plain_runs(words) and {q for _, _, q in got} == {1, 2, 3, 11}


def test_every_segment_word_is_frequent():
    r = random.Random(3)
    words = r.choices(range(40), weights=[1 / (k + 1) for k in range(40)], k=3000)
    ids = np.array(words)
    for lo, hi in periodic.segments(ids):
        assert hi - lo >= 6 and min(words[lo:hi].count(x) for x in set(words[lo:hi])) >= 4
    assert periodic.find_runs([str(x).encode() for x in words]) == plain_runs(words)


def test_long_texts_are_scanned_whole():
    words = [b"same"] * 300_000
    assert periodic.find_runs(words) == [(0, 300_000, 1)]
    turn = [str(i).encode() for i in range(1000)]
    words = [b"start"] + turn * 150 + [b"mid"] + [b"x", b"y", b"z"] * 40_000
    assert periodic.find_runs(words) == [(1, 150_000, 1000), (150_002, 120_000, 3)]


ROWS = [(1, "a b " * 6 + "tail"), (1, "a b " * 6 + "tail"), (2, None), (3, ""), (4, " \t\n"), (5, "x\x0by\x85z one"), (None, "go " * 7), (6, "Go go " * 3), (7, "é " * 6 + "end"), (8, "w " * 50_000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, runs int, collapsed string")


def test_rows(spark):
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(frame(spark)).collect()]
    want = []
    for key, text in ROWS:
        words = (text or "").encode().split()
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((key, len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


def test_columns_of_the_runs(spark):
    found = periodic.periodic_runs(frame(spark, [(1, "a " * 12 + "b c " * 8 + "b c d e " * 4), (2, "none"), (3, "a " * 6 + "x y " + "b " * 6)]))
    got = {r.doc_id: r for r in found.select("doc_id", "runs", periodic.strongest(F.col("runs")).alias("best"), periodic.runs_digest(F.col("runs")).alias("d")).collect()}
    assert tuple(got[1].best) == (0, 12, 1) and tuple(got[3].best) == (0, 6, 1) and got[2].best is None
    lines = "".join("{},{},{}\n".format(*r) for r in got[1].runs)
    assert len(got[1].runs) >= 3 and got[1].d == hashlib.sha256(lines.encode()).hexdigest()
    assert got[2].d == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 5, 100])
def test_edit(n):
    words = [str(i).encode() for i in range(n)]
    for key in [None, *range(300)]:
        h = zlib.crc32(str(key).encode())
        got = periodic.repeat_tail(key, words)
        if key is None or h % 10 or not n:
            assert got == words
        else:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
