"""Repeated passages against every 50-word window of every document."""

from collections import defaultdict

import numpy as np
import pytest

from tracehound.llm import repeats

SF = "/root/testdata/sf0.001"
N = repeats.MIN_WORDS


def brute(rows):
    """(doc, text hash) -> covered words; over all windows."""
    where = defaultdict(set)
    texts = [(d, (t or "").encode().lower().split()) for d, t in rows if d is not None]
    for d, w in texts:
        for i in range(len(w) - N + 1):
            where[tuple(w[i : i + N])].add(d)
    out = defaultdict(set)
    for d, w in texts:
        cover = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - N + 1):
            if len(where[tuple(w[i : i + N])]) > 1:
                cover[i : i + N] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], cover[:-1], [False]]).astype(int)))
        out[d] |= {(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return {(d, a, b) for d, s in out.items() for a, b in s}


def found(df):
    rows = repeats.repeated_passages(df).collect()
    assert all(r.first_doc <= r.doc_id or r.first_doc > r.doc_id for r in rows)
    return {(r.doc_id, r.start_word, r.end_word) for r in rows}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_test_table(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert want and found(df) == want


@pytest.mark.parametrize("hot", [20_000, 2])
def test_planted_and_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    p = [fresh(n) for n in (49, 50, 51, 80, 400)]
    texts = [" ".join(fresh(int(rng.integers(0, 60))) + p[i % 5] + fresh(int(rng.integers(0, 60)))) for i in range(30)]
    # different left and right extents around one core; runs of one word; copies
    core, a, b = fresh(40), fresh(30), fresh(30)
    texts += [" ".join(x) for x in (a[10:] + core + b[:3], a[20:] + core + b, a + core, core + b[:15] + fresh(60), a[28:] + core + b[:12])]
    texts += ["x " * 70, "X " * 90, "x " * 49, " ".join(p[3]).upper(), "", None, "\n\t", " ".join(p[4]), " ".join(p[4]), " ".join(p[4])]
    rows = [(i, t, 1, "a") for i, t in enumerate(texts)] + [(None, " ".join(p[4]), 1, "a"), (500, " ".join(core * 2 + a), 1, "b"), (500, " ".join(core * 2 + a), 1, "b"), (501, " ".join(core + a), 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, file string")
    assert found(df) == brute([(r[0], r[1]) for r in rows])


def test_empty_table(spark):
    assert repeats.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_doc(spark):
    rng = np.random.default_rng(5)
    p = " ".join(f"v{x}" for x in rng.integers(0, 10**9, 70))
    df = spark.createDataFrame([(9, "a " + p), (4, "b c " + p), (7, p + " d")], "doc_id long, text string")
    assert {r.doc_id: r.first_doc for r in repeats.repeated_passages(df).collect()} == {9: 4, 4: 4, 7: 4}
