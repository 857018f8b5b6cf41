"""Nearest neighbours against brute force: exact scores and order, recall."""

import math

import numpy as np
import pytest

from tracehound.llm import ann


def brute(rows, k=10, every=100):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    sizes = [len(v) for _, v in ok]
    ok = [r for r in ok if len(r[1]) == max(sorted(set(sizes)), key=sizes.count)] if ok else []
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok], float)
    out = {}
    for i, v in ok:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            out[i] = sorted((s, n) for s, n in zip(d.tolist(), ids.tolist()) if n != i)[:k]
    return out


def found(df, **kw):
    out = {}
    for r in sorted(ann.nearest(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_test_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()]), found(df)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = [len({n for _, n in got[q]} & {n for _, n in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    for q, rows in got.items():
        assert rows == sorted(rows)
        for s, n in rows:
            assert s == pytest.approx(np.sqrt(((x[n] - x[q]) ** 2).sum()), abs=1e-12)


def test_few_rows_ties_and_odd_vectors(spark):
    one, nan, inf = [1.0, 0.0, 0.0], float("nan"), float("inf")
    rows = [(i, one) for i in range(0, 320)] + [(i, [0.5, float(i % 3), 1.0]) for i in range(400, 430)]
    rows += [(500, None), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 2.0]), (800, [nan, 1.0, 1.0]), (900, [inf, 1.0, 1.0]), (1000, []), (1100, [1.0, 2.0]), (None, one), (400, [0.5, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, part int, score double")
    got, want = found(df), brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [n for _, n in got[q]] == [n for _, n in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])]
    schema = "vec_id long, embedding array<float>"
    assert [n for _, n in found(spark.createDataFrame(rows, schema))[0]] == [1, 2]
    assert found(spark.createDataFrame([], schema)) == {}
    assert found(spark.createDataFrame([(0, [1.0])], schema)) == {}


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(3000, 16))
    near = ann.graph(x, 10)
    label = ann.balanced_parts(x, near, 16)
    assert np.bincount(label, minlength=16).max() <= np.ceil(ann.SLACK * 3000 / 16)
    split = np.random.default_rng(1).permutation(np.arange(3000) % 16)
    cut = lambda p: (p[np.repeat(np.arange(3000), 10)] != p[near.ravel()]).mean()
    assert cut(label) < 0.9 * cut(split)
