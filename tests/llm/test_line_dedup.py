"""Line dedup: the filter itself, reversibility, and odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tracehound.llm import line_dedup as ld

WS = " \t\n\x0b\x0c\r"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300, unique=True), st.data())
def test_filter_never_forgets_and_can_forget(keys, data):
    k = np.array(keys, np.int64)
    f = ld.filled(k, k * 7 + 1)
    assert f.has(k, k * 7 + 1).all()
    gone = data.draw(st.lists(st.sampled_from(keys), unique=True))
    for x in gone:
        assert f.remove(x, int(np.int64(x) * 7 + 1))
    kept = np.array([x for x in keys if x not in gone], np.int64)
    assert f.has(kept, kept * 7 + 1).all()
    if len(gone) == len(keys):
        assert not f.cells.any()


def test_filter_rarely_errs():
    rng = np.random.default_rng(0)
    k = rng.integers(-(2**63), 2**63 - 1, (40_000, 2))
    f = ld.filled(k[:20_000, 0], k[:20_000, 1])
    assert f.has(k[20_000:, 0], k[20_000:, 1]).mean() < 0.001
    again = ld.CuckooFilter(f.n, f.cells.tobytes())
    assert again.has(k[:20_000, 0], k[:20_000, 1]).all()


def plain(rows, min_docs=5, min_chars=40):
    """(doc, lines, dropped, sha) of each row, by dictionaries."""
    low = lambda d: -(2**63) if d is None else d
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(low(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and low(d) != max(holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


A, B, C = "The first line that very many documents share, word for word.", "É" * 40, "ß" * 39
ROWS = [(i, f"own line {i} of this document, long enough to count as one\n  {A.upper() if i % 2 else A}\t\n{B}\n{C}\n{A}") for i in range(8)]
ROWS += [(100, None), (101, ""), (102, "\n\n"), (None, A), (None, f"{A}\n{B}"), (3, A), (103, A + "\r\n" + A), (104, A[:39]), (-7, "x " * 40_000 + "\n" + A)]
ROWS += [(200 + i, "Held by four only, one short of enough, whatever it says.") for i in range(4)]
SCHEMA = "doc_id long, text string, n_lines string, k1 int, _drop int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], SCHEMA)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_odd_rows(spark):
    out = ld.dedup_lines(frame(spark, ROWS))
    assert got(out) == plain(ROWS)
    for r in out.collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256


def test_small_groups_and_shards(spark, monkeypatch):
    monkeypatch.setattr(ld, "GROUP_ROWS", 3)
    monkeypatch.setattr(ld, "SHARD_KEYS", 1)
    assert got(ld.dedup_lines(frame(spark, ROWS))) == plain(ROWS)


def test_empty_table(spark):
    assert ld.dedup_lines(frame(spark, [])).count() == 0


def state(index):
    refs = sorted(map(tuple, index.refs.collect()), key=str)
    counts = sorted(map(tuple, index.counts.collect()), key=str)
    return refs, counts


def held(index):
    """Which common keys and which others the filters claim to hold."""
    blobs = {r.shard: ld.CuckooFilter(r.buckets, r.cells) for r in index.filters.collect()}
    rows = index.counts.collect()
    has = {(r.k1, r.k2): bool(blobs[r.k1 % index.shards].has(np.array([r.k1]), np.array([r.k2]))[0]) if r.k1 % index.shards in blobs else False for r in rows}
    return {k for r in rows if r.n_docs >= index.min_docs for k in [(r.k1, r.k2)]}, {k for k, v in has.items() if v}


@pytest.mark.parametrize("shard_keys", [32768, 1])
def test_inserts_and_deletions_are_reversible(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(ld, "SHARD_KEYS", shard_keys)
    first, more = frame(spark, ROWS[:14]), frame(spark, ROWS[14:])
    index = ld.LineIndex.build(first)
    grown = index.insert(more)
    assert got(grown.rewrite(frame(spark, ROWS))) == plain(ROWS)
    assert state(grown) == state(ld.LineIndex.build(frame(spark, ROWS)))
    gone = [d for d, _ in ROWS[14:] if d not in {x for x, _ in ROWS[:14]}]
    back = grown.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    left = [r for r in ROWS if r[0] not in gone]
    assert got(back.rewrite(frame(spark, left))) == plain(left)
    common, claimed = held(back)
    assert common <= claimed
    # taking documents away until the line is no longer common
    few = back.delete(spark.createDataFrame([(d,) for d in range(5)], "doc_id long"))
    left = [r for r in left if r[0] not in range(5)]
    assert got(few.rewrite(frame(spark, left))) == plain(left)
    common, claimed = held(few)
    assert common <= claimed and len(claimed) <= len(common)


def test_shards_follow_inserts(spark, monkeypatch):
    """An index built on an empty batch gets the shards of what is inserted."""
    monkeypatch.setattr(ld, "SHARD_KEYS", 20)
    lines = [f"line {i} of a page footer that many documents of a site hold" for i in range(100)]
    docs = spark.createDataFrame([(d, "\n".join(lines)) for d in range(6)], "doc_id long, text string")
    grown = ld.LineIndex.build(docs.limit(0)).insert(docs)
    whole = ld.LineIndex.build(docs)
    assert grown.shards == whole.shards == 6 and grown.filters.count() == whole.filters.count() > 1
    assert sorted(grown.drops().collect()) == sorted(whole.drops().collect()) and grown.drops().count() == 500
    back = grown.delete(docs.select("doc_id").where("doc_id > 2"))
    assert back.drops().count() == 0 and back.insert(docs).drops().count() == 500
