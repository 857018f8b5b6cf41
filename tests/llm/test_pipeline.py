"""Every stage against a plain version over the same rows, in sequence."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from test_lang_id import plain
from test_ngram_join import brute as near_brute
from test_tokens import reference_ids
from tracehound.llm import common, lang_id, ngram_join as near, oracle_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def start(spark):
    docs = common.table(spark, SF, "documents")
    long = " ".join(r.text for r in docs.limit(60).collect())
    noise = "".join(map(chr, np.random.default_rng(8).integers(33, 127, 300)))
    odd = [(-1, None, "en", "s1", 0), (-2, "", None, None, 0), (-3, noise, "en", "s1", 300), (None, "The plain words of nobody, and the others.", "en", "s1", 42), (-5, long, "en", "s1", len(long)), (-5, long, "en", "s1", len(long))]
    return common.stash(docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(4), "start")


@pytest.fixture(scope="module")
def stored(spark, start):
    frames = [start]
    for name, stage in cp.STAGES:
        frames.append(common.stash(stage(spark, frames[-1], SF), f"test-{name}"))
    return frames


def rows(df):
    return [tuple(r) for r in df.select(cp.COLUMNS).collect()]


def test_columns(stored):
    for df in stored[:-1]:
        assert df.columns == cp.COLUMNS


def test_language(stored):
    before = rows(stored[0])
    model = lang_id.fit(stored[0])
    judged = plain([(lang, None, source, text) for _, text, lang, source, _ in before], model)
    want = [r for r, (language, _) in zip(before, judged) if language]
    assert Counter(rows(stored[1])) == Counter(want)
    assert len(want) >= 0.97 * len(before) - 4 and not {-1, -2, -3} & {r[0] for r in want}


def duck(df, sql):
    con = duckdb.connect()
    con.register("documents", df.select(cp.COLUMNS).toArrow())
    return con.sql(sql)


def test_lines(stored):
    import hashlib

    before, after = rows(stored[1]), rows(stored[2])
    unique = stored[1].where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {r[0]: (r[2], r[3]) for r in duck(unique, oracle_sql.SQL["op1_line_dedup"]).project("doc_id, n_lines, n_dropped, kept_sha256").fetchall()}
    assert Counter((r[0], r[2], r[3]) for r in before) == Counter((r[0], r[2], r[3]) for r in after)
    for doc, text, _, _, n in after:
        if doc is not None:
            assert hashlib.sha256((text or "").encode()).hexdigest() == want[doc][1]
        assert n == len(text)
    assert any(dropped for dropped, _ in want.values())


def check_groups(before, after):
    """Of every group of linked rows one with the smallest id stays."""
    label = near_brute([(i, r[1]) for i, r in enumerate(before)], 5, 80)
    groups = {}
    for i, r in enumerate(before):
        groups.setdefault(label[i], []).append(r)
    left = Counter(after)
    for members in groups.values():
        least = min(((r[0] is None, r[0] or 0) for r in members))
        best = [r for r in members if (r[0] is None, r[0] or 0) == least]
        chosen = [r for r in best if left[r]]
        assert chosen, members
        left[chosen[0]] -= 1
    assert not +left


def test_near_duplicates(stored):
    before, after = rows(stored[2]), rows(stored[3])
    check_groups(before, after)
    assert len(after) < len(before)


def test_mix(stored):
    before, after = rows(stored[3]), Counter(rows(stored[4]))
    sql = oracle_sql.SQL["op4_mixing"].replace("SELECT s.doc_id, s.size,", "SELECT s.doc_id, w.whole + CASE WHEN s.cell < b.threshold THEN 1 ELSE 0 END AS copies, s.size,")
    copies = {r[0]: r[1] for r in duck(stored[3], sql).project("doc_id, copies").fetchall()}
    want = Counter()
    for r in before:
        want[r] += copies[r[0]]
    assert after == +want


def test_pack(stored):
    pieces = stored[5].collect()
    want = Counter()
    for r in rows(stored[4]):
        ids = reference_ids(r[1])
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want.update((r[0], p, s, e - s) for p, (s, e) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in pieces) == want
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) / 2048 * 1.05 + 1


def test_run_equals_the_stages(spark):
    got = cp.run(spark, SF)
    docs = common.table(spark, SF, "documents")
    for _, stage in cp.STAGES:
        docs = common.stash(stage(spark, docs, SF), "again")
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(docs) and np.all([c > 0 for c in key(got).values()])


def test_empty_input(spark, start):
    docs = start.limit(0)
    for name, stage in cp.STAGES:
        docs = common.stash(stage(spark, docs, SF), f"none-{name}")
    assert docs.count() == 0


def test_near_duplicates_go_by_row(spark):
    """A row goes for its own text only, and of repeats one stays."""
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(30))
    given = [(1, text), (1, text), (2, text + " more"), (2, "something else under the id of a copy"), (None, text), (None, other), (None, other), (3, ""), (3, ""), (4, None), (5, text + " more"), (6, other + " y")]
    given = [(i, t, "en", "s", 9) for i, t in given]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(cp.near_duplicates(spark, docs, SF))
    want = [(1, text), (2, "something else under the id of a copy"), (6, other + " y"), (3, ""), (3, ""), (4, None)]
    assert Counter((r[0], r[1]) for r in got) == Counter(want)
    check_groups(given, got)


def test_near_duplicates_of_many_repeats(spark):
    text = " ".join(f"w{i}" for i in range(80))
    given = [(7, text, "en", "s", 9)] * 300 + [(i, text + f" v{i}", "en", "s", 9) for i in range(8, 40)] + [(7, f"own words of row {i}", "en", "s", 9) for i in range(5)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = rows(cp.near_duplicates(spark, docs, SF))
    check_groups(given, got)
    assert len(got) == 6


def test_near_duplicates_with_common_lines(spark, monkeypatch):
    """Rows that only share common lines all stay, near copies go, and the sets
    tied by the lines are not shipped to each other's chunks."""
    monkeypatch.setattr(near, "CHUNK", 5000)
    monkeypatch.setattr(near, "_across_chunks", lambda *a: pytest.fail("chunks of a block of common lines met each other"))
    lines = [" ".join(f"line{k}word{i}" for i in range(12)) for k in range(6)]
    data = []
    for i in range(240):
        words = [f"own{i}w{k}" for k in range(30)]
        for d, own in [(2 * i, words), (2 * i + 1, [*words[:-1], "other"])][: 2 if i % 8 == 0 else 1]:
            text = "\n".join([lines[i % 6], " ".join(own), lines[(i + 1 + i // 6 % 5) % 6]])
            data.append((d, text, "en", "s1", len(text)))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()) == [2 * i for i in range(240)]
