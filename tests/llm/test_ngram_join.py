"""The tree join against all pairs, on the test tables and on small cases."""

import numpy as np
import pytest

from tracehound.llm import common, ngram_join

SF = "/root/testdata/sf0.001"


def sets_of(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """doc_id -> smallest reachable, over all pairs of rows."""
    rows = [(d, sets_of(t, n)) for d, t in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in root}


def compare(df, n, percent):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows, n, percent)
    got = ngram_join.components(df, n, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(d), len(sets_of(t, n))) for d, t in rows)
    return want


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_test_table(spark, n, percent):
    want = compare(spark.read.parquet(f"{SF}/documents.parquet"), n, percent)
    assert len(set(want.values())) < len(want)


def test_large_blocks_whose_sets_do_not_all_link(spark, monkeypatch):
    """Chains: neighbours link, ends do not, no set links with all others; the
    chunks of a block must still find every link between them."""
    monkeypatch.setattr(ngram_join, "CHUNK", 250)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(3):
        words = [f"c{c}w{i}" for i in range(60)]
        for i in range(30):
            words[int(rng.integers(60))] = f"c{c}n{i}"
            rows.append((1000 * c + i * 7 % 31 + 31 * (i == 0), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = compare(df, 3, 85)
    assert 3 <= len(set(want.values())) < len(want)
    compare(spark.read.parquet(f"{SF}/documents.parquet"), 4, 60)


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            words[rng.integers(len(words))] = f"w{rng.integers(10**9)}"
        out.append(" ".join(words))
    return out


def test_near_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3000)  # several chunks for the large group
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in range(300)]
    base = list(rng.choice(words, 120))
    other = list(rng.choice(words, 60))
    shared = " ".join(rng.choice(words, 40))
    texts = near_copies(rng, base, 70, 4) + near_copies(rng, other, 20, 3) + [" ".join(base)] * 30
    texts += [shared + " " + " ".join(rng.choice(words, 30)) for _ in range(40)]
    texts += ["", None, "  \n", "one", "ONE", "one two", "One  Two", "one two three", "x " * 3000, "x x x x x", "Same Text here now", "same text HERE now"]
    rows = [(int(i), t, "a", 1) for i, t in enumerate(texts)]
    rows += [(None, " ".join(base), "a", 1), (5, "a second text of document five", "b", 2), (900, "a second text of document five", "b", 2), (3, texts[3], "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gram string, block int")
    compare(df, 4, 85)
    compare(df, 5, 80)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.components(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree_join_spans(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    grams = []
    for _ in range(40):
        keep = base[rng.random(150) < rng.choice([0.5, 0.9, 0.97])]
        grams.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])))
    grams = [g for g in grams if len(g)]
    side = rng.integers(0, 2, len(grams)) if seed % 2 else np.zeros(len(grams), int)
    links = ngram_join.tree_join([g.view(np.int64) for g in grams], np.array([len(g) for g in grams]), side, 85)
    rows = set()
    for i in range(len(grams)):
        for j in range(i):
            inter = len(np.intersect1d(grams[i], grams[j]))
            ok = 100 * inter >= 85 * (len(grams[i]) + len(grams[j]) - inter)
            if ok and (not side.any() or side[i] != side[j]):
                rows.add((j, i))

    def label(pairs):
        root = list(range(len(grams)))
        for _ in range(len(grams)):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert label(rows) == label([tuple(sorted(x)) for x in links])
    assert {tuple(sorted(x)) for x in links} <= rows and len(links) < len(grams)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 480)] + [(500, i) for i in range(501, 600)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    ends = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k in ends}


def other_words(words, places, tag):
    return [f"{tag}{i}" if i in places else w for i, w in enumerate(words)]


def test_repeated_rows_keep_their_links(spark):
    """A row repeated 16 times has the prefix of one row: its few words that
    differ from a near copy's do not fill it."""
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(100)]
        rows += [(100 * g, " ".join(base))] * 16 + [(100 * g + 1, " ".join(other_words(base, {50}, f"g{g}n")))] * 16
    want = compare(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert len(set(want.values())) == 12


def test_two_texts_under_one_id_keep_their_links(spark, monkeypatch):
    """The longer text's rarer n-grams do not push the shorter one's out of the
    prefix; also with the sets of a block in several chunks."""
    rows = []
    for g in range(12):
        base, long = [f"g{g}w{i}" for i in range(100)], [f"g{g}v{i}" for i in range(600)]
        rows += [(100 * g, " ".join(base)), (100 * g, " ".join(long)), (100 * g + 1, " ".join(other_words(base, {50}, f"g{g}n")))]
        rows += [(100 * g + 2, " ".join(other_words(long, {300}, f"g{g}m")))]
        # a third copy of the short text makes its n-grams the commoner ones
        rows += [(100 * g + 3, " ".join(other_words(base, {50}, f"g{g}o")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = compare(df, 4, 85)
    assert len(set(want.values())) == 12
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    compare(df, 4, 85)


def test_common_lines_do_not_make_one_large_block(spark, monkeypatch):
    """Short texts with some of a few common lines and words of their own are
    tied by the lines but do not link; the chunks of no block meet all others,
    and the near copies among them are found."""
    monkeypatch.setattr(ngram_join, "CHUNK", 5000)
    rng = np.random.default_rng(4)
    lines = [" ".join(f"line{k}word{i}" for i in range(12)) for k in range(6)]
    rows = []
    for i in range(240):
        words = [f"own{i}w{k}" for k in range(30)]
        first, second = rng.choice(6, 2, replace=False)
        rows.append((2 * i, "\n".join([lines[first], " ".join(words), lines[second]])))
        if i % 8 == 0:
            rows.append((2 * i + 1, "\n".join([lines[first], " ".join([*words[:-1], "other"]), lines[second]])))
    pairs, dealt = [], ngram_join._tasks
    monkeypatch.setattr(ngram_join, "_across_chunks", lambda *a: pairs.append(a))
    monkeypatch.setattr(ngram_join, "_tasks", lambda sets, percent: pairs.append(sets.groupBy("task", "block").count().collect()) or dealt(sets, percent))
    want = compare(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert len(set(want.values())) == 240
    assert len(pairs) == 1 and max(r["count"] for r in pairs[0]) <= 60


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_linked_sets_share_a_part(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(1500):
        x = np.unique(rng.integers(0, 2**64, rng.choice([rng.integers(1, 12), rng.integers(5, 60), rng.integers(50, 400)]), np.uint64))
        edits = rng.integers(0, len(x) * (100 - percent) // percent + 1)
        gone = rng.integers(0, min(edits + 1, len(x)))
        y = np.unique(np.concatenate([np.delete(x, rng.permutation(len(x))[:gone]), rng.integers(0, 2**64, edits - gone, np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            met += 1
            assert len(np.intersect1d(ngram_join.part_keys(x, percent), ngram_join.part_keys(y, percent)))
    assert met > 500
