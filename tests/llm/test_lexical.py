"""Lexical search against every item scored on every document."""

import math
import random
import re
from collections import Counter

import pytest

from tracehound.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_search(docs, items, k):
    read = [(key, Counter(terms(t))) for key, t in docs]
    held = [(key, c, sum(c.values())) for key, c in read if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for key, text in items:
        wanted.setdefault(key, Counter()).update(terms(text))
    out = []
    for item, need in wanted.items():
        scored = []
        for key, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in need.items() if t in c)
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, r[-1], -r[0]) for i, r in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(out, key=str)


R = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(150)] + ["Été", "日本", "naïve", "x9", "İ", "ß", "\x80odd"]
GLUE = [" ", "  ", "-", "\n", "_", "'", "\x00", "."]


def prose(n):
    return "".join(R.choice(VOCABULARY) + R.choice(GLUE) for _ in range(n))


DOCS = [(i, prose(R.randint(1, 60))) for i in range(300)]
DOCS += [(400 + i, DOCS[5][1]) for i in range(40)] + [(5, DOCS[5][1])] * 3 + [(None, DOCS[5][1])] * 2 + [(500, None), (501, ""), (502, "-- ..."), (503, "w1 " * 30_000)]
ITEMS = [(i, prose(R.randint(1, 25))) for i in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (33, "W1 w1 W2"), (3, "w7 w7"), (None, "w3 x9"), (34, prose(2000))]


def frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(*r, 1, "clash", 2) for r in docs], "doc_id long, text string, item_id int, term string, score int")
    i = spark.createDataFrame([(*r, 1, "clash") for r in items], "item_id long, text string, doc_id int, times string")
    return d, i


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 500])
def test_against_all_scores(spark, block_bytes):
    d, i = frames(spark)
    got = [tuple(r) for r in lexical.search(d.repartition(6), i, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == plain_search(DOCS, ITEMS, 20)


def test_few_results_and_ties(spark):
    d, i = frames(spark)
    got = [tuple(r) for r in lexical.search(d, i, k=3).collect()]
    assert sorted(got, key=str) == plain_search(DOCS, ITEMS, 3)


@pytest.mark.parametrize("docs,items", [([], ITEMS), (DOCS, []), ([], []), ([(1, None)], ITEMS), ([(1, "w1")], [(1, "w1"), (2, "w2")])])
def test_little_input(spark, docs, items):
    d, i = frames(spark, docs, items)
    got = lexical.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 20)


def test_text_ids(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "name string, body string")
    i = spark.createDataFrame([("q", "ONE")], "key string, ask string")
    got = lexical.search(d, i, id_col="name", text_col="body", item_col="key", item_text="ask").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in sorted(got)] == [("q", 1, "a"), ("q", 2, "b")]
