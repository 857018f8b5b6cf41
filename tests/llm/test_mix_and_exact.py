"""Mixing and exact dedup on odd rows, against DuckDB and plain Python."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracehound.llm import exact_dedup, mixing, oracle_sql

ROWS = [(i, " ".join(["w"] * (i % 7)), f"s{i % 3}") for i in range(60)]
ROWS += [(100, None, "s0"), (101, "", None), (102, "a b c", None), (103, "big " * 5000, "s1"), (None, "no id", "s2"), (5, "twice", "Z"), (5, "twice", "Z"), (104, "", "only empty"), (105, "x\x0by\x85z q", "é")]
SCHEMA = "doc_id long, text string, source string, size int, target string, h int, cell int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "clash", 2, 3) for r in rows], SCHEMA)


def water(sizes, weights=(5, 2, 1)):
    """Targets by sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        level = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 2 * sizes[s]]
        if not over:
            out |= level
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
    return out


def test_mix(spark):
    got = [(r.doc_id, r.source, r.mix) for r in mixing.mix(frame(spark)).collect()]
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len((t or "").encode().split())
    want = water(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for _, s, m in got:
        assert m.source_size == sizes[s] and m.target == pytest.approx(want[s]) and 0 <= m.taken <= 2 * m.size
        assert m.taken == m.copies * m.size
        taken[s] += m.taken
        largest[s] = max(largest[s], m.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = [(r.doc_id, r.source, r.mix) for r in mixing.mix(frame(spark).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)
    emitted = mixing.emit(mixing.mix(frame(spark)))
    assert emitted.columns == frame(spark).columns and emitted.count() == sum(m.copies for *_, m in got)


def test_mix_against_sql(spark):
    con = duckdb.connect()
    con.register("documents", frame(spark).select("doc_id", "text", "source").toArrow())
    want = sorted((tuple(r) for r in con.sql(oracle_sql.SQL["op4_mixing"]).fetchall()), key=str)
    got = sorted(((r.doc_id, r.mix.size, r.mix.source_size, r.mix.target, r.mix.taken) for r in mixing.mix(frame(spark)).collect()), key=str)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, "d": 10**6}, {"a": 0, "b": 7}, {"a": 0}, {None: 5, "a": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_empty_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def plain(rows):
    low = lambda d: -(2**63) if d is None else d
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = []
    for d, t in rows:
        ids = groups[norm(t)]
        out.append((d, max(ids, key=low), len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


EXACT = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000), (10, "İ"), (11, "i̇"), (None, "same"), (None, "lone"), (12, "dup"), (12, "dup"), (12, "DUP")]


@pytest.mark.parametrize("capacity", [4096, 1])
def test_exact_odd_rows(spark, capacity):
    df = spark.createDataFrame([(*r, "clash", 1) for r in EXACT], "doc_id long, text string, h string, entry int")
    rows = exact_dedup.exact_duplicates(df, capacity=capacity).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == plain(EXACT)
    kept = [r for r in rows if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in rows}) == len({r.text_sha256 for r in kept})


def test_directory_splits_until_buckets_fit(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h")).cache()
    book = exact_dedup.directory(df, 40)
    placed = df.withColumn("entry", exact_dedup._slot(F.col("h"))).join(book, "entry")
    sizes = {r.bucket: (r.n, r.depth) for r in placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).collect()}
    assert sum(n for n, _ in sizes.values()) == 3000 and max(n for n, _ in sizes.values()) <= 40
    for bucket, (n, depth) in sizes.items():  # the parent was overfull
        size = 1 << (exact_dedup.MAX_DEPTH - depth + 1)
        lo = bucket // size * size
        assert placed.where(F.col("entry").between(lo, lo + size - 1)).count() > 40


def test_directory_leaves_no_bucket_out(spark):
    assert exact_dedup.directory(spark.range(0).select(F.col("id").alias("h")), 10).count() == 0
    one = exact_dedup.directory(spark.range(5).select(F.xxhash64("id").alias("h")), 10).collect()
    assert len(one) == 1 << exact_dedup.MAX_DEPTH and {(r.bucket, r.depth) for r in one} == {(0, 0)}


@pytest.mark.parametrize("capacity", [4096, 1])
def test_colliding_texts_are_chained(spark, capacity):
    """A hash with four values: nearly all texts collide."""
    rows = EXACT + [(100 + i, f"text {i % 40} {'y' * (i % 3)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    weak = lambda c: F.shiftleft(F.pmod(F.octet_length(c), F.lit(4)).cast("long"), 61)
    got = exact_dedup.exact_duplicates(df, capacity=capacity, hash_of=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    index = exact_dedup.build_index(df, hash_of=weak)
    chains = [[bytes(t.sha) for t in r.chain] for r in index["entries"].collect()]
    assert len(chains) <= 4 and max(map(len, chains)) > 10 and all(len(set(c)) == len(c) for c in chains)


def test_each_file_of_entries_is_a_range(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id % 3000) AS text")
    key = "spark.sql.adaptive.coalescePartitions.enabled"     # these few rows would go to one task
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        entries = exact_dedup.build_index(df, capacity=50)["entries"]
    finally:
        spark.conf.set(key, old)
    files = entries.groupBy(F.input_file_name()).agg(F.min(F.struct("bucket", "h")).alias("a"), F.max(F.struct("bucket", "h")).alias("b")).collect()
    spans = sorted((tuple(r.a), tuple(r.b)) for r in files)
    assert len(spans) > 1 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_hot_texts_and_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 50)
    rows = [(None, "hot")] * 400 + [(7, "Hot 2")] * 300 + [(i, "HOT 2") for i in range(5)] + [(i, f"own {i}") for i in range(100)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    assert sum(r.kept for r in got) == 102 and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_owner_tasks_need_no_further_exchange(spark):
    rows = exact_dedup._keyed(spark.range(10).selectExpr("id AS doc_id", "string(id) AS text"), "doc_id", "text", F.xxhash64)
    book = spark.createDataFrame([(0, 0)], "entry int, bucket int")
    plan = exact_dedup._entries(rows, book, F.broadcast(rows.select("h").limit(0)))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Exchange rangepartitioning")[0]
    assert "rangepartitioning" in plan and "Exchange" not in above and "Python" not in plan
