"""C2 beaconing on hand-made connection logs (FIXTURES §C)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import CONN_SCHEMA
from tracehound.operators import c2
from tracehound.sources import fixtures as fx

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def conn(spark, times, bytes_=1000, src="10.0.0.1", dst="203.0.113.9", port=443):
    rows = [(t, src, dst, port, (bytes_(i) if callable(bytes_) else bytes_), 0, 1.0) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, CONN_SCHEMA)


def every(n, seconds, start=T0):
    return [start + dt.timedelta(seconds=seconds * i) for i in range(n)]


def test_perfect_beacon_scores_100_high(spark):
    out = c2.c2_beaconing(conn(spark, every(20, 60))).collect()
    assert len(out) == 1
    r = out[0]
    assert r.confidence_score == 100.0 and r.severity == "high"
    assert r.timestamp == T0
    assert "20 connections with 60.0s average interval (±0.0s jitter) to 203.0.113.9:443" in r.description
    prof = c2.c2_beacon_profile(conn(spark, every(20, 60))).collect()[0]
    assert prof.avg_interval == 60.0 and prof.interval_stddev == 0.0


def test_random_gaps_dropped_by_jitter(spark):
    gaps = [3600 * k for k in (1, 5, 2, 9, 1, 7, 3, 8, 2, 6, 1, 4, 9, 2, 5, 3, 7, 1, 8)]
    times = [T0]
    for g in gaps:
        times.append(times[-1] + dt.timedelta(seconds=g))
    assert c2.c2_beaconing(conn(spark, times)).count() == 0


def test_null_bytes_reference_mode_is_100(spark):
    df = conn(spark, every(20, 60), bytes_=None)
    r = c2.c2_beaconing(df).collect()[0]
    assert r.confidence_score == 100.0 and r.severity == "high"
    assert '"avg_bytes_sent":0' in r.raw_data


def test_null_bytes_jittery_skip_term(spark):
    # 10 connections, gaps alternating 0 and 200 s: mean 100 (approx), stddev ~ 100
    times = [T0]
    for i in range(9):
        times.append(times[-1] + dt.timedelta(seconds=0 if i % 2 == 0 else 200))
    df = conn(spark, times, bytes_=None)
    ref = c2.c2_beaconing(df).collect()
    assert len(ref) == 1 and ref[0].confidence_score == 100.0
    skip = c2.c2_beaconing(df, null_score="skip_term").collect()
    assert skip == []   # 30 + (1 - sd/mean)*40 with sd ~ mean: below 50


def test_zero_bytes_no_error_under_ansi(spark):
    r = c2.c2_beaconing(conn(spark, every(20, 60), bytes_=0)).collect()
    assert r[0].confidence_score == 100.0


def test_single_connection_dropped(spark):
    assert c2.c2_beaconing(conn(spark, every(1, 60))).count() == 0


def test_boundary_min_connections_and_strict_jitter(spark):
    # exactly min_connections rows; a jitter threshold equal to the stddev
    # (0 here) must drop the pair: the comparison is strict
    times = every(10, 60)
    prof = c2.c2_beacon_profile(conn(spark, times)).collect()[0]
    assert prof.connection_count == 10 and prof.interval_stddev == 0.0
    assert c2.c2_beaconing(conn(spark, times), jitter_threshold=0.0).count() == 0
    assert c2.c2_beaconing(conn(spark, times), jitter_threshold=0.001).count() == 1
    assert c2.c2_beaconing(conn(spark, times), min_connections=11).count() == 0


@pytest.mark.parametrize("slice_seconds", [7, 60, 300, 86400])
def test_slicing_is_exact(spark, slice_seconds):
    """The time-sliced profile equals one lag over the whole pair."""
    import random
    rnd = random.Random(5)
    times, t = [], T0
    for _ in range(200):
        t = t + dt.timedelta(seconds=rnd.choice([0, 1, 13, 59, 61, 600, 3601]), microseconds=rnd.randint(0, 999999))
        times.append(t)
    rnd.shuffle(times)
    df = conn(spark, times, bytes_=lambda i: 1000 + (i * 7919) % 503)
    got = c2.c2_beacon_profile(df, slice_seconds=slice_seconds).collect()[0]
    from pyspark.sql import Window
    w = Window.partitionBy("id_orig_h").orderBy("ts")
    ref = df.withColumn("e", F.unix_timestamp("ts")).withColumn("gap", F.col("e") - F.lag("e").over(w)).agg(
        F.avg("gap").alias("a"), F.stddev("gap").alias("s"), F.avg("orig_bytes").alias("ab"),
        F.stddev("orig_bytes").alias("sb")).collect()[0]
    assert got.connection_count == 200
    assert got.avg_interval == pytest.approx(ref.a, rel=1e-12)
    assert got.interval_stddev == pytest.approx(ref.s, rel=1e-9)
    assert got.avg_bytes_sent == pytest.approx(ref.ab, rel=1e-12)
    assert got.bytes_sent_stddev == pytest.approx(ref.sb, rel=1e-9)
    iv = c2.c2_intervals(df, slice_seconds=slice_seconds)
    ref_iv = df.withColumn("e", F.unix_timestamp("ts")).withColumn("gap", F.col("e") - F.lag("e").over(w))
    assert sorted(r.interval_seconds or -1 for r in iv.collect()) == sorted(r.gap or -1 for r in ref_iv.collect())


def test_iso_string_times(spark):
    rows = [(f"2021-01-01T00:{m:02d}:00.000Z", "10.0.0.1", "1.2.3.4", 443, 10, 0, 1.0) for m in range(20)]
    df = spark.createDataFrame(rows, CONN_SCHEMA.replace("ts timestamp_ntz", "ts string"))
    r = c2.c2_beaconing(df).collect()[0]
    assert r.confidence_score == 100.0


def test_no_python_udf_and_no_cartesian(spark):
    plan = c2.c2_beaconing(conn(spark, every(20, 60)))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan


def test_hot_pair_is_spread_and_exact(spark):
    """One pair holds a third of all rows: level 1 spreads it over many
    tasks and the merged profile still equals one lag over the pair."""
    import random
    rnd = random.Random(11)
    rows = []
    for i in range(3000):                       # the hot pair: every 7..70 s for ~2 days
        rows.append((T0 + dt.timedelta(seconds=i * 50 + rnd.randint(0, 20)), "10.9.9.9", "198.51.100.1", 443, 500 + i % 7, 0, 1.0))
    for p in range(600):                        # 600 ordinary pairs, 10 rows each
        for j in range(10):
            rows.append((T0 + dt.timedelta(seconds=p * 97 + j * 3600), f"10.0.{p // 250}.{p % 250}", "198.51.100.2", 443, 100, 0, 1.0))
    df = spark.createDataFrame(rows, CONN_SCHEMA).repartition(8)
    pairs = c2.conn_pairs(df)
    sl = c2.slice_moments(pairs, c2.PAIR).withColumn("pid", F.spark_partition_id())
    hot = sl.filter(F.col("source_ip") == "10.9.9.9")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")   # tiny test data would otherwise be coalesced into one task
    try:
        assert hot.select("pid").distinct().count() > 1
    finally:
        spark.conf.set(key, old)
    assert hot.agg(F.max("n")).collect()[0][0] <= 300 // 7 + 1
    from pyspark.sql import Window
    w = Window.partitionBy("id_orig_h", "id_resp_h").orderBy("ts")
    ref = {(r.id_orig_h, r.id_resp_h): r for r in df.withColumn("e", F.unix_timestamp("ts")).withColumn(
        "gap", F.col("e") - F.lag("e").over(w)).groupBy("id_orig_h", "id_resp_h").agg(
        F.count("*").alias("n"), F.stddev("gap").alias("s"), F.stddev("orig_bytes").alias("sb")).collect()}
    for r in c2.c2_beacon_profile(df).collect():
        x = ref[(r.source_ip, r.destination_ip)]
        assert r.connection_count == x.n
        assert r.interval_stddev == pytest.approx(x.s, rel=1e-9)
        assert (r.bytes_sent_stddev or 0.0) == pytest.approx(x.sb or 0.0, rel=1e-9, abs=1e-12)


def test_byte_similarity_threshold_optional_filter(spark):
    df = conn(spark, every(20, 60), bytes_=lambda i: 100 if i % 2 else 1900)   # regular gaps, very uneven bytes
    assert c2.c2_beaconing(df).count() == 1
    assert c2.c2_beaconing(df, byte_similarity_threshold=0.8).count() == 0
    prof = c2.c2_beacon_profile(df).collect()[0]
    assert prof.byte_similarity < 0.8 and prof.session_seconds == 19 * 60


def test_sessions_split_at_gaps(spark):
    times = every(3, 600) + every(2, 60, T0 + dt.timedelta(hours=5)) + [T0 + dt.timedelta(hours=9)]
    got = sorted(c2.pair_sessions(conn(spark, times, lambda i: i + 1)).collect(), key=lambda r: r.session_start)
    assert [(r.connection_count, r.session_seconds, r.bytes_sent) for r in got] == [(3, 1200, 6), (2, 60, 9), (1, 0, 6)]


def test_ports_are_part_of_the_pair(spark):
    df = conn(spark, every(12, 60)).unionByName(conn(spark, every(15, 60), port=445))
    assert {r.destination_port: r.connection_count for r in c2.c2_beacon_profile(df).collect()} == {443: 12, 445: 15}


def test_stored_numbers_are_not_rounded(spark):
    import json
    times = every(12, 60) + [T0 + dt.timedelta(seconds=60 * 11 + 47)]
    r = c2.c2_beaconing(conn(spark, times)).collect()[0]
    assert json.loads(r.raw_data)["avg_interval_seconds"] == pytest.approx((60 * 11 + 47) / 12, abs=1e-12)


def hot_and_ordinary(spark):
    """One pair with a third of all rows, in bursts and pauses."""
    import random
    rnd = random.Random(3)
    rows, t = [], T0
    for i in range(1500):
        t += dt.timedelta(seconds=rnd.choice([5, 40, 40, 600, 1800, 1801, 9000]), microseconds=rnd.randint(0, 999999))
        rows.append((t, "10.9.9.9", "198.51.100.1", 443, i, 0, 1.0))
    for p in range(300):
        for j in range(10):
            rows.append((T0 + dt.timedelta(seconds=p * 97 + rnd.randint(0, 9) * 700 + j), f"10.0.{p // 250}.{p % 250}", "198.51.100.2", 443, 100, 0, 1.0))
    rows += [(None, "10.9.9.9", "198.51.100.1", 443, 1, 0, 1.0)]
    return spark.createDataFrame(rows, CONN_SCHEMA).repartition(6)


@pytest.mark.parametrize("busy_rows", [None, 1, 1000])
def test_sessions_of_a_hot_pair_meet_across_slices(spark, busy_rows):
    from pyspark.sql import Window
    df = hot_and_ordinary(spark)
    got = sorted(map(tuple, c2.pair_sessions(df, slice_seconds=900, busy_rows=busy_rows).collect()))
    w = Window.partitionBy("id_orig_h", "id_resp_h", "id_resp_p").orderBy("ts")
    fresh = F.when(F.expr("INTERVAL 30 MINUTES") >= F.col("ts") - F.lag("ts").over(w), 0).otherwise(1)
    flat = df.where("ts IS NOT NULL").withColumn("f", fresh).withColumn("s", F.sum("f").over(w))
    want = flat.groupBy("id_orig_h", "id_resp_h", "id_resp_p", "s").agg(
        F.min("ts"), F.max("ts"), F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")), F.count("*"), F.sum("orig_bytes"))
    assert got == sorted(map(tuple, want.drop("s").collect()))


def test_busy_pairs_come_from_a_sample_and_are_few(spark, monkeypatch):
    pairs = c2.conn_pairs(hot_and_ordinary(spark))
    assert [r.source_ip for r in c2.busy_pairs(pairs, c2.PAIR, 1000).collect()] == ["10.9.9.9"]
    assert c2.busy_pairs(pairs, c2.PAIR, 10_000).count() == 0
    monkeypatch.setattr(c2, "BUSY_SAMPLED", 100)
    assert [r.source_ip for r in c2.busy_pairs(pairs, c2.PAIR, 700).collect()] == ["10.9.9.9"]
    monkeypatch.setattr(c2, "MAX_BUSY", 3)
    assert c2.busy_pairs(pairs, c2.PAIR, 5).count() == 3


@pytest.mark.parametrize("op", [c2.c2_beaconing, c2.c2_intervals, c2.pair_sessions, c2.c2_beacon_profile])
def test_the_raw_log_moves_once_without_automatic_broadcasts(spark, op):
    """Of the exchanges, one has the raw rows below it; the others carry
    aggregated rows, or one row per slice."""
    import re
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = op(fx.load(spark, "/root/testdata/sf0.001", "conn_logs"))._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    at = [(re.search(r"[A-Z]", x).start(), x) for x in plan if re.search(r"[A-Z]", x)]
    raw = []
    for i, (depth, line) in enumerate(at):
        if "Exchange hashpartitioning" in line and "Reused" not in line:
            below = []
            for d, x in at[i + 1:]:
                if d <= depth:
                    break
                below.append(x)
            # what the exchange carries: aggregated rows, slice edges (a filter on a window) or the log
            if not re.search("Aggregate|Window", next(x for x in below if re.search("Aggregate|Window|Exchange|Scan", x))):
                raw.append(line)
    assert len(raw) == 1 and not any(re.search("Cartesian|NestedLoop|SortMergeJoin", x) for x in plan), "\n".join(plan)


@pytest.mark.parametrize("busy_rows", [None, 1, 10_000])
def test_intervals_of_a_hot_pair(spark, busy_rows):
    from pyspark.sql import Window
    df = hot_and_ordinary(spark).where("ts IS NOT NULL")
    df = df.unionByName(df.where("orig_bytes % 7 = 0")).withColumn("id_resp_p", F.expr("IF(orig_bytes % 2 = 0, NULL, id_resp_p)"))
    w = Window.partitionBy("id_orig_h", "id_resp_h", "id_resp_p").orderBy("ts")
    want = df.select("id_orig_h", "id_resp_h", "id_resp_p", "ts", F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(w))
    got = c2.c2_intervals(df, slice_seconds=500, busy_rows=busy_rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
