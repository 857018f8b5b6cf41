"""Property: the time-sliced C2 profile equals one lag over the pair."""

import datetime as dt
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import CONN_SCHEMA
from tracehound.operators import c2
from tracehound.plans import sweeps

T0 = dt.datetime(2024, 1, 1)

offsets = st.lists(st.tuples(st.integers(0, 3 * 86400), st.integers(0, 999999), st.one_of(st.none(), st.integers(0, 10**7))),
                   min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=offsets, slice_seconds=st.sampled_from([1, 60, 300, 7200, 200000]), pairs=st.integers(1, 3),
       busy_rows=st.sampled_from([None, 0, 5, 20, 10**6]))
def test_sliced_profile_equals_single_lag(spark, rows, slice_seconds, pairs, busy_rows):
    data = [(T0 + dt.timedelta(seconds=s, microseconds=us), f"10.0.0.{i % pairs}", "1.1.1.1", 443, b, 0, 1.0)
            for i, (s, us, b) in enumerate(rows)]
    df = spark.createDataFrame(data, CONN_SCHEMA)
    got = {r.source_ip: r for r in c2.c2_beacon_profile(df, slice_seconds=slice_seconds, busy_rows=busy_rows).collect()}
    w = Window.partitionBy("id_orig_h").orderBy("ts")
    ref = df.withColumn("e", F.unix_timestamp("ts")).withColumn("gap", F.col("e") - F.lag("e").over(w)).groupBy("id_orig_h").agg(
        F.count("*").alias("n"), F.avg("gap").alias("a"), F.stddev("gap").alias("s"),
        F.avg("orig_bytes").alias("ab"), F.stddev("orig_bytes").alias("sb"), F.min("e").alias("f"), F.max("e").alias("l"))
    for r in ref.collect():
        g = got[r.id_orig_h]
        assert (g.connection_count, g.first_seen, g.last_seen) == (r.n, r.f, r.l)
        for mine, theirs in ((g.avg_interval, r.a), (g.interval_stddev, r.s), (g.avg_bytes_sent, r.ab), (g.bytes_sent_stddev, r.sb)):
            assert (mine is None) == (theirs is None)
            if mine is not None:
                assert mine == pytest.approx(theirs, rel=1e-9, abs=1e-6)


far = st.lists(st.tuples(st.integers(0, 12 * 86400), st.integers(0, 3)), min_size=2, max_size=50)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=far, outlier=st.sampled_from([20 * 2**30, 5 * 10**15]))
def test_sliding_byte_spread_ignores_what_lies_outside_the_window(spark, rows, outlier):
    """Every reported window against one direct aggregate over its own rows,
    with one huge transfer ten days before all others."""
    first = T0 - dt.timedelta(days=10)
    data = [(first, "10.0.0.1", "1.1.1.1", 443, outlier, 0, 1.0)]
    data += [(T0 + dt.timedelta(seconds=s), "10.0.0.1", "1.1.1.1", 443, 1000 + b, 0, 1.0) for s, b in rows]
    df = spark.createDataFrame(data, CONN_SCHEMA)
    got = sweeps.sliding_c2_profile(df).collect()
    times = [(r[0], r[4]) for r in data]
    seen = 0
    for r in got:
        inside = [b for t, b in times if r.window_start <= t < r.window_end]
        assert r.connection_count == len(inside)
        if len(inside) > 1:
            assert r.bytes_sent_stddev == pytest.approx(statistics.stdev(inside), rel=1e-9)
            seen += 1
    assert len(got) >= 12 and (seen or len(rows) < 3)


spaced = st.lists(st.tuples(st.integers(-2 * 86400, 9 * 86400), st.integers(0, 999999), st.sampled_from([0, 0, 1, None]),
                            st.one_of(st.none(), st.integers(0, 10**6))), min_size=1, max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=spaced, k=st.sampled_from([1, 2, 3, 12]), dense=st.booleans(), slice_seconds=st.sampled_from([300, 7200, 21600]))
def test_sliding_profile_equals_each_window_apart(spark, rows, k, dense, slice_seconds):
    """Every window that holds a connection, and every column of it, against
    the pair's connections in it; a row without a time is in none."""
    scale = 12 if dense else 1      # dense: most hops hold several connections
    data = [(T0 + dt.timedelta(seconds=s // scale, microseconds=us), None if p is None else f"10.0.0.{p}", "1.1.1.1", 443, b, 0, 1.0)
            for s, us, p, b in rows]
    none = [(None, "10.0.0.0", "1.1.1.1", 443, 5, 0, 1.0), (None, "10.0.0.8", "1.1.1.1", 443, 5, 0, 1.0)]
    df = spark.createDataFrame(data + none, CONN_SCHEMA)
    got = {(r.source_ip, r.window_start): r for r in
           sweeps.sliding_c2_profile(df, window_hours=6 * k, hop_hours=6, slice_seconds=slice_seconds).collect()}
    epoch, hop = dt.datetime(1970, 1, 1), dt.timedelta(hours=6)
    want = {}
    for t, src, *_, b, _, _ in data:
        first = epoch + ((t - epoch) // hop - k + 1) * hop
        for i in range(k):
            want.setdefault((src, first + i * hop), []).append((t, b))
    assert got.keys() == want.keys()
    for key, inside in want.items():
        r, times, sent = got[key], sorted(t for t, _ in inside), [b for _, b in inside if b is not None]
        secs = [(t - epoch) // dt.timedelta(seconds=1) for t in times]
        gaps = [b - a for a, b in zip(secs, secs[1:])]
        assert r.window_end == r.window_start + k * hop
        assert (r.connection_count, r.first_ts, r.last_ts, r.first_seen, r.last_seen) == (len(inside), times[0], times[-1], secs[0], secs[-1])
        for mine, values, of, least in ((r.avg_interval, gaps, statistics.mean, 1), (r.interval_stddev, gaps, statistics.stdev, 2),
                                        (r.avg_bytes_sent, sent, statistics.mean, 1), (r.bytes_sent_stddev, sent, statistics.stdev, 2)):
            if len(values) < least:
                assert mine is None
            else:
                assert mine == pytest.approx(of(values), rel=1e-9, abs=1e-6)


def test_sliding_moments_give_a_run_of_windows_once(spark):
    """Two rows at most for a hop with a connection, not one per window."""
    times = [T0 + dt.timedelta(hours=h) for h in (0, 1, 30, 100, 106, 1000)]
    df = spark.createDataFrame([(t, "10.0.0.1", "1.1.1.1", 443, 10, 0, 1.0) for t in times], CONN_SCHEMA)
    hops = c2.hop_moments(c2.slice_moments(c2.conn_pairs(df), c2.PAIR), c2.PAIR, 300, 21600)
    assert hops.count() == 5
    runs = c2.sliding_moments(hops, c2.PAIR, 12).collect()
    assert len(runs) <= 10
    windows = [w for r in runs for w in range(r["_from"], r["_to"] + 1)]
    assert len(windows) == len(set(windows)) == sweeps.sliding_c2_profile(df).count()
