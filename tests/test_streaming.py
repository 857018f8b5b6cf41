"""Streaming hunts equal their batch definitions (T4–T7), in append mode, with
files in any order and rows shuffled over them, as far as the watermark allows."""

import datetime as dt
import json
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tracehound.operators import c2, dedup, hunts, ioc, lateral
from tracehound.plans import sweeps
from tracehound.sources import fixtures as fx, manifest, sinks
from tracehound.streaming import jobs as st

SF = "/root/testdata/sf0.001"
FLUSH = dt.datetime(2024, 6, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every stateful operator has a state store per partition and batch."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def disordered(spark, df, time_col, files=4, spread_hours=10):
    """A stream over files that overlap in time by ``spread_hours``, each file
    shuffled, then one row far in the future that closes every window."""
    path = tempfile.mkdtemp(prefix="th-stream-") + "/in"
    t = F.col(f"`{time_col}`")
    jitter = F.unix_timestamp(t) + F.pmod(F.xxhash64(*df.columns), F.lit(spread_hours * 3600))
    ranked = df.withColumn("_k", jitter)
    lo, hi = ranked.agg(F.min("_k"), F.max("_k")).first()
    for i in range(files):
        a, b = lo + (hi - lo + 1) * i / files, lo + (hi - lo + 1) * (i + 1) / files
        part = ranked.filter((F.col("_k") >= a) & (F.col("_k") < b)).drop("_k")
        part.orderBy(F.xxhash64(*df.columns)).coalesce(1).write.mode("append").parquet(path)
    last = df.limit(1).withColumn(time_col, F.lit(FLUSH).cast(df.schema[time_col].dataType))
    last.coalesce(1).write.mode("append").parquet(path)
    last.withColumn(time_col, t + F.expr("INTERVAL 1 DAY")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, sdf, mode="append"):
    name = f"q_{uuid.uuid4().hex[:8]}"
    sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def keys(df, cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


COLS = ["source_ip", "confidence_score", "severity", "description", "raw_data"]


def test_streaming_c2_equals_batch_under_disorder(spark):
    logs = fx.load(spark, SF, "conn_logs").drop("year", "month", "day")
    slices = run(spark, st.streaming_c2_slices(disordered(spark, logs, "ts"), watermark="11 hours")).where(F.col("ts_last") < F.lit(FLUSH))
    got = {tuple(r[k] for k in c2.PAIR): r for r in st.c2_profile_from_slices(slices).collect()}
    want = {tuple(r[k] for k in c2.PAIR): r for r in c2.c2_beacon_profile(logs).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("connection_count", "first_seen", "last_seen", "avg_interval", "interval_stddev", "avg_bytes_sent", "bytes_sent_stddev"):
            assert got[k][c] == w[c] or got[k][c] == pytest.approx(w[c], rel=1e-12)
    assert keys(st.c2_from_slices(slices, **fx.C2_PARAMS), COLS) == keys(c2.c2_beaconing(logs, **fx.C2_PARAMS), COLS)


CONN = "ts timestamp_ntz, id_orig_h string, id_resp_h string, id_resp_p int, orig_bytes long, resp_bytes long, duration double"


def pair_stream(spark, batches, **params):
    """Run the stream of pairs over one file per batch, then two rows that
    close every slice; returns the folder of its stored state."""
    path, at = tempfile.mkdtemp(prefix="th-pairs-") + "/in", tempfile.mkdtemp(prefix="th-c2-") + "/pairs"
    ends = [[(FLUSH + dt.timedelta(days=d), "z", "z", 1, 1, 0, 1.0)] for d in (0, 1)]
    for part in [*batches, *ends]:
        frame = part if hasattr(part, "write") else spark.createDataFrame(part, CONN)
        frame.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(CONN).option("maxFilesPerTrigger", 1).parquet(path)
    q = st.streaming_c2_pairs(stream, **params).writeStream.foreachBatch(st.c2_upkeep(at)).trigger(availableNow=True)
    q.option("checkpointLocation", tempfile.mkdtemp(prefix="th-ck-")).start().awaitTermination()
    return at


def beacon(minutes, src="a"):
    return [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), src, "b", 443, 10 + m, 0, 1.0) for m in minutes]


def test_interleaved_minutes_lose_no_row(spark):
    """Two files of interleaved minutes within the default watermark."""
    rows = beacon(range(11))
    at = pair_stream(spark, [rows[::2], rows[1::2]])
    r = st.read_c2_pairs(spark, at).where("source_ip = 'a'").collect()[0]
    assert (r.connection_count, r.avg_interval, r.interval_stddev, r.avg_bytes_sent) == (11, 60.0, 0.0, 15.0)
    found = st.latest_c2_findings(spark, at, min_score=0).collect()
    assert len(found) == 1 and "11 connections" in found[0].description


def test_three_files_of_one_beacon_give_one_finding(spark):
    files = [beacon(range(45)), beacon(range(45, 105)), beacon(range(105, 165)) + beacon(range(100, 140), "quiet")]
    at = pair_stream(spark, files)
    stored = manifest.read(spark, at, f"{st.PAIR_TYPES}, {st.PAIR_STATE}")
    # each batch stored the pairs it touched, with all that came before in one row
    seen = sorted(r.connection_count for r in stored.where("source_ip = 'a'").collect())
    assert len(seen) >= 3 and seen[-1] == 165
    logs = spark.createDataFrame([r for f in files for r in f], CONN)
    want = keys(c2.c2_beaconing(logs), COLS)
    assert keys(st.latest_c2_findings(spark, at), COLS) == want and len(want) == 2
    st.compact_c2_pairs(spark, at)
    assert keys(st.latest_c2_findings(spark, at), COLS) == want and len(manifest.parts(spark, at, f"{st.PAIR_TYPES}, {st.PAIR_STATE}")) == 1
    # a replayed batch replaces its own rows
    st.c2_upkeep(at)(stored.limit(0), 10_000)
    st.c2_upkeep(at)(stored.where("source_ip = 'quiet'"), 0)
    assert keys(st.latest_c2_findings(spark, at), COLS) == want


def test_a_pair_that_loses_its_rhythm_has_no_finding_left(spark):
    late = [(dt.datetime(2024, 1, 2) + dt.timedelta(hours=h * h), "a", "b", 443, 10, 0, 1.0) for h in range(1, 9)]
    at = pair_stream(spark, [beacon(range(60)), late])
    logs = spark.createDataFrame(beacon(range(60)) + late, CONN)
    assert st.latest_c2_findings(spark, at).count() == c2.c2_beaconing(logs).count() == 0


def test_pairs_of_odd_rows(spark):
    """Null keys, null bytes and rows without a time."""
    rows = [(t, None, "b", None, None, 0, 1.0) for t, *_ in beacon(range(0, 30, 2))] + [(None, "n", "b", 1, 1, 0, 1.0)]
    rows += [(t, "big", "b", 443, 2**60 + i, 0, 1.0) for i, (t, *_) in enumerate(beacon(range(0, 30, 2)))]
    at = pair_stream(spark, [rows[:20], rows[20:]], watermark="1 hour")
    got = {r.source_ip: r for r in st.read_c2_pairs(spark, at).where("destination_ip = 'b'").collect()}
    want = {r.source_ip: r for r in c2.c2_beacon_profile(spark.createDataFrame([r for r in rows if r[0]], CONN)).collect()}
    assert set(got) == set(want) == {None, "big"}
    for k in want:
        for c in ("connection_count", "avg_interval", "interval_stddev", "avg_bytes_sent", "bytes_sent_stddev", "first_seen", "last_seen"):
            assert got[k][c] == want[k][c], (k, c)


def test_streaming_pairs_equal_batch_under_disorder(spark):
    logs = fx.load(spark, SF, "conn_logs").drop("year", "month", "day")
    stream = st.streaming_c2_pairs(disordered(spark, logs, "ts", files=3), watermark="11 hours")
    at = tempfile.mkdtemp(prefix="th-c2-") + "/pairs"
    stream.writeStream.foreachBatch(st.c2_upkeep(at)).trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="th-ck-")).start().awaitTermination()
    last = dict((tuple(r[k] for k in c2.PAIR), r) for r in c2.c2_beacon_profile(logs).collect())
    got = {tuple(r[k] for k in c2.PAIR): r for r in st.read_c2_pairs(spark, at).where(F.col("last_ts") < F.lit(FLUSH)).collect()}
    # the pair of the closing rows goes on to the closing time
    assert len(last) - len(got) <= 1
    for k, r in got.items():
        for c in ("connection_count", "first_seen", "last_seen", "avg_interval", "interval_stddev", "avg_bytes_sent", "bytes_sent_stddev"):
            assert r[c] == last[k][c] or r[c] == pytest.approx(last[k][c], rel=1e-12)


def test_lateral_state_holds_hosts_not_logons(spark):
    """The stateful operators are keyed by host first; no list of raw rows."""
    logs = fx.load(spark, SF, "win_security").drop("year", "month", "day")
    name = f"q_{uuid.uuid4().hex[:8]}"
    q = st.streaming_lateral(disordered(spark, logs, "@timestamp", files=2), watermark="11 hours").writeStream.format("memory").queryName(name)
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    held = [[o["numRowsTotal"] for o in p["stateOperators"]] for p in (json.loads(x.json) for x in q.recentProgress)]
    hosts = logs.select(F.window("@timestamp", "60 minutes"), "user_name", "source_ip", "host_name").distinct().count()
    assert all(len(h) == 2 and h[1] <= hosts + 1 for h in held) and max(h[1] for h in held) > 0


def test_streaming_lateral_equals_batch_under_disorder(spark):
    logs = fx.load(spark, SF, "win_security").drop("year", "month", "day")
    params = dict(fx.LATERAL_PARAMS)
    got = run(spark, st.streaming_lateral(disordered(spark, logs, "@timestamp"), watermark="11 hours", **params))
    want = lateral.lateral_movement(logs, **params)
    cols = ["username", *COLS]
    assert keys(got, cols) == keys(want, cols) and want.count() > 0


def test_streaming_dns_equals_daily_batch_under_disorder(spark):
    logs = fx.load(spark, SF, "dns_logs").drop("year", "month", "day")
    got = run(spark, st.streaming_dns(disordered(spark, logs, "ts", spread_hours=1), watermark="3 hours"))
    want = sweeps.in_one_pass(hunts.get("dns_tunneling"), logs, sweeps.daily_runs)
    cols = ["destination_hostname", *COLS]
    rows = [k for k in keys(got.where(F.col("timestamp") < F.lit(FLUSH)), cols)]
    assert rows == keys(want, cols) and rows


def test_ioc_upkeep_equals_one_roll_up_and_survives_replay(spark):
    f = fx.load(spark, SF, "findings")
    path = tempfile.mkdtemp(prefix="th-ioc-in-") + "/in"
    for early in (True, False):
        f.where((F.col("created_at") < "1995-06-01") == F.lit(early)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(path)
    base = tempfile.mkdtemp(prefix="th-ioc-") + "/iocs"
    stream.writeStream.foreachBatch(st.ioc_upkeep(base)).trigger(availableNow=True) \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="th-ck-")).start().awaitTermination()
    want = {(r.ioc_type, r.ioc_value): r.asDict() for r in ioc.ioc_rollup(f).collect()}
    read = lambda: {(r.ioc_type, r.ioc_value): r.asDict() for r in sinks.read_iocs(spark, base).collect()}
    assert read() == want
    st.ioc_upkeep(base)(f.where("created_at < '1995-06-01'"), 0)
    assert read() == want


def test_streaming_dedup_keeps_findings_of_old_logs(spark):
    """Event times go back for years from file to file; creation does not."""
    t0 = dt.datetime(2024, 5, 1)
    schema = ("finding_type string, source_ip string, destination_ip string, destination_hostname string, username string, "
              "timestamp timestamp_ntz, created_at timestamp_ntz")
    files = [[("c2", "a", "b", None, None, dt.datetime(2024, 4, 1), t0), ("c2", "a", "b", None, None, dt.datetime(2024, 4, 2), t0)],
             [("c2", "x", "b", None, None, dt.datetime(2019, 1, 1), t0 + dt.timedelta(days=1))],
             [("c2", "y", "b", None, None, dt.datetime(2015, 1, 1), t0 + dt.timedelta(days=2)),
              ("c2", "a", "b", None, None, dt.datetime(2016, 1, 1), t0 + dt.timedelta(days=2)),
              ("c2", "z", "b", None, None, dt.datetime(2024, 4, 20), t0 - dt.timedelta(days=3))]]
    path = tempfile.mkdtemp(prefix="th-dd-") + "/in"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(spark, st.streaming_dedup(stream))
    assert sorted(r.source_ip for r in got.collect()) == ["a", "x", "y", "z"]
    assert dedup.with_fingerprint(got.drop("fingerprint")).count() == 4


def test_checkpoint_dir_defaults_to_session_setting(spark):
    from tracehound.session import checkpoint_dir
    d = checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d


def test_checkpoint_dir_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tracehound.session import checkpoint_dir
    for master, fine in (("yarn", False), ("local-cluster[3,2,1024]", False)):
        conf = SimpleNamespace(get=lambda *a: None)
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError):
            checkpoint_dir(fake)
