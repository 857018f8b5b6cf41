"""Run folders behind a committed list: runs, compaction and readers in any
order, retries, attempts and ids."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tracehound.operators import executions, ioc
from tracehound.plans import jobs
from tracehound.sources import manifest, sinks

SCHEMA = "k string, n bigint"
FINDING = "finding_type string, source_ip string, destination_ip string, destination_hostname string, severity string, timestamp timestamp, created_at timestamp"


def base():
    return tempfile.mkdtemp(prefix="th-man-") + "/t"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def total(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def read(spark, at):
    return {r.k: r.n for r in total(manifest.read(spark, at, SCHEMA)).collect()}


def compact(spark, at):
    return manifest.compact(spark, at, SCHEMA, total)


def partial(spark, ip, t=dt.datetime(2024, 1, 1)):
    return ioc.stored_partial(spark.createDataFrame([("c2", ip, None, None, "high", t, t)], FINDING))


def test_a_run_written_before_and_committed_after_a_compaction(spark):
    at = base()
    sinks.write_iocs(partial(spark, "10.0.0.1"), at, 1)
    attempt = manifest.claim(spark, at, "key=2")
    partial(spark, "10.0.0.2").write.parquet(manifest.folder(at, 2, attempt))     # all data there, not committed
    assert [r.ioc_value for r in sinks.read_iocs(spark, at).collect()] == ["10.0.0.1"]
    sinks.compact_iocs(spark, at)
    manifest.commit(spark, at, 2, attempt)
    assert sorted(r.ioc_value for r in sinks.read_iocs(spark, at).collect()) == ["10.0.0.1", "10.0.0.2"]
    sinks.compact_iocs(spark, at)
    assert sorted((r.ioc_value, r.times_seen) for r in sinks.read_iocs(spark, at).collect()) == [("10.0.0.1", 1), ("10.0.0.2", 1)]


def test_a_run_committed_while_a_compaction_is_under_way(spark):
    """It shows up after the compaction has listed the runs, before it reads or
    commits: it must count once."""
    at = base()
    manifest.write(rows(spark, ("a", 1)), at, 1)

    def merge_late(df):
        manifest.write(rows(spark, ("a", 10), ("b", 5)), at, 2)
        return total(df)

    manifest.compact(spark, at, SCHEMA, merge_late)
    assert read(spark, at) == {"a": 11, "b": 5}
    compact(spark, at)
    assert read(spark, at) == {"a": 11, "b": 5}


def test_an_empty_table_and_empty_runs(spark):
    at = base()
    assert read(spark, at) == {} and compact(spark, at) is None and manifest.vacuum(spark, at, 0) == []
    manifest.write(rows(spark), at, 1)
    assert read(spark, at) == {}
    compact(spark, at)
    assert read(spark, at) == {}


def test_a_repeated_run_replaces_what_a_snapshot_holds(spark):
    at = base()
    for key in (1, 2, 3):
        manifest.write(rows(spark, ("a", key)), at, key)
    compact(spark, at)
    manifest.write(rows(spark), at, 2)                          # taken back
    assert read(spark, at) == {"a": 4}
    assert [len(manifest.parts(spark, at, SCHEMA))] == [1]      # the snapshot is out of date: the runs themselves
    compact(spark, at)
    manifest.write(rows(spark, ("b", 7)), at, 4)
    assert read(spark, at) == {"a": 4, "b": 7} and len(manifest.parts(spark, at, SCHEMA)) == 2


def test_an_older_attempt_that_ends_late_changes_nothing(spark):
    at = base()
    slow, quick = manifest.claim(spark, at, "key=1"), manifest.claim(spark, at, "key=1")
    assert (slow, quick) == (1, 2)
    manifest.write(rows(spark, ("new", 1)), at, 1, quick)
    compact(spark, at)
    manifest.write(rows(spark, ("old", 1)), at, 1, slow)
    assert read(spark, at) == {"new": 1}
    compact(spark, at)
    assert read(spark, at) == {"new": 1}


def test_two_compactions_at_once(spark):
    at = base()
    manifest.write(rows(spark, ("a", 1)), at, 1)

    def nested(df):
        compact(spark, at)
        return total(df)

    manifest.compact(spark, at, SCHEMA, nested)
    assert read(spark, at) == {"a": 1}


def test_vacuum_keeps_what_counts(spark):
    at = base()
    manifest.write(rows(spark, ("a", 1)), at, 1)
    compact(spark, at)
    manifest.write(rows(spark, ("a", 2)), at, 1)
    manifest.write(rows(spark, ("b", 1)), at, 2)
    compact(spark, at)
    running = manifest.claim(spark, at, "key=2")
    rows(spark, ("b", 100)).write.parquet(manifest.folder(at, 2, running))
    assert manifest.vacuum(spark, at, 3600) == []
    gone = manifest.vacuum(spark, at, 0)
    assert len(gone) == 2 and manifest.folder(at, 1, 1) in gone
    assert read(spark, at) == {"a": 2, "b": 1}
    manifest.commit(spark, at, 2, running)
    assert read(spark, at) == {"a": 2, "b": 100}


def events(spark, *rows):
    names = [c.split()[0] for c in sinks.EVENT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], sinks.EVENT_SCHEMA)


def test_a_quicker_retry_with_the_same_start_counts(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    row = lambda attempt, seq, seconds, status: {
        "execution_id": 1, "attempt": attempt, "event_seq": seq, "event_time": t + dt.timedelta(seconds=seconds), "hunt_name": "c2_beaconing", "status": status}
    log = events(spark, row(1, 0, 0, "running"), row(1, 1, 60, "failed"), row(2, 0, 0, "running"), row(2, 1, 5, "completed"))
    assert [r.status for r in executions.execution_log_latest(log).collect()] == ["completed"]
    # an old attempt that fails after the new one has started does not hide it
    log = events(spark, row(1, 0, 0, "running"), row(2, 0, 1, "running"), row(1, 1, 900, "failed"))
    assert [r.status for r in executions.execution_log_latest(log).collect()] == ["running"]
    # stored before attempts were numbered
    assert [r.status for r in executions.execution_log_latest(events(spark, row(None, 0, 0, "running"), row(None, 1, 9, "failed"))).collect()] == ["failed"]


CONN = "ts timestamp_ntz, id_orig_h string, id_resp_h string, id_resp_p int, orig_bytes long, resp_bytes long, duration double"
DAYS = {"start_date": "2024-01-01", "end_date": "2024-01-02"}


def logs(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t + dt.timedelta(minutes=m), "10.0.0.1", "203.0.113.9", 443, 10, 0, 1.0) for m in range(20)], CONN)


def test_a_failed_run_and_its_retry(spark):
    out, now = base(), dt.datetime(2024, 1, 3)
    with pytest.raises(Exception):
        jobs.run_hunt_job(spark, "c2_beaconing", spark.createDataFrame([(1,)], "x int"), results_dir=out, execution_id=5, now=now, **DAYS)
    assert [r.status for r in jobs.stored_results(spark, out)[1].collect()] == ["failed"]
    done = jobs.run_hunt_job(spark, "c2_beaconing", logs(spark), results_dir=out, execution_id=5, now=now, **DAYS)
    got = jobs.stored_results(spark, out)[1].collect()
    assert [(r.execution_id, r.status, r.findings_count) for r in got] == [(5, "completed", done["findings_count"])] and done["findings_count"] == 1


def test_the_id_of_another_hunt_is_refused(spark):
    out = base()
    jobs.run_hunt_job(spark, "c2_beaconing", logs(spark), results_dir=out, execution_id=5, **DAYS)
    before = sinks.read_iocs(spark, f"{out}/hunt_iocs").count()
    dns = spark.createDataFrame([], "ts timestamp_ntz, id_orig_h string, query string")
    with pytest.raises(ValueError, match="c2_beaconing"):
        jobs.run_hunt_job(spark, "dns_tunneling", dns, results_dir=out, execution_id=5, **DAYS)
    assert sinks.read_findings(spark, f"{out}/hunt_findings").count() == 1 and sinks.read_iocs(spark, f"{out}/hunt_iocs").count() == before == 2


def test_new_ids_are_above_all_others(spark):
    out = base()
    ids = [jobs.run_hunt_job(spark, "c2_beaconing", logs(spark), results_dir=out, execution_id=i, **DAYS)["execution_id"] for i in (None, 40, None, None)]
    assert ids == [1, 40, 41, 42]
    assert sorted(r.execution_id for r in jobs.stored_results(spark, out)[1].collect()) == [1, 40, 41, 42]
