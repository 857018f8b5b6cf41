"""Merged summaries against direct aggregates, analysts' edits on read, and
both through stored runs."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tracehound.operators import edits
from tracehound.plans import dashboards, jobs, report, rollups, views
from tracehound.sources import fixtures as fx, manifest, sinks

SF = "/root/testdata/sf0.001"
WINDOW = {"as_of": dt.date(1998, 1, 15), "days": 300}


def shown(df):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.select(sorted(df.columns)).collect())


def in_parts(df, partial, n=5):
    key = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    out = partial(df.where(key == 0))
    for i in range(1, n):
        out = out.unionByName(partial(df.where(key == i)))
    return out


@pytest.mark.parametrize("name", ["daily", "timeline", "sources", "summary", "overall"])
def test_merged_equals_direct(spark, name):
    f, e = fx.load(spark, SF, "findings"), fx.load(spark, SF, "executions")
    if name == "daily":
        got, want = rollups.daily_findings(rollups.merge_hourly(in_parts(f, rollups.hourly_partial))), views.vw_daily_findings(f)
    elif name == "timeline":
        got, want = rollups.hunt_timeline(in_parts(f, rollups.hourly_partial)), views.vw_hunt_timeline(f)
    elif name == "sources":
        got, want = rollups.top_sources(rollups.merge_sources(in_parts(f, rollups.source_partial))), views.vw_top_sources(f)
    elif name == "summary":
        got, want = rollups.hunt_summary(in_parts(e, rollups.runs_partial), **WINDOW), dashboards.dashboard_hunt_summary(e, **WINDOW)
        drop = "total_executions"
        a, b = ({r.hunt_name: r[drop] for r in x.collect()} for x in (got, want))
        assert set(a) == set(b) and all(abs(a[k] - b[k]) <= 0.05 * b[k] for k in b)
        got, want = got.drop(drop), want.drop(drop)
    else:
        got, want = rollups.overall(in_parts(e, rollups.runs_partial), **WINDOW), report.report_overall(e, **WINDOW)
        assert abs(got.first().total_hunts - want.first().total_hunts) <= 0.05 * want.first().total_hunts
        got, want = got.drop("total_hunts"), want.drop("total_hunts")
    assert shown(got) == shown(want) and shown(want)


def test_sketches_of_many_sources_are_within_the_stated_error(spark):
    n = 60_000
    f = spark.range(n).selectExpr("id", "timestamp'2024-01-01 05:00:00' AS timestamp", "'h' AS hunt_name", "'low' AS severity", "'new' AS status",
                                  "concat('10.', id) AS source_ip", "concat('x', id % 9) AS destination_ip", "CAST(NULL AS DECIMAL(5,2)) AS confidence_score")
    cut = [rollups.hourly_partial(f.where(f"id % 7 = {i} OR id % 5 = 0")) for i in range(7)]     # overlapping parts
    hourly = cut[0]
    for c in cut[1:]:
        hourly = hourly.unionByName(c)
    r = rollups.daily_findings(hourly).first()
    assert abs(r.unique_sources - n) < 4 * 0.016 * n and r.unique_destinations == 9 and r.avg_confidence is None


def test_findings_without_a_time_or_source_survive_storing(spark):
    t = dt.datetime(2024, 1, 1, 5)
    f = spark.createDataFrame([(t, "h", "low", "new", "1.1.1.1", None, None), (None, "h", "low", "new", None, "x", 1.5), (None, None, None, "new", "1.1.1.1", "x", 2.5),
                               (t, "h", "low", None, "2.2.2.2", "x", 2.5)],
                              "timestamp timestamp, hunt_name string, severity string, status string, source_ip string, destination_ip string, s double")
    f = f.withColumn("confidence_score", F.col("s").cast("decimal(5,2)")).withColumn("finding_type", F.col("hunt_name"))
    rows = rollups.merge_partials(rollups.partials(f).unionByName(rollups.partials(f.limit(0))))
    assert shown(rollups.daily_findings(rollups.hourly_of(rows))) == shown(views.vw_daily_findings(f))
    assert shown(rollups.hunt_timeline(rollups.hourly_of(rows))) == shown(views.vw_hunt_timeline(f))
    assert shown(rollups.top_sources(rollups.sources_of(rows))) == shown(views.vw_top_sources(f)) != []


def test_empty_tables(spark):
    f, e = fx.load(spark, SF, "findings").limit(0), fx.load(spark, SF, "executions").limit(0)
    assert rollups.daily_findings(rollups.hourly_partial(f)).count() == rollups.top_sources(rollups.source_partial(f)).count() == 0
    assert shown(rollups.overall(rollups.runs_partial(e), **WINDOW)) == shown(report.report_overall(e, **WINDOW))
    assert edits.with_edits(f, fx.load(spark, SF, "edits").limit(0)).columns == f.columns


def test_the_latest_edit_of_each_field_wins(spark):
    found = spark.createDataFrame([(1, 10, "new", None), (1, 11, "new", "kept"), (2, 10, None, None), (None, 12, "new", None)],
                                  "execution_id bigint, finding_id bigint, status string, analyst_notes string")
    t = dt.datetime(2024, 1, 1)
    made = spark.createDataFrame([
        (1, 10, t, "investigating", "first look"), (1, 10, t + dt.timedelta(days=2), "confirmed", None), (1, 10, t + dt.timedelta(days=1), "resolved", "second"),
        (2, 10, t, "false_positive", None), (3, 99, t, "confirmed", "of no finding"), (None, 12, t, "confirmed", None), (1, 11, t, None, None)], sinks.EDITS_SCHEMA)
    got = sorted(edits.with_edits(found, made).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 10, "confirmed", "second"), (1, 11, "new", "kept"), (2, 10, "false_positive", None), (None, 12, "new", None)], key=str)


CONN = "ts timestamp_ntz, id_orig_h string, id_resp_h string, id_resp_p int, orig_bytes long, resp_bytes long, duration double"
DAYS = {"start_date": "2024-01-01", "end_date": "2024-01-02"}


def logs(spark, n=3):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t + dt.timedelta(minutes=m), f"10.0.0.{i}", "203.0.113.9", 443, 10, 0, 1.0) for i in range(n) for m in range(20)], CONN)


def test_edits_and_summaries_of_stored_runs(spark):
    out, now = tempfile.mkdtemp(prefix="th-edit-"), dt.datetime(2024, 1, 3)
    jobs.run_hunt_job(spark, "c2_beaconing", logs(spark), results_dir=out, execution_id=1, now=now, **DAYS)
    jobs.run_hunt_job(spark, "c2_beaconing", logs(spark, 5), results_dir=out, execution_id=2, now=now, **DAYS)

    def same():
        found, _ = jobs.stored_results(spark, out)
        jobs.refresh_summaries(spark, out)
        hourly, sources = sinks.read_rollups(spark, f"{out}/finding_rollups")
        assert shown(rollups.daily_findings(hourly)) == shown(views.vw_daily_findings(found))
        assert shown(rollups.hunt_timeline(hourly)) == shown(views.vw_hunt_timeline(found))
        assert shown(rollups.top_sources(sources)) == shown(views.vw_top_sources(found))
        return {(r.execution_id, r.source_ip): (r.status, r.analyst_notes) for r in found.collect()}, found

    assert jobs.refresh_summaries(spark, out) == [1, 2] and jobs.refresh_summaries(spark, out) == []
    before, found = same()
    assert len(before) == 5 and set(before.values()) == {("new", None)}
    ids = {(r.execution_id, r.source_ip): r.finding_id for r in found.collect()}
    made = spark.createDataFrame([(1, ids[1, "10.0.0.0"], now, "false_positive", "a scanner"), (2, ids[2, "10.0.0.4"], now, "confirmed", None)], sinks.EDITS_SCHEMA)
    jobs.edit_findings(spark, out, made)
    after, _ = same()
    assert after == before | {(1, "10.0.0.0"): ("false_positive", "a scanner"), (2, "10.0.0.4"): ("confirmed", None)}
    # a repeated run keeps what was decided about its findings
    jobs.run_hunt_job(spark, "c2_beaconing", logs(spark), results_dir=out, execution_id=1, now=now, **DAYS)
    sinks.compact_rollups(spark, f"{out}/finding_rollups")
    assert same()[0] == after
    assert len(manifest.parts(spark, f"{out}/finding_rollups", rollups.PARTIALS_SCHEMA)) == 1
    counts = jobs.run_full_export(spark, out, as_of="2024-01-04", approx=True)
    assert counts["dashboard_ioc_feed"] == 2 and spark.table("vw_daily_findings").agg(F.sum("finding_count")).first()[0] == 4
