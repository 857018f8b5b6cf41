"""Result layer: dedup, IOCs, views, statistics, report."""

import datetime as dt

from decimal import Decimal

from tracehound.operators import dedup, executions, ioc
from tracehound.plans import dashboards, report, views

FIND = ("finding_id long, execution_id long, hunt_name string, severity string, finding_type string, source_ip string, "
        "destination_ip string, destination_hostname string, username string, timestamp timestamp_ntz, "
        "confidence_score decimal(5,2), status string, created_at timestamp_ntz")
D = dt.datetime


def f(spark, rows):
    return spark.createDataFrame(rows, FIND)


def row(fid, ts, sev="medium", ftype="c2_beaconing", src="1.1.1.1", dst=None, host=None, user=None, status="new", created=None, eid=1):
    return (fid, eid, ftype, sev, ftype, src, dst, host, user, ts, Decimal(50), status, created or ts)


def test_ioc_order_first_last_by_arrival(spark):
    rows = [row(1, D(2024, 1, 3), "low", created=D(2024, 2, 1)),
            row(2, D(2024, 1, 1), "critical", ftype="dns_tunneling", created=D(2024, 2, 2)),
            row(3, D(2024, 1, 2), "medium", created=D(2024, 2, 3))]
    r = ioc.ioc_rollup(f(spark, rows)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.first_seen, r.last_seen, r.times_seen, r.threat_level) == (D(2024, 1, 3), D(2024, 1, 2), 3, "critical")
    assert [(h.hunt, h.times) for h in r.associated_hunts] == [("c2_beaconing", 2), ("dns_tunneling", 1)]


def test_ioc_low_after_info_keeps_info(spark):
    rows = [row(1, D(2024, 1, 1), "info", created=D(2024, 2, 1)), row(2, D(2024, 1, 2), "low", created=D(2024, 2, 2))]
    assert ioc.ioc_rollup(f(spark, rows)).collect()[0].threat_level == "info"


def test_ioc_upsert_merges_and_never_lowers(spark):
    old = [row(1, D(2024, 1, 1), "high", created=D(2024, 2, 1))]
    new = [row(2, D(2024, 1, 5), "low", ftype="dns_tunneling", created=D(2024, 3, 1)),
           row(3, D(2024, 1, 4), "medium", created=D(2024, 3, 2)),
           row(4, D(2024, 1, 9), "medium", src="9.9.9.9", created=D(2024, 3, 3))]
    merged = ioc.ioc_upsert(ioc.ioc_rollup(f(spark, old)), ioc.ioc_rollup(f(spark, new)))
    got = {r.ioc_value: r for r in merged.collect()}
    a = got["1.1.1.1"]
    assert (a.first_seen, a.last_seen, a.times_seen, a.threat_level) == (D(2024, 1, 1), D(2024, 1, 4), 3, "high")
    assert [(h.hunt, h.times) for h in a.associated_hunts] == [("c2_beaconing", 2), ("dns_tunneling", 1)]
    assert got["9.9.9.9"].threat_level == "medium" and got["9.9.9.9"].times_seen == 1
    whole = {r.ioc_value: r for r in ioc.ioc_rollup(f(spark, old + new)).collect()}
    for k in got:
        assert got[k].asDict() == whole[k].asDict()


def test_ioc_skips_empty_values(spark):
    rows = [row(1, D(2024, 1, 1), src="", dst=None, host="evil.example")]
    r = ioc.ioc_rollup(f(spark, rows)).collect()
    assert [(x.ioc_type, x.ioc_value) for x in r] == [("domain", "evil.example")]


def test_dedup_source_null_source_kept(spark):
    hist = f(spark, [row(1, D(2024, 1, 5)), row(2, D(2024, 1, 5), src=None)])
    inc = f(spark, [row(3, D(2024, 1, 9)), row(4, D(2024, 1, 9), src=None), row(5, D(2024, 1, 9), src="2.2.2.2")])
    kept = sorted(r.finding_id for r in dedup.dedup_source(inc, hist, as_of="2024-01-09", lookback_days=7).collect())
    assert kept == [4, 5]
    # history older than the look-back does not count
    assert dedup.dedup_source(inc, hist, as_of="2024-01-20", lookback_days=7).count() == 3


def test_dedup_fingerprint_within_batch(spark):
    inc = f(spark, [row(1, D(2024, 1, 9, 5)), row(2, D(2024, 1, 9, 1)), row(3, D(2024, 1, 9), src="3.3.3.3")])
    got = dedup.dedup_fingerprint(inc, f(spark, [row(9, D(2000, 1, 1))]), as_of="2024-01-09").collect()
    assert sorted(r.finding_id for r in got) == [2, 3]


def test_fingerprint_missing_is_empty_string(spark):
    import hashlib
    r = dedup.with_fingerprint(f(spark, [row(1, D(2024, 1, 1))])).collect()[0]
    assert r.fingerprint == hashlib.sha256(b"c2_beaconing|1.1.1.1|||").hexdigest()


def test_max_severity_text_vs_ranked(spark):
    df = f(spark, [row(1, D(2024, 1, 1), "critical"), row(2, D(2024, 1, 2), "medium")])
    r = views.vw_top_sources(df).collect()[0]
    assert (r.max_severity, r.max_severity_ranked) == ("medium", "critical")


EXEC = ("execution_id long, hunt_name string, execution_start timestamp_ntz, execution_end timestamp_ntz, status string, "
        "records_analyzed long, findings_count int")


def test_statistics_left_join_and_last_wins(spark):
    ex = spark.createDataFrame([(1, "c2", D(2024, 1, 10, 1), D(2024, 1, 10, 1, 0, 30), "completed", 100, 0),
                                (2, "c2", D(2024, 1, 10, 5), D(2024, 1, 10, 5, 1), "completed", 200, 1)], EXEC)
    fi = f(spark, [row(1, D(2024, 1, 10), "high", eid=1)])
    r = dashboards.hunt_statistics(ex, fi, as_of="2024-01-12").collect()
    assert len(r) == 1
    assert (r[0].records_analyzed, r[0].total_findings, r[0].avg_confidence_score, r[0].execution_time_seconds) == (200, 0, None, 60)


def test_execution_log_latest(spark):
    ex = spark.createDataFrame([(1, "c2", D(2024, 1, 1), None, "running", 5, 1),
                                (2, "dns", D(2024, 1, 1), D(2024, 1, 1, 0, 1), "failed", 7, 0)], EXEC)
    got = {r.execution_id: r for r in executions.execution_log_latest(executions.execution_events(ex)).collect()}
    assert got[1].status == "running" and got[1].records_analyzed is None
    assert got[2].status == "failed" and got[2].records_analyzed == 7


def test_report_summary_one_row_empty_period(spark):
    ex = spark.createDataFrame([], EXEC)
    r = report.report_summary(f(spark, []), ex, as_of="2024-01-10", days=7).collect()
    assert len(r) == 1 and r[0].total_hunts == 0 and r[0].success_rate is None
    assert r[0].severity_breakdown == [] and r[0].period_start == dt.date(2024, 1, 3)


def test_views_approx_distinct_close_to_exact(spark):
    rows = [row(i, D(2024, 1, 1), src=f"10.0.0.{i % 50}") for i in range(400)]
    exact = {(r.hunt_name, r.severity): r.unique_sources for r in views.vw_daily_findings(f(spark, rows)).collect()}
    approx = {(r.hunt_name, r.severity): r.unique_sources for r in views.vw_daily_findings(f(spark, rows), approx=True).collect()}
    for k, v in exact.items():
        assert abs(approx[k] - v) <= max(1, 0.05 * v)


def test_the_key_filter_passes_every_repeat_and_little_else(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS a", "IF(id % 10 = 0, NULL, id) AS b")
    filt = dedup.key_filter(keys, ["a", "b"]).collect()
    assert len(filt) <= dedup.FILTER_BITS // 32768 and all(len(r["_bitmap"]) == 4096 for r in filt)
    history = spark.range(20_000).selectExpr("concat('k', id) AS a", "IF(id % 10 = 0, NULL, id) AS b", "id")
    got = {r.id for r in dedup.maybe_among(history, keys, ["a", "b"]).collect()}
    assert set(range(5000)) <= got and len(got) < 5050
    assert dedup.maybe_among(history, keys.limit(0), ["a", "b"]).count() == 0


def test_few_bits_change_no_result(spark, monkeypatch):
    inc = f(spark, [row(i, D(2024, 1, 9), src=f"10.{i}") for i in range(300)])
    hist = f(spark, [row(i, D(2024, 1, 8), src=f"10.{i * 3}") for i in range(300)])
    want = sorted(f"10.{i}" for i in range(300) if i % 3)

    def left():
        made = [dedup.dedup_fingerprint(inc, hist, as_of="2024-01-09")]
        made += [dedup.dedup_source(inc, hist, as_of="2024-01-09", prefilter=p) for p in (True, False)]
        return [sorted(r.source_ip for r in m.collect()) for m in made]

    assert left() == [want] * 3
    monkeypatch.setattr(dedup, "FILTER_BITS", 128)
    assert left() == [want] * 3
