"""Physical-plan properties that matter at scale."""

import os
import re

import pytest

from tracehound.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df) -> str:
    df.collect()   # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_no_python_rows_no_cartesian(spark, name):
    p = plan(catalog.REGISTRY[name](spark, SF))
    assert "BatchEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_c2_scan_is_pruned(spark):
    p = catalog.REGISTRY["c2_beaconing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # only the four columns the mapping needs reach the reader
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_logon_filter_pushed_to_scan(spark):
    from tracehound.operators import lateral
    import tempfile
    path = tempfile.mkdtemp(prefix="th-win-") + "/w"
    catalog.fx.load(spark, SF, "win_security").write.parquet(path)
    df = lateral.logon_events(spark.read.parquet(path))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_code" in p


def test_c2_exchanges(spark):
    """One for the count per pair, one for the log, one for the slice rows."""
    p = plan(catalog.REGISTRY["c2_beacon_profile"](spark, SF)).split("== Initial Plan ==")[0]
    assert p.count("Exchange hashpartitioning") <= 3


def test_second_c2_exchange_has_a_row_per_pair(spark):
    from tracehound.operators import c2
    logs = catalog.fx.load(spark, SF, "conn_logs")
    pairs = c2.conn_pairs(logs)
    rows = c2.slice_moments(pairs, c2.PAIR, busy_rows=c2.BUSY_PAIR_ROWS).count()
    assert rows == pairs.select(*c2.PAIR).distinct().count() < c2.slice_moments(pairs, c2.PAIR).count()


def test_sliding_sweep_holds_no_window_of_a_task_in_memory(spark):
    """Two exchanges of slice rows, and the rows of a task are only sorted: no
    hash table of the (pair, window) groups, twelve for a slice row."""
    p = plan(catalog.REGISTRY["sliding_c2_sweep"](spark, SF)).split("== Initial Plan ==")[0]
    assert p.count("Exchange") == 2
    assert "Aggregate" not in p
    assert len(re.findall(r"\bSort\b", p)) == 2


def test_entropy_stays_in_the_projection(spark):
    assert "Generate" not in plan(catalog.REGISTRY["dns_entropy"](spark, SF))


def test_statistics_cut_findings_before_the_aggregate(spark):
    """Stored findings of other runs are not even read."""
    import tempfile
    from pyspark.sql import functions as F
    from tracehound.plans import dashboards
    path = tempfile.mkdtemp(prefix="th-stat-") + "/f"
    f = catalog.fx.load(spark, SF, "findings").where("execution_id < 400")
    f.repartition(1).write.partitionBy("execution_id").parquet(path)
    e = catalog.fx.load(spark, SF, "executions").where("execution_id < 400")
    stored = spark.read.parquet(path)
    day = e.where("status = 'completed'").agg(F.max(F.to_date("execution_start"))).first()[0]
    out = dashboards.hunt_statistics(e, stored, as_of=day, days=1)
    p = plan(out).split("== Initial Plan ==")[0]
    assert "LeftSemi" in p and "dynamicpruning" in p.lower()


@pytest.mark.parametrize("name", ["dashboard_ioc_feed", "dashboard_top_indicators", "report_top_threats", "campaign_summary"])
def test_lists_are_collected_from_one_row_per_value(spark, name):
    p = plan(catalog.REGISTRY[name](spark, SF)).split("== Initial Plan ==")[0]
    assert "collect_set" not in p and p.count("HashAggregate") >= 2


def test_fingerprints_are_reduced_before_the_join(spark):
    p = plan(catalog.REGISTRY["dedup_fingerprint"](spark, SF)).split("== Initial Plan ==")[0]
    assert p.index("LeftAnti") < p.index("min(struct")


@pytest.mark.parametrize("name,order", [
    ("vw_top_sources", lambda r: (-r.finding_count, r.source_ip)),
    ("dashboard_finding_types", lambda r: (-r["count"], r.finding_type)),
    ("dashboard_top_indicators", lambda r: (-r.occurrence_count, r.source_ip or "", r.destination_ip or "")),
    ("report_top_threats", lambda r: (-r.finding_count, r.source_ip or "")),
    ("dashboard_severity_trends", lambda r: (r.date, ["critical", "high", "medium", "low", "info"].index(r.severity))),
])
def test_rows_come_in_order(spark, name, order):
    rows = catalog.REGISTRY[name](spark, SF).collect()
    assert rows == sorted(rows, key=order)


def test_observed_records_keep_logon_pushdown(spark):
    """The job counts analysed records in the hunt's own pass; the logon
    filter must still reach the parquet reader."""
    import tempfile
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    from tracehound.operators.hunts import REGISTRY
    path = tempfile.mkdtemp(prefix="th-obs-") + "/w"
    catalog.fx.load(spark, SF, "win_security").write.parquet(path)
    h = REGISTRY["lateral_movement"]
    obs = Observation("records")
    df = h.run(h.scope(spark.read.parquet(path)).observe(obs, F.count(F.lit(1)).alias("n")))
    df.collect()
    assert obs.get["n"] == catalog.fx.load(spark, SF, "win_security").filter(F.col("event_code").isin("4624", "4625", "4648")).count()
    assert "PushedFilters: [In(event_code" in df._jdf.queryExecution().executedPlan().toString()


def test_dedup_reads_the_history_in_place(spark):
    """Below the filter join the history has no exchange."""
    import re

    from tracehound.operators import dedup
    from tracehound.sources import fixtures as fx
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        f = fx.load(spark, SF, "findings")
        text = dedup.dedup_fingerprint(f.where("execution_id % 2 = 0"), f, as_of="1998-01-01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [(re.search(r"[A-Z]", x).start(), x) for x in text.split("\n") if re.search(r"[A-Z]", x)]
    at = next(i for i, (_, x) in enumerate(lines) if "BroadcastHashJoin" in x and "_number" in x)
    stream = []
    for d, x in lines[at + 1:]:
        if "BroadcastExchange" in x:
            break
        stream.append(x)
    assert any("FileScan" in x for x in stream) and not any("Exchange" in x for x in stream), text
