"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads whole test tables through ``sources.fixtures`` and runs
one library operator with the fixed parameters of FIXTURES.md.  Double
outputs are rounded to 6 digits so the oracle compare is stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehound.functions import text
from tracehound.functions.timecols import cutoff
from tracehound.operators import c2, dedup, dns, edits, executions, extensions, hunts, inventory, ioc, lateral
from tracehound.plans import charts, dashboards, report, rollups, sweeps, views
from tracehound.session import pin_utc
from tracehound.sources import fixtures as fx
from tracehound.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)


# raw_data of the hunts that store unrounded numbers, as the compare rounds it.
RAW_DATA = {
    "c2_beaconing": "connection_count BIGINT, avg_interval_seconds DOUBLE, interval_stddev DOUBLE, avg_bytes_sent BIGINT, "
                    "first_seen STRING, last_seen STRING",
    "dns_tunneling": "query_count BIGINT, avg_query_length DOUBLE, max_query_length BIGINT, avg_subdomain_count DOUBLE, "
                     "first_seen STRING, last_seen STRING",
}


def round_raw_data(df: DataFrame) -> DataFrame:
    if not {"raw_data", "hunt_name"} <= set(df.columns):
        return df
    out = F.when(F.lit(False), F.col("raw_data"))
    for hunt, fields in RAW_DATA.items():
        parsed = F.from_json("raw_data", fields)
        names = [f.split()[:2] for f in fields.split(", ")]
        shown = {n: F.round(parsed[n], DIGITS) if kind == "DOUBLE" else parsed[n] for n, kind in names}
        out = out.when(F.col("hunt_name") == hunt, text.raw_json(**shown))
    return df.withColumn("raw_data", out.otherwise(F.col("raw_data")))


def query(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return round_raw_data(round_doubles(fn(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__wrapped__ = fn
        REGISTRY[name] = run
        return run
    return deco


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fx.load(spark, sf_dir, name)


# --- hunts ------------------------------------------------------------------
@query("c2_beaconing")
def q_c2_beaconing(spark, sf_dir):
    """C2 beaconing findings."""
    return c2.c2_beaconing(_load(spark, sf_dir, "conn_logs"), **fx.C2_PARAMS)


@query("dns_tunneling")
def q_dns_tunneling(spark, sf_dir):
    """DNS tunneling findings."""
    return dns.dns_tunneling(_load(spark, sf_dir, "dns_logs"), **fx.DNS_PARAMS)


@query("lateral_movement")
def q_lateral_movement(spark, sf_dir):
    """Lateral movement findings."""
    return lateral.lateral_movement(_load(spark, sf_dir, "win_security"), **fx.LATERAL_PARAMS)


def _log_inputs(spark, sf_dir):
    return {n: _load(spark, sf_dir, n) for n in ("conn_logs", "dns_logs", "win_security")}


HUNT_PARAMS = {"c2_beaconing": fx.C2_PARAMS, "dns_tunneling": fx.DNS_PARAMS, "lateral_movement": fx.LATERAL_PARAMS}


@query("all_hunts")
def q_all_hunts(spark, sf_dir):
    """Every registered hunt, unioned by name (the campaign)."""
    return hunts.all_hunts(_log_inputs(spark, sf_dir), HUNT_PARAMS)


@query("c2_beacon_profile")
def q_c2_beacon_profile(spark, sf_dir):
    """A1 (+E2, E4): per-pair connection profile."""
    return c2.c2_beacon_profile(_load(spark, sf_dir, "conn_logs")).drop("first_ts", "last_ts")


@query("c2_intervals")
def q_c2_intervals(spark, sf_dir):
    """Seconds since the previous connection of the same pair."""
    return c2.c2_intervals(_load(spark, sf_dir, "conn_logs"))


@query("dns_profile")
def q_dns_profile(spark, sf_dir):
    """A2: per (source, query) statistics."""
    return dns.dns_profile(_load(spark, sf_dir, "dns_logs"))


@query("lateral_profile")
def q_lateral_profile(spark, sf_dir):
    """A3: per (user, source, bucket) logon burst statistics."""
    p = lateral.lateral_profile(_load(spark, sf_dir, "win_security"),
                                time_window_minutes=fx.LATERAL_PARAMS["time_window_minutes"])
    return p.withColumn("hosts_accessed", F.array_join("hosts_accessed", ","))


@query("logon_events")
def q_logon_events(spark, sf_dir):
    """Logon events only, renamed."""
    return lateral.logon_events(_load(spark, sf_dir, "win_security"))


@query("privileged_accounts")
def q_privileged_accounts(spark, sf_dir):
    """G1: privileged-name flag per logon account."""
    ev = lateral.logon_events(_load(spark, sf_dir, "win_security"))
    per_user = ev.groupBy("username").agg(F.count(F.lit(1)).alias("logon_count"))
    return lateral.with_privilege(per_user).select("username", "is_privileged_account", "logon_count")


@query("records_analyzed")
def q_records_analyzed(spark, sf_dir):
    """A4: rows each hunt analyses."""
    return hunts.records_analyzed(_log_inputs(spark, sf_dir))


# --- result layer -------------------------------------------------------------
def _results(spark, sf_dir):
    return _load(spark, sf_dir, "findings"), _load(spark, sf_dir, "executions")


RESULT_WINDOW = {"as_of": fx.RESULTS_AS_OF, "days": fx.SUMMARY_DAYS}


def _view(name):
    table, fn = views.VIEWS[name]

    def run(spark, sf_dir):
        f, e = _results(spark, sf_dir)
        return fn(f if table == "findings" else e)
    run.__doc__ = fn.__doc__
    return run


for _name in views.VIEWS:
    query(_name)(_view(_name))


@query("dashboard_hunt_summary")
def q_dashboard_hunt_summary(spark, sf_dir):
    return dashboards.dashboard_hunt_summary(_results(spark, sf_dir)[1], **RESULT_WINDOW)


@query("dashboard_severity_trends")
def q_dashboard_severity_trends(spark, sf_dir):
    return dashboards.dashboard_severity_trends(_results(spark, sf_dir)[0], **RESULT_WINDOW)


@query("dashboard_finding_types")
def q_dashboard_finding_types(spark, sf_dir):
    return dashboards.dashboard_finding_types(_results(spark, sf_dir)[0], **RESULT_WINDOW)


@query("dashboard_top_indicators")
def q_dashboard_top_indicators(spark, sf_dir):
    return dashboards.dashboard_top_indicators(_results(spark, sf_dir)[0], **RESULT_WINDOW)


@query("dashboard_ioc_feed")
def q_dashboard_ioc_feed(spark, sf_dir):
    return dashboards.dashboard_ioc_feed(_results(spark, sf_dir)[0])


@query("hunt_statistics")
def q_hunt_statistics(spark, sf_dir):
    f, e = _results(spark, sf_dir)
    return dashboards.hunt_statistics(e, f, as_of=fx.RESULTS_AS_OF, days=7)


@query("report_overall")
def q_report_overall(spark, sf_dir):
    return report.report_overall(_results(spark, sf_dir)[1], **RESULT_WINDOW)


@query("report_severity")
def q_report_severity(spark, sf_dir):
    return report.report_severity(_results(spark, sf_dir)[0], **RESULT_WINDOW)


@query("report_top_threats")
def q_report_top_threats(spark, sf_dir):
    return report.report_top_threats(_results(spark, sf_dir)[0], **RESULT_WINDOW)


@query("report_hunt_performance")
def q_report_hunt_performance(spark, sf_dir):
    return report.report_hunt_performance(_results(spark, sf_dir)[1], **RESULT_WINDOW)


@query("report_summary")
def q_report_summary(spark, sf_dir):
    """R5, with the three breakdowns rendered as JSON text."""
    f, e = _results(spark, sf_dir)
    r = report.report_summary(f, e, **RESULT_WINDOW)
    perf = F.transform("hunt_performance", lambda x: x.withField("avg_time", F.round(x["avg_time"], DIGITS)))
    return r.withColumns({"severity_breakdown": text.to_json("severity_breakdown"), "top_threats": text.to_json("top_threats"),
                          "hunt_performance": text.to_json(perf)})


CHART_SOURCES = {
    "chart_findings_by_severity": (charts.chart_findings_by_severity, "vw_severity_distribution"),
    "chart_daily_trend": (charts.chart_daily_trend, "vw_daily_findings"),
    "chart_hunt_performance": (charts.chart_hunt_performance, "vw_hunt_performance"),
    "chart_top_sources": (charts.chart_top_sources, "vw_top_sources"),
    "chart_timeline_heatmap": (charts.chart_timeline_heatmap, "vw_hunt_timeline"),
    "chart_effectiveness": (charts.chart_effectiveness, "vw_hunt_effectiveness"),
    "chart_investigation_status": (charts.chart_investigation_status, "vw_investigation_status"),
    "chart_ioc_feed": (charts.chart_ioc_feed, "dashboard_ioc_feed"),
    "chart_finding_types": (charts.chart_finding_types, "dashboard_finding_types"),
    "chart_severity_trends": (charts.chart_severity_trends, "dashboard_severity_trends"),
}


def _chart(name):
    fn, source = CHART_SOURCES[name]

    def run(spark, sf_dir):
        return fn(REGISTRY[source].__wrapped__(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


for _name in CHART_SOURCES:
    query(_name)(_chart(_name))


# --- de-duplication, IOCs, execution log ---------------------------------------
def _dedup_inputs(spark, sf_dir):
    f = _load(spark, sf_dir, "findings")
    t = f.schema["timestamp"].dataType
    day = lambda d: F.lit(d).cast(t)
    history = f.filter((F.col("timestamp") >= day(cutoff(fx.DEDUP_AS_OF, fx.DEDUP_LOOKBACK_DAYS)))
                       & (F.col("timestamp") < day(fx.DEDUP_AS_OF)))
    incoming = f.filter((F.col("timestamp") >= day(fx.DEDUP_AS_OF)) & (F.col("timestamp") < day(fx.DEDUP_INCOMING_END)))
    return incoming, history


@query("dedup_source")
def q_dedup_source(spark, sf_dir):
    """Anti join on (finding_type, source_ip) within the look-back."""
    incoming, history = _dedup_inputs(spark, sf_dir)
    return dedup.dedup_source(incoming, history, as_of=fx.DEDUP_AS_OF, lookback_days=fx.DEDUP_LOOKBACK_DAYS)


@query("dedup_fingerprint")
def q_dedup_fingerprint(spark, sf_dir):
    """Anti join on the fingerprint plus first-of-batch."""
    incoming, history = _dedup_inputs(spark, sf_dir)
    return dedup.dedup_fingerprint(incoming, history, as_of=fx.DEDUP_AS_OF, lookback_days=fx.DEDUP_LOOKBACK_DAYS)


@query("finding_fingerprint")
def q_finding_fingerprint(spark, sf_dir):
    """the five-field SHA-256 fingerprint of every finding."""
    f = dedup.with_fingerprint(_load(spark, sf_dir, "findings"))
    return f.select("finding_id", "execution_id", "finding_type", "source_ip", "destination_ip",
                    "destination_hostname", "username", "fingerprint")


def _ioc_out(df):
    return df.select("ioc_type", "ioc_value", "first_seen", "last_seen", "times_seen",
                     text.to_json("associated_hunts").alias("associated_hunts"), "threat_level")


# --- stored summaries and edits -------------------------------------------------
def _by_run(spark, sf_dir, table, partial, merge):
    """The summaries of the runs of even and odd months, merged."""
    df = _load(spark, sf_dir, table)
    odd = F.month("created_at" if table == "findings" else "execution_start") % 2 == 1
    parts = partial(df.where(odd)).unionByName(partial(df.where(~odd)))
    return merge(parts) if merge else parts


@query("rollup_daily_findings")
def q_rollup_daily(spark, sf_dir):
    """V1 (A9) from mergeable hourly summaries."""
    return rollups.daily_findings(_by_run(spark, sf_dir, "findings", rollups.hourly_partial, rollups.merge_hourly))


@query("rollup_hunt_timeline")
def q_rollup_timeline(spark, sf_dir):
    """V5 (A9) from mergeable hourly summaries."""
    return rollups.hunt_timeline(_by_run(spark, sf_dir, "findings", rollups.hourly_partial, rollups.merge_hourly))


@query("rollup_top_sources")
def q_rollup_sources(spark, sf_dir):
    """V4 from mergeable per-source summaries."""
    return rollups.top_sources(_by_run(spark, sf_dir, "findings", rollups.source_partial, None))


@query("edited_investigation_status")
def q_edited_status(spark, sf_dir):
    """V6 over findings as analysts edited them."""
    return views.vw_investigation_status(edits.with_edits(_load(spark, sf_dir, "findings"), _load(spark, sf_dir, "edits")))


@query("edited_hunt_effectiveness")
def q_edited_effectiveness(spark, sf_dir):
    """V7 over findings as analysts edited them."""
    return views.vw_hunt_effectiveness(edits.with_edits(_load(spark, sf_dir, "findings"), _load(spark, sf_dir, "edits")))


@query("edited_top_threats")
def q_edited_threats(spark, sf_dir):
    """R3 over findings as analysts edited them."""
    found = edits.with_edits(_load(spark, sf_dir, "findings"), _load(spark, sf_dir, "edits"))
    return report.report_top_threats(found, **RESULT_WINDOW)


@query("ioc_rollup")
def q_ioc_rollup(spark, sf_dir):
    """Indicator roll-up of all findings."""
    return _ioc_out(ioc.ioc_rollup(_load(spark, sf_dir, "findings")))


@query("ioc_upsert")
def q_ioc_upsert(spark, sf_dir):
    """K4: roll-up of older findings, then the newer ones merged in."""
    f = _load(spark, sf_dir, "findings")
    split = F.lit(fx.IOC_SPLIT).cast(f.schema["created_at"].dataType)
    state = ioc.ioc_rollup(f.filter(F.col("created_at") < split))
    delta = ioc.ioc_rollup(f.filter(F.col("created_at") >= split))
    return _ioc_out(ioc.ioc_upsert(state, delta))


@query("execution_log_latest")
def q_execution_log_latest(spark, sf_dir):
    """K3: current state per run from appended start/complete events."""
    return executions.execution_log_latest(executions.execution_events(_load(spark, sf_dir, "executions")))


@query("campaign_summary")
def q_campaign_summary(spark, sf_dir):
    """Per-day campaign outcome."""
    return executions.campaign_summary(_load(spark, sf_dir, "executions"))


# --- sources -------------------------------------------------------------------
@query("union_sources")
def q_union_sources(spark, sf_dir):
    """S3: two connection logs with different column sets, by name."""
    return tables.union_sources([_load(spark, sf_dir, "conn_logs"),
                                 fx.conn_logs_alt(fx.table(spark, sf_dir, "lineitem"))])


@query("partition_date_range")
def q_partition_date_range(spark, sf_dir):
    """Inclusive day range on year/month/day."""
    return tables.partition_date_range(_load(spark, sf_dir, "conn_logs"), *fx.PARTITION_RANGE)


@query("table_inventory")
def q_table_inventory(spark, sf_dir):
    """A5: rows, day range, days and columns per log table."""
    return inventory.table_inventory({n: _load(spark, sf_dir, n) for n in ("conn_logs", "dns_logs", "win_security")})


# --- sweeps --------------------------------------------------------------------
@query("daily_hunt_sweep")
def q_daily_hunt_sweep(spark, sf_dir):
    """Every hunt for every day, one plan."""
    return sweeps.daily_hunt_sweep(_log_inputs(spark, sf_dir), HUNT_PARAMS)


@query("weekly_hunt_sweep")
def q_weekly_hunt_sweep(spark, sf_dir):
    """Every hunt for every 8-day week ending on a Sunday."""
    return sweeps.weekly_hunt_sweep(_log_inputs(spark, sf_dir), HUNT_PARAMS)


@query("sliding_c2_sweep")
def q_sliding_c2_sweep(spark, sf_dir):
    """C2 over 3-day windows every 6 hours."""
    return sweeps.sliding_c2_sweep(_load(spark, sf_dir, "conn_logs"), **fx.SLIDING_C2_PARAMS)


# --- extensions ----------------------------------------------------------------
@query("statistics_upsert")
def q_statistics_upsert(spark, sf_dir):
    """K5: the statistics of a week, then those of its last days replace theirs.
    The first pass sees no finding created after its split date."""
    f, e = _results(spark, sf_dir)
    early = f.filter(F.col("created_at") < F.lit(fx.RESULTS_AS_OF).cast(f.schema["created_at"].dataType))
    old = dashboards.hunt_statistics(e, early, as_of=fx.RESULTS_AS_OF, days=7)
    new = dashboards.hunt_statistics(e, f, as_of=fx.RESULTS_AS_OF, days=3)
    return dashboards.upsert_statistics(old, new)


@query("c2_sessions")
def q_c2_sessions(spark, sf_dir):
    """Gap-based sessions per pair."""
    return c2.pair_sessions(_load(spark, sf_dir, "conn_logs"), max_gap="2 hours")


@query("admin_port_access")
def q_admin_port_access(spark, sf_dir):
    """E8 on a log with many ports: the port filter and the port in the key."""
    return extensions.admin_port_fanout(_load(spark, sf_dir, "conn_logs_ports"), min_destinations=3)


@query("c2_port_profile")
def q_c2_port_profile(spark, sf_dir):
    """A1 on a log where one pair of hosts talks on several ports."""
    return c2.c2_beacon_profile(_load(spark, sf_dir, "conn_logs_ports")).drop("first_ts", "last_ts")


@query("dns_entropy")
def q_dns_entropy(spark, sf_dir):
    """Shannon entropy per distinct query name."""
    return extensions.dns_entropy(_load(spark, sf_dir, "dns_logs"))


@query("c2_off_hours")
def q_c2_off_hours(spark, sf_dir):
    """Off-hours share of each pair's connections."""
    return extensions.c2_off_hours(_load(spark, sf_dir, "conn_logs"))


@query("dns_subdomains")
def q_dns_subdomains(spark, sf_dir):
    """E5: distinct names per parent domain."""
    return extensions.dns_subdomains(_load(spark, sf_dir, "dns_logs"))


@query("new_logon_pairs")
def q_new_logon_pairs(spark, sf_dir):
    """(account, host) pairs unseen on the baseline day."""
    ev = lateral.logon_events(_load(spark, sf_dir, "win_security"))
    split = F.lit(fx.NEW_PAIRS_SPLIT).cast(ev.schema["timestamp"].dataType)
    return extensions.new_logon_pairs(ev.filter(F.col("timestamp") >= split), ev.filter(F.col("timestamp") < split),
                                      keys=("username", "destination_host"))


@query("logon_escalation")
def q_logon_escalation(spark, sf_dir):
    """Privileged success right after a failure on the same host."""
    return extensions.logon_escalation(_load(spark, sf_dir, "win_security"))


@query("admin_port_fanout")
def q_admin_port_fanout(spark, sf_dir):
    """Distinct destinations per source on the watched ports."""
    return extensions.admin_port_fanout(_load(spark, sf_dir, "conn_logs"), **fx.FANOUT_PARAMS)
