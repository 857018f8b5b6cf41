"""Dashboard summaries D1–D6: the exported tables, as DataFrames.

``as_of`` replaces the reference's wall clock; the cutoff is midnight of
``as_of - days`` with no upper bound, as in the reference.  The cutoff is
a literal of the column's own type, so it reaches the parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scoring import severity_from_rank, severity_rank
from tracehound.functions.timecols import at_midnight, cutoff
from tracehound.plans.views import avg_score, count_when, n_distinct, not_false_positive, run_seconds, severity_at, \
    text_position, with_distinct_list

TOP_INDICATORS_LIMIT = 100


def since(df: DataFrame, col: str, as_of: _dt.date | str, days: int) -> DataFrame:
    """P10: ``col >= midnight(as_of - days)``."""
    return df.filter(F.col(col) >= at_midnight(cutoff(as_of, days), df.schema[col].dataType))


def dashboard_hunt_summary(executions: DataFrame, *, as_of, days: int = 30, approx: bool = False) -> DataFrame:
    """Per hunt since the cutoff: executions, findings, mean time, last run."""
    return since(executions, "execution_start", as_of, days).groupBy("hunt_name").agg(
        n_distinct("execution_id", approx).alias("total_executions"),
        F.sum("findings_count").cast("long").alias("total_findings"),
        F.avg(run_seconds()).alias("avg_time_seconds"),
        F.max("execution_start").alias("last_run"),
    )


def dashboard_severity_trends(findings: DataFrame, *, as_of, days: int = 30) -> DataFrame:
    """Date x severity, ordered by date then severity level."""
    f = not_false_positive(since(findings, "timestamp", as_of, days))
    agg = f.groupBy(F.to_date("timestamp").alias("date"), "severity").agg(F.count(F.lit(1)).alias("count"))
    return agg.orderBy("date", F.desc(severity_rank("severity")))


def dashboard_finding_types(findings: DataFrame, *, as_of, days: int = 30) -> DataFrame:
    """D3: per finding type: count and mean confidence, most first."""
    f = not_false_positive(since(findings, "timestamp", as_of, days))
    agg = f.groupBy("finding_type").agg(F.count(F.lit(1)).alias("count"), avg_score().alias("avg_confidence"))
    return agg.orderBy(F.desc("count"), F.asc("finding_type"))


def dashboard_top_indicators(findings: DataFrame, *, as_of, days: int = 30,
                             limit: int = TOP_INDICATORS_LIMIT) -> DataFrame:
    """(source, destination) pairs seen more than 5 times, top ``limit``
    (a top-k: TakeOrderedAndProject keeps only ``limit`` rows per task)."""
    f = not_false_positive(since(findings, "timestamp", as_of, days))
    agg = with_distinct_list(
        f.withColumn("_p", text_position()), ["source_ip", "destination_ip"], "finding_type", "finding_types",
        {"occurrence_count": ("count(1)", "sum"), "_p": ("max(_p)", "max")}, max_severity=severity_at(F.col("_p"))).drop("_p")
    return (agg.filter(F.col("occurrence_count") > 5)
            .orderBy(F.desc("occurrence_count"), F.asc_nulls_first("source_ip"), F.asc_nulls_first("destination_ip"))
            .limit(limit))


# Indicator kinds of the IOC feed: (branch, ioc_type, finding column).
IOC_FEED_BRANCHES = [
    ("source", "ip", "source_ip"),
    ("destination", "ip", "destination_ip"),
    ("hostname", "domain", "destination_hostname"),
]


def dashboard_ioc_feed(findings: DataFrame) -> DataFrame:
    """The three indicator roll-ups of the reference's UNION ALL, in one
    scan: explode each finding to its (branch, type, value) indicators and
    group once.  An IP seen as source and as destination appears twice."""
    f = findings.filter(F.col("status").isin("confirmed", "investigating"))
    ind = F.explode(F.array(*[
        F.struct(F.lit(b).alias("branch"), F.lit(t).alias("ioc_type"), F.col(c).alias("ioc_value"))
        for b, t, c in IOC_FEED_BRANCHES
    ])).alias("ind")
    x = f.select(ind, "timestamp", "severity", "finding_type", "confidence_score").select(
        "ind.*", "timestamp", "severity", "finding_type", "confidence_score").filter(F.col("ioc_value").isNotNull())
    agg = with_distinct_list(
        x.withColumns({"_p": text_position(), "_r": severity_rank("severity")}), ["branch", "ioc_type", "ioc_value"],
        "finding_type", "associated_hunts",
        {"first_seen": ("min(timestamp)", "min"), "last_seen": ("max(timestamp)", "max"), "times_seen": ("count(1)", "sum"),
         "_p": ("max(_p)", "max"), "_r": ("max(_r)", "max"), "max_confidence": ("max(confidence_score)", "max")},
        threat_level=severity_at(F.col("_p")), threat_level_ranked=severity_from_rank("_r"),
        max_confidence=F.col("max_confidence").cast("double")).drop("_p", "_r")
    return agg.drop("branch")


def hunt_statistics(executions: DataFrame, findings: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    """D6 (J1 + A8 + W3): per completed run in the last ``days`` days, its
    findings by severity and status; the last run per (hunt, date) wins.

    The window's executions come first: findings are cut to their ids by a
    semi-join before anything is aggregated (stored findings are foldered by
    execution, so other folders are not read), then pre-aggregated per
    execution (one row per execution on both sides of the join).  "Last wins"
    is a ``max_by`` (partial aggregate) instead of a window."""
    day0 = cutoff(as_of, days)
    ex = executions.filter((F.col("status") == "completed") & (F.to_date("execution_start") >= F.lit(day0)))
    sev = F.col("severity")
    inside = findings.join(ex.select("execution_id").distinct(), "execution_id", "left_semi")
    fagg = inside.groupBy("execution_id").agg(
        F.count("finding_id").alias("total_findings"),
        count_when(sev == "critical").alias("critical_findings"),
        count_when(sev == "high").alias("high_findings"),
        count_when(sev == "medium").alias("medium_findings"),
        count_when(sev == "low").alias("low_findings"),
        count_when(F.col("status") == "false_positive").alias("false_positives"),
        count_when(F.col("status") == "confirmed").alias("confirmed_threats"),
        F.sum("confidence_score").alias("_score_sum"),
        F.count("confidence_score").alias("_score_n"),
    )
    j = ex.join(fagg, "execution_id", "left")
    counters = ["total_findings", "critical_findings", "high_findings", "medium_findings", "low_findings",
                "false_positives", "confirmed_threats"]
    keys = ["hunt_name", F.to_date("execution_start").alias("execution_date"), "records_analyzed",
            "execution_start", "execution_end"]
    per_run = j.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters],
        F.try_divide(F.sum("_score_sum"), F.sum("_score_n")).cast("double").alias("avg_confidence_score"),
    ).withColumn("execution_time_seconds", run_seconds())
    cols = counters + ["avg_confidence_score", "records_analyzed", "execution_time_seconds"]
    latest = per_run.groupBy("hunt_name", "execution_date").agg(
        F.max_by(F.struct(*cols), F.struct("execution_start", "execution_end", "records_analyzed")).alias("_row"))
    return latest.select("hunt_name", "execution_date", "_row.*")


def upsert_statistics(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K5: replace rows whose (hunt_name, execution_date) is in ``new``."""
    kept = existing.join(new.select("hunt_name", "execution_date"), ["hunt_name", "execution_date"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def export_summary_statistics(findings: DataFrame, executions: DataFrame, *, as_of, days: int = 30,
                              approx: bool = False) -> dict[str, DataFrame]:
    """The four summary tables of one export run (lazy)."""
    return {
        "dashboard_hunt_summary": dashboard_hunt_summary(executions, as_of=as_of, days=days, approx=approx),
        "dashboard_severity_trends": dashboard_severity_trends(findings, as_of=as_of, days=days),
        "dashboard_finding_types": dashboard_finding_types(findings, as_of=as_of, days=days),
        "dashboard_top_indicators": dashboard_top_indicators(findings, as_of=as_of, days=days),
    }
