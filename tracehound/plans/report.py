"""Executive report R1–R5.

R1–R4 are plain aggregates.  R5 assembles them into one nested row without
a join: the four bounded results (1 row, <= 5 severities, <= 10 threats,
one row per hunt) are unioned as tagged structs and folded by one global
aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scoring import severity_rank
from tracehound.functions.timecols import as_date, cutoff
from tracehound.plans.dashboards import since
from tracehound.plans.views import count_when, n_distinct, not_false_positive, run_seconds, severity_at, text_position, \
    with_distinct_list

TOP_THREATS = 10


def report_overall(executions: DataFrame, *, as_of, days: int = 7, approx: bool = False) -> DataFrame:
    """Runs, findings, completed runs and records since the cutoff."""
    return since(executions, "execution_start", as_of, days).agg(
        n_distinct("execution_id", approx).alias("total_hunts"),
        F.sum("findings_count").cast("long").alias("total_findings"),
        count_when(F.col("status") == "completed").alias("successful_hunts"),
        F.sum("records_analyzed").cast("long").alias("total_records_analyzed"),
    )


def report_severity(findings: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    """R2: findings per severity since the cutoff, false positives excluded."""
    f = not_false_positive(since(findings, "timestamp", as_of, days))
    return f.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def report_top_threats(findings: DataFrame, *, as_of, days: int = 7, limit: int = TOP_THREATS) -> DataFrame:
    """confirmed/investigating sources with most findings (top-k)."""
    f = since(findings, "timestamp", as_of, days).filter(F.col("status").isin("confirmed", "investigating"))
    agg = with_distinct_list(
        f.withColumn("_p", text_position()), ["source_ip"], "finding_type", "threat_types",
        {"finding_count": ("count(1)", "sum"), "_p": ("max(_p)", "max")}, max_severity=severity_at(F.col("_p"))).drop("_p")
    return agg.orderBy(F.desc("finding_count"), F.asc_nulls_first("source_ip")).limit(limit)


def report_hunt_performance(executions: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    """Per hunt, completed runs only: runs, findings, mean seconds."""
    e = since(executions, "execution_start", as_of, days).filter(F.col("status") == "completed")
    return e.groupBy("hunt_name").agg(
        F.count(F.lit(1)).alias("execution_count"),
        F.sum("findings_count").cast("long").alias("total_findings"),
        F.avg(run_seconds()).alias("avg_time"),
    )


def report_summary(findings: DataFrame, executions: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    """One row: period, overall counts, success rate (%), records in
    millions, and the three breakdowns as ordered arrays of structs."""
    as_of = as_date(as_of)
    o = report_overall(executions, as_of=as_of, days=days)
    s = report_severity(findings, as_of=as_of, days=days)
    t = report_top_threats(findings, as_of=as_of, days=days)
    p = report_hunt_performance(executions, as_of=as_of, days=days)

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.lit(tag).alias("tag"), F.struct(*df.columns).alias(tag))

    parts = [tagged(o, "overall"),
             tagged(s.withColumn("rank", severity_rank("severity")), "severity"),
             tagged(t, "threats"), tagged(p, "performance")]
    u = parts[0]
    for part in parts[1:]:
        u = u.unionByName(part, allowMissingColumns=True)
    folded = u.agg(
        F.first("overall", ignorenulls=True).alias("ov"),
        F.collect_list("severity").alias("sev"),
        F.collect_list("threats").alias("thr"),
        F.collect_list("performance").alias("perf"),
    )
    ov = F.col("ov")
    total, ok = ov["total_hunts"], ov["successful_hunts"]
    # severity highest first; threats by count desc then source; hunts by name
    sev = F.transform(F.array_sort(F.transform("sev", lambda x: F.struct((-x["rank"]).alias("k"), x["severity"].alias("severity"),
                                                                          x["count"].alias("count")))),
                      lambda x: F.struct(x["severity"].alias("severity"), x["count"].alias("count")))
    thr = F.transform(
        F.array_sort(F.transform("thr", lambda x: F.struct((-x["finding_count"]).alias("k"), x["source_ip"].alias("source_ip"),
                                                            x["finding_count"].alias("finding_count"),
                                                            x["max_severity"].alias("max_severity"),
                                                            x["threat_types"].alias("threat_types")))),
        lambda x: F.struct(x["source_ip"].alias("source_ip"), x["finding_count"].alias("finding_count"),
                           x["max_severity"].alias("max_severity"), x["threat_types"].alias("threat_types")))
    perf = F.array_sort("perf")
    return folded.select(
        F.lit(as_of).alias("report_date"),
        F.lit(days).alias("period_days"),
        F.lit(cutoff(as_of, days)).alias("period_start"),
        F.lit(as_of).alias("period_end"),
        F.coalesce(total, F.lit(0)).cast("long").alias("total_hunts"),
        F.coalesce(ov["total_findings"], F.lit(0)).cast("long").alias("total_findings"),
        F.coalesce(ok, F.lit(0)).cast("long").alias("successful_hunts"),
        F.coalesce(ov["total_records_analyzed"], F.lit(0)).cast("long").alias("records_analyzed"),
        F.try_divide(ok.cast("double") * F.lit(100.0), total.cast("double")).alias("success_rate"),
        (F.coalesce(ov["total_records_analyzed"], F.lit(0)).cast("double") / F.lit(1e6)).alias("records_millions"),
        sev.alias("severity_breakdown"),
        thr.alias("top_threats"),
        perf.alias("hunt_performance"),
    )
