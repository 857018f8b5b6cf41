"""Dashboard views V1–V7 over the findings and executions tables.

Each is one partial-aggregated ``groupBy`` (map-side combine before the
shuffle, so hot keys cost one row per map task).  ``approx=True`` swaps
exact distinct counts for HyperLogLog sketches on very large tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scoring import SEVERITY_LEVELS, severity_from_rank, severity_rank

# Severity levels in text order: how MAX over the severity text ranks them.
TEXT_ORDER = sorted(SEVERITY_LEVELS)


def not_false_positive(findings: DataFrame) -> DataFrame:
    """``status != 'false_positive'`` (NULL status drops, as in SQL)."""
    return findings.filter(F.col("status") != "false_positive")


def avg_score(col: str = "confidence_score") -> Column:
    return F.avg(F.col(col)).cast("double")


def n_distinct(col: str, approx: bool = False) -> Column:
    return F.approx_count_distinct(col) if approx else F.countDistinct(col)


def run_seconds(start: str = "execution_start", end: str = "execution_end") -> Column:
    """TIMESTAMPDIFF(SECOND, start, end): whole elapsed seconds, NULL while running."""
    return F.timestamp_diff("SECOND", F.col(start), F.col(end))


def count_when(cond: Column) -> Column:
    return F.count_if(cond)


def max_severity_text(col: str = "severity") -> Column:
    """MAX over the severity text (what the reference's SQL returns:
    'medium' > 'low' > 'info' > 'high' > 'critical').  Computed as the max of
    each level's text position, an integer, so the aggregate stays
    hash-based (a string max forces a sort-based aggregate).  Severity is
    the result table's five-level enum; other text is ignored."""
    return severity_at(F.max(text_position(col)))


def text_position(col: str = "severity") -> Column:
    c = F.col(col)
    pos = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, level in enumerate(TEXT_ORDER):
        pos = pos.when(c == level, F.lit(i))
    return pos


def severity_at(m: Column) -> Column:
    out = F.when(m.isNull(), F.lit(None).cast("string"))
    for i, level in enumerate(TEXT_ORDER):
        out = out.when(m == i, F.lit(level))
    return out


def max_severity_ranked(col: str = "severity") -> Column:
    """Highest severity by level (critical > high > ...)."""
    return severity_from_rank(F.max(severity_rank(col)))


def listed(col: str) -> Column:
    """The values of ``col``, one row each, sorted and comma-joined; NULL when
    there is none.  Collect only after grouping by ``col`` as well."""
    s = F.array_sort(F.collect_list(col))
    return F.when(F.size(s) > 0, F.array_join(s, ","))


def with_distinct_list(df: DataFrame, keys: Sequence[str], col: str, alias: str, parts: Mapping[str, tuple[str, str]],
                       **finished: Column) -> DataFrame:
    """GROUP BY ``keys`` with GROUP_CONCAT(DISTINCT ``col``) as ``alias``.

    ``parts`` names mergeable aggregates: alias -> (SQL over the rows, SQL
    function that merges them).  They are taken per (keys, col) first, in a
    hash aggregate with fixed-width buffers; the list is then collected from
    at most one row per value.  ``finished`` replaces merged columns."""
    per_value = df.groupBy(*keys, col).agg(*[F.expr(first).alias(a) for a, (first, _) in parts.items()])
    out = per_value.groupBy(*keys).agg(*[F.expr(f"{merge}({a})").alias(a) for a, (_, merge) in parts.items()], listed(col).alias(alias))
    return out.withColumns(finished) if finished else out


def vw_daily_findings(findings: DataFrame, approx: bool = False) -> DataFrame:
    """V1: date x hunt x severity, false positives excluded."""
    return not_false_positive(findings).groupBy(
        F.to_date("timestamp").alias("finding_date"), "hunt_name", "severity"
    ).agg(
        F.count(F.lit(1)).alias("finding_count"),
        avg_score().alias("avg_confidence"),
        n_distinct("source_ip", approx).alias("unique_sources"),
        n_distinct("destination_ip", approx).alias("unique_destinations"),
    )


def vw_hunt_performance(executions: DataFrame) -> DataFrame:
    """V2: hunt x run date: runs, findings, mean run time, records, outcomes."""
    return executions.groupBy("hunt_name", F.to_date("execution_start").alias("execution_date")).agg(
        F.count(F.lit(1)).alias("execution_count"),
        F.sum("findings_count").cast("long").alias("total_findings"),
        F.avg(run_seconds()).alias("avg_execution_time"),
        F.sum("records_analyzed").cast("long").alias("total_records_analyzed"),
        count_when(F.col("status") == "completed").alias("successful_runs"),
        count_when(F.col("status") == "failed").alias("failed_runs"),
    )


def vw_severity_distribution(findings: DataFrame) -> DataFrame:
    """V3: severity x finding type, false positives excluded."""
    return not_false_positive(findings).groupBy("severity", "finding_type").agg(
        F.count(F.lit(1)).alias("count"), avg_score().alias("avg_confidence"))


def vw_top_sources(findings: DataFrame, approx: bool = False) -> DataFrame:
    """V4: per source with more than one finding, most findings first."""
    f = not_false_positive(findings).filter(F.col("source_ip").isNotNull())
    agg = f.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("finding_count"),
        n_distinct("finding_type", approx).alias("unique_finding_types"),
        max_severity_text().alias("max_severity"),
        max_severity_ranked().alias("max_severity_ranked"),
        avg_score().alias("avg_confidence"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    return agg.filter(F.col("finding_count") > 1).orderBy(F.desc("finding_count"), F.asc("source_ip"))


def vw_hunt_timeline(findings: DataFrame, approx: bool = False) -> DataFrame:
    """V5: date x hour x hunt."""
    return not_false_positive(findings).groupBy(
        F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "hunt_name"
    ).agg(F.count(F.lit(1)).alias("finding_count"), n_distinct("source_ip", approx).alias("unique_sources"))


def vw_investigation_status(findings: DataFrame) -> DataFrame:
    """V6: status x severity with the oldest/newest creation time."""
    return findings.groupBy("status", "severity").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("created_at").alias("oldest_finding"),
        F.max("created_at").alias("newest_finding"),
    )


def vw_hunt_effectiveness(findings: DataFrame) -> DataFrame:
    """V7: per hunt: total, confirmed, false positives, true-positive rate (%)."""
    agg = findings.groupBy("hunt_name").agg(
        F.count(F.lit(1)).alias("total_findings"),
        count_when(F.col("status") == "confirmed").alias("confirmed_threats"),
        count_when(F.col("status") == "false_positive").alias("false_positives"),
    )
    return agg.withColumn(
        "true_positive_rate",
        F.round(F.col("confirmed_threats").cast("double") * F.lit(100.0) / F.col("total_findings").cast("double"), 2))


VIEWS = {
    "vw_daily_findings": ("findings", vw_daily_findings),
    "vw_hunt_performance": ("executions", vw_hunt_performance),
    "vw_severity_distribution": ("findings", vw_severity_distribution),
    "vw_top_sources": ("findings", vw_top_sources),
    "vw_hunt_timeline": ("findings", vw_hunt_timeline),
    "vw_investigation_status": ("findings", vw_investigation_status),
    "vw_hunt_effectiveness": ("findings", vw_hunt_effectiveness),
}


# Views whose distinct counts can come from sketches.
APPROXIMATE = ("vw_daily_findings", "vw_top_sources", "vw_hunt_timeline")


def create_dashboard_views(findings: DataFrame, executions: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """K6: register all seven views as temp views (lazy; nothing runs)."""
    src = {"findings": findings, "executions": executions}
    out = {}
    for name, (table, fn) in VIEWS.items():
        df = fn(src[table], approx=approx) if name in APPROXIMATE else fn(src[table])
        df.createOrReplaceTempView(name)
        out[name] = df
    return out
