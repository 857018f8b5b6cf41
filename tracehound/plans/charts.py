"""Chart datasets X1–X10: the re-aggregations the dashboards draw.

They run on top of the views in one plan, without a stored intermediate.  A
chart that sums a view again (X1, X2, X5) adds a second, small exchange over the
view's groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_SOURCES = 10


def chart_findings_by_severity(severity_distribution: DataFrame) -> DataFrame:
    """SUM(count) per severity over V3."""
    return severity_distribution.groupBy("severity").agg(F.sum("count").alias("total_count"))


def chart_daily_trend(daily_findings: DataFrame) -> DataFrame:
    """SUM(finding_count) per day and hunt over V1."""
    return daily_findings.groupBy("finding_date", "hunt_name").agg(F.sum("finding_count").alias("total_findings"))


def chart_hunt_performance(hunt_performance: DataFrame) -> DataFrame:
    """The five table columns of V2."""
    return hunt_performance.select("hunt_name", "execution_count", "total_findings", "avg_execution_time", "successful_runs")


def chart_top_sources(top_sources: DataFrame, limit: int = TOP_SOURCES) -> DataFrame:
    """Top sources of V4 by finding count."""
    return top_sources.select("source_ip", "finding_count").orderBy(
        F.desc("finding_count"), F.asc("source_ip")).limit(limit)


def chart_timeline_heatmap(timeline: DataFrame) -> DataFrame:
    """SUM(finding_count) per day and hour over V5."""
    return timeline.groupBy("date", "hour").agg(F.sum("finding_count").alias("total_findings"))


def chart_effectiveness(effectiveness: DataFrame) -> DataFrame:
    """The V7 table."""
    return effectiveness.select("hunt_name", "total_findings", "confirmed_threats", "false_positives", "true_positive_rate")


def chart_investigation_status(status: DataFrame) -> DataFrame:
    """SUM(count) per status and severity over V6."""
    return status.groupBy("status", "severity").agg(F.sum("count").alias("total_count"))


def chart_ioc_feed(ioc_feed: DataFrame) -> DataFrame:
    """The six table columns of D5."""
    return ioc_feed.select("ioc_value", "ioc_type", "times_seen", "threat_level", "first_seen", "last_seen")


def chart_finding_types(finding_types: DataFrame) -> DataFrame:
    """Count per finding type from D3."""
    return finding_types.select("finding_type", "count")


def chart_severity_trends(severity_trends: DataFrame) -> DataFrame:
    """Count per date and severity from D2."""
    return severity_trends.select("date", "severity", "count")
