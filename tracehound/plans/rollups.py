"""Mergeable summaries of findings and runs, for exports that do not read
the findings again (V1, V4, V5, D1, R1).

Each run stores its own partials; readers merge them.  Counts, sums and the
per-source table are exact.  Distinct sources, destinations and runs come from
HyperLogLog sketches of 2**SKETCH_BITS registers: a standard error of
1.04 / sqrt(2**SKETCH_BITS), 1.6 %, however the partials were cut; groups of
a few hundred values or less come out exact but for rare hash collisions.

* hourly – date x hour x hunt x severity, false positives left out: V1 and V5;
* sources – source x finding type, false positives left out: V4, whose number
  of finding types is a count of rows, not a sketch;
* runs – hunt x day of the execution log: D1 and R1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scoring import severity_from_rank, severity_rank
from tracehound.functions.timecols import as_date, cutoff
from tracehound.plans.views import count_when, not_false_positive, run_seconds, severity_at, text_position

SKETCH_BITS = 12
HOUR_KEYS = ["finding_date", "hour", "hunt_name", "severity"]
SOURCE_KEYS = ["source_ip", "finding_type"]
RUN_KEYS = ["hunt_name", "execution_date"]
#: Both summaries of a run in one table: hourly rows have an hour, source rows a source.
PARTIALS_SCHEMA = ("finding_date date, hour int, hunt_name string, severity string, finding_count bigint, score_sum decimal(38,2), score_n bigint, "
                   "sources binary, destinations binary, source_ip string, finding_type string, text_rank int, rank int, first_seen timestamp, last_seen timestamp")
_HOURLY = [*HOUR_KEYS, "finding_count", "score_sum", "score_n", "sources", "destinations"]
_SOURCE = [*SOURCE_KEYS, "finding_count", "score_sum", "score_n", "text_rank", "rank", "first_seen", "last_seen"]


def _sketch(col: str) -> Column:
    return F.hll_sketch_agg(col, SKETCH_BITS)


def _estimate(col: str) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(col))


def _score() -> list[Column]:
    s = F.col("confidence_score")
    return [F.sum(s.cast("decimal(28,2)")).cast("decimal(38,2)").alias("score_sum"), F.count(s).alias("score_n")]


def _merged_score() -> list[Column]:
    return [F.sum("score_sum").cast("decimal(38,2)").alias("score_sum"), F.sum("score_n").alias("score_n")]


def _mean_score() -> Column:
    return F.try_divide(F.sum("score_sum").cast("double"), F.sum("score_n").cast("double"))


def hourly_partial(findings: DataFrame) -> DataFrame:
    """The hourly summary of some findings."""
    at = F.col("timestamp")
    return not_false_positive(findings).groupBy(F.to_date(at).alias("finding_date"), F.hour(at).alias("hour"), "hunt_name", "severity").agg(
        F.count(F.lit(1)).alias("finding_count"), *_score(), _sketch("source_ip").alias("sources"), _sketch("destination_ip").alias("destinations"))


def merge_hourly(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*HOUR_KEYS).agg(
        F.sum("finding_count").alias("finding_count"), *_merged_score(),
        F.hll_union_agg("sources").alias("sources"), F.hll_union_agg("destinations").alias("destinations"))


def daily_findings(hourly: DataFrame) -> DataFrame:
    """V1 from hourly summaries."""
    return hourly.groupBy("finding_date", "hunt_name", "severity").agg(
        F.sum("finding_count").alias("finding_count"), _mean_score().alias("avg_confidence"),
        _estimate("sources").alias("unique_sources"), _estimate("destinations").alias("unique_destinations"))


def hunt_timeline(hourly: DataFrame) -> DataFrame:
    """V5 from hourly summaries."""
    return hourly.groupBy(F.col("finding_date").alias("date"), "hour", "hunt_name").agg(
        F.sum("finding_count").alias("finding_count"), _estimate("sources").alias("unique_sources"))


def source_partial(findings: DataFrame) -> DataFrame:
    """The per-source summary of some findings."""
    return not_false_positive(findings).where("source_ip IS NOT NULL").groupBy(*SOURCE_KEYS).agg(
        F.count(F.lit(1)).alias("finding_count"), *_score(), F.max(text_position()).alias("text_rank"), F.max(severity_rank("severity")).alias("rank"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


_SOURCE_MERGE = {"finding_count": F.sum, "text_rank": F.max, "rank": F.max, "first_seen": F.min, "last_seen": F.max}


def merge_sources(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*SOURCE_KEYS).agg(*_merged_score(), *[f(c).alias(c) for c, f in _SOURCE_MERGE.items()]).select(_SOURCE)


def top_sources(partials: DataFrame) -> DataFrame:
    """V4 from per-source summaries; exact."""
    agg = merge_sources(partials).groupBy("source_ip").agg(
        F.sum("finding_count").alias("finding_count"), F.count("finding_type").alias("unique_finding_types"),
        severity_at(F.max("text_rank")).alias("max_severity"), severity_from_rank(F.max("rank")).alias("max_severity_ranked"),
        _mean_score().alias("avg_confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return agg.where("finding_count > 1").orderBy(F.desc("finding_count"), F.asc("source_ip"))


def partials(findings: DataFrame) -> DataFrame:
    """Both summaries of some findings, as stored.  A finding without a time
    is in an hour of its own (-1)."""
    hourly = hourly_partial(findings).withColumn("hour", F.coalesce("hour", F.lit(-1)))
    rows = hourly.unionByName(source_partial(findings), allowMissingColumns=True)
    return rows.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in PARTIALS_SCHEMA.split(", "))])


def hourly_of(rows: DataFrame) -> DataFrame:
    return rows.where("source_ip IS NULL").select(_HOURLY).withColumn("hour", F.nullif("hour", F.lit(-1)))


def sources_of(rows: DataFrame) -> DataFrame:
    return rows.where("source_ip IS NOT NULL").select(_SOURCE)


def merge_partials(rows: DataFrame) -> DataFrame:
    """Stored summaries of several runs as one."""
    hourly = merge_hourly(rows.where("source_ip IS NULL").select(_HOURLY))
    both = hourly.unionByName(merge_sources(sources_of(rows)), allowMissingColumns=True)
    return both.select([c.split(" ", 1)[0] for c in PARTIALS_SCHEMA.split(", ")])


def runs_partial(executions: DataFrame) -> DataFrame:
    """The per-day summary of some runs."""
    return executions.groupBy("hunt_name", F.to_date("execution_start").alias("execution_date")).agg(
        _sketch("execution_id").alias("runs"), F.sum("findings_count").cast("long").alias("total_findings"),
        F.sum(run_seconds()).alias("seconds_sum"), F.count(run_seconds()).alias("seconds_n"), F.max("execution_start").alias("last_run"),
        count_when(F.col("status") == "completed").alias("completed"), F.sum("records_analyzed").cast("long").alias("records_analyzed"))


def _days(runs: DataFrame, as_of, days: int) -> DataFrame:
    return runs.where(F.col("execution_date") >= F.lit(as_date(cutoff(as_of, days))))


def hunt_summary(runs: DataFrame, *, as_of, days: int = 30) -> DataFrame:
    """D1 from daily run summaries: only the days since the cutoff are read."""
    return _days(runs, as_of, days).groupBy("hunt_name").agg(
        _estimate("runs").alias("total_executions"), F.sum("total_findings").alias("total_findings"),
        F.try_divide(F.sum("seconds_sum"), F.sum("seconds_n")).cast("double").alias("avg_time_seconds"), F.max("last_run").alias("last_run"))


def overall(runs: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    """R1 from daily run summaries."""
    return _days(runs, as_of, days).agg(
        F.coalesce(_estimate("runs"), F.lit(0)).alias("total_hunts"), F.sum("total_findings").alias("total_findings"),
        F.coalesce(F.sum("completed"), F.lit(0)).alias("successful_hunts"), F.sum("records_analyzed").alias("total_records_analyzed"))
