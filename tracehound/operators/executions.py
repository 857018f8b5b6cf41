"""Hunt execution log (K3) and campaign summary.

The reference inserts a 'running' row and later updates it in place.  Here
a run appends events (start, then completion) and the current state of each
run is the latest event of its latest attempt — a ``max_by`` partial aggregate,
no update, no window over a hot key.  Attempts are numbered, so a retry counts
whatever its times are, and an older attempt that ends late does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.plans.views import with_distinct_list

# Columns of a run's state, as in the result table.
STATE_COLUMNS = ["hunt_name", "execution_start", "execution_end", "status", "records_analyzed", "findings_count"]
START, COMPLETE = 0, 1


def execution_events(executions: DataFrame) -> DataFrame:
    """Split run rows into their start event and, for runs that finished,
    the completion event (status, end time, counts)."""
    start = F.struct(
        F.lit(START).alias("event_seq"),
        F.col("execution_start").alias("event_time"),
        F.col("hunt_name"), F.col("execution_start"),
        F.lit(None).cast(executions.schema["execution_end"].dataType).alias("execution_end"),
        F.lit("running").alias("status"),
        F.lit(None).cast("long").alias("records_analyzed"),
        F.lit(None).cast("int").alias("findings_count"),
    )
    done = F.struct(
        F.lit(COMPLETE).alias("event_seq"),
        F.col("execution_end").alias("event_time"),
        F.col("hunt_name"), F.col("execution_start"), F.col("execution_end"), F.col("status"),
        F.col("records_analyzed").cast("long").alias("records_analyzed"),
        F.col("findings_count").cast("int").alias("findings_count"),
    )
    finished = F.col("status") != "running"
    ev = F.explode(F.when(finished, F.array(start, done)).otherwise(F.array(start)))
    return executions.select("execution_id", F.lit(1).alias("attempt"), ev.alias("e")).select("execution_id", "attempt", "e.*")


def execution_log_latest(events: DataFrame) -> DataFrame:
    """Current state per run: the event with the highest (attempt, event_seq,
    event_time).  Events without an attempt number come first."""
    attempt = F.coalesce(F.col("attempt"), F.lit(0)) if "attempt" in events.columns else F.lit(0)
    latest = events.groupBy("execution_id").agg(
        F.max_by(F.struct(*STATE_COLUMNS), F.struct(attempt, "event_seq", "event_time")).alias("_s"))
    return latest.select("execution_id", "_s.*")


def campaign_summary(executions: DataFrame) -> DataFrame:
    """Per campaign (runs started the same day): runs, completed,
    failed, findings of completed runs, and the hunts that ran."""
    return with_distinct_list(
        executions.withColumn("campaign_date", F.to_date("execution_start")), ["campaign_date"], "hunt_name", "hunts",
        {"hunts_run": ("count(1)", "sum"),
         "successful_hunts": ("count_if(status = 'completed')", "sum"),
         "failed_hunts": ("count_if(status = 'failed')", "sum"),
         "total_findings": ("sum(CASE WHEN status = 'completed' THEN CAST(findings_count AS BIGINT) END)", "sum")},
        total_findings=F.coalesce("total_findings", F.lit(0)).cast("long"))
