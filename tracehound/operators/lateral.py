"""Lateral movement: one account reaching many hosts from one source
within a time bucket.

Distinct hosts are counted in two stages — ``(user, source, bucket, host)``
then ``(user, source, bucket)`` — so a hot account is spread over hosts in
the first shuffle and the second shuffle carries one row per distinct host
(bounded by the host inventory), never one row per logon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.functions import scoring, text
from tracehound.functions.timecols import epoch_seconds, normalize_time, text_time

HUNT = "lateral_movement"
GROUP = ["username", "source_ip", "time_bucket"]


def logon_events(win_logs: DataFrame, *, time_col: str = "@timestamp", keep: Sequence[str] = ()) -> DataFrame:
    """Keep logon event codes (pushed into the parquet scan), rename."""
    df = normalize_time(win_logs, time_col, "_t")
    return df.filter(F.col("event_code").cast("string").isin(*scoring.LOGON_EVENT_CODES)).select(
        F.col("_t").alias("timestamp"),
        F.col("event_code").cast("string").alias("event_code"),
        F.col("user_name").alias("username"),
        F.col("host_name").alias("destination_host"),
        F.col("source_ip"),
        F.col("logon_type"),
        *[F.col(f"`{k}`") for k in keep],
    )


def bucketed(logons: DataFrame, time_window_minutes: int) -> DataFrame:
    """Epoch-aligned tumbling bucket number."""
    return logons.withColumn("time_bucket", F.floor(epoch_seconds("timestamp") / F.lit(time_window_minutes * 60)))


def burst_profile(logons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A3 over bucketed logons: distinct hosts, attempts, sorted host list,
    first/last logon per (user, source, bucket)."""
    g = [*by, *GROUP]
    per_host = logons.groupBy(*g, "destination_host").agg(
        F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    return hosts_merged(per_host, g)


def hosts_merged(per_host: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The second stage of A3, from one row per distinct host of a group."""
    return per_host.groupBy(*keys).agg(
        F.count("destination_host").alias("unique_hosts"),
        F.sum("_n").alias("logon_attempts"),
        F.array_sort(F.collect_list("destination_host")).alias("hosts_accessed"),
        F.min("_first").alias("first_logon"),
        F.max("_last").alias("last_logon"),
    )


def lateral_profile(win_logs: DataFrame, *, time_window_minutes: int = 60, time_col: str = "@timestamp",
                    by: Sequence[str] = ()) -> DataFrame:
    """A3: per (username, source_ip, time_bucket) burst statistics.  ``by``
    names further key columns of the log."""
    return burst_profile(bucketed(logon_events(win_logs, time_col=time_col, keep=by), time_window_minutes), by)


def with_privilege(profile: DataFrame, patterns: Sequence[str] = scoring.PRIVILEGED_PATTERNS) -> DataFrame:
    """G1: native replacement of the row-at-a-time privileged-name UDF."""
    return profile.withColumn("is_privileged_account", scoring.is_privileged("username", patterns))


def movement_findings(profile: DataFrame, *, time_window_minutes: int, min_hosts: int = 5,
                      privileged_accounts: Sequence[str] = scoring.PRIVILEGED_PATTERNS,
                      min_score: float = 50, by: Sequence[str] = ()) -> DataFrame:
    """P6 + G1 + F5 + P7 + P8."""
    cand = with_privilege(profile.filter(F.col("unique_hosts") >= min_hosts), privileged_accounts)
    s = scoring.lateral_score(F.col("unique_hosts"), F.col("logon_attempts"), F.col("is_privileged_account"))
    scored = cand.withColumn("_score", s).filter(F.col("_score") > min_score)
    raw = text.raw_json(
        unique_hosts_count=F.col("unique_hosts"),
        logon_attempts=F.col("logon_attempts"),
        hosts_accessed=F.col("hosts_accessed"),
        is_privileged_account=F.col("is_privileged_account"),
        first_logon=text_time("first_logon"),
        last_logon=text_time("last_logon"),
        time_window_minutes=F.lit(time_window_minutes),
    )
    return scored.select(
        *by,
        F.lit(HUNT).alias("hunt_name"),
        F.when(F.col("is_privileged_account"), F.lit("critical")).otherwise(F.lit("high")).alias("severity"),
        F.lit(HUNT).alias("finding_type"),
        F.col("source_ip"),
        F.lit(None).cast("string").alias("destination_ip"),
        F.lit(None).cast("string").alias("destination_hostname"),
        F.col("username"),
        F.col("first_logon").alias("timestamp"),
        F.round(F.col("_score"), 2).alias("confidence_score"),
        text.lateral_description(F.col("username"), F.col("unique_hosts"), time_window_minutes,
                                 F.col("source_ip")).alias("description"),
        raw.alias("raw_data"),
    )


def lateral_movement(win_logs: DataFrame, *, time_window_minutes: int = 60, min_hosts: int = 5,
                     privileged_accounts: Sequence[str] = scoring.PRIVILEGED_PATTERNS,
                     min_score: float = 50, time_col: str = "@timestamp", by: Sequence[str] = ()) -> DataFrame:
    """The lateral movement hunt: Windows security log -> findings, for each
    value of the ``by`` columns apart."""
    prof = lateral_profile(win_logs, time_window_minutes=time_window_minutes, time_col=time_col, by=by)
    return movement_findings(prof, time_window_minutes=time_window_minutes, min_hosts=min_hosts,
                             privileged_accounts=privileged_accounts, min_score=min_score, by=by)
