"""Scheduled sweeps (T1–T3) as single batch jobs.

Instead of a timer that re-runs each hunt per day, every event is tagged
with the run(s) it belongs to and the run becomes one more key of the hunt
(``by``) — one plan computes every run of every hunt, and each hunt reads its
log once.  For the sliding C2 sweep the
raw rows are *not* copied into each overlapping window: each pair's
time-slice moments are computed once and merged per hop, each run of windows
that hold the same hops is summed once, and only its profile is given out
to the single windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.timecols import epoch_to_time, normalize_time
from tracehound.operators import c2
from tracehound.operators.hunts import FINDING_COLUMNS, Hunt, chosen
from tracehound.sources.tables import partition_date_range

RUN = ["run_start", "run_end"]
Runs = Callable[[Column], Column]   # day -> array<struct<run_start, run_end>>


def daily_runs(day: Column) -> Column:
    """Each day is its own run."""
    return F.array(F.struct(day.alias("run_start"), day.alias("run_end")))


def weekly_runs(day: Column) -> Column:
    """Runs end on Sundays and cover 8 days [end - 7, end]; a Sunday
    belongs to the run it ends and to the next one."""
    end1 = F.next_day(F.date_sub(day, 1), "Sun")
    run = lambda e: F.struct(F.date_sub(e, 7).alias("run_start"), e.alias("run_end"))
    return F.when(F.dayofweek(day) == 1, F.array(run(end1), run(F.date_add(end1, 7)))).otherwise(F.array(run(end1)))


def tagged(logs: DataFrame, time_col: str, runs: Runs) -> DataFrame:
    """The log with the run(s) of each row; a row without a time has none."""
    day = F.to_date(F.col(f"`{time_col}`"))
    logs = normalize_time(logs, time_col).drop(*RUN)
    return logs.where(day.isNotNull()).withColumn("_run", F.explode(runs(day))).withColumns(
        {"run_start": F.col("_run.run_start"), "run_end": F.col("_run.run_end")}).drop("_run")


def in_one_pass(hunt: Hunt, logs: DataFrame, runs: Runs, **params) -> DataFrame:
    """All runs of a keyed hunt, its log read once however many there are."""
    return hunt.run_by(tagged(logs, hunt.time_col, runs), RUN, **params)


def run_by_run(hunt: Hunt, logs: DataFrame, runs: Runs, **params) -> DataFrame:
    """A hunt that is not keyed, once per run: the runs that the log's days
    belong to (a list of dates) are found first, then each gets its date range."""
    days = normalize_time(logs, hunt.time_col).select(F.to_date(F.col(f"`{hunt.time_col}`")).alias("d")).where("d IS NOT NULL").distinct()
    spans = sorted({(r.r.run_start, r.r.run_end) for r in days.select(F.explode(runs(F.col("d"))).alias("r")).distinct().collect()})
    parts = [hunt.run(partition_date_range(logs, a, b, hunt.time_col), **params).withColumns(
        {"run_start": F.lit(a), "run_end": F.lit(b)}) for a, b in spans]
    if not parts:
        parts = [hunt.run(logs, **params).withColumns({c: F.lit(None).cast("date") for c in RUN}).limit(0)]
    return reduce(DataFrame.unionByName, parts)


def hunt_sweep(inputs: Mapping[str, DataFrame], runs: Runs, params: Mapping[str, Mapping] | None = None,
               names: list[str] | None = None) -> DataFrame:
    """Every registered hunt, every run, one plan."""
    params, parts = params or {}, []
    for h in chosen(inputs, names):
        fn = in_one_pass if h.keyed else run_by_run
        parts.append(fn(h, inputs[h.source], runs, **dict(params.get(h.name, {}))).select(*RUN, *FINDING_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def daily_hunt_sweep(inputs, params=None) -> DataFrame:
    """All hunts for each day (the 02:00 daily routine, for every day)."""
    return hunt_sweep(inputs, daily_runs, params)


def weekly_hunt_sweep(inputs, params=None) -> DataFrame:
    """All hunts over each 8-day week ending on a Sunday."""
    return hunt_sweep(inputs, weekly_runs, params)


def sliding_c2_profile(conn_logs: DataFrame, *, window_hours: int = 72, hop_hours: int = 6,
                       slice_seconds: int = c2.DEFAULT_SLICE_SECONDS) -> DataFrame:
    """The C2 profile of every ``window_hours`` window starting every
    ``hop_hours`` (epoch-aligned, as ``window()``) that holds a connection."""
    size, hop = window_hours * 3600, hop_hours * 3600
    if size % hop or hop % slice_seconds:
        raise ValueError("window must be a multiple of hop, hop a multiple of slice_seconds")
    pairs = c2.conn_pairs(conn_logs).where("ts IS NOT NULL")
    ts_type = pairs.schema["ts"].dataType
    hops = c2.hop_moments(c2.slice_moments(pairs, c2.PAIR, slice_seconds), c2.PAIR, slice_seconds, hop)
    prof = c2.profile_of_moments(c2.sliding_moments(hops, c2.PAIR, size // hop), ["_from", "_to", *c2.PAIR])
    prof = prof.select(F.explode(F.sequence("_from", "_to")).alias("_w"), *prof.columns[2:])
    start = F.col("_w") * F.lit(hop)
    return c2.add_extensions(prof.withColumns({"window_start": epoch_to_time(start, ts_type),
                                               "window_end": epoch_to_time(start + F.lit(size), ts_type)}))


def sliding_c2_sweep(conn_logs: DataFrame, *, window_hours: int = 72, hop_hours: int = 6, min_connections: int = 5,
                     jitter_threshold: float = 150, min_score: float = 50, null_score: str = "reference",
                     slice_seconds: int = c2.DEFAULT_SLICE_SECONDS) -> DataFrame:
    """The C2 hunt over every sliding window."""
    prof = sliding_c2_profile(conn_logs, window_hours=window_hours, hop_hours=hop_hours, slice_seconds=slice_seconds)
    cands = c2.beacon_candidates(prof, min_connections=min_connections, jitter_threshold=jitter_threshold)
    return c2.beacon_findings(c2.score_beacons(cands, min_score=min_score, null_score=null_score),
                              by=["window_start", "window_end"])
