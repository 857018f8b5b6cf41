"""End-to-end jobs: a hunt run (execute), a campaign, and the export.

``run_hunt_job`` replaces the reference's execute(): start event -> read the
date range -> hunt -> de-duplicate against stored findings -> one write -> IOC
roll-up -> completion event.  The hunt, de-dup and projection are one lazy plan
executed by a single write; the analysed-record and finding counts are taken in
that same pass with ``observe``.  Everything a run stores is keyed by its
execution id and replaced whole, so a job that is retried or repeated after a
crash at any point ends in the same state.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracehound.functions.timecols import as_date, cutoff
from tracehound.operators import dedup, hunts, ioc
from tracehound.operators.executions import execution_log_latest
from tracehound.plans import dashboards, report, rollups, views
from tracehound.sources import manifest, sinks
from tracehound.sources.manifest import one_row
from tracehound.sources.tables import lookback_range, partition_date_range, read_table


def _paths(results_dir: str) -> dict[str, str]:
    return {k: os.path.join(results_dir, k) for k in (
        "hunt_findings", "hunt_executions", "hunt_iocs", "hunt_statistics", "finding_edits", "finding_rollups")}


def _event(spark: SparkSession, row: dict) -> DataFrame:
    return one_row(spark, sinks.EVENT_SCHEMA, **row)


def _logs(spark: SparkSession, h: hunts.Hunt, logs: DataFrame | str, start: _dt.date, end: _dt.date, fmt: str) -> DataFrame:
    """The hunt's log, cut to the date range (in a path: only its folders)."""
    if isinstance(logs, str):
        return read_table(spark, logs, start, end, fmt=fmt, time_col=h.time_col)
    return partition_date_range(logs, start, end, h.time_col)


def run_hunt_job(spark: SparkSession, name: str, logs: DataFrame | str | None, *, results_dir: str, execution_id: int | None = None,
                 start_date: _dt.date | str, end_date: _dt.date | str, params: Mapping | None = None,
                 dedup_mode: str = "fingerprint", lookback_days: int = 7, now: _dt.datetime | None = None,
                 fmt: str = "parquet") -> dict:
    """Run one hunt over the days [start_date, end_date] of ``logs`` (a table
    path or a frame) and store its findings, execution events and IOC roll-up.

    ``dedup_mode="source"`` reproduces the reference's check (same type and
    source with an *event time* in the look-back), "fingerprint" drops
    findings whose five-field fingerprint was stored in the look-back, and
    repeats within the run.  ``now`` (UTC unless it has a zone) stands for the
    start of the run.  Without an ``execution_id`` the run gets a new one; the
    id of an earlier run of this hunt repeats that run, and its latest attempt
    is the one that counts."""
    params = dict(params or {})
    h = hunts.get(name)
    now, clock = sinks.utc(now or _dt.datetime.now(_dt.timezone.utc)), time.monotonic()
    start_date, end_date = as_date(start_date), as_date(end_date)
    p = _paths(results_dir)
    if execution_id is None:
        execution_id = sinks.new_execution_id(spark, p["hunt_executions"])
    attempt = sinks.start_attempt(spark, p["hunt_executions"], execution_id, name)
    base = {"execution_id": execution_id, "attempt": attempt, "hunt_name": name, "hunt_version": h.version, "execution_start": now,
            "date_range_start": start_date, "date_range_end": end_date, "parameters": json.dumps(params, default=str)}

    def finish(status: str, **fields) -> None:
        end = now + _dt.timedelta(seconds=time.monotonic() - clock)
        sinks.append_events(_event(spark, {**base, "event_seq": 1, "event_time": end, "execution_end": end,
                                           "status": status, **fields}), p["hunt_executions"])

    sinks.append_events(_event(spark, {**base, "event_seq": 0, "event_time": now, "status": "running"}), p["hunt_executions"])
    try:
        if logs is None:
            raise ValueError(f"hunt {name} has no log ({h.source})")
        seen, written = Observation(f"records_{execution_id}"), Observation(f"findings_{execution_id}")
        # the count rides on the hunt's own scan; the scope filter stays below
        # the observation so it is still pushed into the reader
        scoped = h.scope(_logs(spark, h, logs, start_date, end_date, fmt))
        findings = h.run(scoped.observe(seen, F.count(F.lit(1)).alias("n")), **params)
        staged = None
        if sinks.exists(spark, p["hunt_findings"]):
            # stored before the de-duplication, which reads them twice; the log is read once
            staged = f"{results_dir}/_staging/execution_id={execution_id}/attempt={attempt}"
            findings.write.mode("overwrite").parquet(staged)
            findings = spark.read.schema(findings.schema).parquet(staged)
        # a re-run of this execution replaces its own output
        history = sinks.read_findings(spark, p["hunt_findings"]).filter(F.col("execution_id") != execution_id)
        if dedup_mode == "fingerprint":
            history = history.filter(F.col("created_date") >= F.lit(cutoff(now.date(), lookback_days)))
            findings = (dedup.dedup_fingerprint(findings, history, as_of=now.date(), lookback_days=lookback_days) if staged
                        else dedup.first_per_fingerprint(findings).drop("fingerprint"))     # nothing is stored yet
        elif staged:
            findings = dedup.dedup_source(findings, history, as_of=now.date(), lookback_days=lookback_days, prefilter=True)
        table = sinks.to_findings_table(findings, execution_id, now).observe(written, F.count(F.lit(1)).alias("n"))
        sinks.write_findings(table, p["hunt_findings"], execution_id, now)
        n_found, records = int(written.get.get("n") or 0), int(seen.get.get("n") or 0)
        stored = sinks.read_findings(spark, p["hunt_findings"]).filter(F.col("execution_id") == execution_id)
        sinks.write_iocs(ioc.stored_partial(stored), p["hunt_iocs"], execution_id, attempt)
        if attempt > 1:     # its summaries may be there already; those of new runs wait for the next export
            _summarise(spark, p, execution_id)
        if staged:
            sinks.remove(spark, staged)
        finish("completed", records_analyzed=records, findings_count=n_found)
        return {"execution_id": execution_id, "hunt_name": name, "status": "completed",
                "findings_count": n_found, "records_analyzed": records}
    except Exception as e:  # record the failure, then re-raise (as the reference)
        finish("failed", error_message=str(e))
        raise


def _summarise(spark: SparkSession, p: dict[str, str], execution_id: int) -> None:
    """Store the mergeable summaries of a run's findings as edited."""
    found = sinks.read_findings(spark, p["hunt_findings"], p["finding_edits"]).filter(F.col("execution_id") == execution_id)
    sinks.write_rollups(found, p["finding_rollups"], execution_id)


def refresh_summaries(spark: SparkSession, results_dir: str) -> list[int]:
    """Summarise the runs that are stored and have no summary yet; their ids."""
    p = _paths(results_dir)
    have = {r.key for r in manifest.latest(spark, p["finding_rollups"]).collect()}
    stored = [int(n.split("=")[1]) for n in manifest.children(spark, p["hunt_findings"]) if n.startswith("execution_id=")]
    new = sorted(set(stored) - have)
    for execution_id in new:
        _summarise(spark, p, execution_id)
    return new


def edit_findings(spark: SparkSession, results_dir: str, edits: DataFrame) -> None:
    """Store analysts' edits (``sinks.EDITS_SCHEMA``) and bring the summaries
    of the runs they touch up to date."""
    p = _paths(results_dir)
    edits = edits.select("execution_id", *[c for c in edits.columns if c != "execution_id"])
    sinks.append_edits(edits, p["finding_edits"])
    for r in edits.select("execution_id").where("execution_id IS NOT NULL").distinct().collect():
        _summarise(spark, p, r.execution_id)


def run_campaign(spark: SparkSession, inputs: Mapping[str, DataFrame | str], *, results_dir: str,
                 first_execution_id: int | None = None, start_date, end_date, params: Mapping[str, Mapping] | None = None, now: _dt.datetime | None = None) -> list[dict]:
    """Every registered hunt in turn over the logs (frames or table paths) of
    ``inputs``.  A hunt that fails, or whose log is not given, is recorded as
    failed and the others go on.  Runs are numbered from
    ``first_execution_id`` on, or get new ids."""
    out = []
    for i, (name, h) in enumerate(hunts.REGISTRY.items()):
        run_id = sinks.new_execution_id(spark, _paths(results_dir)["hunt_executions"]) if first_execution_id is None else first_execution_id + i
        try:
            out.append(run_hunt_job(spark, name, inputs.get(h.source), results_dir=results_dir,
                                    execution_id=run_id, start_date=start_date, end_date=end_date,
                                    params=(params or {}).get(name), now=now))
        except Exception as e:  # noqa: BLE001 - campaign keeps going
            out.append({"execution_id": run_id, "hunt_name": name, "status": "failed", "error": str(e)})
    return out


def run_lookback_hunt(spark: SparkSession, name: str, path: str, *, results_dir: str, execution_id: int | None = None,
                      as_of, lookback_days: int = 30, fmt: str = "parquet", params: Mapping | None = None) -> dict:
    """A hunt over the last ``lookback_days`` days up to ``as_of`` (inclusive
    day range, pruned at the scan)."""
    start, end = lookback_range(as_of, lookback_days)
    return run_hunt_job(spark, name, path, results_dir=results_dir, execution_id=execution_id,
                        start_date=start, end_date=end, params=params, fmt=fmt)


def stored_results(spark: SparkSession, results_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored findings, as analysts edited them, and the current state of
    every run."""
    p = _paths(results_dir)
    events = sinks.read_result(spark, p["hunt_executions"], sinks.EVENT_SCHEMA)
    return sinks.read_findings(spark, p["hunt_findings"], p["finding_edits"]), execution_log_latest(events)


def create_ioc_feed(spark: SparkSession, results_dir: str) -> int:
    """The IOC feed table (replaced); returns its row count."""
    findings, _ = stored_results(spark, results_dir)
    path = os.path.join(results_dir, "dashboard_ioc_feed")
    sinks.replace_table(dashboards.dashboard_ioc_feed(findings), path)
    return spark.read.parquet(path).count()


def update_statistics_table(spark: SparkSession, results_dir: str, *, as_of, days: int = 7) -> int:
    """Upsert the last ``days`` days of per-run statistics; returns the
    number of rows written for this period."""
    findings, executions = stored_results(spark, results_dir)
    path = _paths(results_dir)["hunt_statistics"]
    sinks.write_statistics(dashboards.hunt_statistics(executions, findings, as_of=as_of, days=days), path)
    first = F.lit(cutoff(as_of, days))
    return sinks.read_statistics(spark, path).filter(F.col("execution_date") >= first).count()


def save_report(spark: SparkSession, results_dir: str, *, as_of, days: int = 7, output_path: str | None = None) -> str:
    """The executive report (R5) as a JSON document; returns its path."""
    findings, executions = stored_results(spark, results_dir)
    path = output_path or os.path.join(results_dir, "report", f"{as_date(as_of):%Y%m%d}")
    sinks.write_report(report.report_summary(findings, executions, as_of=as_of, days=days), path)
    return path


def run_full_export(spark: SparkSession, results_dir: str, *, as_of, days: int = 30, approx: bool = False) -> dict[str, int]:
    """Views, the four summaries, the IOC feed, the statistics upsert and
    the report, written next to the result tables.  Returns row counts.
    ``approx`` takes distinct counts from sketches, and the daily, timeline
    and source views from the runs' stored summaries: a few rows per run
    instead of every finding (very large histories).  Only runs since the last
    such export are summarised first."""
    findings, executions = stored_results(spark, results_dir)
    views.create_dashboard_views(findings, executions, approx=approx)
    if approx:
        refresh_summaries(spark, results_dir)
        hourly, sources = sinks.read_rollups(spark, _paths(results_dir)["finding_rollups"])
        rollups.daily_findings(hourly).createOrReplaceTempView("vw_daily_findings")
        rollups.hunt_timeline(hourly).createOrReplaceTempView("vw_hunt_timeline")
        rollups.top_sources(sources).createOrReplaceTempView("vw_top_sources")
    counts = {}
    for name, df in dashboards.export_summary_statistics(findings, executions, as_of=as_of, days=days, approx=approx).items():
        sinks.replace_table(df, os.path.join(results_dir, name))
        counts[name] = spark.read.parquet(os.path.join(results_dir, name)).count()
    counts["dashboard_ioc_feed"] = create_ioc_feed(spark, results_dir)
    counts["hunt_statistics"] = update_statistics_table(spark, results_dir, as_of=as_of)
    save_report(spark, results_dir, as_of=as_of, output_path=os.path.join(results_dir, "report", "latest"))
    return counts
