"""Sinks (K1–K5, K7, K8): the result tables as parquet folders.

Every table is made of folders that one run owns and replaces whole, so a
retried or repeated job converges and runs never touch each other's rows:

* findings – ``execution_id=N/created_date=D``; a run replaces its folder, also
  with nothing; the creation date lets a look-back skip older folders;
* IOCs – the mergeable roll-up of each run's attempt, visible through a
  committed list (``manifest``); readers merge them (``read_iocs``), with a
  snapshot of many runs as a cache;
* statistics – one folder per (date, hunt), replaced by partition;
* execution events – appended, each with its run's attempt.

Tables are read with their schema given, so a folder without files is an empty
table, not an error.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators import ioc
from tracehound.operators.dedup import with_fingerprint
from tracehound.operators.edits import with_edits
from tracehound.plans import rollups
from tracehound.sources import manifest
from tracehound.sources.manifest import exists

# Stored findings table: column -> Spark type (result-table DDL).
FINDINGS_TABLE = [
    ("finding_id", "bigint"), ("execution_id", "bigint"), ("hunt_name", "string"), ("severity", "string"),
    ("finding_type", "string"), ("source_ip", "string"), ("destination_ip", "string"), ("source_hostname", "string"),
    ("destination_hostname", "string"), ("username", "string"), ("process_name", "string"), ("command_line", "string"),
    ("timestamp", "timestamp"), ("confidence_score", "decimal(5,2)"), ("description", "string"), ("raw_data", "string"),
    ("analyst_notes", "string"), ("status", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"),
]
FINDINGS_SCHEMA = ", ".join(f"`{n}` {t}" for n, t in FINDINGS_TABLE) + ", created_date date"
EDITS_SCHEMA = "execution_id bigint, finding_id bigint, edited_at timestamp, status string, analyst_notes string"
STATISTICS_SCHEMA = (
    "total_findings bigint, critical_findings bigint, high_findings bigint, medium_findings bigint, low_findings bigint, "
    "false_positives bigint, confirmed_threats bigint, avg_confidence_score double, records_analyzed bigint, "
    "execution_time_seconds bigint, execution_date date, hunt_name string")
EVENT_SCHEMA = (
    "execution_id bigint, event_seq int, event_time timestamp, hunt_name string, hunt_version string, "
    "execution_start timestamp, execution_end timestamp, status string, records_analyzed bigint, "
    "findings_count int, date_range_start date, date_range_end date, parameters string, error_message string, attempt int")


def utc(t: _dt.datetime) -> _dt.datetime:
    """An aware UTC time; a naive one is taken as UTC."""
    return t.replace(tzinfo=_dt.timezone.utc) if t.tzinfo is None else t.astimezone(_dt.timezone.utc)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = manifest.file_system(spark, path)
    fs.delete(p, True)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table; one that was never written is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def read_results(spark: SparkSession, *, path: str | None = None, table: str | None = None, jdbc: dict | None = None,
                 schema: str | None = None) -> DataFrame:
    """A result table from exactly one of: a folder, a catalog table, or a
    database (``jdbc``: options of ``spark.read.jdbc``, where ``column``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` split the read)."""
    if sum(x is not None for x in (path, table, jdbc)) != 1:
        raise ValueError("give one of path, table and jdbc")
    if table is not None:
        return spark.table(table)
    if jdbc is not None:
        return spark.read.jdbc(**jdbc)
    return read_result(spark, path, schema) if schema else spark.read.parquet(path)


def to_findings_table(findings: DataFrame, execution_id: int, created_at: _dt.datetime) -> DataFrame:
    """K1 projection: add run id, creation time, status 'new' and a stable
    finding id; missing columns become NULL; cast to the table types."""
    f = with_fingerprint(findings)
    extra = {
        "execution_id": F.lit(execution_id).cast("bigint"),
        "created_at": F.lit(utc(created_at)).cast("timestamp"),
        "updated_at": F.lit(utc(created_at)).cast("timestamp"),
        "status": F.lit("new"),
        "finding_id": F.xxhash64(F.lit(execution_id), F.col("fingerprint"), F.col("timestamp").cast("string")),
    }
    f = f.withColumns(extra)
    cols = []
    for name, typ in FINDINGS_TABLE:
        c = F.col(name) if name in f.columns else F.lit(None)
        cols.append(c.cast(typ).alias(name))
    return f.select(*cols)


def write_findings(table: DataFrame, path: str, execution_id: int, created_at: _dt.datetime) -> None:
    """K1 write: the run's folder, replaced whole on a re-run."""
    day = F.lit(utc(created_at).date())
    (table.drop("execution_id").withColumn("created_date", day).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("created_date").parquet(f"{path}/execution_id={execution_id}"))


def read_findings(spark: SparkSession, path: str, edits: str | None = None) -> DataFrame:
    """The stored findings; with ``edits`` (a folder) as analysts edited them."""
    found = read_result(spark, path, FINDINGS_SCHEMA)
    return with_edits(found, read_result(spark, edits, EDITS_SCHEMA)) if edits and exists(spark, edits) else found


def append_edits(edits: DataFrame, path: str) -> None:
    """Add analysts' edits (EDITS_SCHEMA; a null field stays as it is)."""
    names = [c.split()[0] for c in EDITS_SCHEMA.split(", ")]
    edits.select(*[(F.col(n) if n in edits.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in EDITS_SCHEMA.split(", "))]) \
        .select(names).write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batchsize: int = 1000, **props) -> None:
    """JDBC target (needs the driver jar on the classpath; untested here)."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize) \
        .options(**props).mode(mode).save()


def replace_table(df: DataFrame, path: str) -> None:
    """K2/K8: replace a summary table wholesale."""
    df.write.mode("overwrite").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """K3: append execution events (start/complete); readers take the
    latest per run with ``executions.execution_log_latest``."""
    events.write.mode("append").parquet(path)


def start_attempt(spark: SparkSession, events: str, execution_id: int, hunt_name: str) -> int:
    """K3: the number of this attempt at a run, above all earlier ones.  An id
    whose start event names another hunt is refused: its results would be
    replaced."""
    attempt = manifest.claim(spark, events, f"execution_id={execution_id}")
    if attempt > 1:
        others = (read_result(spark, events, EVENT_SCHEMA).where(F.col("execution_id") == execution_id)
                  .where(F.col("hunt_name") != hunt_name).select("hunt_name").first())
        if others:
            raise ValueError(f"execution {execution_id} is a run of {others.hunt_name}")
    return attempt


def new_execution_id(spark: SparkSession, events: str) -> int:
    """A run id that no run has and no other job gets: above all stored ones."""
    highest = read_result(spark, events, EVENT_SCHEMA).agg(F.max("execution_id")).first()[0] or 0
    while (n := manifest.claim(spark, events, "ids")) <= highest:
        manifest.raise_to(spark, events, "ids", highest)
    return n


def write_iocs(delta: DataFrame, base: str, execution_id: int, attempt: int | None = None) -> None:
    """K4: the run's own roll-up (``ioc.stored_partial``).  It counts once it
    is stored whole, in place of the run's earlier attempts."""
    manifest.write(delta, base, execution_id, attempt)


def read_iocs(spark: SparkSession, base: str) -> DataFrame:
    """The tracked indicators: all committed runs' roll-ups merged."""
    return ioc.ioc_finish(ioc.merge_partials(manifest.read(spark, base, ioc.PARTIAL_SCHEMA)))


def compact_iocs(spark: SparkSession, base: str) -> None:
    """Merge the committed runs' roll-ups into a snapshot, also while other
    runs are being written or committed."""
    manifest.compact(spark, base, ioc.PARTIAL_SCHEMA, ioc.merge_partials)


def write_rollups(findings: DataFrame, path: str, execution_id: int, attempt: int | None = None) -> None:
    """The mergeable summaries of a run's findings, in place of its earlier ones."""
    manifest.write(rollups.partials(findings), path, execution_id, attempt)


def read_rollups(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The hourly and the per-source summaries of all runs."""
    rows = manifest.read(spark, path, rollups.PARTIALS_SCHEMA)
    return rollups.hourly_of(rows), rollups.sources_of(rows)


def compact_rollups(spark: SparkSession, path: str) -> None:
    manifest.compact(spark, path, rollups.PARTIALS_SCHEMA, rollups.merge_partials)


def write_statistics(new: DataFrame, path: str) -> None:
    """K5: replace the rows of each (date, hunt) in ``new``."""
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("execution_date", "hunt_name").parquet(path))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return read_result(spark, path, STATISTICS_SCHEMA)


def write_report(report: DataFrame, path: str) -> None:
    """K7: the one-row nested report as a JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)
