"""Mappings from the driver's synthetic tables to the hunt inputs.

The test tables are TPC-H-like; these projections give them the shape of
connection, DNS and logon logs and of the result tables, so every query
runs on whole tables whose size grows with the scale factor.  Each is a
pure projection (no shuffle) and reads only the columns it needs.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The hunt names, the dates and the parameters the mappings
# are checked with.
HUNT_NAMES = ["c2_beaconing", "dns_tunneling", "lateral_movement"]
RESULTS_AS_OF = _dt.date(2000, 1, 15)   # executions and findings span 1995..2001
LOGS_AS_OF = _dt.date(2024, 1, 31)      # events span 2024-01-01..2024-01-30
SUMMARY_DAYS = 30
C2_PARAMS = {"min_connections": 10, "jitter_threshold": 400000}
DNS_PARAMS: dict = {}
LATERAL_PARAMS = {"time_window_minutes": 4320, "min_hosts": 3}
# Windows of the de-duplication and IOC upsert checks.
DEDUP_AS_OF = _dt.date(2000, 1, 1)
DEDUP_INCOMING_END = _dt.date(2000, 2, 1)
DEDUP_LOOKBACK_DAYS = 7
IOC_SPLIT = _dt.date(1998, 1, 1)
PARTITION_RANGE = (_dt.date(2024, 1, 10), _dt.date(2024, 1, 20))
SLIDING_C2_PARAMS = {"min_connections": 5, "jitter_threshold": 400000}
NEW_PAIRS_SPLIT = _dt.date(2024, 1, 2)
FANOUT_PARAMS = {"ports": (443,), "min_destinations": 3}
# ---------------------------------------------------------------------------


_LOADED: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, loaded once per session (as a user registers a table
    once and references it from many queries; the files are read-only)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (str(spark._jsparkSession.sessionUUID()), path)
    df = _LOADED.get(key)
    if df is None:
        df = _LOADED[key] = spark.read.parquet(path)
    return df


# The mappings below are the FIXTURES.md Spark SQL, as select expressions
# (one parse per column instead of one JVM call per function); offsets are
# added with timestampadd (integer arithmetic) instead of decimal intervals.
YMD = ["year({t}) AS year", "month({t}) AS month", "day({t}) AS day"]
HUNT_OF = ("CASE {k} % 3 WHEN 0 THEN 'c2_beaconing' WHEN 1 THEN 'dns_tunneling' "
           "ELSE 'lateral_movement' END")

CONN_LOGS = [
    "ts",
    "concat('10.0.', CAST(floor(user_id / 256) AS STRING), '.', CAST(user_id % 256 AS STRING)) AS id_orig_h",
    "concat('203.0.113.', CAST(ascii(event_type) AS STRING)) AS id_resp_h",
    "443 AS id_resp_p",
    "CAST(floor(value * 100) AS BIGINT) AS orig_bytes",
    "CAST(floor(value * 10) AS BIGINT) AS resp_bytes",
    "value AS duration",
]

CONN_LOGS_ALT = [
    "l_returnflag AS service",
    "CAST(8000 + l_linenumber AS INT) AS id_resp_p",
    "timestampadd(SECOND, (l_orderkey * 37 + l_partkey) % 86400, l_shipdate) AS ts",
    "concat('10.4.0.', CAST(l_suppkey % 256 AS STRING)) AS id_orig_h",
    "concat('198.51.100.', CAST(l_partkey % 256 AS STRING)) AS id_resp_h",
    "CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes",
    "CAST(floor(l_quantity) AS BIGINT) AS resp_bytes",
    "l_discount AS duration",
]

# The connection log with ports: SMB and RDP among others, by event value.
CONN_LOGS_PORTS = [
    c if not c.startswith("443") else
    "CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 445 WHEN 1 THEN 3389 WHEN 2 THEN 443 ELSE 8080 END AS id_resp_p"
    for c in CONN_LOGS
]

DNS_LOGS = [
    "concat('10.2.0.', CAST(page_id % 20 AS STRING)) AS id_orig_h",
    "CASE WHEN page_id % 16 = 0 THEN concat(sha2(url, 256), '.', sha2(concat(url, 'x'), 256), '.', md5(url), '.', host) "
    "WHEN page_id % 4 = 0 THEN concat(md5(url), '.', sha2(url, 256), '.', host) ELSE host END AS query",
    "timestampadd(MINUTE, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts",
]

WIN_SECURITY = [
    "ts AS `@timestamp`",
    "CASE event_type WHEN 'click' THEN '4624' WHEN 'view' THEN '4625' WHEN 'error' THEN '4648' ELSE '4634' END AS event_code",
    "concat(CASE WHEN user_id % 5 = 0 THEN 'Admin' ELSE 'user' END, CAST(user_id % 15 AS STRING)) AS user_name",
    "concat('host', CAST(CAST(floor(value) AS BIGINT) % 12 AS STRING)) AS host_name",
    "concat('10.3.0.', CAST(user_id % 15 AS STRING)) AS source_ip",
    "3 AS logon_type",
]

EXECUTIONS = [
    "o_orderkey AS execution_id",
    HUNT_OF.format(k="o_custkey") + " AS hunt_name",
    "timestampadd(SECOND, o_orderkey % 86400, o_orderdate) AS execution_start",
    "CASE WHEN o_orderstatus <> 'P' THEN timestampadd(SECOND, o_orderkey % 86400 + 1 + o_custkey % 600, o_orderdate) END AS execution_end",
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status",
    "CAST(floor(o_totalprice) AS BIGINT) AS records_analyzed",
    "CAST(o_orderkey % 7 AS INT) AS findings_count",
]

FINDINGS = [
    "l_orderkey * 10 + l_linenumber AS finding_id",
    "l_orderkey AS execution_id",
    HUNT_OF.format(k="l_orderkey") + " AS hunt_name",
    "CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 15 THEN 'medium' "
    "WHEN l_quantity > 5 THEN 'low' ELSE 'info' END AS severity",
    "CASE l_returnflag WHEN 'A' THEN 'c2_beaconing' WHEN 'N' THEN 'dns_tunneling' ELSE 'lateral_movement' END AS finding_type",
    "CASE WHEN l_suppkey % 17 <> 0 THEN concat('10.0.0.', CAST(l_suppkey AS STRING)) END AS source_ip",
    "CASE WHEN l_returnflag = 'A' THEN concat('10.1.', CAST(l_partkey % 8 AS STRING), '.', CAST(l_partkey % 5 AS STRING)) END AS destination_ip",
    "CASE WHEN l_returnflag = 'N' THEN concat('h', CAST(l_partkey % 50 AS STRING), '.example.net') END AS destination_hostname",
    "CASE WHEN l_returnflag = 'R' THEN concat('user', CAST(l_suppkey % 40 AS STRING)) END AS username",
    "timestampadd(SECOND, (l_orderkey * 37 + l_partkey) % 86400, l_shipdate) AS timestamp",
    "CAST(l_quantity * 2 AS DECIMAL(5,2)) AS confidence_score",
    "CASE l_linenumber % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'investigating' WHEN 2 THEN 'confirmed' "
    "WHEN 3 THEN 'false_positive' ELSE 'resolved' END AS status",
    "timestampadd(DAY, 1, l_shipdate) AS created_at",
]


# Analysts' edits: what is decided some days later about the findings of
# discounted lines; some edits leave the status as it is.
EDITS = [
    "l_orderkey AS execution_id",
    "l_orderkey * 10 + l_linenumber AS finding_id",
    "timestampadd(DAY, 2 + l_suppkey % 9, l_shipdate) AS edited_at",
    "CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'false_positive' END AS status",
    "concat('seen as ', l_linestatus) AS analyst_notes",
]


def conn_logs(events: DataFrame) -> DataFrame:
    """events -> Zeek-style connection log."""
    return events.selectExpr(*CONN_LOGS, *[e.format(t="ts") for e in YMD])


def conn_logs_alt(lineitem: DataFrame) -> DataFrame:
    """lineitem -> a second connection log with its columns in another
    order, an extra ``service`` column and no partition columns."""
    return lineitem.selectExpr(*CONN_LOGS_ALT)


def dns_logs(pages: DataFrame) -> DataFrame:
    """pages -> Zeek-style DNS log; every 4th page gets encoded labels,
    every 16th longer ones."""
    with_host = pages.selectExpr("page_id", "url", r"regexp_extract(url, '^https?://([^/]+)', 1) AS host")
    return with_host.selectExpr(*DNS_LOGS).selectExpr("*", *[e.format(t="ts") for e in YMD])


def win_security(events: DataFrame) -> DataFrame:
    """events -> Windows security log (logon events)."""
    return events.selectExpr(*WIN_SECURITY, *[e.format(t="ts") for e in YMD])


def executions(orders: DataFrame) -> DataFrame:
    """orders -> hunt execution log (running ones have no end)."""
    return orders.selectExpr(*EXECUTIONS)


def findings(lineitem: DataFrame) -> DataFrame:
    """lineitem -> stored findings.  finding_id is not unique."""
    return lineitem.selectExpr(*FINDINGS)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One mapped input by name."""
    if name == "conn_logs":
        return conn_logs(table(spark, sf_dir, "events"))
    if name == "conn_logs_ports":
        return table(spark, sf_dir, "events").selectExpr(*CONN_LOGS_PORTS, *[e.format(t="ts") for e in YMD])
    if name == "dns_logs":
        return dns_logs(table(spark, sf_dir, "pages"))
    if name == "win_security":
        return win_security(table(spark, sf_dir, "events"))
    if name == "executions":
        return executions(table(spark, sf_dir, "orders"))
    if name == "findings":
        return findings(table(spark, sf_dir, "lineitem"))
    if name == "edits":
        return table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").selectExpr(*EDITS)
    raise ValueError(f"unknown fixture {name!r}")
