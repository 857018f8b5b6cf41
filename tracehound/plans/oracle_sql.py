"""DuckDB SQL for each registered query (the correctness oracle).

Each statement starts from the pre-registered test tables and applies the
same mappings as ``tracehound.sources.fixtures``.  Floating outputs are
rounded to 6 digits on both sides.
"""

from __future__ import annotations

# --- mappings (DuckDB spelling of tracehound.sources.fixtures) --------------
CONN = """conn_logs AS (
  SELECT concat('10.0.', user_id // 256, '.', user_id % 256) AS id_orig_h, concat('203.0.113.', ascii(event_type)) AS id_resp_h,
         443 AS id_resp_p, ts, CAST(floor(value*100) AS BIGINT) AS orig_bytes, CAST(floor(value*10) AS BIGINT) AS resp_bytes,
         value AS duration, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day
  FROM events)"""

DNS = """dns_logs AS (
  SELECT concat('10.2.0.', page_id % 20) AS id_orig_h,
         CASE WHEN page_id % 16 = 0 THEN concat(sha256(url),'.',sha256(concat(url,'x')),'.',md5(url),'.',host)
              WHEN page_id % 4 = 0 THEN concat(md5(url),'.',sha256(url),'.',host) ELSE host END AS query,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS INTEGER)) AS ts,
         CAST(year(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS INTEGER))) AS INTEGER) AS year,
         CAST(month(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS INTEGER))) AS INTEGER) AS month,
         CAST(day(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS INTEGER))) AS INTEGER) AS day
  FROM (SELECT *, regexp_extract(url,'^https?://([^/]+)',1) AS host FROM pages))"""

WIN = """win_security AS (
  SELECT ts AS timestamp, CASE event_type WHEN 'click' THEN '4624' WHEN 'view' THEN '4625' WHEN 'error' THEN '4648' ELSE '4634' END AS event_code,
         concat(CASE WHEN user_id % 5 = 0 THEN 'Admin' ELSE 'user' END, user_id % 15) AS user_name,
         concat('host', CAST(floor(value) AS BIGINT) % 12) AS host_name, concat('10.3.0.', user_id % 15) AS source_ip, 3 AS logon_type,
         CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day
  FROM events)"""

EXECS = """executions AS (
  SELECT o_orderkey AS execution_id,
         CASE o_custkey % 3 WHEN 0 THEN 'c2_beaconing' WHEN 1 THEN 'dns_tunneling' ELSE 'lateral_movement' END AS hunt_name,
         o_orderdate + to_seconds(o_orderkey % 86400) AS execution_start,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey % 86400 + 1 + o_custkey % 600) END AS execution_end,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
         CAST(floor(o_totalprice) AS BIGINT) AS records_analyzed, CAST(o_orderkey % 7 AS INT) AS findings_count
  FROM orders)"""

FINDINGS = """findings AS (
  SELECT l_orderkey*10+l_linenumber AS finding_id, l_orderkey AS execution_id,
         CASE l_orderkey % 3 WHEN 0 THEN 'c2_beaconing' WHEN 1 THEN 'dns_tunneling' ELSE 'lateral_movement' END AS hunt_name,
         CASE WHEN l_quantity>45 THEN 'critical' WHEN l_quantity>30 THEN 'high' WHEN l_quantity>15 THEN 'medium' WHEN l_quantity>5 THEN 'low' ELSE 'info' END AS severity,
         CASE l_returnflag WHEN 'A' THEN 'c2_beaconing' WHEN 'N' THEN 'dns_tunneling' ELSE 'lateral_movement' END AS finding_type,
         CASE WHEN l_suppkey % 17 <> 0 THEN concat('10.0.0.', l_suppkey) END AS source_ip,
         CASE WHEN l_returnflag='A' THEN concat('10.1.', l_partkey % 8, '.', l_partkey % 5) END AS destination_ip,
         CASE WHEN l_returnflag='N' THEN concat('h', l_partkey % 50, '.example.net') END AS destination_hostname,
         CASE WHEN l_returnflag='R' THEN concat('user', l_suppkey % 40) END AS username,
         l_shipdate + to_seconds((l_orderkey*37+l_partkey) % 86400) AS timestamp, CAST(l_quantity*2 AS DECIMAL(5,2)) AS confidence_score,
         CASE l_linenumber % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'investigating' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'false_positive' ELSE 'resolved' END AS status,
         l_shipdate + to_days(1) AS created_at
  FROM lineitem)"""

SEV_RANK = "CASE {c} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'info' THEN 0 ELSE -1 END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- hunts ------------------------------------------------------------------
def c2_profile_cte(by: str = "", part: str = "", src: str = "conn_logs", extra: str = "") -> str:
    """Reference-shaped C2 profile: one lag over each pair, then agg."""
    keys = f"{by}source_ip, destination_ip, destination_port"
    return f"""c2_iv AS (
  SELECT {extra} id_orig_h AS source_ip, id_resp_h AS destination_ip, id_resp_p AS destination_port, ts, orig_bytes,
         CAST(floor(epoch(ts)) AS BIGINT) AS e,
         CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY {part}id_orig_h, id_resp_h, id_resp_p ORDER BY ts) AS gap
  FROM {src}),
c2_prof AS (
  SELECT {keys}, count(*) AS connection_count, avg(gap) AS avg_interval, stddev_samp(gap) AS interval_stddev,
         avg(orig_bytes) AS avg_bytes_sent, stddev_samp(orig_bytes) AS bytes_sent_stddev,
         min(e) AS first_seen, max(e) AS last_seen, min(ts) AS first_ts, max(ts) AS last_ts
  FROM c2_iv GROUP BY {keys})"""


def c2_findings_sql(min_connections=10, jitter=300, min_score=50, by: str = "") -> str:
    return f"""SELECT {by}'c2_beaconing' AS hunt_name, CASE WHEN score > 80 THEN 'high' ELSE 'medium' END AS severity, 'c2_beaconing' AS finding_type,
  source_ip, destination_ip, NULL::VARCHAR AS destination_hostname, NULL::VARCHAR AS username, date_trunc('second', first_ts) AS timestamp,
  round(score, 2) AS confidence_score,
  printf('Potential C2 beaconing detected: %d connections with %.1fs average interval (±%.1fs jitter) to %s:%s',
         connection_count, round(avg_interval, 1), round(interval_stddev, 1), destination_ip, CAST(destination_port AS VARCHAR)) AS description,
  to_json({{'connection_count': connection_count, 'avg_interval_seconds': round(avg_interval, 6), 'interval_stddev': round(interval_stddev, 6),
           'avg_bytes_sent': coalesce(CAST(trunc(avg_bytes_sent) AS BIGINT), 0),
           'first_seen': strftime(first_ts, '%Y-%m-%d %H:%M:%S'), 'last_seen': strftime(last_ts, '%Y-%m-%d %H:%M:%S')}}) AS raw_data
FROM (SELECT *, least(100.0, connection_count / 10.0::DOUBLE * 30 + (1 - interval_stddev / nullif(avg_interval, 0)) * 40
                      + (1 - bytes_sent_stddev / nullif(avg_bytes_sent, 0)) * 30) AS score
      FROM c2_prof WHERE connection_count >= {min_connections} AND interval_stddev < {jitter} AND avg_interval IS NOT NULL AND avg_interval > 0)
WHERE score > {min_score}"""


def c2_beaconing(min_connections=10, jitter=400000) -> str:
    return with_(CONN, c2_profile_cte()) + c2_findings_sql(min_connections, jitter)


def dns_ctes(by: str = "", extra: str = "", src: str = "dns_logs") -> list[str]:
    return [DNS, f"""dns_q AS (
  SELECT {extra} id_orig_h AS source_ip, query AS query_domain, ts AS timestamp, CAST(length(query) AS BIGINT) AS query_length,
         length(query) - length(replace(query, '.', '')) + 1 AS subdomain_count
  FROM {src} WHERE query IS NOT NULL AND query <> ''),
dns_prof AS (
  SELECT {by}source_ip, query_domain, count(*) AS query_count, avg(query_length) AS avg_query_length, max(query_length) AS max_query_length,
         avg(subdomain_count) AS avg_subdomain_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
  FROM dns_q GROUP BY {by}source_ip, query_domain)"""]


ISO = "'%Y-%m-%dT%H:%M:%S.%f'"


def dns_findings_sql(min_len=50, min_count=100, min_score=50, by: str = "") -> str:
    return f"""SELECT {by}'dns_tunneling' AS hunt_name, CASE WHEN score > 80 THEN 'critical' ELSE 'high' END AS severity, 'dns_tunneling' AS finding_type,
  source_ip, NULL::VARCHAR AS destination_ip, query_domain AS destination_hostname, NULL::VARCHAR AS username, first_seen AS timestamp,
  round(score, 2) AS confidence_score,
  printf('Potential DNS tunneling: %d queries with avg length %.0f chars to %s', query_count, round(avg_query_length, 0), query_domain) AS description,
  to_json({{'query_count': query_count, 'avg_query_length': round(avg_query_length, 6), 'max_query_length': max_query_length,
           'avg_subdomain_count': round(avg_subdomain_count, 6), 'first_seen': strftime(first_seen, {ISO}), 'last_seen': strftime(last_seen, {ISO})}}) AS raw_data
FROM (SELECT *, least(100.0, avg_query_length / 100.0::DOUBLE * 40 + query_count / 1000.0::DOUBLE * 40 + avg_subdomain_count / 10.0::DOUBLE * 20) AS score
      FROM dns_prof WHERE avg_query_length > {min_len} OR query_count > {min_count} OR avg_subdomain_count > 5)
WHERE score > {min_score}"""


PRIV = "coalesce(contains(lower({u}), 'admin') OR contains(lower({u}), 'svc') OR contains(lower({u}), 'service'), false)"


def lateral_ctes(minutes: int, by: str = "", extra: str = "", src: str = "win_security") -> list[str]:
    return [WIN, f"""lat_le AS (
  SELECT {extra} timestamp, event_code, user_name AS username, host_name AS destination_host, source_ip, logon_type,
         CAST(floor(epoch(timestamp) / {minutes * 60}) AS BIGINT) AS time_bucket
  FROM {src} WHERE event_code IN ('4624', '4625', '4648')),
lat_prof AS (
  SELECT {by}username, source_ip, time_bucket, count(DISTINCT destination_host) AS unique_hosts, count(*) AS logon_attempts,
         list_sort(list(DISTINCT destination_host) FILTER (WHERE destination_host IS NOT NULL)) AS hosts_accessed,
         min(timestamp) AS first_logon, max(timestamp) AS last_logon
  FROM lat_le GROUP BY {by}username, source_ip, time_bucket)"""]


def lateral_findings_sql(minutes: int, min_hosts=5, min_score=50, by: str = "") -> str:
    return f"""SELECT {by}'lateral_movement' AS hunt_name, CASE WHEN priv THEN 'critical' ELSE 'high' END AS severity, 'lateral_movement' AS finding_type,
  source_ip, NULL::VARCHAR AS destination_ip, NULL::VARCHAR AS destination_hostname, username, first_logon AS timestamp,
  round(score, 2) AS confidence_score,
  printf('Potential lateral movement: Account ''%s'' accessed %d unique hosts in %d minutes from %s',
         coalesce(username, 'None'), unique_hosts, {minutes}, coalesce(source_ip, 'None')) AS description,
  to_json({{'unique_hosts_count': unique_hosts, 'logon_attempts': logon_attempts, 'hosts_accessed': hosts_accessed, 'is_privileged_account': priv,
           'first_logon': strftime(first_logon, {ISO}), 'last_logon': strftime(last_logon, {ISO}), 'time_window_minutes': {minutes}}}) AS raw_data
FROM (SELECT *, least(100.0, unique_hosts / 10.0::DOUBLE * 50 + logon_attempts / 20.0::DOUBLE * 30 + CASE WHEN priv THEN 20 ELSE 0 END) AS score
      FROM (SELECT *, {PRIV.format(u='username')} AS priv FROM lat_prof WHERE unique_hosts >= {min_hosts}))
WHERE score > {min_score}"""


HUNT_COLS = "hunt_name, severity, finding_type, source_ip, destination_ip, destination_hostname, username, timestamp, confidence_score, description, raw_data"


def dns_tunneling() -> str:
    return with_(*dns_ctes()) + dns_findings_sql()


def lateral_movement() -> str:
    return with_(*lateral_ctes(4320)) + lateral_findings_sql(4320, 3)


def all_hunts() -> str:
    return (with_(CONN, c2_profile_cte(), *dns_ctes(), *lateral_ctes(4320))
            + f"SELECT {HUNT_COLS} FROM ({c2_findings_sql(10, 400000)})\nUNION ALL SELECT {HUNT_COLS} FROM ({dns_findings_sql()})\n"
            + f"UNION ALL SELECT {HUNT_COLS} FROM ({lateral_findings_sql(4320, 3)})")


def c2_beacon_profile() -> str:
    return with_(CONN, c2_profile_cte()) + """SELECT source_ip, destination_ip, destination_port, connection_count,
  round(avg_interval, 6) AS avg_interval, round(interval_stddev, 6) AS interval_stddev, round(avg_bytes_sent, 6) AS avg_bytes_sent,
  round(bytes_sent_stddev, 6) AS bytes_sent_stddev, first_seen, last_seen,
  round(1 - bytes_sent_stddev / nullif(avg_bytes_sent, 0), 6) AS byte_similarity, last_seen - first_seen AS session_seconds
FROM c2_prof"""


def c2_intervals() -> str:
    return with_(CONN, c2_profile_cte()) + "SELECT source_ip, destination_ip, destination_port, ts, gap AS interval_seconds FROM c2_iv"


def dns_profile() -> str:
    return with_(*dns_ctes()) + """SELECT source_ip, query_domain, query_count, round(avg_query_length, 6) AS avg_query_length, max_query_length,
  round(avg_subdomain_count, 6) AS avg_subdomain_count, first_seen, last_seen FROM dns_prof"""


def lateral_profile() -> str:
    return with_(*lateral_ctes(4320)) + """SELECT username, source_ip, time_bucket, unique_hosts, logon_attempts,
  array_to_string(hosts_accessed, ',') AS hosts_accessed, first_logon, last_logon FROM lat_prof"""


def logon_events() -> str:
    return with_(WIN) + """SELECT timestamp, event_code, user_name AS username, host_name AS destination_host, source_ip, logon_type
FROM win_security WHERE event_code IN ('4624', '4625', '4648')"""


def privileged_accounts() -> str:
    return with_(WIN) + f"""SELECT user_name AS username, {PRIV.format(u='user_name')} AS is_privileged_account, count(*) AS logon_count
FROM win_security WHERE event_code IN ('4624', '4625', '4648') GROUP BY user_name"""


def records_analyzed() -> str:
    return with_(CONN, DNS, WIN) + """SELECT 'c2_beaconing' AS hunt_name, count(*) AS records_analyzed FROM conn_logs
UNION ALL SELECT 'dns_tunneling', count(*) FROM dns_logs
UNION ALL SELECT 'lateral_movement', count(*) FROM win_security WHERE event_code IN ('4624', '4625', '4648')"""


# --- result layer (as_of 2000-01-15, 30 days -> cutoff 1999-12-16) --------------
CUT = "TIMESTAMP '1999-12-16 00:00:00'"
NOT_FP = "status != 'false_positive'"
RANKED_MAX = "CASE max(" + SEV_RANK.format(c="severity") + ") WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' WHEN 0 THEN 'info' END"
AVG_CONF = "round(CAST(avg(confidence_score) AS DOUBLE), 6)"
RUN_SECS = "datesub('second', execution_start, execution_end)"
DLIST = "string_agg(DISTINCT finding_type, ',' ORDER BY finding_type)"

VIEW_BODIES = {
    "vw_daily_findings": f"""SELECT CAST(timestamp AS DATE) AS finding_date, hunt_name, severity, count(*) AS finding_count, {AVG_CONF} AS avg_confidence,
  count(DISTINCT source_ip) AS unique_sources, count(DISTINCT destination_ip) AS unique_destinations
FROM findings WHERE {NOT_FP} GROUP BY ALL""",
    "vw_hunt_performance": f"""SELECT hunt_name, CAST(execution_start AS DATE) AS execution_date, count(*) AS execution_count,
  CAST(sum(findings_count) AS BIGINT) AS total_findings, round(avg({RUN_SECS}), 6) AS avg_execution_time,
  CAST(sum(records_analyzed) AS BIGINT) AS total_records_analyzed, count_if(status = 'completed') AS successful_runs,
  count_if(status = 'failed') AS failed_runs
FROM executions GROUP BY ALL""",
    "vw_severity_distribution": f"""SELECT severity, finding_type, count(*) AS "count", {AVG_CONF} AS avg_confidence
FROM findings WHERE {NOT_FP} GROUP BY ALL""",
    "vw_top_sources": f"""SELECT source_ip, count(*) AS finding_count, count(DISTINCT finding_type) AS unique_finding_types, max(severity) AS max_severity,
  {RANKED_MAX} AS max_severity_ranked, {AVG_CONF} AS avg_confidence, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM findings WHERE source_ip IS NOT NULL AND {NOT_FP} GROUP BY source_ip HAVING count(*) > 1""",
    "vw_hunt_timeline": f"""SELECT CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour, hunt_name, count(*) AS finding_count,
  count(DISTINCT source_ip) AS unique_sources
FROM findings WHERE {NOT_FP} GROUP BY ALL""",
    "vw_investigation_status": """SELECT status, severity, count(*) AS "count", min(created_at) AS oldest_finding, max(created_at) AS newest_finding
FROM findings GROUP BY ALL""",
    "vw_hunt_effectiveness": """SELECT hunt_name, count(*) AS total_findings, count_if(status = 'confirmed') AS confirmed_threats,
  count_if(status = 'false_positive') AS false_positives, round(CAST(count_if(status = 'confirmed') AS DOUBLE) * 100.0 / count(*), 2) AS true_positive_rate
FROM findings GROUP BY hunt_name""",
    "dashboard_hunt_summary": f"""SELECT hunt_name, count(DISTINCT execution_id) AS total_executions, CAST(sum(findings_count) AS BIGINT) AS total_findings,
  round(avg({RUN_SECS}), 6) AS avg_time_seconds, max(execution_start) AS last_run
FROM executions WHERE execution_start >= {CUT} GROUP BY hunt_name""",
    "dashboard_severity_trends": f"""SELECT CAST(timestamp AS DATE) AS date, severity, count(*) AS "count"
FROM findings WHERE timestamp >= {CUT} AND {NOT_FP} GROUP BY ALL""",
    "dashboard_finding_types": f"""SELECT finding_type, count(*) AS "count", {AVG_CONF} AS avg_confidence
FROM findings WHERE timestamp >= {CUT} AND {NOT_FP} GROUP BY finding_type""",
    "dashboard_top_indicators": f"""SELECT source_ip, destination_ip, count(*) AS occurrence_count, {DLIST} AS finding_types, max(severity) AS max_severity
FROM findings WHERE timestamp >= {CUT} AND {NOT_FP} GROUP BY source_ip, destination_ip HAVING count(*) > 5
ORDER BY occurrence_count DESC, source_ip ASC NULLS FIRST, destination_ip ASC NULLS FIRST LIMIT 100""",
    "dashboard_ioc_feed": "\nUNION ALL\n".join(
        f"""SELECT {col} AS ioc_value, '{kind}' AS ioc_type, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS times_seen,
  max(severity) AS threat_level, {RANKED_MAX} AS threat_level_ranked, {DLIST} AS associated_hunts, CAST(max(confidence_score) AS DOUBLE) AS max_confidence
FROM findings WHERE {col} IS NOT NULL AND status IN ('confirmed', 'investigating') GROUP BY {col}"""
        for col, kind in (("source_ip", "ip"), ("destination_ip", "ip"), ("destination_hostname", "domain"))),
    "report_overall": f"""SELECT count(DISTINCT execution_id) AS total_hunts, CAST(sum(findings_count) AS BIGINT) AS total_findings,
  count_if(status = 'completed') AS successful_hunts, CAST(sum(records_analyzed) AS BIGINT) AS total_records_analyzed
FROM executions WHERE execution_start >= {CUT}""",
    "report_severity": f"""SELECT severity, count(*) AS "count" FROM findings WHERE timestamp >= {CUT} AND {NOT_FP} GROUP BY severity""",
    "report_top_threats": f"""SELECT source_ip, count(*) AS finding_count, max(severity) AS max_severity, {DLIST} AS threat_types
FROM findings WHERE timestamp >= {CUT} AND status IN ('confirmed', 'investigating') GROUP BY source_ip
ORDER BY finding_count DESC, source_ip ASC NULLS FIRST LIMIT 10""",
    "report_hunt_performance": f"""SELECT hunt_name, count(*) AS execution_count, CAST(sum(findings_count) AS BIGINT) AS total_findings, round(avg({RUN_SECS}), 6) AS avg_time
FROM executions WHERE execution_start >= {CUT} AND status = 'completed' GROUP BY hunt_name""",
}


def result_sql(body: str) -> str:
    return with_(FINDINGS, EXECS) + body


EDITED = FINDINGS.replace("findings AS (", "stored AS (", 1) + """,
edits AS (
  SELECT l_orderkey AS execution_id, l_orderkey*10+l_linenumber AS finding_id, l_shipdate + to_days(CAST(2 + l_suppkey % 9 AS INTEGER)) AS edited_at,
         CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'false_positive' END AS new_status
  FROM lineitem WHERE l_discount >= 0.05),
latest AS (
  SELECT execution_id, finding_id, new_status FROM edits WHERE new_status IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY execution_id, finding_id ORDER BY edited_at DESC, new_status DESC) = 1),
findings AS (
  SELECT stored.* REPLACE (coalesce(new_status, status) AS status) FROM stored LEFT JOIN latest USING (execution_id, finding_id))"""


def edited_sql(view: str) -> str:
    return with_(EDITED) + VIEW_BODIES[view]


def hunt_statistics(first_day: str = "2000-01-08", seen: str = "true") -> str:
    """Statistics of runs from ``first_day`` on, over the findings ``seen``."""
    return with_(FINDINGS, EXECS, f"""fagg AS (
  SELECT execution_id, count(finding_id) AS total_findings, count_if(severity = 'critical') AS critical_findings,
         count_if(severity = 'high') AS high_findings, count_if(severity = 'medium') AS medium_findings, count_if(severity = 'low') AS low_findings,
         count_if(status = 'false_positive') AS false_positives, count_if(status = 'confirmed') AS confirmed_threats,
         sum(confidence_score) AS s, count(confidence_score) AS n
  FROM findings WHERE {seen} GROUP BY execution_id)""", f"""runs AS (
  SELECT e.hunt_name, CAST(e.execution_start AS DATE) AS execution_date, e.records_analyzed, e.execution_start, e.execution_end,
         CAST(coalesce(sum(total_findings), 0) AS BIGINT) AS total_findings, CAST(coalesce(sum(critical_findings), 0) AS BIGINT) AS critical_findings,
         CAST(coalesce(sum(high_findings), 0) AS BIGINT) AS high_findings, CAST(coalesce(sum(medium_findings), 0) AS BIGINT) AS medium_findings,
         CAST(coalesce(sum(low_findings), 0) AS BIGINT) AS low_findings, CAST(coalesce(sum(false_positives), 0) AS BIGINT) AS false_positives,
         CAST(coalesce(sum(confirmed_threats), 0) AS BIGINT) AS confirmed_threats,
         round(CAST(sum(s) AS DOUBLE) / nullif(sum(n), 0), 6) AS avg_confidence_score
  FROM executions e LEFT JOIN fagg f ON e.execution_id = f.execution_id
  WHERE e.status = 'completed' AND CAST(e.execution_start AS DATE) >= DATE '{first_day}'
  GROUP BY e.hunt_name, CAST(e.execution_start AS DATE), e.records_analyzed, e.execution_start, e.execution_end)""") + f"""SELECT hunt_name, execution_date,
  total_findings, critical_findings, high_findings, medium_findings, low_findings, false_positives, confirmed_threats, avg_confidence_score,
  records_analyzed, {RUN_SECS} AS execution_time_seconds
FROM (SELECT *, row_number() OVER (PARTITION BY hunt_name, execution_date ORDER BY execution_start DESC, execution_end DESC, records_analyzed DESC) AS rn FROM runs)
WHERE rn = 1"""


def statistics_upsert() -> str:
    return f"""WITH old AS ({hunt_statistics(seen="created_at < TIMESTAMP '2000-01-15 00:00:00'")}), new AS ({hunt_statistics("2000-01-12")})
SELECT * FROM old WHERE (hunt_name, execution_date) NOT IN (SELECT (hunt_name, execution_date) FROM new)
UNION ALL SELECT * FROM new"""


def report_summary() -> str:
    v = VIEW_BODIES
    return with_(FINDINGS, EXECS, f"ov AS ({v['report_overall']})", f"sev AS ({v['report_severity']})",
                 f"thr AS ({v['report_top_threats']})", f"perf AS ({v['report_hunt_performance']})") + f"""SELECT DATE '2000-01-15' AS report_date, 30 AS period_days,
  DATE '1999-12-16' AS period_start, DATE '2000-01-15' AS period_end,
  coalesce(total_hunts, 0) AS total_hunts, coalesce(total_findings, 0) AS total_findings, coalesce(successful_hunts, 0) AS successful_hunts,
  coalesce(total_records_analyzed, 0) AS records_analyzed,
  round(successful_hunts * 100.0::DOUBLE / nullif(total_hunts, 0), 6) AS success_rate,
  round(coalesce(total_records_analyzed, 0) / 1e6::DOUBLE, 6) AS records_millions,
  (SELECT to_json(list({{'severity': severity, 'count': "count"}} ORDER BY {SEV_RANK.format(c="severity")} DESC)) FROM sev) AS severity_breakdown,
  (SELECT to_json(list({{'source_ip': source_ip, 'finding_count': finding_count, 'max_severity': max_severity, 'threat_types': threat_types}}
                  ORDER BY finding_count DESC, source_ip ASC NULLS FIRST)) FROM thr) AS top_threats,
  (SELECT to_json(list({{'hunt_name': hunt_name, 'execution_count': execution_count, 'total_findings': total_findings, 'avg_time': avg_time}}
                  ORDER BY hunt_name)) FROM perf) AS hunt_performance
FROM ov"""


CHART_BODIES = {
    "chart_findings_by_severity": ("vw_severity_distribution", 'SELECT severity, CAST(sum("count") AS BIGINT) AS total_count FROM v GROUP BY severity'),
    "chart_daily_trend": ("vw_daily_findings", "SELECT finding_date, hunt_name, CAST(sum(finding_count) AS BIGINT) AS total_findings FROM v GROUP BY ALL"),
    "chart_hunt_performance": ("vw_hunt_performance", "SELECT hunt_name, execution_count, total_findings, avg_execution_time, successful_runs FROM v"),
    "chart_top_sources": ("vw_top_sources", "SELECT source_ip, finding_count FROM v ORDER BY finding_count DESC, source_ip ASC LIMIT 10"),
    "chart_timeline_heatmap": ("vw_hunt_timeline", 'SELECT date, hour, CAST(sum(finding_count) AS BIGINT) AS total_findings FROM v GROUP BY ALL'),
    "chart_effectiveness": ("vw_hunt_effectiveness", "SELECT hunt_name, total_findings, confirmed_threats, false_positives, true_positive_rate FROM v"),
    "chart_investigation_status": ("vw_investigation_status", 'SELECT status, severity, CAST(sum("count") AS BIGINT) AS total_count FROM v GROUP BY ALL'),
    "chart_ioc_feed": ("dashboard_ioc_feed", "SELECT ioc_value, ioc_type, times_seen, threat_level, first_seen, last_seen FROM v"),
    "chart_finding_types": ("dashboard_finding_types", 'SELECT finding_type, "count" FROM v'),
    "chart_severity_trends": ("dashboard_severity_trends", 'SELECT date, severity, "count" FROM v'),
}


def chart_sql(name: str) -> str:
    view, body = CHART_BODIES[name]
    return with_(FINDINGS, EXECS, f"v AS ({VIEW_BODIES[view]})") + body


# --- de-duplication, IOCs, execution log, sources --------------------------------
FINDING_COLS = ("finding_id, execution_id, hunt_name, severity, finding_type, source_ip, destination_ip, destination_hostname, username, "
                "timestamp, CAST(confidence_score AS DOUBLE) AS confidence_score, status, created_at")
FP = "sha256(concat_ws('|', coalesce(finding_type, ''), coalesce(source_ip, ''), coalesce(destination_ip, ''), coalesce(destination_hostname, ''), coalesce(username, '')))"
INCOMING = "findings WHERE timestamp >= TIMESTAMP '2000-01-01 00:00:00' AND timestamp < TIMESTAMP '2000-02-01 00:00:00'"
HISTORY = "findings WHERE timestamp >= TIMESTAMP '1999-12-25 00:00:00' AND timestamp < TIMESTAMP '2000-01-01 00:00:00'"


def dedup_source() -> str:
    return with_(FINDINGS) + f"""SELECT {FINDING_COLS} FROM {INCOMING}
  AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT finding_type AS t, source_ip AS s FROM {HISTORY}) h
                  WHERE h.t = findings.finding_type AND h.s = findings.source_ip)"""


def dedup_fingerprint() -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in ["timestamp", "finding_id", "execution_id", "confidence_score", "severity", "status",
                                                    "created_at", "hunt_name", "finding_id", "execution_id", "hunt_name", "severity",
                                                    "finding_type", "source_ip", "destination_ip", "destination_hostname", "username"])
    return with_(FINDINGS) + f"""SELECT fingerprint, {FINDING_COLS} FROM (
  SELECT *, {FP} AS fingerprint FROM {INCOMING}) inc
WHERE fingerprint NOT IN (SELECT {FP} FROM {HISTORY})
QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY {order}) = 1"""


def finding_fingerprint() -> str:
    return with_(FINDINGS) + f"""SELECT finding_id, execution_id, finding_type, source_ip, destination_ip, destination_hostname, username, {FP} AS fingerprint
FROM findings"""


ARRIVAL = "created_at, execution_id, finding_id, timestamp, severity, finding_type"


def ioc_rollup() -> str:
    ind = "\n  UNION ALL ".join(
        f"SELECT '{t}' AS ioc_type, {c} AS ioc_value, timestamp, finding_type AS hunt, {SEV_RANK.format(c='severity')} AS rank, seq "
        f"FROM fs WHERE {c} IS NOT NULL AND {c} <> ''"
        for t, c in (("ip", "source_ip"), ("ip", "destination_ip"), ("domain", "destination_hostname")))
    return with_(FINDINGS, f"fs AS (SELECT *, dense_rank() OVER (ORDER BY {ARRIVAL}) AS seq FROM findings)", f"ind AS (\n  {ind})",
                 """ph AS (SELECT ioc_type, ioc_value, hunt, count(*) AS times, min(seq) AS a0 FROM ind GROUP BY ALL)""",
                 """agg AS (SELECT ioc_type, ioc_value, arg_min(timestamp, seq) AS first_seen, arg_max(timestamp, seq) AS last_seen,
    count(*) AS times_seen, arg_min(rank, seq) AS r0, max(CASE WHEN rank >= 2 THEN rank END) AS esc FROM ind GROUP BY ALL)""") + """SELECT a.ioc_type, a.ioc_value, first_seen, last_seen, times_seen,
  (SELECT to_json(list({'hunt': hunt, 'times': times} ORDER BY a0)) FROM ph WHERE ph.ioc_type = a.ioc_type AND ph.ioc_value = a.ioc_value) AS associated_hunts,
  CASE greatest(r0, esc) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' WHEN 0 THEN 'info' END AS threat_level
FROM agg a"""


def execution_log_latest() -> str:
    return with_(EXECS) + """SELECT execution_id, hunt_name, execution_start, execution_end, status,
  CASE WHEN status <> 'running' THEN records_analyzed END AS records_analyzed, CASE WHEN status <> 'running' THEN findings_count END AS findings_count
FROM executions"""


def campaign_summary() -> str:
    return with_(EXECS) + """SELECT CAST(execution_start AS DATE) AS campaign_date, count(*) AS hunts_run, count_if(status = 'completed') AS successful_hunts,
  count_if(status = 'failed') AS failed_hunts, CAST(coalesce(sum(CASE WHEN status = 'completed' THEN findings_count END), 0) AS BIGINT) AS total_findings,
  string_agg(DISTINCT hunt_name, ',' ORDER BY hunt_name) AS hunts
FROM executions GROUP BY 1"""


CONN_ALT = """SELECT l_returnflag AS service, CAST(8000 + l_linenumber AS INTEGER) AS id_resp_p, l_shipdate + to_seconds((l_orderkey*37+l_partkey) % 86400) AS ts,
  concat('10.4.0.', l_suppkey % 256) AS id_orig_h, concat('198.51.100.', l_partkey % 256) AS id_resp_h,
  CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes, CAST(floor(l_quantity) AS BIGINT) AS resp_bytes, l_discount AS duration FROM lineitem"""


def union_sources() -> str:
    return with_(CONN) + f"SELECT * FROM conn_logs UNION ALL BY NAME {CONN_ALT}"


def partition_date_range() -> str:
    return with_(CONN) + "SELECT * FROM conn_logs WHERE make_date(year, month, day) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"


def table_inventory() -> str:
    parts = "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS record_count, min(make_date(year, month, day)) AS earliest, max(make_date(year, month, day)) AS latest, "
        f"count(DISTINCT make_date(year, month, day)) AS partition_count, {k} AS column_count FROM {n}"
        for n, k in (("conn_logs", 10), ("dns_logs", 6), ("win_security", 9)))
    return with_(CONN, DNS, WIN) + parts


# --- sweeps and extensions --------------------------------------------------------
RUNCOLS = "run_start, run_end, "


def _runs(table: str, tcol: str, weekly: bool) -> str:
    d = f"CAST({tcol} AS DATE)"
    if not weekly:
        return f"(SELECT *, {d} AS run_start, {d} AS run_end FROM {table})"
    e1 = f"({d} + CAST((7 - dayofweek({d})) % 7 AS INTEGER))"
    ends = f"CASE WHEN dayofweek({d}) = 0 THEN [{e1}, {e1} + 7] ELSE [{e1}] END"
    return f"(SELECT *, run_end - 7 AS run_start FROM (SELECT *, unnest({ends}) AS run_end FROM {table}))"


def hunt_sweep(weekly: bool) -> str:
    ctes = [CONN, c2_profile_cte(by=RUNCOLS, part=RUNCOLS, src=_runs("conn_logs", "ts", weekly), extra="run_start, run_end,"),
            *dns_ctes(by=RUNCOLS, extra="run_start, run_end,", src=_runs("dns_logs", "ts", weekly)),
            *lateral_ctes(4320, by=RUNCOLS, extra="run_start, run_end,", src=_runs("win_security", "timestamp", weekly))]
    cols = f"{RUNCOLS}{HUNT_COLS}"
    return (with_(*ctes) + f"SELECT {cols} FROM ({c2_findings_sql(10, 400000, by=RUNCOLS)})\n"
            f"UNION ALL SELECT {cols} FROM ({dns_findings_sql(by=RUNCOLS)})\n"
            f"UNION ALL SELECT {cols} FROM ({lateral_findings_sql(4320, 3, by=RUNCOLS)})")


def sliding_c2_sweep() -> str:
    w = "CAST(floor(epoch(ts) / 21600) AS BIGINT)"
    src = (f"(SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(w * 21600) AS window_start, "
           f"TIMESTAMP '1970-01-01 00:00:00' + to_seconds(w * 21600 + 259200) AS window_end "
           f"FROM (SELECT *, unnest(generate_series({w} - 11, {w})) AS w FROM conn_logs))")
    by = "window_start, window_end, "
    return with_(CONN, c2_profile_cte(by=by, part=by, src=src, extra="window_start, window_end,")) + c2_findings_sql(5, 400000, by=by)


def dns_entropy() -> str:
    ent = "-sum(n / length(query_domain) * log2(n / length(query_domain)))"
    return with_(DNS, """names AS (SELECT DISTINCT query AS query_domain FROM dns_logs WHERE query IS NOT NULL AND query <> '')""",
                 """cnt AS (SELECT query_domain, c, count(*) AS n FROM (SELECT query_domain, unnest(string_split(query_domain, '')) AS c FROM names) GROUP BY ALL)""") + \
        f"""SELECT query_domain, CAST(length(query_domain) AS BIGINT) AS query_length, round({ent}, 6) AS entropy, {ent} >= 3.5 AS high_entropy
FROM cnt GROUP BY query_domain"""


def c2_off_hours() -> str:
    off = "hour(ts) < 8 OR hour(ts) >= 18"
    return with_(CONN) + f"""SELECT id_orig_h AS source_ip, id_resp_h AS destination_ip, id_resp_p AS destination_port, count(*) AS connection_count,
  count_if({off}) AS off_hours_count, round(count_if({off}) / count(*), 6) AS off_hours_share
FROM conn_logs GROUP BY ALL"""


def dns_subdomains() -> str:
    parent = "CASE WHEN len(string_split(query_domain, '.')) >= 2 THEN array_to_string(string_split(query_domain, '.')[-2:], '.') ELSE query_domain END"
    return with_(*dns_ctes()) + f"""SELECT {parent} AS parent_domain, count(DISTINCT query_domain) AS subdomain_count, count(*) AS query_count,
  count(DISTINCT source_ip) AS source_count FROM dns_q GROUP BY 1"""


LOGONS = """le AS (SELECT timestamp, event_code, user_name AS username, host_name AS destination_host, source_ip
  FROM win_security WHERE event_code IN ('4624', '4625', '4648'))"""


def new_logon_pairs() -> str:
    split = "TIMESTAMP '2024-01-02 00:00:00'"
    return with_(WIN, LOGONS) + f"""SELECT * FROM (
  SELECT username, destination_host, count(*) AS logon_count, min(timestamp) AS first_logon, max(timestamp) AS last_logon
  FROM le WHERE timestamp >= {split} GROUP BY ALL) c
WHERE NOT EXISTS (SELECT 1 FROM le b WHERE b.timestamp < {split} AND b.username = c.username AND b.destination_host = c.destination_host)"""


def logon_escalation() -> str:
    return with_(WIN, LOGONS) + f"""SELECT username, destination_host, source_ip, timestamp, pt AS failed_at FROM (
  SELECT *, lag(event_code) OVER w AS pc, lag(timestamp) OVER w AS pt FROM le WHERE {PRIV.format(u='username')}
  WINDOW w AS (PARTITION BY username, destination_host ORDER BY timestamp, event_code))
WHERE event_code = '4624' AND pc = '4625'"""


def admin_port_fanout() -> str:
    return with_(CONN) + """SELECT id_orig_h AS source_ip, id_resp_p AS destination_port, count(DISTINCT id_resp_h) AS destination_count,
  count(*) AS connection_count, min(ts) AS first_seen, max(ts) AS last_seen
FROM conn_logs WHERE id_resp_p IN (443) GROUP BY ALL HAVING count(DISTINCT id_resp_h) >= 3"""


def c2_sessions() -> str:
    return with_(CONN, """marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER pair <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM conn_logs
  WINDOW pair AS (PARTITION BY id_orig_h, id_resp_h, id_resp_p ORDER BY ts))""", """numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY id_orig_h, id_resp_h, id_resp_p ORDER BY ts) AS k FROM marked)""") + """SELECT id_orig_h AS source_ip,
  id_resp_h AS destination_ip, id_resp_p AS destination_port, min(ts) AS session_start, max(ts) AS session_end,
  CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS session_seconds, count(*) AS connection_count,
  CAST(sum(orig_bytes) AS BIGINT) AS bytes_sent
FROM numbered GROUP BY id_orig_h, id_resp_h, id_resp_p, k"""


PORTS = "CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 445 WHEN 1 THEN 3389 WHEN 2 THEN 443 ELSE 8080 END AS id_resp_p"


def on_ports(sql: str) -> str:
    """A statement over the connection log with ports."""
    return sql.replace("443 AS id_resp_p", PORTS)


# --- registry -----------------------------------------------------------------
def registered() -> dict[str, str]:
    """name -> SQL for every query that has an oracle."""
    return {
        "c2_beaconing": c2_beaconing(10, 400000),
        "dns_tunneling": dns_tunneling(),
        "lateral_movement": lateral_movement(),
        "all_hunts": all_hunts(),
        "c2_beacon_profile": c2_beacon_profile(),
        "c2_intervals": c2_intervals(),
        "dns_profile": dns_profile(),
        "lateral_profile": lateral_profile(),
        "logon_events": logon_events(),
        "privileged_accounts": privileged_accounts(),
        "records_analyzed": records_analyzed(),
        **{name: result_sql(body) for name, body in VIEW_BODIES.items()},
        "hunt_statistics": hunt_statistics(),
        "report_summary": report_summary(),
        **{name: chart_sql(name) for name in CHART_BODIES},
        "dedup_source": dedup_source(),
        "dedup_fingerprint": dedup_fingerprint(),
        "finding_fingerprint": finding_fingerprint(),
        "ioc_rollup": ioc_rollup(),
        "ioc_upsert": ioc_rollup(),          # merging old + new equals rolling up all
        "execution_log_latest": execution_log_latest(),
        "campaign_summary": campaign_summary(),
        "union_sources": union_sources(),
        "partition_date_range": partition_date_range(),
        "table_inventory": table_inventory(),
        "daily_hunt_sweep": hunt_sweep(weekly=False),
        "weekly_hunt_sweep": hunt_sweep(weekly=True),
        "sliding_c2_sweep": sliding_c2_sweep(),
        "dns_entropy": dns_entropy(),
        "c2_off_hours": c2_off_hours(),
        "dns_subdomains": dns_subdomains(),
        "new_logon_pairs": new_logon_pairs(),
        "logon_escalation": logon_escalation(),
        "admin_port_fanout": admin_port_fanout(),
        "statistics_upsert": statistics_upsert(),
        "c2_sessions": c2_sessions(),
        "admin_port_access": on_ports(admin_port_fanout()).replace("IN (443)", "IN (445, 3389)"),
        "c2_port_profile": on_ports(c2_beacon_profile()),
        "rollup_daily_findings": result_sql(VIEW_BODIES["vw_daily_findings"]),
        "rollup_hunt_timeline": result_sql(VIEW_BODIES["vw_hunt_timeline"]),
        "rollup_top_sources": result_sql(VIEW_BODIES["vw_top_sources"]),
        "edited_investigation_status": edited_sql("vw_investigation_status"),
        "edited_hunt_effectiveness": edited_sql("vw_hunt_effectiveness"),
        "edited_top_threats": edited_sql("report_top_threats"),
    }
