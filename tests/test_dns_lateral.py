"""DNS tunneling and lateral movement on hand-made logs (FIXTURES §C)."""

import datetime as dt

import pytest

from conftest import DNS_SCHEMA, WIN_SCHEMA
from tracehound.functions import scoring
from tracehound.operators import dns, lateral

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def dns_df(spark, rows):
    return spark.createDataFrame(rows, DNS_SCHEMA)


def test_long_query_scores_60_04_high(spark):
    q = ".".join(["a" * 20] * 5) + "." + "b" * 15   # 6 labels, 120 chars
    assert len(q) == 120
    r = dns.dns_tunneling(dns_df(spark, [(T0, "10.2.0.1", q)])).collect()
    assert len(r) == 1
    assert r[0].confidence_score == pytest.approx(60.04)
    assert r[0].severity == "high"
    assert r[0].destination_hostname == q
    assert r[0].description == f"Potential DNS tunneling: 1 queries with avg length 120 chars to {q}"


def test_busy_short_name_exactly_50_not_kept(spark):
    q = "abcdefgh.example.com"   # 20 chars, 3 labels
    rows = [(T0 + dt.timedelta(seconds=i), "10.2.0.2", q) for i in range(900)]
    prof = dns.dns_profile(dns_df(spark, rows)).collect()[0]
    assert prof.query_count == 900 and prof.avg_query_length == 20 and prof.avg_subdomain_count == 3
    assert dns.dns_tunneling(dns_df(spark, rows)).count() == 0


def test_null_and_empty_queries_ignored(spark):
    rows = [(T0, "10.2.0.3", None)] * 100 + [(T0, "10.2.0.3", "")] * 100
    assert dns.dns_tunneling(dns_df(spark, rows)).count() == 0
    assert dns.dns_profile(dns_df(spark, rows)).count() == 0


def test_iso_string_first_seen_parsed_as_utc(spark):
    q = ".".join(["x" * 30] * 4)
    df = spark.createDataFrame([("2021-01-01T00:00:00.000Z", "10.2.0.4", q)], DNS_SCHEMA.replace("ts timestamp_ntz", "ts string"))
    r = dns.dns_tunneling(df).collect()[0]
    assert r.timestamp.replace(tzinfo=None) == dt.datetime(2021, 1, 1)   # session zone is UTC


def logons(spark, user, hosts, attempts, start=T0, step=60, code="4624"):
    rows = [(start + dt.timedelta(seconds=step * i), code, user, hosts[i % len(hosts)], "10.3.0.7", 3) for i in range(attempts)]
    return spark.createDataFrame(rows, WIN_SCHEMA)


def test_burst_of_plain_user_dropped(spark):
    df = logons(spark, "bob", [f"h{i}" for i in range(5)], 10)
    prof = lateral.lateral_profile(df).collect()
    assert len(prof) == 1 and prof[0].unique_hosts == 5 and prof[0].logon_attempts == 10
    assert lateral.lateral_movement(df).count() == 0          # 25 + 15 = 40


def test_privileged_burst_critical(spark):
    df = logons(spark, "SVC_backup", [f"h{i}" for i in range(5)], 10)
    r = lateral.lateral_movement(df).collect()
    assert len(r) == 1 and r[0].confidence_score == 60.0 and r[0].severity == "critical"
    assert r[0].description == "Potential lateral movement: Account 'SVC_backup' accessed 5 unique hosts in 60 minutes from 10.3.0.7"
    assert '"hosts_accessed":["h0","h1","h2","h3","h4"]' in r[0].raw_data


def test_bucket_edge_splits(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 59, 59), "4624", "u", "h1", "s", 3),
            (dt.datetime(2024, 1, 1, 1, 0, 0), "4624", "u", "h2", "s", 3)]
    prof = lateral.lateral_profile(spark.createDataFrame(rows, WIN_SCHEMA)).collect()
    assert len(prof) == 2


def test_other_event_codes_not_counted(spark):
    df = logons(spark, "admin1", [f"h{i}" for i in range(8)], 16, code="4634")
    assert lateral.logon_events(df).count() == 0
    assert lateral.lateral_movement(df).count() == 0


def test_privileged_patterns_validated():
    with pytest.raises(TypeError):
        scoring.check_patterns("admin")
    assert scoring.check_patterns(["Admin", "SVC"]) == ["admin", "svc"]


def test_privileged_null_is_false(spark):
    df = spark.createDataFrame([(None,), ("xAdMiNx",), ("bob",)], "username string")
    got = {r.username: r.p for r in df.select("username", scoring.is_privileged("username").alias("p")).collect()}
    assert got == {None: False, "xAdMiNx": True, "bob": False}


def test_registry_run_hunt_and_unknown_name(spark):
    from tracehound.operators import hunts
    df = logons(spark, "SVC_backup", [f"h{i}" for i in range(5)], 10)
    assert hunts.run_hunt("lateral_movement", {"win_security": df}).count() == 1
    with pytest.raises(ValueError):
        hunts.get("no_such_hunt")


def test_entropy_threshold_filters_findings(spark):
    varied = "".join(chr(97 + (i * 7) % 26) for i in range(100))
    high = ".".join(varied[i:i + 20] for i in range(0, 100, 20)) + ".example"      # 6 labels, 112 chars, ~4.8 bits
    low = ".".join(["a" * 20] * 5) + ".example"                                    # 6 labels, 112 chars, ~0.7 bits
    rows = [(T0, "10.2.0.9", high), (T0, "10.2.0.9", low)]
    df = dns_df(spark, rows)
    assert dns.dns_tunneling(df).count() == 2
    kept = [r.destination_hostname for r in dns.dns_tunneling(df, entropy_threshold=3.5).collect()]
    assert kept == [high]


def test_entropy_values(spark):
    import math
    from tracehound.operators.extensions import query_entropy
    df = spark.createDataFrame([("aabb",), ("abcd",), ("aaaa",)], "query_domain string")
    got = {r.query_domain: r.entropy for r in query_entropy(df).collect()}
    assert got["aabb"] == pytest.approx(1.0) and got["abcd"] == pytest.approx(2.0) and got["aaaa"] == pytest.approx(0.0)
    assert math.isfinite(got["abcd"])
