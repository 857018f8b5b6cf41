"""DNS tunneling: long, numerous or deeply nested queries per source.

One partial-aggregated ``groupBy(source_ip, query)``: a hot query name is
combined map-side before the shuffle, so skew costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.functions import scoring, text
from tracehound.functions.timecols import normalize_time, text_time

HUNT = "dns_tunneling"
KEYS = ["source_ip", "query_domain"]


def dns_queries(dns_logs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P2 + F2: rename and measure each query; NULL or empty names are
    dropped (the reference would score such a group 100 and then fail)."""
    df = normalize_time(dns_logs, "ts")
    q = F.col("query")
    return df.filter(q.isNotNull() & (q != "")).select(
        F.col("id_orig_h").alias("source_ip"),
        q.alias("query_domain"),
        F.col("ts").alias("timestamp"),
        F.length(q).cast("long").alias("query_length"),
        scoring.label_count(q).alias("subdomain_count"),
        *[F.col(f"`{k}`") for k in keep],
    )


def profile_queries(queries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return queries.groupBy(*by, *KEYS).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.avg("query_length").alias("avg_query_length"),
        F.max("query_length").alias("max_query_length"),
        F.avg("subdomain_count").alias("avg_subdomain_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def dns_profile(dns_logs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2: per (source_ip, query_domain) count, avg/max length, avg labels,
    first/last time.  ``by`` names further key columns of the log."""
    return profile_queries(dns_queries(dns_logs, by), by)


def tunneling_findings(profile: DataFrame, *, min_query_length: int = 50, min_query_count: int = 100,
                       min_score: float = 50, by: Sequence[str] = ()) -> DataFrame:
    """P5 + F4 + P7 + P8."""
    # Fixed value: a label count above 5 is suspicious on its own.
    max_labels = 5
    cand = profile.filter((F.col("avg_query_length") > min_query_length)
                          | (F.col("query_count") > min_query_count)
                          | (F.col("avg_subdomain_count") > max_labels))
    s = scoring.dns_score(F.col("avg_query_length"), F.col("query_count"), F.col("avg_subdomain_count"))
    scored = cand.withColumn("_score", s).filter(F.col("_score") > min_score)
    raw = text.raw_json(
        query_count=F.col("query_count"),
        avg_query_length=F.col("avg_query_length"),
        max_query_length=F.col("max_query_length"),
        avg_subdomain_count=F.col("avg_subdomain_count"),
        first_seen=text_time("first_seen"),
        last_seen=text_time("last_seen"),
    )
    return scored.select(
        *by,
        F.lit(HUNT).alias("hunt_name"),
        F.when(F.col("_score") > 80, F.lit("critical")).otherwise(F.lit("high")).alias("severity"),
        F.lit(HUNT).alias("finding_type"),
        F.col("source_ip"),
        F.lit(None).cast("string").alias("destination_ip"),
        F.col("query_domain").alias("destination_hostname"),
        F.lit(None).cast("string").alias("username"),
        F.col("first_seen").alias("timestamp"),
        F.round(F.col("_score"), 2).alias("confidence_score"),
        text.dns_description(F.col("query_count"), F.col("avg_query_length"), F.col("query_domain")).alias("description"),
        raw.alias("raw_data"),
    )


def dns_tunneling(dns_logs: DataFrame, *, min_query_length: int = 50, min_query_count: int = 100,
                  entropy_threshold: float | None = None, min_score: float = 50, by: Sequence[str] = ()) -> DataFrame:
    """The DNS tunneling hunt: DNS log -> findings, for each value of the
    ``by`` columns apart.

    ``entropy_threshold`` is documented by the reference but not applied
    there; when given, findings are also required to have a query-name
    Shannon entropy at or above it (see ``extensions.dns_entropy``)."""
    found = tunneling_findings(dns_profile(dns_logs, by), min_query_length=min_query_length,
                               min_query_count=min_query_count, min_score=min_score, by=by)
    if entropy_threshold is None:
        return found
    from tracehound.operators.extensions import shannon_entropy
    return found.filter(shannon_entropy(F.col("destination_hostname")) >= entropy_threshold)
