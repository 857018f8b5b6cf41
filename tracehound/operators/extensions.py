"""Detections the reference documents but does not implement.

E2 (byte-pattern similarity) and E4 (session length) are columns of the
C2 profile (``c2.add_extensions``).  Every operator here is a composition
of partial aggregates, anti joins or sliced windows, so no hot key lands
whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions import scoring
from tracehound.functions.timecols import epoch_seconds
from tracehound.operators import c2, dns, lateral

# The reference's documented thresholds.
ENTROPY_THRESHOLD = 3.5
BUSINESS_HOURS = (8, 18)          # [start, end) in hours of the day, event-time zone
ADMIN_PORTS = (445, 3389)         # SMB, RDP
SUCCESS_CODE, FAILURE_CODE = "4624", "4625"
DEFAULT_SLICE_SECONDS = 3600


# --- generic: previous row in order, skew-safe ---------------------------------
def previous_in_order(df: DataFrame, keys: Sequence[str], time_col: str, order: Sequence[str],
                      values: Sequence[str], slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """For each row, the ``values`` of the previous row with the same
    ``keys`` in ``order`` (NULL for the first), as ``prev_<value>``.

    ``lag`` runs inside (keys, time slice) partitions, so a hot key is
    spread over its slices; the first row of each slice takes the last
    row of the previous non-empty slice (one row per slice, joined back;
    both branches come from one window, so the input is read once)."""
    x = df.withColumn("_slice", F.floor(epoch_seconds(time_col) / F.lit(slice_seconds)))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    x = x.withColumns({"_head": F.lag(F.lit(1)).over(w).isNull(), "_is_tail": F.lead(F.lit(1)).over(w).isNull(),
                       **{f"_lag_{v}": F.lag(v).over(w) for v in values}})
    # the last row of each slice, from the same window; it carries the whole
    # row so both branches need the same columns and share one exchange
    tails = x.filter(F.col("_is_tail")).select(*keys, "_slice", F.struct(*df.columns).alias("_tail"))
    tails = tails.withColumn("_prev_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")))
    tails = tails.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_slice").alias("_t_slice"), "_prev_tail")
    cond = [x[k].eqNullSafe(tails[f"_t_{k}"]) for k in keys] + [x["_slice"] == tails["_t_slice"]]
    j = x.join(tails, cond, "left")
    out = j.select(*df.columns, *[
        F.when(F.col("_head"), F.col("_prev_tail")[v]).otherwise(F.col(f"_lag_{v}")).alias(f"prev_{v}") for v in values])
    return out


# --- E1 ---------------------------------------------------------------------------
def query_entropy(names: DataFrame, col: str = "query_domain") -> DataFrame:
    """Shannon entropy (bits per character) of each distinct name."""
    distinct = names.select(col).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct()
    return distinct.withColumn("entropy", shannon_entropy(F.col(col)))


def shannon_entropy(q: Column) -> Column:
    """Bits per character of a text, in the projection: for each different
    character, its share from the length that removing it leaves."""
    n = F.length(q).cast("double")

    def bits(acc: Column, c: Column) -> Column:
        p = (F.length(q) - F.length(F.replace(q, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.aggregate(F.array_distinct(F.filter(F.split(q, ""), lambda c: c != "")), F.lit(0.0), bits)


def dns_entropy(dns_logs: DataFrame, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """Entropy per distinct query name, flagged at ``threshold``."""
    ent = query_entropy(dns.dns_queries(dns_logs))
    return ent.select(F.col("query_domain"), F.length("query_domain").cast("long").alias("query_length"), "entropy",
                      (F.col("entropy") >= threshold).alias("high_entropy"))


# --- E3 ---------------------------------------------------------------------------
def c2_off_hours(conn_logs: DataFrame, business_hours: tuple[int, int] = BUSINESS_HOURS) -> DataFrame:
    """Per pair, connections outside business hours and their share."""
    start, end = business_hours
    pairs = c2.conn_pairs(conn_logs)
    h = F.hour("ts")
    off = (h < start) | (h >= end)
    agg = pairs.groupBy(*c2.PAIR).agg(F.count(F.lit(1)).alias("connection_count"), F.count_if(off).alias("off_hours_count"))
    return agg.withColumn("off_hours_share", F.col("off_hours_count") / F.col("connection_count"))


# --- E5 ---------------------------------------------------------------------------
def parent_domain(q) -> F.Column:
    """Last two labels of a name (the whole name when it has one label)."""
    return F.substring_index(q, ".", -2)


def dns_subdomains(dns_logs: DataFrame, approx: bool = False) -> DataFrame:
    """E5: per parent domain: distinct names below it, queries, sources."""
    q = dns.dns_queries(dns_logs).withColumn("parent_domain", parent_domain(F.col("query_domain")))
    nd = F.approx_count_distinct if approx else F.countDistinct
    return q.groupBy("parent_domain").agg(
        nd("query_domain").alias("subdomain_count"),
        F.count(F.lit(1)).alias("query_count"),
        nd("source_ip").alias("source_count"),
    )


# --- E6 ---------------------------------------------------------------------------
def new_logon_pairs(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("username", "source_ip")) -> DataFrame:
    """Key pairs (default account x source) seen in ``current`` logons
    but never in ``baseline`` — anti join on the baseline's distinct keys."""
    keys = list(keys)
    seen = baseline.select(*keys).distinct()
    agg = current.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("logon_count"),
        F.min("timestamp").alias("first_logon"),
        F.max("timestamp").alias("last_logon"),
    )
    return agg.join(seen, keys, "left_anti")


# --- E7 ---------------------------------------------------------------------------
def logon_escalation(win_logs: DataFrame, privileged_accounts: Sequence[str] = scoring.PRIVILEGED_PATTERNS,
                     time_col: str = "@timestamp", slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """A privileged account's successful logon (4624) right after a
    failed one (4625) on the same host."""
    ev = lateral.with_privilege(lateral.logon_events(win_logs, time_col=time_col), privileged_accounts)
    ev = ev.filter(F.col("is_privileged_account")).select("username", "destination_host", "source_ip", "timestamp", "event_code")
    prev = previous_in_order(ev, ["username", "destination_host"], "timestamp", ["timestamp", "event_code"],
                             ["event_code", "timestamp"], slice_seconds)
    hit = (F.col("event_code") == SUCCESS_CODE) & (F.col("prev_event_code") == FAILURE_CODE)
    return prev.filter(hit).select("username", "destination_host", "source_ip", "timestamp",
                                   F.col("prev_timestamp").alias("failed_at"))


# --- E8 ---------------------------------------------------------------------------
def admin_port_fanout(conn_logs: DataFrame, ports: Sequence[int] = ADMIN_PORTS, min_destinations: int = 10) -> DataFrame:
    """Sources reaching many distinct hosts on admin ports.  Distinct
    destinations are counted in two stages (source, port, destination)
    then (source, port)."""
    pairs = c2.conn_pairs(conn_logs).filter(F.col("destination_port").isin(*ports))
    per_dst = pairs.groupBy("source_ip", "destination_port", "destination_ip").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    agg = per_dst.groupBy("source_ip", "destination_port").agg(
        F.count("destination_ip").alias("destination_count"),
        F.sum("_n").alias("connection_count"),
        F.min("_first").alias("first_seen"),
        F.max("_last").alias("last_seen"),
    )
    return agg.filter(F.col("destination_count") >= min_destinations)
