"""Indicator-of-compromise tracking (A7 roll-up, K4 upsert).

Each finding yields up to three indicators (source IP, destination IP,
destination host name).  The roll-up is two partial aggregates —
``(type, value, hunt)`` then ``(type, value)`` — so every output field is
bounded: the associated hunts are kept as (hunt, times) pairs in order of
first arrival (at most one entry per hunt) instead of an ever-growing
list with repeats.  Arrival order is an explicit key (``arrival``), never
the physical order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scoring import severity_from_rank, severity_rank

# Indicator kinds tracked per finding: (ioc_type, finding column).
IOC_SOURCES = [("ip", "source_ip"), ("ip", "destination_ip"), ("domain", "destination_hostname")]
DEFAULT_ARRIVAL = ["created_at", "execution_id", "finding_id", "timestamp", "severity", "finding_type"]
# Levels that raise a tracked indicator's threat level on later sightings
# (rank of 'medium'); 'low' and 'info' only count on the first sighting.
ESCALATING_RANK = 2
IOC_KEYS = ["ioc_type", "ioc_value"]


def indicators(findings: DataFrame, arrival: Sequence[str] = DEFAULT_ARRIVAL) -> DataFrame:
    """Explode findings to (ioc_type, ioc_value) rows; NULL or empty values
    are skipped.  Missing severity counts as 'medium'."""
    order = [c for c in arrival if c in findings.columns]
    arr = F.struct(*[F.col(c) for c in order]).alias("arrival")
    ind = F.explode(F.array(*[F.struct(F.lit(t).alias("ioc_type"), F.col(c).alias("ioc_value")) for t, c in IOC_SOURCES]))
    sev = severity_rank(F.coalesce(F.col("severity"), F.lit("medium")))
    x = findings.select(ind.alias("i"), arr, F.col("finding_type").alias("hunt"), sev.alias("rank"))
    x = x.select("i.*", "arrival", "hunt", "rank")
    return x.filter(F.col("ioc_value").isNotNull() & (F.col("ioc_value") != ""))


def _escalation(rank: Column) -> Column:
    return F.max(F.when(rank >= ESCALATING_RANK, rank))


ARRIVAL_TYPES = {"created_at": "timestamp", "execution_id": "bigint", "finding_id": "bigint", "timestamp": "timestamp",
                 "severity": "string", "finding_type": "string"}
#: A run's roll-up as stored, with the whole default arrival key.
_ARRIVAL_STRUCT = "struct<" + ",".join(f"`{c}`:{t}" for c, t in ARRIVAL_TYPES.items()) + ">"
PARTIAL_SCHEMA = f"ioc_type string, ioc_value string, hunt string, n bigint, a0 {_ARRIVAL_STRUCT}, a1 {_ARRIVAL_STRUCT}, esc int"


def ioc_partial(findings: DataFrame, arrival: Sequence[str] = DEFAULT_ARRIVAL) -> DataFrame:
    """The mergeable part of the roll-up: per (indicator, hunt) the count, the
    first and last arrival and the highest escalating severity.

    The arrival key carries the sighting's time and severity, so one minimum
    and one maximum of it yield the first and last sighting whole.  A struct
    with text needs a sort-based partial aggregate; that sort is local to a
    task and spills, and only one row per key and task is shuffled.  (Hash
    aggregates on the numbers alone would need the raw rows shuffled again to
    settle ties, hot indicators included.)"""
    arrival = [c for c in arrival if c in findings.columns]
    for c in ("timestamp", "severity"):
        if c not in arrival:
            arrival.append(c)
    return indicators(findings, arrival).groupBy(*IOC_KEYS, "hunt").agg(
        F.count(F.lit(1)).alias("n"), F.min("arrival").alias("a0"), F.max("arrival").alias("a1"),
        _escalation(F.col("rank")).alias("esc"))


def stored_partial(findings: DataFrame) -> DataFrame:
    """``ioc_partial`` in the stored form (PARTIAL_SCHEMA): the whole arrival
    key in its fixed types, absent columns NULL."""
    fixed = {c: (F.col(c) if c in findings.columns else F.lit(None)).cast(t) for c, t in ARRIVAL_TYPES.items()}
    return ioc_partial(findings.withColumns(fixed))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Roll-ups of several runs as one."""
    return partials.groupBy(*IOC_KEYS, "hunt").agg(
        F.sum("n").alias("n"), F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.max("esc").alias("esc"))


def ioc_finish(per_hunt: DataFrame) -> DataFrame:
    """The tracked indicators of a (merged) roll-up."""
    agg = per_hunt.groupBy(*IOC_KEYS).agg(
        F.min("a0").alias("_first"),
        F.max("a1").alias("_last"),
        F.sum("n").alias("times_seen"),
        F.array_sort(F.collect_list(F.struct("a0", "hunt", "n"))).alias("_hunts"),
        F.max("esc").alias("escalation_rank"),
    )
    first_rank = severity_rank(F.coalesce(F.col("_first.severity"), F.lit("medium")))
    return agg.select(
        *IOC_KEYS,
        F.col("_first.timestamp").alias("first_seen"),
        F.col("_last.timestamp").alias("last_seen"),
        "times_seen",
        F.transform("_hunts", lambda h: F.struct(h["hunt"].alias("hunt"), h["n"].alias("times"))).alias("associated_hunts"),
        severity_from_rank(F.greatest(first_rank, F.col("escalation_rank"))).alias("threat_level"),
        "escalation_rank",
    )


def ioc_rollup(findings: DataFrame, arrival: Sequence[str] = DEFAULT_ARRIVAL) -> DataFrame:
    """Per indicator: first/last sighting time (by arrival, not by
    time), times seen, hunts with counts in order of first arrival, and
    the threat level (first sighting's level, raised by later medium+)."""
    return ioc_finish(ioc_partial(findings, arrival))


HUNTS_TYPE = "array<struct<hunt:string,times:bigint>>"


def _merge_hunts(state: Column, delta: Column) -> Column:
    """state's hunts keep their place; counts add; new hunts go last."""
    def step(acc, h):
        hit = F.exists(acc, lambda y: y["hunt"] == h["hunt"])
        bumped = F.transform(acc, lambda y: F.when(y["hunt"] == h["hunt"], F.struct(
            y["hunt"].alias("hunt"), (y["times"] + h["times"]).alias("times"))).otherwise(y))
        return F.when(hit, bumped).otherwise(F.concat(acc, F.array(h)))
    empty = F.array().cast(HUNTS_TYPE)
    return F.aggregate(F.coalesce(delta, empty), F.coalesce(state, empty), step)


def ioc_upsert(state: DataFrame, delta: DataFrame) -> DataFrame:
    """K4: merge a roll-up of new findings (``delta``) into the tracked
    indicators (``state``) with one full outer join on the unique key
    (both sides hold one row per key: no skew).  First sighting is kept,
    last sighting and counts advance, the threat level never drops."""
    s = state.select(*IOC_KEYS, *[F.col(c).alias(f"s_{c}") for c in state.columns if c not in IOC_KEYS])
    d = delta.select(*IOC_KEYS, *[F.col(c).alias(f"d_{c}") for c in delta.columns if c not in IOC_KEYS])
    j = s.join(d, IOC_KEYS, "full_outer")
    tracked = F.col("s_times_seen").isNotNull()
    raised = severity_from_rank(F.greatest(severity_rank("s_threat_level"), F.col("d_escalation_rank")))
    s_esc = F.col("s_escalation_rank") if "s_escalation_rank" in j.columns else F.lit(None).cast("int")
    return j.select(
        *IOC_KEYS,
        F.coalesce("s_first_seen", "d_first_seen").alias("first_seen"),
        F.coalesce("d_last_seen", "s_last_seen").alias("last_seen"),
        (F.coalesce("s_times_seen", F.lit(0)) + F.coalesce("d_times_seen", F.lit(0))).alias("times_seen"),
        _merge_hunts(F.col("s_associated_hunts"), F.col("d_associated_hunts")).alias("associated_hunts"),
        F.when(tracked, raised).otherwise(F.col("d_threat_level")).alias("threat_level"),
        F.greatest(s_esc, F.col("d_escalation_rank")).alias("escalation_rank"),
    )
