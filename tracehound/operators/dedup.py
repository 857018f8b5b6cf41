"""Finding de-duplication (J2, J3, F14) as anti joins, not per-row lookups.

The history is not shuffled: each of its rows is first looked up in a bitmap
filter of the incoming keys (a Bloom filter with one hash), which is broadcast
and has a fixed size however many keys there are.  Only keys that pass are
reduced to distinct ones and joined, so a run pays for the stored findings it
might repeat.  For fingerprints the incoming side is one row per key as well,
so a hot key costs nothing extra.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions import scoring
from tracehound.functions.timecols import at_midnight, cutoff

SOURCE_KEYS = ["finding_type", "source_ip"]
# Order that picks the first of several same-fingerprint findings.
FIRST_ORDER = ["timestamp", "finding_id", "execution_id", "confidence_score", "severity", "status", "created_at", "hunt_name"]


#: Bits of the filter: 8 MB as 2048 bitmaps of 4 KB.  A history row that repeats
#: nothing passes with probability (incoming keys) / FILTER_BITS.
FILTER_BITS = 1 << 26
_HASH, _BITMAP = "_hash", "_bitmap"


def _place(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1     # bitmap functions count from one


def key_filter(incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming keys as bitmaps: (bitmap number, bitmap), at most
    FILTER_BITS / 32768 rows."""
    at = incoming.select(_place(keys).alias(_HASH))
    return at.groupBy(F.bitmap_bucket_number(_HASH).alias("_number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_HASH)).alias(_BITMAP))


def maybe_among(history: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The history rows whose keys may be among the incoming ones: all that
    are, and a few others.  The history is read in place."""
    f = F.broadcast(key_filter(incoming, keys))
    placed = history.withColumn(_HASH, _place(keys)).withColumn("_number", F.bitmap_bucket_number(_HASH))
    bit = F.bitmap_bit_position(_HASH)
    byte = F.conv(F.hex(F.substring(_BITMAP, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (bit % 8).cast("int")) == 1
    return placed.join(f, "_number").where(hit).select(*history.columns)


def recent(history: DataFrame, as_of: _dt.date | str, lookback_days: int, time_col: str = "timestamp") -> DataFrame:
    """History rows with ``time_col >= as_of - lookback_days`` (midnight)."""
    t = history.schema[time_col].dataType
    return history.filter(F.col(time_col) >= at_midnight(cutoff(as_of, lookback_days), t))


def dedup_source(incoming: DataFrame, history: DataFrame, *, as_of, lookback_days: int = 7, prefilter: bool = False) -> DataFrame:
    """Drop an incoming finding when the history holds the same
    (finding_type, source_ip) within the look-back.  A NULL source never
    matches, so such findings are kept; incoming rows are not compared with
    each other (as in the reference).  ``prefilter`` looks the history up in
    the filter first; it reads ``incoming`` twice, so give it stored rows."""
    keys = recent(history, as_of, lookback_days).select(*SOURCE_KEYS)
    keys = (maybe_among(keys, incoming, SOURCE_KEYS) if prefilter else keys).distinct()
    return incoming.join(keys, SOURCE_KEYS, "left_anti")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """SHA-256 of finding_type|source_ip|destination_ip|destination_hostname|username."""
    c = F.col
    return findings.withColumn("fingerprint", scoring.fingerprint(
        c("finding_type"), c("source_ip"), c("destination_ip"), c("destination_hostname"), c("username")))


def first_per_fingerprint(findings: DataFrame) -> DataFrame:
    """One finding per fingerprint: the earliest by ``FIRST_ORDER``.

    A minimum is a partial aggregate, so a fingerprint repeated a million
    times is reduced map-side (no window over a hot group)."""
    fp = findings if "fingerprint" in findings.columns else with_fingerprint(findings)
    order = [c for c in FIRST_ORDER if c in fp.columns]
    rest = [c for c in fp.columns if c != "fingerprint" and c not in order]
    # order first, then the other columns: one struct is key and value
    picked = fp.groupBy("fingerprint").agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return picked.select("fingerprint", "_f.*").select(fp.columns)


def dedup_fingerprint(incoming: DataFrame, history: DataFrame, *, as_of, lookback_days: int = 7,
                      time_col: str | None = None) -> DataFrame:
    """The intended fingerprint de-duplication: drop fingerprints
    stored within the look-back, and keep only the first of repeats within
    the batch.  The look-back is on ``created_at`` (when a finding was
    stored) when the history has it, so findings of a retrospective hunt,
    whose event times are old, are still recognised as repeats.  Reads
    ``incoming`` twice (filter and join): give it stored rows, as the job does."""
    time_col = time_col or ("created_at" if "created_at" in history.columns else "timestamp")
    # first of each fingerprint before the join: one row per key on both sides
    first = first_per_fingerprint(incoming)
    seen = with_fingerprint(recent(history, as_of, lookback_days, time_col)).select("fingerprint")
    return first.join(maybe_among(seen, first, ["fingerprint"]).distinct(), "fingerprint", "left_anti")
