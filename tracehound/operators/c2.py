"""C2 beaconing: periodic connections from one source to one service.

Plan shape (the raw log goes through one exchange):

0. Busy pairs are found in a sample of the log: a map-side combined count, of
   which at most ``MAX_BUSY`` pairs are kept.  So what marks them in the log is
   a broadcast of proven size, never a join that shuffles the log.
1. ``(pair, time slice)`` — the connection log is hash-partitioned on the
   pair *and*, for busy pairs, a fixed-width time slice of the connection
   time, so one hot pair (say a third of all rows) is spread over
   ``range/slice`` tasks.  A burst of one pair within a slice is one task.
   Inside a slice ``lag`` gives the gaps; the slice is reduced to
   mergeable moments: gap count/sum/sum of squares (exact 64-bit integers),
   byte count/sum/sum of squares (exact) and the first/last connection time.
2. ``pair`` — one row per non-empty slice (for an ordinary pair: one row).
   ``lag`` over slices yields the gap that crosses each slice boundary; all
   sums are merged exactly.

Which pairs are sliced changes the spread over tasks only, not the result.
The result equals one ``lag`` over the whole pair followed by ``avg`` and
``stddev`` — without ever putting a whole pair into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracehound.functions import scoring, text
from tracehound.functions.timecols import epoch_seconds, floor_second, normalize_time, text_time

PAIR = ["source_ip", "destination_ip", "destination_port"]
HUNT = "c2_beaconing"
DEFAULT_SLICE_SECONDS = 300
SESSION_SLICE_SECONDS = 3600
# A pair with about this many connections or more is cut into time slices; any
# other is one slice, so the second exchange carries one row for it.  The
# result is the same for every value.
BUSY_PAIR_ROWS = 500_000
# The sample is taken so that a pair of BUSY_PAIR_ROWS has this many rows in it.
BUSY_SAMPLED = 2_000
# At most so many pairs are sliced, the busiest; any other one then has less
# than 1 / MAX_BUSY of the log.
MAX_BUSY = 10_000
# Gaps are non-negative and add up to last - first, so every sum of squared
# gaps is at most (last - first)^2: a long holds it for spans under ~95
# years.  Only the variance numerator n*S2 - S1^2 needs exact decimals.
_EXACT = "decimal(38,0)"
_NO_HOP = 1 << 62   # after the last hop
MOMENTS = ["n", "gn", "g1", "g2", "e_first", "e_last", "ts_first", "ts_last", "bn", "b1", "b2"]


def conn_pairs(conn_logs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rename the Zeek columns (id_orig_h -> source_ip, ...)."""
    df = normalize_time(conn_logs, "ts")
    return df.select(
        F.col("ts"),
        F.col("id_orig_h").alias("source_ip"),
        F.col("id_resp_h").alias("destination_ip"),
        F.col("id_resp_p").alias("destination_port"),
        F.col("orig_bytes"),
        *[F.col(f"`{k}`") for k in keep],
    )


def busy_pairs(pairs: DataFrame, keys: Sequence[str], busy_rows: int) -> DataFrame:
    """The keys of at most ``MAX_BUSY`` pairs with about ``busy_rows`` rows or
    more, by their rows in a sample."""
    rate = min(1.0, BUSY_SAMPLED / max(1, busy_rows))
    some = pairs.select(*keys) if rate == 1.0 else pairs.select(*keys).sample(False, rate, seed=1)
    n = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > busy_rows * rate)
    return n.orderBy(F.desc("_rows")).limit(MAX_BUSY).select(*keys)


def _sliced(pairs: DataFrame, keys: Sequence[str], slice_seconds: int, busy_rows: int | None) -> DataFrame:
    """Epoch second and slice of each row; slice 0 for all rows of a pair
    that is not busy (``busy_rows`` None: slice every pair)."""
    x = pairs.withColumn("_e", epoch_seconds("ts"))
    slice_ = F.floor(F.col("_e") / F.lit(slice_seconds))
    if busy_rows is None:
        return x.withColumn("_slice", slice_)
    busy = busy_pairs(pairs, keys, busy_rows).select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.lit(True).alias("_busy"))
    x = x.join(F.broadcast(busy), [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys], "left").drop(*[f"_b_{k}" for k in keys])
    return x.withColumn("_slice", F.when(F.col("_busy"), slice_).otherwise(F.lit(0).cast("long"))).drop("_busy")


def slice_moments(pairs: DataFrame, keys: Sequence[str], slice_seconds: int = DEFAULT_SLICE_SECONDS,
                  busy_rows: int | None = None) -> DataFrame:
    """Level 1: one row per (keys, slice) with mergeable moments.  The slices
    are summed as they come out of the sort that ``lag`` needs: a slice often
    is a single row, and a hash table would hold them all."""
    x = _sliced(pairs, keys, slice_seconds, busy_rows)
    w = Window.partitionBy(*keys, "_slice")
    x = x.withColumns({"_gap": F.col("_e") - F.lag("_e").over(w.orderBy("ts")), "_last": F.lead(F.lit(1)).over(w.orderBy("ts")).isNull()})
    total = lambda e: F.expr(e).over(w)
    x = x.withColumns({
        "n": total("count(1)"),
        "gn": total("count(_gap)"),
        "g1": F.coalesce(total("sum(_gap)"), F.lit(0)),
        "g2": F.coalesce(total("sum(_gap * _gap)"), F.lit(0)),
        "e_first": total("min(_e)"),
        "e_last": total("max(_e)"),
        "ts_first": total("min(ts)"),
        "ts_last": total("max(ts)"),
        "bn": total("count(orig_bytes)"),
        "b1": total(f"sum(CAST(orig_bytes AS {_EXACT}))"),
        "b2": total("sum(CAST(orig_bytes AS DECIMAL(19,0)) * CAST(orig_bytes AS DECIMAL(19,0)))"),
    })
    return x.where("_last").select(*keys, "_slice", *MOMENTS)


def with_edges(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gap crossing into each slice from the previous non-empty slice of
    the same keys."""
    w_ord = Window.partitionBy(*keys).orderBy("_slice")
    return slices.withColumns({
        "_prev_slice": F.lag("_slice").over(w_ord),
        "_edge": F.col("e_first") - F.lag("e_last").over(w_ord),
    })


# Level-2 merge, as SQL expressions over the slice rows.  All sums are exact
# integers, so neither the order of merging nor a far outlier in another
# window can change a spread.
_MERGE = [
    "sum(n) AS connection_count",
    "sum(gn) + count(_edge) AS _gaps",
    "sum(g1) + coalesce(sum(_edge), 0) AS _g1",
    "sum(g2) + coalesce(sum(_edge * _edge), 0) AS _g2",
    "sum(bn) AS _bn",
    f"CAST(sum(b1) AS {_EXACT}) AS _b1",
    f"CAST(sum(b2) AS {_EXACT}) AS _b2",
    "min(e_first) AS first_seen",
    "max(e_last) AS last_seen",
    "min(ts_first) AS first_ts",
    "max(ts_last) AS last_ts",
]
_MEAN = f"CAST(_b1 DIV _bn AS {_EXACT})"
_PROFILE = [
    "connection_count",
    "CASE WHEN _gaps > 0 THEN CAST(_g1 AS DOUBLE) / CAST(_gaps AS DOUBLE) END AS avg_interval",
    f"CASE WHEN _gaps > 1 THEN sqrt(CAST(CAST(_gaps AS {_EXACT}) * CAST(_g2 AS {_EXACT})"
    f" - CAST(_g1 AS {_EXACT}) * CAST(_g1 AS {_EXACT}) AS DOUBLE)"
    " / (CAST(_gaps AS DOUBLE) * CAST(_gaps - 1 AS DOUBLE))) END AS interval_stddev",
    "CASE WHEN _bn > 0 THEN CAST(_b1 AS DOUBLE) / CAST(_bn AS DOUBLE) END AS avg_bytes_sent",
    # squares about the integer c just below the mean (exact), then about the mean
    f"CASE WHEN _bn > 1 THEN sqrt(greatest(CAST(_b2 - 2 * {_MEAN} * _b1 + _bn * {_MEAN} * {_MEAN} AS DOUBLE)"
    f" - power(CAST(_b1 - _bn * {_MEAN} AS DOUBLE), 2) / _bn, 0.0) / (_bn - 1)) END AS bytes_sent_stddev",
    "first_seen",
    "last_seen",
    "first_ts",
    "last_ts",
]


def merge_moments(edged: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Level 2: merge slice moments to one profile row per keys."""
    agg = edged.groupBy(*keys).agg(*[F.expr(e) for e in _MERGE], *[F.first(k).alias(k) for k in keep])
    return profile_of_moments(agg, [*keys, *keep])


def hop_moments(slices: DataFrame, keys: Sequence[str], slice_seconds: int, hop_seconds: int) -> DataFrame:
    """The slices of each hop (``_h``, a multiple of the slice) merged to one
    row, with the gap that crosses into it from the keys' previous hop
    (``_edge``, ``_prev_h``).  All of it follows one sort."""
    across, inside = Window.partitionBy(*keys).orderBy("_h", "_slice"), Window.partitionBy(*keys, "_h")
    x = slices.withColumn("_h", F.floor(F.col("_slice") * F.lit(slice_seconds) / F.lit(hop_seconds)))
    x = x.withColumns({"_prev_h": F.lag("_h").over(across), "_edge": F.col("e_first") - F.lag("e_last").over(across)})
    x = x.withColumn("_in", F.when(F.col("_prev_h") == F.col("_h"), F.col("_edge")))
    total = lambda e: F.expr(e).over(inside)
    x = x.withColumns({
        "n": total("sum(n)"),
        "gn": total("sum(gn)") + total("count(_in)"),
        "g1": total("sum(g1)") + F.coalesce(total("sum(_in)"), F.lit(0)),
        "g2": total("sum(g2)") + F.coalesce(total("sum(_in * _in)"), F.lit(0)),
        "e_first": total("min(e_first)"),
        "e_last": total("max(e_last)"),
        "ts_first": total("min(ts_first)"),
        "ts_last": total("max(ts_last)"),
        "bn": total("sum(bn)"),
        "b1": total("sum(b1)"),
        "b2": total("sum(b2)"),
    })
    return x.where("_prev_h IS NULL OR _prev_h <> _h").select(*keys, "_h", "_prev_h", "_edge", *MOMENTS)


def sliding_moments(hops: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The merged moments of every window of ``k`` hops that holds one.

    What a window holds changes only where a hop comes in (window ``_h - k + 1``)
    or has gone (window ``_h + 1``), so a hop gives at most two rows, each for the
    windows ``_from`` to ``_to``.  Their sums are over at most ``k`` hop rows of
    the sorted keys: no row is copied per window and nothing is hashed."""
    order = Window.partitionBy(*keys).orderBy("_h")
    # a gap between hops that no window holds both of is never used (nor squared)
    x = hops.withColumns({"_edge": F.when(F.col("_h") - F.col("_prev_h") < k, F.col("_edge")),
                          "_next_h": F.coalesce(F.lead("_h").over(order), F.lit(_NO_HOP))})

    def merged(frame: WindowSpec, start: Column, used: Column) -> Column:
        total = lambda e: F.expr(e).over(frame)
        # the first hop's gap comes from before the window
        before = F.coalesce(total("first(_edge)"), F.lit(0))
        return F.when(used, F.struct(
            start.alias("_from"),
            F.least(total("min(_h)"), total("max(_next_h)") - k).alias("_to"),
            total("sum(n)").alias("connection_count"),
            (total("sum(gn)") + total("count(_edge)") - F.when(total("first(_edge)").isNull(), 0).otherwise(1)).alias("_gaps"),
            (total("sum(g1)") + F.coalesce(total("sum(_edge)"), F.lit(0)) - before).alias("_g1"),
            (total("sum(g2)") + F.coalesce(total("sum(_edge * _edge)"), F.lit(0)) - before * before).alias("_g2"),
            total("sum(bn)").alias("_bn"),
            total("sum(b1)").cast(_EXACT).alias("_b1"),
            total("sum(b2)").cast(_EXACT).alias("_b2"),
            total("min(e_first)").alias("first_seen"),
            total("max(e_last)").alias("last_seen"),
            total("min(ts_first)").alias("first_ts"),
            total("max(ts_last)").alias("last_ts"),
        ))

    into, gone = order.rangeBetween(1 - k, 0), order.rangeBetween(1, k)
    # nothing is left once the hop has gone (no last hop), or another one comes in with the same window
    x = x.withColumns({"_into": merged(into, F.col("_h") - (k - 1), F.lit(True)),
                       "_gone": merged(gone, F.col("_h") + 1, F.expr("max(_h)").over(gone) < F.col("_h") + k)})
    x = x.select(*keys, F.explode(F.array("_into", "_gone")).alias("_m"))
    return x.where("_m IS NOT NULL").select(*keys, "_m.*")


def profile_of_moments(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The profile of fully merged moments (means and spreads)."""
    return merged.selectExpr(*[f"`{k}`" for k in keys], *_PROFILE)


def profile_from_pairs(pairs: DataFrame, by: Sequence[str] = (), slice_seconds: int = DEFAULT_SLICE_SECONDS,
                       busy_rows: int | None = BUSY_PAIR_ROWS) -> DataFrame:
    keys = [*by, *PAIR]
    edged = with_edges(slice_moments(pairs, keys, slice_seconds, busy_rows), keys)
    return merge_moments(edged, keys)


def add_extensions(profile: DataFrame) -> DataFrame:
    """E2 byte-pattern similarity (1 - sd/mean of bytes) and E4 session
    length (last - first connection, seconds)."""
    return profile.withColumns({
        "byte_similarity": F.lit(1.0) - F.try_divide(F.col("bytes_sent_stddev"), F.col("avg_bytes_sent")),
        "session_seconds": F.col("last_seen") - F.col("first_seen"),
    })


def c2_beacon_profile(conn_logs: DataFrame, *, slice_seconds: int = DEFAULT_SLICE_SECONDS,
                      busy_rows: int | None = BUSY_PAIR_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """A1: per (source_ip, destination_ip, destination_port): connection
    count, interval mean/stddev, bytes mean/stddev, first/last epoch.  ``by``
    names further key columns of the log."""
    return add_extensions(profile_from_pairs(conn_pairs(conn_logs, by), by, slice_seconds, busy_rows))


def pair_sessions(conn_logs: DataFrame, *, max_gap: str = "30 minutes", slice_seconds: int = SESSION_SLICE_SECONDS,
                  busy_rows: int | None = BUSY_PAIR_ROWS) -> DataFrame:
    """Sessions of a pair: runs of connections no further apart than
    ``max_gap``, with their length, connections and bytes.

    Two levels, as for the profile: sessions inside (pair, time slice), then
    sessions that meet across slice edges are joined.  The raw log moves once,
    a busy pair's rows by slice; the second exchange carries sessions, of which
    a pair has at most one per ``max_gap`` and slice."""
    x = _sliced(conn_pairs(conn_logs).where("ts IS NOT NULL"), PAIR, slice_seconds, busy_rows)
    gap = F.expr(f"INTERVAL {max_gap}")
    inside = Window.partitionBy(*PAIR, "_slice").orderBy("ts")
    x = x.withColumn("_new", F.when(F.col("ts") - F.lag("ts").over(inside) <= gap, 0).otherwise(1))
    x = x.withColumn("_k", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = x.groupBy(*PAIR, "_slice", "_k").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.sum("orig_bytes").alias("bytes"))
    across = Window.partitionBy(*PAIR).orderBy("_slice", "_k")
    part = part.withColumn("_new", F.when(F.col("a") - F.lag("b").over(across) <= gap, 0).otherwise(1))
    part = part.withColumn("_s", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = part.groupBy(*PAIR, "_s").agg(
        F.sum("n").alias("connection_count"), F.min("a").alias("session_start"), F.max("b").alias("session_end"),
        F.sum("bytes").cast("long").alias("bytes_sent"))
    return whole.select(*PAIR, "session_start", "session_end",
                        (epoch_seconds("session_end") - epoch_seconds("session_start")).alias("session_seconds"), "connection_count", "bytes_sent")


def c2_intervals(conn_logs: DataFrame, *, slice_seconds: int = DEFAULT_SLICE_SECONDS,
                 busy_rows: int | None = BUSY_PAIR_ROWS) -> DataFrame:
    """Per connection, seconds since the previous connection of the
    same pair (NULL for the first), computed slice by slice.

    ``lag`` inside (pair, slice) gives every row but a slice's first.  The
    first and last rows of the slices (two per slice, so at most two for an
    ordinary pair) are stitched over the pair: before a slice's first row comes
    the last row of the slice before.  Both branches read the one exchange of
    the log; nothing is joined to it.  Rows of equal time give equal rows
    whichever of them is first."""
    x = _sliced(conn_pairs(conn_logs), PAIR, slice_seconds, busy_rows)
    w = Window.partitionBy(*PAIR, "_slice").orderBy("ts")
    x = x.select(*PAIR, "ts", "_e", "_slice").withColumns({
        "_gap": F.col("_e") - F.lag("_e").over(w), "_first": F.lag(F.lit(1)).over(w).isNull(), "_last": F.lead(F.lit(1)).over(w).isNull()})
    inside = x.where(~F.col("_first")).select(*PAIR, "ts", F.col("_gap").alias("interval_seconds"))
    edges = x.where(F.col("_first") | F.col("_last"))
    # of a slice with two rows or more, the first one comes before the last one
    across = Window.partitionBy(*PAIR).orderBy("_slice", F.col("_first").desc())
    edges = edges.withColumn("interval_seconds", F.col("_e") - F.lag("_e").over(across))
    return inside.unionByName(edges.where("_first").select(*PAIR, "ts", "interval_seconds"))


def beacon_candidates(profile: DataFrame, *, min_connections: int, jitter_threshold: float,
                      byte_similarity_threshold: float | None = None) -> DataFrame:
    """Enough connections, low jitter, a positive mean gap."""
    cond = ((F.col("connection_count") >= min_connections)
            & (F.col("interval_stddev") < jitter_threshold)
            & F.col("avg_interval").isNotNull()
            & (F.col("avg_interval") > 0))
    if byte_similarity_threshold is not None:   # E2, documented by the reference but not applied there
        cond = cond & (F.col("byte_similarity") >= byte_similarity_threshold)
    return profile.filter(cond)


def score_beacons(cands: DataFrame, *, min_score: float = 50, null_score: str = "reference") -> DataFrame:
    """F3 + P7: score, keep score > min_score (strict, on the raw score)."""
    s = scoring.c2_score(F.col("connection_count"), F.col("avg_interval"), F.col("interval_stddev"),
                         F.col("avg_bytes_sent"), F.col("bytes_sent_stddev"), null_score)
    return cands.withColumn("_score", s).filter(F.col("_score") > min_score)


def beacon_findings(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The common finding columns."""
    first = floor_second(F.col("first_ts"))
    last = floor_second(F.col("last_ts"))
    raw = text.raw_json(
        connection_count=F.col("connection_count"),
        avg_interval_seconds=F.col("avg_interval"),
        interval_stddev=F.col("interval_stddev"),
        avg_bytes_sent=F.coalesce(F.col("avg_bytes_sent").cast("long"), F.lit(0).cast("long")),
        first_seen=text_time(first, with_fraction=False),
        last_seen=text_time(last, with_fraction=False),
    )
    return scored.select(
        *by,
        F.lit(HUNT).alias("hunt_name"),
        F.when(F.col("_score") > 80, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.lit(HUNT).alias("finding_type"),
        F.col("source_ip"),
        F.col("destination_ip"),
        F.lit(None).cast("string").alias("destination_hostname"),
        F.lit(None).cast("string").alias("username"),
        first.alias("timestamp"),
        F.round(F.col("_score"), 2).alias("confidence_score"),
        text.c2_description(F.col("connection_count"), F.col("avg_interval"), F.col("interval_stddev"),
                            F.col("destination_ip"), F.col("destination_port")).alias("description"),
        raw.alias("raw_data"),
    )


def c2_beaconing(conn_logs: DataFrame, *, min_connections: int = 10, jitter_threshold: float = 300,
                 byte_similarity_threshold: float | None = None, min_score: float = 50,
                 null_score: str = "reference", slice_seconds: int = DEFAULT_SLICE_SECONDS,
                 busy_rows: int | None = BUSY_PAIR_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """The C2 beaconing hunt: connection log -> findings, for each value of
    the ``by`` columns apart."""
    prof = c2_beacon_profile(conn_logs, slice_seconds=slice_seconds, busy_rows=busy_rows, by=by)
    cands = beacon_candidates(prof, min_connections=min_connections, jitter_threshold=jitter_threshold,
                              byte_similarity_threshold=byte_similarity_threshold)
    return beacon_findings(score_beacons(cands, min_score=min_score, null_score=null_score), by=by)
