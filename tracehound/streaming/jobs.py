"""Structured Streaming versions of the hunts.

Each takes a streaming DataFrame of raw log rows and returns a streaming
DataFrame of findings; the caller picks the sink and trigger
(``trigger(availableNow=True)`` over files in tests).  The batch operators
supply the scoring and projection, so batch and stream stay one
definition.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracehound.functions import scoring
from tracehound.functions.timecols import epoch_seconds, ntz_as_utc
from tracehound.operators import c2, dedup, dns, ioc, lateral
from tracehound.sources import manifest, sinks


def _event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; an NTZ wall clock is taken as UTC."""
    t = df.schema[col].dataType.simpleString()
    if t == "timestamp_ntz":
        return df.withColumn(col, ntz_as_utc(col))
    if t == "string":
        return df.withColumn(col, F.to_timestamp(col))
    return df


# --- T4 ------------------------------------------------------------------------
def streaming_lateral(win_stream: DataFrame, *, time_window_minutes: int = 60, min_hosts: int = 5,
                      privileged_accounts: Sequence[str] = scoring.PRIVILEGED_PATTERNS, min_score: float = 50,
                      watermark: str = "10 minutes", time_col: str = "@timestamp") -> DataFrame:
    """Tumbling ``time_window_minutes`` windows (epoch-aligned, the same
    buckets as the batch hunt); late rows beyond the watermark are dropped."""
    ev = _event_time(lateral.logon_events(win_stream, time_col=time_col), "timestamp").withWatermark("timestamp", watermark)
    span = f"{time_window_minutes} minutes"
    # two chained stateful aggregates: the state of the first is one row per
    # host and window, also for a hot account; the second gets closed windows
    per_host = ev.groupBy(F.window("timestamp", span).alias("win"), "username", "source_ip", "destination_host").agg(
        F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    closed = per_host.withColumn("at", F.window_time("win"))
    prof = lateral.hosts_merged(closed, [F.window("at", span), "username", "source_ip"])
    return lateral.movement_findings(prof, time_window_minutes=time_window_minutes, min_hosts=min_hosts,
                                     privileged_accounts=privileged_accounts, min_score=min_score)


# --- T5 ------------------------------------------------------------------------
def streaming_dns(dns_stream: DataFrame, *, min_query_length: int = 50, min_query_count: int = 100,
                  min_score: float = 50, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Per source and query name, per daily window."""
    q = _event_time(dns.dns_queries(dns_stream), "timestamp").withWatermark("timestamp", watermark)
    prof = dns.profile_queries(q, by=[F.window("timestamp", window).alias("win")])
    return dns.tunneling_findings(prof.drop("win"), min_query_length=min_query_length,
                                  min_query_count=min_query_count, min_score=min_score)


# --- T6 ------------------------------------------------------------------------
def streaming_c2_slices(conn_stream: DataFrame, *, watermark: str = "10 minutes",
                        slice_seconds: int = c2.DEFAULT_SLICE_SECONDS) -> DataFrame:
    """The level-1 moments of the batch hunt, one row per (pair, time slice),
    in append mode: a slice comes out once, when the watermark has passed it.

    Rows may arrive in any order within the watermark; the slice's times are
    sorted when it closes, so gaps never depend on arrival.  State is the open
    slices only; what a slice holds is bounded by one pair's burst in it."""
    ev = _event_time(c2.conn_pairs(conn_stream), "ts")
    t = F.array_sort(F.collect_list(epoch_seconds("ts")))
    exact = "decimal(38,0)"
    b = F.col("orig_bytes").cast("decimal(19,0)")
    agg = ev.withWatermark("ts", watermark).groupBy(F.window("ts", f"{slice_seconds} seconds").alias("_win"), *c2.PAIR).agg(
        t.alias("_t"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"),
        F.count("orig_bytes").alias("bn"), F.sum(b.cast(exact)).alias("b1"), F.sum((b * b).cast(exact)).alias("b2"))
    gaps = F.zip_with(F.slice("_t", 2, F.size("_t")), F.slice("_t", 1, F.size("_t") - 1), lambda later, earlier: later - earlier)
    return agg.select(
        *c2.PAIR, F.window_time("_win").alias("closes"), F.floor(epoch_seconds("_win.start") / F.lit(slice_seconds)).alias("_slice"), "n",
        (F.col("n") - 1).alias("gn"), (F.element_at("_t", -1) - F.element_at("_t", 1)).alias("g1"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g * g).alias("g2"),
        F.element_at("_t", 1).alias("e_first"), F.element_at("_t", -1).alias("e_last"), "ts_first", "ts_last", "bn", "b1", "b2")


def c2_profile_from_slices(slices: DataFrame) -> DataFrame:
    """Level 2 of the batch hunt over closed slices."""
    return c2.add_extensions(c2.merge_moments(c2.with_edges(slices, c2.PAIR), c2.PAIR))


def c2_from_slices(slices: DataFrame, *, min_connections: int = 10, jitter_threshold: float = 300,
                   byte_similarity_threshold: float | None = None, min_score: float = 50, null_score: str = "reference") -> DataFrame:
    """C2 findings over closed slices: those of the batch hunt on their rows."""
    cands = c2.beacon_candidates(c2_profile_from_slices(slices), min_connections=min_connections, jitter_threshold=jitter_threshold,
                                 byte_similarity_threshold=byte_similarity_threshold)
    return c2.beacon_findings(c2.score_beacons(cands, min_score=min_score, null_score=null_score))


#: What is known of a pair: the merged moments of its closed slices (times in
#: microseconds, the state has no zones) and the last of these slices.
PAIR_STATE = ("connection_count bigint, _gaps bigint, _g1 bigint, _g2 bigint, _bn bigint, _b1 decimal(38,0), _b2 decimal(38,0), "
              "first_seen bigint, last_seen bigint, first_us bigint, last_us bigint, _slice bigint")
_STATE_COLUMNS = [c.split()[0] for c in PAIR_STATE.split(", ")]
PAIR_TYPES = "source_ip string, destination_ip string, destination_port int"


def add_slice(held: dict | None, new: dict) -> dict:
    """The moments of a pair and those of a later slice of it: sums add, and
    the gap between the two is one more gap."""
    add = lambda a, b: a if b is None else int(b) + int(a or 0)
    if held is None:
        return {"connection_count": new["n"], "_gaps": new["gn"], "_g1": new["g1"], "_g2": new["g2"], "_bn": new["bn"], "_b1": add(None, new["b1"]),
                "_b2": add(None, new["b2"]), "first_seen": new["e_first"], "last_seen": new["e_last"], "first_us": new["first_us"], "last_us": new["last_us"],
                "_slice": new["_slice"]}
    edge = int(new["e_first"]) - int(held["last_seen"])
    return held | {
        "connection_count": held["connection_count"] + new["n"], "_gaps": held["_gaps"] + new["gn"] + 1, "_g1": held["_g1"] + new["g1"] + edge,
        "_g2": held["_g2"] + new["g2"] + edge * edge, "_bn": held["_bn"] + new["bn"], "_b1": add(held["_b1"], new["b1"]), "_b2": add(held["_b2"], new["b2"]),
        "last_seen": new["e_last"], "last_us": new["last_us"], "_slice": new["_slice"]}


class PairMoments(StatefulProcessor):
    """One row of moments per pair, to which its closed slices are added."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", PAIR_STATE)

    def _forget_at(self, held: dict) -> int:
        return held["last_us"] // 1000 + self.idle_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = held = dict(zip(_STATE_COLUMNS, self.state.get())) if self.state.exists() else None
        for new in sorted((r.asDict() for r in rows), key=lambda r: r["_slice"]):
            held = add_slice(held, new)
        for c in ("_b1", "_b2"):
            held[c] = None if held[c] is None else decimal.Decimal(int(held[c]))
        self.state.update(tuple(held[c] for c in _STATE_COLUMNS))
        if before:
            self.handle.deleteTimer(self._forget_at(before))
        self.handle.registerTimer(self._forget_at(held))
        yield Row(**dict(zip(c2.PAIR, key)), **{c: held[c] for c in _STATE_COLUMNS})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaming_c2_pairs(conn_stream: DataFrame, *, watermark: str = "10 minutes", slice_seconds: int = c2.DEFAULT_SLICE_SECONDS,
                       idle_days: int = 30) -> DataFrame:
    """The merged moments of each pair, as one row per batch in which a slice
    of it closed (``PAIR_STATE``; a pair's row with the highest ``_slice`` is
    its latest).

    A second stateful operator after the slices keeps one row of moments per
    pair in the state store, which versions it by batch.  Slices of a pair
    close in order, so each is added to what is held, and a batch costs the
    pairs it touches, whatever came before.  A pair without a connection for
    ``idle_days`` is forgotten and would start anew.  Needs the RocksDB state
    store (``session.STREAM_SETTINGS``)."""
    slices = streaming_c2_slices(conn_stream, watermark=watermark, slice_seconds=slice_seconds)
    slices = slices.withColumns({"first_us": F.unix_micros("ts_first"), "last_us": F.unix_micros("ts_last")}).drop("ts_first", "ts_last")
    types = ", ".join(f"{k} {slices.schema[k].dataType.simpleString()}" for k in c2.PAIR)
    return slices.groupBy(*c2.PAIR).transformWithState(PairMoments(idle_days * 86_400_000), f"{types}, {PAIR_STATE}", "Append", "EventTime")


def c2_upkeep(base_path: str):
    """foreachBatch function for ``streaming_c2_pairs``: store the batch's
    rows, committed under its id; a replayed batch replaces its own."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        manifest.write(batch, base_path, batch_id)
    return apply


def _pair_schema(pair_types: str) -> str:
    return f"{pair_types}, {PAIR_STATE}"


def latest_pairs(rows: DataFrame) -> DataFrame:
    """Each pair's row with the highest slice."""
    held = F.max_by(F.struct(*_STATE_COLUMNS), "_slice").alias("_s")
    return rows.groupBy(*c2.PAIR).agg(held).select(*c2.PAIR, "_s.*")


def read_c2_pairs(spark: SparkSession, base_path: str, pair_types: str = PAIR_TYPES) -> DataFrame:
    """The stored state of the C2 stream: one profile per pair."""
    rows = latest_pairs(manifest.read(spark, base_path, _pair_schema(pair_types)))
    times = {"first_ts": F.timestamp_micros("first_us"), "last_ts": F.timestamp_micros("last_us")}
    return c2.add_extensions(c2.profile_of_moments(rows.withColumns(times), c2.PAIR))


def latest_c2_findings(spark: SparkSession, base_path: str, *, pair_types: str = PAIR_TYPES, min_connections: int = 10, jitter_threshold: float = 300,
                       byte_similarity_threshold: float | None = None, min_score: float = 50, null_score: str = "reference") -> DataFrame:
    """The finding of each pair as of its last closed slice: at most one, and
    those of the batch hunt on the rows seen so far."""
    cands = c2.beacon_candidates(read_c2_pairs(spark, base_path, pair_types), min_connections=min_connections, jitter_threshold=jitter_threshold,
                                 byte_similarity_threshold=byte_similarity_threshold)
    return c2.beacon_findings(c2.score_beacons(cands, min_score=min_score, null_score=null_score))


def compact_c2_pairs(spark: SparkSession, base_path: str, pair_types: str = PAIR_TYPES) -> None:
    """Fold the stored batches into one row per pair."""
    manifest.compact(spark, base_path, _pair_schema(pair_types), latest_pairs)


# --- T7 ------------------------------------------------------------------------
def streaming_dedup(findings_stream: DataFrame, watermark: str = "7 days", time_col: str = "created_at") -> DataFrame:
    """Drop repeats of a fingerprint while its first copy is within the
    watermark (state is bounded by the watermark).  The watermark is on when a
    finding was made, as in the batch look-back: the findings of a hunt over
    old logs have old event times but are not late."""
    f = _event_time(dedup.with_fingerprint(findings_stream), time_col)
    return f.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["fingerprint"])


def ioc_upkeep(base_path: str):
    """foreachBatch function: store each micro-batch's mergeable IOC roll-up
    under its batch id (``sinks.read_iocs`` merges them).  A replayed batch
    replaces its own roll-up."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        sinks.write_iocs(ioc.stored_partial(batch), base_path, batch_id)
    return apply


def run_available_now(df: DataFrame, name: str, *, sink: str = "parquet", path: str | None = None,
                      output_mode: str = "append", checkpoint: str | None = None, foreach_batch=None):
    """Process everything available once and stop (``availableNow``).

    The checkpoint goes under the shared folder the cluster names in
    ``spark.checkpoint.dir`` unless one is given, so a restarted job resumes
    from its last committed batch."""
    from tracehound.session import checkpoint_dir
    ck = checkpoint or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", ck).trigger(availableNow=True)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    elif sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink).option("path", path)
    q = w.start()
    q.awaitTermination()
    return q
