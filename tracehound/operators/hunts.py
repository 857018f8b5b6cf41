"""The hunt registry and the campaign (all hunts over one range).

A hunt is a function ``(logs: DataFrame, **params) -> findings DataFrame``
registered with the name of the log it reads.  New hunts register the
same way; the campaign is a ``unionByName`` of every hunt's findings, so
it stays one lazy plan.

A hunt whose function takes ``by`` is keyed: given names of log columns, it
hunts each of their values apart and returns them with the findings.  Sweeps
then compute all their runs in one pass over the log.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scoring import LOGON_EVENT_CODES as LOGON_CODES
from tracehound.operators import c2, dns, lateral

# The finding columns every hunt emits, in order.
FINDING_COLUMNS = [
    "hunt_name", "severity", "finding_type", "source_ip", "destination_ip", "destination_hostname",
    "username", "timestamp", "confidence_score", "description", "raw_data",
]


@dataclass(frozen=True)
class Hunt:
    name: str
    source: str                                   # which log it reads
    run: Callable[..., DataFrame]                 # (logs, **params) -> findings
    records: Callable[[DataFrame], DataFrame]     # rows it analyses (A4)
    # the raw rows it analyses, same columns (pushed into the scan); counting
    # them in the run's own pass gives records_analyzed without a second scan
    scope: Callable[[DataFrame], DataFrame] = lambda logs: logs
    version: str = "1.0"
    description: str = ""
    time_col: str = "ts"                          # event time of its log

    @property
    def keyed(self) -> bool:
        """Whether the function takes ``by``."""
        return "by" in inspect.signature(self.run).parameters

    def run_by(self, logs: DataFrame, by: Sequence[str], **params) -> DataFrame:
        """The hunt for each value of the log columns ``by`` apart; a keyed
        hunt whose findings lack them breaks its contract."""
        found = self.run(logs, by=list(by), **params)
        if absent := [c for c in by if c not in found.columns]:
            raise ValueError(f"hunt {self.name} takes by but returns no {absent}")
        return found


REGISTRY: dict[str, Hunt] = {}


def register(h: Hunt) -> Hunt:
    REGISTRY[h.name] = h
    return h


register(Hunt("c2_beaconing", "conn_logs", c2.c2_beaconing, lambda logs: logs,
              description="Regular check-ins from one host to one service, as malware makes to its controller"))
register(Hunt("dns_tunneling", "dns_logs", dns.dns_tunneling, lambda logs: logs,
              description="Long, many or deeply nested query names that carry data out over DNS"))
register(Hunt("lateral_movement", "win_security", lateral.lateral_movement, lateral.logon_events,
              scope=lambda logs: logs.filter(F.col("event_code").cast("string").isin(*LOGON_CODES)),
              description="One account logging on to many hosts within a short time", time_col="@timestamp"))


def get(name: str) -> Hunt:
    if name not in REGISTRY:
        raise ValueError(f"Unknown hunt: {name}. Available: {list(REGISTRY)}")
    return REGISTRY[name]


def run_hunt(name: str, inputs: Mapping[str, DataFrame], **params) -> DataFrame:
    h = get(name)
    return h.run(inputs[h.source], **params)


def chosen(inputs: Mapping[str, object], names: list[str] | None = None) -> list[Hunt]:
    """The hunts to run: ``names``, or all registered.  A hunt whose log is
    not given is an error, never skipped; leave it out by ``names``."""
    picked = [get(n) for n in (names or REGISTRY)]
    absent = {h.name: h.source for h in picked if h.source not in inputs}
    if absent:
        raise ValueError(f"no log for these hunts (hunt: log): {absent}")
    return picked


def all_hunts(inputs: Mapping[str, DataFrame], params: Mapping[str, Mapping] | None = None,
              names: list[str] | None = None) -> DataFrame:
    """Every registered hunt (or those of ``names``), unioned by name."""
    params = params or {}
    parts = [h.run(inputs[h.source], **dict(params.get(h.name, {}))).select(*FINDING_COLUMNS) for h in chosen(inputs, names)]
    return reduce(DataFrame.unionByName, parts)


def records_analyzed(inputs: Mapping[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """A4: rows each hunt analyses (c2/dns: all rows in range, lateral:
    logon events only) — one global partial aggregate per hunt."""
    parts = [h.records(inputs[h.source]).agg(F.count(F.lit(1)).alias("records_analyzed"))
             .select(F.lit(h.name).alias("hunt_name"), "records_analyzed") for h in chosen(inputs, names)]
    return reduce(DataFrame.unionByName, parts)
