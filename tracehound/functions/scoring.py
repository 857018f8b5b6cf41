"""Scoring, severity and matching expressions (all native, no Python UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for equal results.
# Severity levels, highest first; the result-table enum order is
# critical, high, medium, low, info.
SEVERITY_LEVELS = ["critical", "high", "medium", "low", "info"]
# Default privileged-account name patterns of the lateral movement hunt.
PRIVILEGED_PATTERNS = ["admin", "svc", "service"]
# Windows logon event codes the lateral movement hunt keeps.
LOGON_EVENT_CODES = ["4624", "4625", "4648"]
# Finding statuses of the result table.
FINDING_STATUSES = ["new", "investigating", "confirmed", "false_positive", "resolved"]
# ---------------------------------------------------------------------------


def severity_rank(col: Column | str) -> Column:
    """critical=4 … info=0; unknown text ranks -1 (NULL stays NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, level in enumerate(SEVERITY_LEVELS):
        expr = expr.when(c == level, F.lit(len(SEVERITY_LEVELS) - 1 - i))
    return expr.otherwise(F.lit(-1))


def severity_from_rank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for i, level in enumerate(SEVERITY_LEVELS):
        expr = expr.when(c == len(SEVERITY_LEVELS) - 1 - i, F.lit(level))
    return expr


def ratio_term(sd: Column, mean: Column, weight: float) -> Column:
    """(1 - sd/mean) * weight; NULL when mean is 0 or NULL (never raises)."""
    return (F.lit(1.0) - F.try_divide(sd, mean)) * F.lit(weight)


def c2_score(n: Column, avg_i: Column, sd_i: Column, avg_b: Column, sd_b: Column,
             null_score: str = "reference") -> Column:
    """least(100, n/10*30 + regularity*40 + byte consistency*30).

    ``least`` ignores NULL, so with ``null_score="reference"`` a missing term
    (no bytes, one value, zero mean) makes the score 100.  ``"skip_term"``
    counts a missing term as 0 instead."""
    freq = n / F.lit(10.0) * F.lit(30)
    reg = ratio_term(sd_i, avg_i, 40)
    byt = ratio_term(sd_b, avg_b, 30)
    if null_score == "skip_term":
        reg, byt = F.coalesce(reg, F.lit(0.0)), F.coalesce(byt, F.lit(0.0))
    elif null_score != "reference":
        raise ValueError(f"null_score must be 'reference' or 'skip_term', not {null_score!r}")
    return F.least(F.lit(100.0), freq + reg + byt)


def dns_score(avg_len: Column, n: Column, avg_labels: Column) -> Column:
    return F.least(
        F.lit(100.0),
        avg_len / F.lit(100.0) * F.lit(40) + n / F.lit(1000.0) * F.lit(40) + avg_labels / F.lit(10.0) * F.lit(20),
    )


def lateral_score(hosts: Column, attempts: Column, privileged: Column) -> Column:
    return F.least(
        F.lit(100.0),
        hosts / F.lit(10.0) * F.lit(50)
        + attempts / F.lit(20.0) * F.lit(30)
        + F.when(privileged, F.lit(20)).otherwise(F.lit(0)),
    )


def check_patterns(patterns: Sequence[str] | str) -> list[str]:
    """A bare string would match single characters; demand a list."""
    if isinstance(patterns, str) or not all(isinstance(p, str) for p in patterns):
        raise TypeError("privileged_accounts must be a list of strings")
    return [p.lower() for p in patterns]


def is_privileged(username: Column | str, patterns: Sequence[str] = PRIVILEGED_PATTERNS) -> Column:
    """NULL name is not privileged; otherwise the lower-cased name contains
    any (lower-cased) pattern."""
    u = F.lower(F.col(username) if isinstance(username, str) else username)
    pats = check_patterns(patterns)
    if not pats:
        return F.lit(False)
    hit = None
    for p in pats:
        term = u.contains(F.lit(p))
        hit = term if hit is None else hit | term
    return F.coalesce(hit, F.lit(False))


def label_count(q: Column) -> Column:
    """Number of dot-separated labels (same as size(split(q, '.')) for
    non-NULL text) without building an array."""
    return F.length(q) - F.length(F.replace(q, F.lit("."), F.lit(""))) + F.lit(1)


def fingerprint(finding_type: Column, source_ip: Column, destination_ip: Column,
                destination_hostname: Column, username: Column) -> Column:
    """SHA-256 of the five identity fields joined by '|'; a missing field
    is the empty string (coalesce keeps field positions stable)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in
             (finding_type, source_ip, destination_ip, destination_hostname, username)]
    return F.sha2(F.concat_ws("|", *parts), 256)
