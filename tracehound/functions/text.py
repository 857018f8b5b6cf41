"""Finding descriptions and raw_data JSON, built as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Description templates whose text must equal the reference's.
C2_DESCRIPTION = "Potential C2 beaconing detected: %d connections with %.1fs average interval (±%.1fs jitter) to %s:%s"
DNS_DESCRIPTION = "Potential DNS tunneling: %d queries with avg length %.0f chars to %s"
LATERAL_DESCRIPTION = "Potential lateral movement: Account '%s' accessed %d unique hosts in %d minutes from %s"
# Text a missing value prints as inside a description.
MISSING_TEXT = "None"
# ---------------------------------------------------------------------------


def shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING_TEXT))


def fixed(c: Column, digits: int) -> Column:
    """Round half away from zero before printing, so ``%.Nf`` never meets a tie."""
    return F.round(c, digits)


def c2_description(n: Column, avg_i: Column, sd_i: Column, dst: Column, port: Column) -> Column:
    return F.format_string(C2_DESCRIPTION, n, fixed(avg_i, 1), fixed(sd_i, 1), shown(dst), shown(port))


def dns_description(n: Column, avg_len: Column, domain: Column) -> Column:
    return F.format_string(DNS_DESCRIPTION, n, fixed(avg_len, 0), shown(domain))


def lateral_description(user: Column, hosts: Column, minutes: int, src: Column) -> Column:
    return F.format_string(LATERAL_DESCRIPTION, shown(user), hosts, F.lit(minutes), shown(src))


# JSON keeps NULL fields (as ``json.dumps`` does).
JSON_OPTIONS = {"ignoreNullFields": "false"}


def to_json(c: Column | str) -> Column:
    return F.to_json(c, JSON_OPTIONS)


def raw_json(**fields: Column) -> Column:
    """``to_json`` of a struct whose keys keep the given order."""
    return to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
