"""Time expressions.

Event times arrive as TIMESTAMP, TIMESTAMP_NTZ or ISO-8601 strings.  All
arithmetic is done on whole epoch seconds (``unix_timestamp`` treats an
NTZ wall clock as UTC, so NTZ inputs never depend on the session zone) and
output times keep the input's own type.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_time(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """Make ``name`` a timestamp column (strings are parsed as ISO-8601;
    a trailing ``Z`` means UTC)."""
    alias = alias or name
    dtype = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        col = F.to_timestamp(col)
    elif isinstance(dtype, T.DateType):
        col = col.cast("timestamp_ntz")
    elif alias == name:
        return df       # as it is; an alias would keep exchanges from being reused
    return df.withColumn(alias, col)


def epoch_seconds(col: Column | str) -> Column:
    """Whole seconds since 1970 (floors sub-second precision)."""
    return F.unix_timestamp(F.col(col) if isinstance(col, str) else col)


def floor_second(col: Column | str) -> Column:
    """Drop the sub-second part of a timestamp, keeping its type."""
    c = F.col(col) if isinstance(col, str) else col
    frac = F.date_part(F.lit("SECOND"), c) - F.second(c)
    return c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), frac)


def at_midnight(day: _dt.date | str, dtype: T.DataType) -> Column:
    """Midnight of ``day`` as a literal of the column's own timestamp type,
    so a cutoff compares without casting the column (keeps pushdown)."""
    if isinstance(day, str):
        day = _dt.date.fromisoformat(day)
    lit = F.lit(day)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return lit.cast(dtype)
    return lit


def as_date(day: _dt.date | str) -> _dt.date:
    return _dt.date.fromisoformat(day) if isinstance(day, str) else day


def cutoff(as_of: _dt.date | str, days: int) -> _dt.date:
    """The first day of an ``days``-long look-back ending at ``as_of``."""
    return as_date(as_of) - _dt.timedelta(days=days)


def text_time(col: Column | str, with_fraction: bool = True) -> Column:
    """Render a time as text; whole-second form for epoch-derived times."""
    c = F.col(col) if isinstance(col, str) else col
    if with_fraction:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def epoch_to_time(seconds: Column, dtype: T.DataType) -> Column:
    """Epoch seconds back to a time of ``dtype`` (NTZ: UTC wall clock)."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.timestamp_seconds(seconds)


def epoch_micros(col: Column | str) -> Column:
    """Microseconds since 1970 (NTZ wall clock taken as UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    frac = (F.date_part(F.lit("SECOND"), c) - F.second(c)) * F.lit(1000000)
    return epoch_seconds(c) * F.lit(1000000) + frac.cast("long")


def ntz_as_utc(col: Column | str) -> Column:
    """An NTZ wall clock as the TIMESTAMP instant it names in UTC."""
    return F.timestamp_micros(epoch_micros(col))
