"""Log sources (S1–S5, S7): table reads, nested-table discovery, union by
name, and the inclusive partition date range.

Discovery lists directories through the Hadoop FileSystem of the path (so
it works on HDFS/S3/ABFS alike); only metadata crosses to the driver.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehound.functions.timecols import as_date

PARTITION_COLUMNS = ("year", "month", "day")
# The log folder that marks a table root by itself.
TABLE_LOG = "_delta_log"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discover_table_roots(spark: SparkSession, path: str) -> list[str]:
    """``path`` itself if it is a table, else every table below it.

    A folder is a table if it has a table log, data files or partition
    folders (``name=value``); nothing below a table is listed, so day folders
    are not walked.  Other folders are searched.  A folder that is a table and
    also has plain subfolders cannot be told apart and is an error, as is a
    path without any table."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        raise ValueError(f"No tables found at {path}")
    if fs.getFileStatus(root).isFile():
        return [path]
    found: list[str] = []
    stack = [root]
    while stack:
        folder = stack.pop()
        children = [(c.getPath().getName(), c) for c in fs.listStatus(folder)]
        if any(name == TABLE_LOG for name, _ in children):
            found.append(folder.toString())
            continue
        seen = [(name, c) for name, c in children if not name.startswith(("_", "."))]
        plain = [c.getPath() for name, c in seen if c.isDirectory() and "=" not in name]
        if len(plain) == len(seen):
            stack.extend(plain)
        elif plain:
            raise ValueError(f"{folder.toString()} holds data and also plain folders ({plain[0].getName()}, ...): name the tables one by one")
        else:
            found.append(folder.toString())
    if not found:
        raise ValueError(f"No tables found at {path}")
    return sorted(found)


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """S3: union by column name; a column missing from a part is NULL there."""
    if not parts:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def partition_date_range(df: DataFrame, start: _dt.date | str, end: _dt.date | str, time_col: str | None = None) -> DataFrame:
    """Keep days in [start, end] (both inclusive).

    With year/month/day partition columns the predicate is on
    ``make_date(year, month, day)`` only, so it lands in ``PartitionFilters``
    and whole directories are skipped.  Without them the event time is
    filtered instead (the reference silently skipped the filter)."""
    a, b = as_date(start), as_date(end)
    if all(c in df.columns for c in PARTITION_COLUMNS):
        d = F.make_date(*[F.col(c) for c in PARTITION_COLUMNS])
        return df.filter(d.between(F.lit(a), F.lit(b)))
    if time_col is None:
        raise ValueError("no year/month/day columns and no time column to filter on")
    tc = F.col(f"`{time_col}`")
    if isinstance(df.schema[time_col].dataType, T.StringType):
        tc = F.to_timestamp(tc)
    return df.filter(F.to_date(tc).between(F.lit(a), F.lit(b)))


def day_folders(spark: SparkSession, root: str, start: _dt.date, end: _dt.date) -> list[str] | None:
    """The ``year=/month=/day=`` folders of a table in [start, end], or None
    if it is not laid out by day.  One listing per month of the range."""
    fs, p = _fs(spark, root)
    if not any(c.getPath().getName().startswith("year=") for c in fs.listStatus(p)):
        return None
    path, found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for m in range(12 * start.year + start.month - 1, 12 * end.year + end.month):
        year, month = m // 12, m % 12 + 1
        listed = fs.globStatus(path(f"{root}/year={year}/month={{{month},{month:02d}}}/day=*")) or []
        for name, folder in sorted((x.getPath().getName(), x.getPath().toString()) for x in listed):
            day = name.removeprefix("day=")
            if day.isdigit() and (start.year, start.month, start.day) <= (year, month, int(day)) <= (end.year, end.month, end.day):
                found.append(folder)
    return found


def read_table(spark: SparkSession, path: str, start=None, end=None, *, fmt: str = "parquet", time_col: str | None = None,
               schema: T.StructType | str | None = None, merge_schema: bool = False) -> DataFrame:
    """S1+S2+S3+S4: read one table, or every table below ``path`` unioned by
    name, then apply the inclusive date range.

    With a range, only the day folders in it are listed and read.  The schema
    comes from one file (or ``schema``); ``merge_schema=True`` reads the footer
    of every file that is listed."""
    def load(root: str) -> DataFrame:
        reader = spark.read.option("mergeSchema", str(merge_schema).lower()).format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        if fmt == "parquet" and start is not None and end is not None:
            days = day_folders(spark, root, as_date(start), as_date(end))
            if days:
                return reader.option("basePath", root).load(days)
        return reader.load(root)
    df = union_sources([load(r) for r in discover_table_roots(spark, path)])
    if start is not None and end is not None:
        df = partition_date_range(df, start, end, time_col)
    return df


def read_parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """Read every parquet file under ``path`` ignoring any table log
    (opt-in fallback: it also sees files a table has deleted)."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .parquet(path))


def lookback_range(as_of: _dt.date | str, days: int) -> tuple[_dt.date, _dt.date]:
    """[as_of - days, as_of]."""
    end = as_date(as_of)
    return end - _dt.timedelta(days=days), end

