"""A5: table inventory — one aggregate per table instead of four jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.sources.tables import PARTITION_COLUMNS, union_sources


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, earliest/latest partition day, number of distinct
    days, column count.  Days are real dates (the reference compared
    unpadded "y-m-d" strings, so 2021-10-1 sorted before 2021-9-1)."""
    parts = []
    for name, df in tables.items():
        has_days = all(c in df.columns for c in PARTITION_COLUMNS)
        d = F.make_date(*[F.col(c) for c in PARTITION_COLUMNS]) if has_days else F.lit(None).cast("date")
        agg = df.agg(
            F.count(F.lit(1)).alias("record_count"),
            F.min(d).alias("earliest"),
            F.max(d).alias("latest"),
            F.countDistinct(d).alias("partition_count"),
        )
        parts.append(agg.select(F.lit(name).alias("table_name"), "*", F.lit(len(df.columns)).alias("column_count")))
    return union_sources(parts)


def sample_row(df: DataFrame) -> DataFrame:
    """One row of a table (the inventory's sample record)."""
    return df.limit(1)
