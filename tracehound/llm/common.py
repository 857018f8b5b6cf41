"""Helpers shared by the corpus operators: reading a table, writing an
intermediate table to the shared folder, size-checked broadcasts, ASCII case
folding, and connected components over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracehound.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side is broadcast only when (counted rows) x (bytes a row) stays below this.
BROADCAST_BYTES = 16 << 20
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tracehound-{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut
    at files every executor sees, so a lost executor costs only its own tasks.
    ``codec`` is the file compression, the session's own unless given."""
    path = shared_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is within ``limit``;
    otherwise unchanged, and the join shuffles (same rows either way)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= limit else df


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character untouched.  ``lower`` does exactly
    that on pure ASCII and is several times faster than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long) as (node, label),
    label being the smallest node of the component.

    Alternating large-star and small-star rounds; each is one grouped minimum
    and one join, so no component is ever gathered in a task.  Each round is
    written to the shared folder.  Nodes without an edge do not appear; a null
    end drops its edge.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = stash(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(small_min.select("u", F.col("m").alias("v"))).distinct()
        )
        e = stash(small, name)
        n, s = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, s) == mark:
            break
        mark = (n, s)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
