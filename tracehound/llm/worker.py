"""Running Arrow functions on Python workers that are used again and again.

A worker outlives its task, and what the allocators keep after a task adds up
over the workers of an executor.  So every function ends by emptying the
module caches and handing free memory back to the system.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CACHES: list[dict] = []


def cache(d: dict) -> dict:
    """Register a cache to be emptied after each task."""
    CACHES.append(d)
    return d


def tidy() -> None:
    for c in CACHES:
        c.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own way
        pass


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (one machine or a shared folder).  Elsewhere install it on the executors
    or pass it with ``--py-files``; the extra path then does nothing."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``; batches without rows are not handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(b for b in batches if b.num_rows)
        finally:
            tidy()

    reach(df.sparkSession)
    return df.mapInArrow(run, schema)


def per_group(fn: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """For ``applyInArrow`` on groups of one or two frames."""

    # the number of parameters tells Spark whether the key is wanted
    def one(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            tidy()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return fn(left, right)
        finally:
            tidy()

    return two if fn.__code__.co_argcount == 2 else one
