"""Tables of run folders that become visible through a committed list.

A run writes its rows to a folder of its own attempt
(``key=N/attempt=K``, never written twice) and then appends one row to
``_commits``.  Readers and compaction take the list first and open exactly the
folders it names, so rows of a run that is still being written, or was cut
off, are in neither, whenever they appear.  Of several attempts the highest
that was committed counts; an older one that ends late changes nothing.

A snapshot holds many runs merged, and its row in ``_commits`` lists the
attempts it covers.  It counts as long as each of them is still its run's
latest; readers take the one that covers most and add the runs outside it.  The run
folders stay until ``vacuum``, so a lost or outdated snapshot costs nothing.

The list has one row per run and is reduced by Spark; the driver gets the
folders of the runs since the last usable snapshot.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS, SNAPSHOTS, CLAIMS = "_commits", "_snapshots", "_claims"
PAIRS = "array<struct<key:bigint,attempt:int>>"
COMMIT_SCHEMA = f"key bigint, attempt int, snapshot string, covers {PAIRS}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path as one of its."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path``; none if it is absent."""
    fs, p = file_system(spark, path)
    return [c.getPath().getName() for c in fs.listStatus(p)] if fs.exists(p) else []


def claim(spark: SparkSession, base: str, name: str) -> int:
    """The next free number under ``name``, from 1 on, taken by creating its
    marker file (which exactly one of several jobs can do)."""
    folder = f"{base}/{CLAIMS}/{name}"
    n = max((int(c) for c in children(spark, folder) if c.isdigit()), default=0)
    while True:
        n += 1
        fs, p = file_system(spark, f"{folder}/{n}")
        try:
            if fs.createNewFile(p):
                return n
        except Py4JJavaError as e:      # taken between the listing and the creation
            if not fs.exists(p):
                raise e


def raise_to(spark: SparkSession, base: str, name: str, n: int) -> None:
    """Take every number under ``name`` up to ``n``."""
    fs, p = file_system(spark, f"{base}/{CLAIMS}/{name}/{n}")
    fs.create(p, True).close()


def folder(base: str, key: int, attempt: int) -> str:
    return f"{base}/key={key}/attempt={attempt}"


def _append(spark: SparkSession, base: str, row: DataFrame) -> None:
    row.coalesce(1).write.mode("append").parquet(f"{base}/{COMMITS}")


def write(df: DataFrame, base: str, key: int, attempt: int | None = None) -> int:
    """Store the rows of run ``key`` and commit them; returns the attempt
    (claimed unless given).  They replace those of its earlier attempts."""
    spark = df.sparkSession
    attempt = claim(spark, base, f"key={key}") if attempt is None else attempt
    df.write.mode("overwrite").parquet(folder(base, key, attempt))
    commit(spark, base, key, attempt)
    return attempt


def one_row(spark: SparkSession, schema: str, **values) -> DataFrame:
    """A row of literals (``schema``: name and type pairs; absent ones null)."""
    return spark.range(0, 1, 1, 1).select(*[F.lit(values.get(n)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in schema.split(", "))])


def commit(spark: SparkSession, base: str, key: int, attempt: int) -> None:
    _append(spark, base, one_row(spark, COMMIT_SCHEMA, key=key, attempt=attempt))


def commits(spark: SparkSession, base: str) -> DataFrame:
    """The list as it is now (the files are listed once, here)."""
    path = f"{base}/{COMMITS}"
    if not exists(spark, path):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(path)


def _latest(listed: DataFrame) -> DataFrame:
    """(key, attempt): the attempt of each run that counts."""
    covered = listed.where("covers IS NOT NULL").select(F.explode("covers").alias("c")).select("c.key", "c.attempt")
    return listed.where("key IS NOT NULL").select("key", "attempt").unionByName(covered).groupBy("key").agg(F.max("attempt").alias("attempt"))


def latest(spark: SparkSession, base: str) -> DataFrame:
    """(key, attempt) of all committed runs."""
    return _latest(commits(spark, base))


def _usable(listed: DataFrame) -> str | None:
    """The snapshot that covers most runs, all by their latest attempt."""
    held = listed.where("covers IS NOT NULL").select("snapshot", F.explode("covers").alias("c")).select("snapshot", "c.key", F.col("c.attempt").alias("held"))
    judged = held.join(_latest(listed), "key").groupBy("snapshot").agg(F.count("*").alias("n"), F.count_if(F.col("held") < F.col("attempt")).alias("old"))
    best = judged.where("old = 0").orderBy(F.desc("n"), "snapshot").first()
    return best.snapshot if best else None


def parts(spark: SparkSession, base: str, schema: str, listed: DataFrame | None = None) -> list[DataFrame]:
    """The committed rows: the best snapshot, and the runs not in it."""
    listed = commits(spark, base) if listed is None else listed
    snapshot, rest, out = _usable(listed), _latest(listed), []
    if snapshot:
        covered = listed.where(F.col("snapshot") == snapshot).select(F.explode("covers").alias("c")).select("c.key")
        rest = rest.join(covered, "key", "left_anti")
        out.append(spark.read.schema(schema).parquet(f"{base}/{SNAPSHOTS}/{snapshot}"))
    if folders := [folder(base, r.key, r.attempt) for r in rest.collect()]:
        out.append(spark.read.schema(schema).parquet(*folders))
    return out


def read(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """All committed rows; a snapshot's are merged already."""
    found = parts(spark, base, schema)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def compact(spark: SparkSession, base: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> str | None:
    """Store ``merge`` of all committed rows as a snapshot and commit it.  A
    run that is committed meanwhile is outside it, and readers add it."""
    listed = commits(spark, base)
    found = parts(spark, base, schema, listed)
    if not found:
        return None
    name = uuid.uuid4().hex
    merge(reduce(DataFrame.unionByName, found)).write.parquet(f"{base}/{SNAPSHOTS}/{name}")
    covers = _latest(listed).agg(F.sort_array(F.collect_list(F.struct("key", "attempt"))).cast(PAIRS).alias("covers"))
    _append(spark, base, covers.select(F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("int").alias("attempt"), F.lit(name).alias("snapshot"), "covers"))
    return name


def vacuum(spark: SparkSession, base: str, older_than_seconds: float = 86_400) -> list[str]:
    """Delete what no reader of the last ``older_than_seconds`` can need:
    snapshots other than the best, and attempts below their run's latest."""
    listed = commits(spark, base)
    best, before, gone = _usable(listed), (time.time() - older_than_seconds) * 1000, []
    latest = {r.key: r.attempt for r in _latest(listed).where("attempt > 1").collect()}   # repeated runs only
    old = [f"{base}/{SNAPSHOTS}/{s}" for s in children(spark, f"{base}/{SNAPSHOTS}") if s != best]
    for key, attempt in latest.items():
        names = children(spark, f"{base}/key={key}")
        old += [f"{base}/key={key}/{n}" for n in names if n.startswith("attempt=") and int(n.split("=")[1]) < attempt]
    for path in old:
        fs, p = file_system(spark, path)
        if fs.getFileStatus(p).getModificationTime() <= before and fs.delete(p, True):
            gone.append(path)
    return gone
