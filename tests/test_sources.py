"""Sources: partition range with pruning, discovery, union by name."""

import datetime as dt
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from tracehound.operators import inventory
from tracehound.sources import tables


@pytest.fixture(scope="module")
def partitioned(spark):
    root = tempfile.mkdtemp(prefix="th-src-")
    days = [dt.date(2020, 12, 30) + dt.timedelta(days=i) for i in range(5)] + [dt.date(2021, 1, 31), dt.date(2021, 2, 1)]
    rows = [(dt.datetime.combine(d, dt.time(12)), f"10.0.0.{i}", d.year, d.month, d.day) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id_orig_h string, year int, month int, day int")
    for org in ("org_a", "org_b"):
        df.write.partitionBy("year", "month", "day").parquet(f"{root}/{org}/conn")
    return root


def test_range_inclusive_across_year_and_month(spark, partitioned):
    df = tables.read_table(spark, f"{partitioned}/org_a/conn", "2020-12-31", "2021-01-31")
    days = sorted((r.year, r.month, r.day) for r in df.collect())
    assert days == [(2020, 12, 31), (2021, 1, 1), (2021, 1, 2), (2021, 1, 3), (2021, 1, 31)]


def test_range_lands_in_partition_filters(spark, partitioned):
    df = tables.read_table(spark, f"{partitioned}/org_a/conn", "2021-01-01", "2021-01-02")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "make_date" in plan.split("PartitionFilters")[1].split("]")[0]


def test_nested_discovery_unions_every_table(spark, partitioned):
    roots = tables.discover_table_roots(spark, partitioned)
    assert [r.split("/")[-2] for r in roots] == ["org_a", "org_b"]
    assert tables.read_table(spark, partitioned).count() == 14


def test_discovery_nothing_found(spark):
    with pytest.raises(ValueError):
        tables.discover_table_roots(spark, tempfile.mkdtemp(prefix="th-empty-"))
    with pytest.raises(ValueError):
        tables.read_table(spark, tempfile.mkdtemp(prefix="th-empty-"))


def test_tables_without_a_marker_are_found(spark):
    root = tempfile.mkdtemp(prefix="th-bare-")
    for name in ("a", "b", "deep/c"):
        spark.range(3).coalesce(1).write.parquet(f"{root}/{name}")
    spark.range(2).withColumn("year", F.lit(2021)).write.partitionBy("year").parquet(f"{root}/d")
    for name in ("b", "deep/c", "d"):
        os.remove(f"{root}/{name}/_SUCCESS")
    assert [r.split("/")[-1] for r in tables.discover_table_roots(spark, root)] == ["a", "b", "d", "c"]
    assert tables.read_table(spark, root).count() == 11
    one = [f for f in os.listdir(f"{root}/b") if f.endswith(".parquet")][0]
    assert tables.read_table(spark, f"{root}/b/{one}").count() == 3


def test_mixed_layout_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="th-mixed-")
    spark.range(3).write.mode("append").parquet(root)
    spark.range(3).write.parquet(f"{root}/inner")
    with pytest.raises(ValueError, match="inner"):
        tables.read_table(spark, root)


def test_folders_outside_the_range_are_not_opened(spark, partitioned):
    root = tempfile.mkdtemp(prefix="th-out-") + "/t"
    shutil.copytree(f"{partitioned}/org_a/conn", root)
    for name in os.listdir(f"{root}/year=2021/month=2/day=1"):
        if name.endswith(".parquet"):
            with open(f"{root}/year=2021/month=2/day=1/{name}", "wb") as f:
                f.write(b"not parquet")
    df = tables.read_table(spark, root, "2020-12-30", "2021-01-31", merge_schema=True)
    assert df.count() == 6 and not any("month=2" in f for f in df.inputFiles())
    assert tables.read_table(spark, root, "2019-01-01", "2019-01-02", schema=df.schema).count() == 0


def test_given_schema_is_used(spark, partitioned):
    df = tables.read_table(spark, f"{partitioned}/org_a/conn", schema="id_orig_h string, extra int, year int, month int, day int")
    assert df.columns == ["id_orig_h", "extra", "year", "month", "day"] and df.count() == 7


def test_missing_partition_columns_filter_event_time(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1, 5),), (dt.datetime(2021, 1, 3, 5),)], "ts timestamp_ntz")
    got = tables.partition_date_range(df, "2021-01-01", "2021-01-02", time_col="ts").count()
    assert got == 1
    with pytest.raises(ValueError):
        tables.partition_date_range(df, "2021-01-01", "2021-01-02")


def test_union_by_name_extra_column_null(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([("y", 2, True)], "name string, id long, extra boolean")
    rows = sorted(tables.union_sources([a, b]).collect(), key=lambda r: r.id)
    assert [(r.id, r.name, r.extra) for r in rows] == [(1, "x", None), (2, "y", True)]


def test_inventory_uses_real_dates(spark):
    rows = [(2021, 9, 1), (2021, 10, 1), (2021, 10, 1)]
    df = spark.createDataFrame(rows, "year int, month int, day int")
    r = inventory.table_inventory({"t": df}).collect()[0]
    assert (r.earliest, r.latest, r.partition_count, r.record_count, r.column_count) == \
        (dt.date(2021, 9, 1), dt.date(2021, 10, 1), 2, 3, 3)


def test_smoke_write_read_roundtrip(spark):
    path = tempfile.mkdtemp(prefix="th-smoke-") + "/t"
    df = spark.createDataFrame([(1, "alice", "2024-10-14"), (2, "bob", "2024-10-15")], "id long, name string, date string")
    df.write.mode("overwrite").parquet(path)
    df.write.mode("overwrite").parquet(path)
    assert spark.read.parquet(path).count() == 2
    assert spark.read.parquet(path).filter(F.col("name") == "bob").count() == 1


def test_raw_parquet_fallback_reads_every_file(spark, partitioned):
    # ignores table layout: finds the files of both tables, without partition columns
    df = tables.read_parquet_files(spark, partitioned)
    assert df.count() == 14 and "year" not in df.columns


def test_lookback_range():
    assert tables.lookback_range("2024-03-01", 30) == (dt.date(2024, 1, 31), dt.date(2024, 3, 1))


def test_lookback_hunt_reads_pruned_range(spark):
    from tracehound.plans import jobs
    from tracehound.sources import fixtures as fx
    src = tempfile.mkdtemp(prefix="th-lb-") + "/conn"
    fx.load(spark, "/root/testdata/sf0.001", "conn_logs").write.partitionBy("year", "month", "day").parquet(src)
    r = jobs.run_lookback_hunt(spark, "c2_beaconing", src, results_dir=tempfile.mkdtemp(prefix="th-lbr-"), execution_id=5,
                               as_of="2024-01-31", lookback_days=30, params=fx.C2_PARAMS)
    assert r["records_analyzed"] == 1000 and r["findings_count"] == 31


def test_inventory_sample_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert inventory.sample_row(df).count() == 1
