"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same check at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.oracle_check import TABLES, norm  # noqa: E402
from tracehound.plans import catalog, oracle_sql  # noqa: E402

SF = os.environ.get("TRACEHOUND_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.REGISTRY) == set(oracle_sql.registered())
    assert set(catalog.REGISTRY) <= set(entry.queries()) and len(catalog.REGISTRY) >= 62


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    si = [sdf.columns.index(c) for c in order]
    di = [rel.columns.index(c) for c in order]
    got = sorted(tuple(norm(r[i]) for i in si) for r in sdf.collect())
    want = sorted(tuple(norm(r[i]) for i in di) for r in rel.fetchall())
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "confidence_score" in df.columns
