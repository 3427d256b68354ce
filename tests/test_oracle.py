"""Every registered query against its DuckDB oracle at sf0.001 (the
driver's gate runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows_of  # noqa: E402
from claimspark.sources.tables import TEST_TABLES  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    import tempfile
    c.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='duck-spill-', dir='/tmp')}'")
    for t in TEST_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["input_id", "misinfo_id", "confidence", "rank"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    sp = sdf.toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(sp.columns) > 0
        return
    od = con.execute(sql).df()
    sc, sr = rows_of(sp)
    oc, orr = rows_of(od)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr
