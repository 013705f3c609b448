import glob
import os

import duckdb
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
