"""Every named query with a twin equals DuckDB on the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 6))
        return str(v)

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
