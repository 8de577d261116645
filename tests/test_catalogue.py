"""Every catalogued query against its SQL."""

import duckdb
import pytest

from weftline import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = (catalogue.QUERIES | catalogue.FIXED)[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = list(want.columns)
    got = got[order]
    assert want.sort_values(order).reset_index(drop=True).astype(str).equals(got.sort_values(order).reset_index(drop=True).astype(str))
