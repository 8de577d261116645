"""Every query over expression trees against its SQL, over the whole small tables."""

import duckdb
import pytest

from weftline import treecatalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", treecatalogue.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(treecatalogue.ORACLE_SQL[name]).df()
    got = treecatalogue.QUERIES[name](spark, SF).toPandas()
    order = sorted(want.columns)
    assert sorted(got.columns) == order and len(want)
    assert want[order].sort_values(order).reset_index(drop=True).astype(str).equals(got[order].sort_values(order).reset_index(drop=True).astype(str))


def test_parses(spark):
    """As many linkages are found as are counted, up to those asked for; each clause of a
    linkage is one that pruning left."""
    c = treecatalogue.parsable(spark, SF)
    from weftline.operators import parsing

    n = {tuple(r[k] for k in treecatalogue.KEYS): r["n_parses"] for r in parsing.parse_counts(c, treecatalogue.KEYS).collect()}
    best = parsing.linkages(c, treecatalogue.KEYS, 3).collect()
    have = {}
    for r in best:
        have.setdefault(tuple(r[k] for k in treecatalogue.KEYS), []).append(r)
    assert {k: min(3, v) for k, v in n.items()} == {k: len(v) for k, v in have.items()}
    for rows in have.values():
        costs = [(r["cost"], r["length"]) for r in sorted(rows, key=lambda r: r["rank"])]
        assert costs == sorted(costs)
