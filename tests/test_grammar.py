"""The grammar's operators against SQL and brute force."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline import registry
from weftline.operators import parsing, postprocess
from weftline.streaming import classes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = (registry.QUERIES | registry.FIXED)[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert want.sort_values(order).reset_index(drop=True).astype(str).equals(got.sort_values(order).reset_index(drop=True).astype(str))


def test_any_grammar_counts(spark):
    """Words that may link to any: connected planar graphs, 1, 4, 23, 156."""
    clauses = [("LEFT-WALL", "@ANY+"), ("any", "@ANY- & @ANY+"), ("any", "@ANY-"), ("any", "@ANY+")]
    c = spark.createDataFrame([(*x, 0.0) for x in clauses], "classname string, disjunct string, cost double")
    words = spark.createDataFrame([(n, i, "any" if i else "LEFT-WALL") for n in (1, 2, 3, 4) for i in range(n + 1)], "k int, w int, classname string")
    got = parsing.parse_counts(parsing.pruned(parsing.sentence_clauses(words, ["k"], c), ["k"]), ["k"])
    assert {r["k"]: r["n_parses"] for r in got.collect()} == {1: 1, 2: 4, 3: 23, 4: 156}


def test_corpus(spark):
    rows = registry.gr_corpus_errors(spark, SF).collect()
    assert len(rows) == 10 and not any(r["error"] for r in rows), rows


def test_linkages_of_the_any_grammar(spark):
    """As many linkages as are counted, all different, planar and connected, cheapest first."""
    clauses = [("LEFT-WALL", "@ANY+", 0.0), ("any", "@ANY- & @ANY+", 0.0), ("any", "@ANY-", 0.5), ("any", "@ANY+", 0.0)]
    c = spark.createDataFrame(clauses, "classname string, disjunct string, cost double")
    words = spark.createDataFrame([(n, i, "any" if i else "LEFT-WALL") for n in (1, 2, 3) for i in range(n + 1)], "k int, w int, classname string")
    rows = parsing.linkages(parsing.pruned(parsing.sentence_clauses(words, ["k"], c), ["k"]), ["k"], 100).collect()
    for n, want in ((1, 1), (2, 4), (3, 23)):
        own = sorted((r for r in rows if r["k"] == n), key=lambda r: r["rank"])
        sets = [frozenset((x["lw"], x["rw"]) for x in r["links"]) for r in own]
        assert len(set(sets)) == want == len(own)
        for r, pairs in zip(own, sets, strict=True):
            assert not any(a < c < b < d for a, b in pairs for c, d in pairs)
            reached = {0}
            for _ in range(n):
                reached |= {y for p in pairs for y in p if set(p) & reached}
            assert reached == set(range(n + 1))
            assert r["nulls"] == 0 and r["length"] == sum(b - a - 1 for a, b in pairs)
        assert [(r["cost"], r["length"]) for r in own] == sorted((r["cost"], r["length"]) for r in own)


def test_null_words(spark):
    """Words that nothing links to are left out, as few as allow a linkage."""
    c = spark.createDataFrame([("LEFT-WALL", "W+", 0.0), ("a", "W-", 0.0), ("b", "X-", 0.0)], "classname string, disjunct string, cost double")
    words = [(1, "a"), (2, "ab"), (3, "ba"), (4, "bab"), (5, "bbab"), (6, "b"), (7, "aa")]
    rows = [(k, i, x) for k, ws in words for i, x in enumerate(["LEFT-WALL", *ws])]
    cl = parsing.pruned(parsing.sentence_clauses(spark.createDataFrame(rows, "k int, w int, classname string"), ["k"], c), ["k"])
    got = {r["k"]: (r["nulls"], r["n_parses"]) for r in parsing.parse_counts(cl, ["k"], max_null=2).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (1, 1), 4: (2, 1), 7: (1, 2)}


def test_rules(spark):
    rows = [(1, 1, [(0, 1, "MVp")]), (1, 2, [(0, 1, "MVp"), (1, 2, "Ss")]), (2, 1, [(0, 1, "Ost")]), (3, 1, [])]
    df = spark.createDataFrame(rows, "k int, rank int, links array<struct<lw:int,rw:int,name:string>>")
    assert {(r["k"], r["rank"], r["rule"]) for r in postprocess.violations(df, ["k"]).collect()} == {(1, 1, 1), (2, 1, 3)}


def test_stream(spark, tmp_path):
    """A stream's counts equal those of the table that its files make."""
    rows = [("2024-01-01 00:10:00", "The dog walked."), ("2024-01-01 00:50:00", "It is 12"), ("2024-01-01 05:00:00", None)]
    table = spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = classes.word_classes(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("word_classes").outputMode("complete").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(spark.table("word_classes").collect()) == sorted(classes.word_classes(table).collect())
    assert {(r["classname"], r["n"]) for r in spark.table("word_classes").collect()} == {("det", 1), ("noun", 2), ("verb", 1), ("pron", 1), ("be", 1)}


def test_entry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
