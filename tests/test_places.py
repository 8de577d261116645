"""What connectors find in each other, by rows of words, against pairs of connectors."""

from pyspark.sql import functions as F

from weftline import catalogue, registry, treecatalogue
from weftline.operators import parsing, places

SF = "/root/testdata/sf0.001"
CLAUSES = [("a", "hX*+ & @Y+", 0.0), ("a", "dXs- & X+", 0.0), ("b", "hXa-", 0.0), ("b", "Y- & dX*+", 0.5), ("c", "Xb- & hX-", 0.0), ("c", "Z+", 0.0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_pairs(spark):
    """Heads, subtypes, words at the ends, words that stand twice, and null keys."""
    c = spark.createDataFrame(CLAUSES, "classname string, disjunct string, cost double")
    rows = [(k, i, x) for k, s in ((1, "abcabcab"), (2, "ab"), (3, "ccba"), (None, "abc")) for i, x in enumerate(s)] + [(1, 2, "c"), (1, 3, "b"), (2, 2, "?")]
    words = spark.createDataFrame(rows, "k int, w int, classname string").coalesce(1)
    cons = parsing.connectors(parsing.sentence_clauses(words, ["k"], c), ["k"])
    met = parsing.partners(cons, ["k"]).cache()
    p = places.places(words, ["k"], c)
    assert dict(places.link_counts(p).collect()) == dict(met.groupBy("name").count().collect()) != {}
    own = met.select("k", F.col("lw").alias("w"), F.col("ld").alias("d"), F.col("li").alias("i")).union(met.select("k", "rw", "rd", "ri")).distinct().withColumn("held", F.lit(1))
    want = cons.join(own, ["k", "w", "d", "i"], "left").groupBy("uc", "dir").agg(F.count(F.lit(1)), F.count("held"))
    assert sorted(places.held_counts(p).collect()) == sorted(want.collect())


def test_one_pass(spark):
    """No pairs of connectors are rows: words are read once. Words meet their class's counts where they
    stand, so that the words of a frequent class are not all one task's."""
    for q in (registry.gr_links, catalogue.gr_swept, catalogue.gr_nearest):
        assert _plan(q(spark, SF)).count("conversations.parquet") == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(treecatalogue.gr_exp_counts(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
