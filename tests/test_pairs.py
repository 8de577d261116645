"""Pairs of words by slices of sentences, and sums of what they cost."""

from pyspark.sql import functions as F

from weftline.operators import pairs
from weftline.plans.lineage import cut


def _sentences(spark):
    rows = [(0, "a b c d a b".split()), (1, "b c".split()), (2, ["a"]), (3, []), (4, "a b c".split()), (4, "b c a b".split()), (None, "a b".split())]
    return spark.createDataFrame(rows, "k int, words array<string>")


def test_slices_are_the_join(spark):
    """As the join of places gives them, also where two sentences have one key."""
    sents = _sentences(spark)
    words = sents.select("k", F.posexplode("words").alias("i", "word")).select("k", (F.col("i") + 1).alias("w"), "word")
    want = sorted(map(tuple, pairs.sentence_pairs(words, ["k"]).select("k", "lw", "rw", "l", "r").collect()))
    got = pairs.gathered(sents, ["k"]).select("k", F.inline(pairs.listed()))
    assert want and want == sorted(map(tuple, got.collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_local_sums(spark):
    """As the left join of all pairs with the table gives them; no cost or row of an unknown pair is sent back."""
    sents = pairs.gathered(_sentences(spark), ["k"])
    p = sents.select("k", F.inline(pairs.listed()))
    each = pairs.local(p, pairs.costs(pairs.counts(p)))
    want = each.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("known"), 1)).alias("n_known"), F.round(F.sum("cost"), 3).alias("cost"))
    out = pairs.local_sums(sents, ["k"])
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, out.withColumn("cost", F.round("cost", 3)).collect()))
    assert "LeftOuter" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_broadcast(spark):
    """However small the files are that they come from, neither pairs nor their table go whole through the driver."""
    sents = pairs.gathered(cut(_sentences(spark)), ["k"])
    out = pairs.local_sums(sents, ["k"])
    assert out.count() == 3
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in pairs.costs(pairs.counts(sents.select(F.inline(pairs.listed()))))._jdf.queryExecution().executedPlan().toString()
