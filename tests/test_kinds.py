"""Sentences by kind, and sweeps by words and by names."""

from pyspark.sql import functions as F

from weftline.operators import parsing, sentences, trees
from weftline.sources import trees as source


def _words(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, sentence string")
    return sentences.lookup(sentences.tokens(rows, ["k"]), ["k"]).select("k", "w", "classname")


def test_kinds(spark):
    """Equal sequences of classes are one kind, and each sentence gets its kind's result, once."""
    words = _words(spark, ["the dog", "the cat", "dog the", "a cat", "it"]).unionByName(_words(spark, ["it"]).withColumn("k", F.lit(None).cast("int")))
    found = sentences.kinds(words, ["k"])
    assert sorted(r["n"] for r in found.each.collect()) == [1, 1, 3]
    last = found.words().groupBy("kind").agg(F.max("w").alias("last"))
    assert sorted((r["k"], r["last"]) for r in found.spread(last).collect()) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1)]


def test_kinds_are_not_broadcast(spark):
    """Tables of kinds and sentences grow with the corpus: no join sends one through the driver, however small its files."""
    found = sentences.kinds(_words(spark, ["the dog", "a cat"]), ["k"])
    last = found.each.select("kind", F.size("classes").alias("last"))
    for df in (found.spread(last), found.words().join(last, "kind"), found.words().join(found.counts(), "kind")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_sweeps_agree(spark, monkeypatch):
    """Dictionaries of many names are swept by rows of connectors, to the same end."""
    words, g = _words(spark, ["the dog is on the table", "dog running in it", "the the of", "it moved the cat and dog to dogs"]), source.grammar(spark)
    rows = lambda df: sorted((r["k"], r["w"], r["classname"], tuple(r["live"])) for r in df.collect())
    for to in ("-", "+", "-+"):
        by_word = rows(trees.swept(trees.whole(words, g), ["k"], g, to))
        with monkeypatch.context() as m:
            m.setattr(trees, "MOST_NAMES", 0)
            assert by_word and by_word == rows(trees.swept(trees.whole(words, g), ["k"], g, to))


def test_types_of_places(spark, tmp_path):
    """Connectors are taken apart once for all words of a class and place: copies of a text change counts only."""
    from weftline import catalogue

    texts = [(i, 0, "the dog is on the table") for i in range(50)]
    spark.createDataFrame(texts, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["dir"], r["n_types"]): r["n"] for r in catalogue.QUERIES["gr_types"](spark, str(tmp_path)).collect()}
    assert got and all(n % 50 == 0 for n in got.values())


def test_pruned_counts(spark):
    """Pruning by live connectors leaves as many clauses and words as pruning by pairs does."""
    words = _words(spark, ["the dog is on the table", "dog running in it", "the the of", "it moved the cat and dog to dogs", "of", "he liked houses by the sea in it"])
    left = parsing.pruned(parsing.sentence_clauses(words, ["k"]), ["k"])
    want = left.groupBy("k").agg(F.count(F.lit(1)).alias("n_clauses"), F.countDistinct("w").alias("n_words"))
    got = parsing.pruned_counts(words, ["k"], parsing.clause_trees())
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect())) and want.count() > 2
