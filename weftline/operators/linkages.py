"""Linkages as tables of links: scores, ranks, islands, domains, rules in domains, displays.

links(k, rank, i, lw, rw, name): link i of linkage rank of sentence k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut

ID = ["k", "rank"]
# Linkages of our own, their words and clause costs, constituents, domain letters and rules.
LINKS = [
    (1, 1, 1, 0, 2, "Wd"), (1, 1, 2, 1, 2, "Ds"), (1, 1, 3, 2, 3, "Ss"), (1, 1, 4, 3, 5, "Os"), (1, 1, 5, 4, 5, "Ds"),
    (1, 2, 1, 0, 2, "Wd"), (1, 2, 2, 1, 2, "Ds"), (1, 2, 3, 2, 3, "Ss"), (1, 2, 4, 3, 4, "Os"),
    (1, 3, 1, 0, 2, "Wd"), (1, 3, 2, 2, 3, "Ss"), (1, 3, 3, 4, 5, "Ds"),
    (2, 1, 1, 0, 1, "Wd"), (2, 1, 2, 1, 2, "Ss"), (2, 1, 3, 2, 3, "TH"), (2, 1, 4, 3, 4, "Ce"), (2, 1, 5, 4, 5, "Ss"), (2, 1, 6, 3, 5, "B"),
    (2, 2, 1, 0, 1, "Wd"), (2, 2, 2, 1, 2, "Ss"), (2, 2, 3, 2, 5, "MVp"), (2, 2, 4, 2, 3, "TH"),
    (2, 3, 1, 0, 1, "Wd"), (2, 3, 2, 1, 2, "Ss"), (2, 3, 3, 2, 5, "MVp"), (2, 3, 4, 2, 3, "TH"),
]
SENTENCES = [(1, 6), (2, 6)]
COSTS = [(1, 1, 0.5), (1, 2, 0.25), (1, 3, 1.5), (2, 1, 0.0), (2, 2, 0.75), (2, 3, 0.75)]
SPANS = [(1, 1, "S", 1, 5), (1, 1, "NP", 1, 2), (1, 1, "VP", 3, 5), (1, 1, "NP", 4, 5), (2, 1, "S", 1, 5), (2, 1, "VP", 2, 5), (2, 1, "SBAR", 3, 5)]
STARTS = [("Ce", "e"), ("TH", "t"), ("Wd", "m")]
DOMAIN_RULES = [(1, "contains_one", "e", "Ss"), (2, "contains_none", "t", "MVp"), (3, "bounded", "e", ""), (4, "contains_one", "t", "Ce"), (5, "contains_one", "m", "Ss")]


def tables(spark) -> dict[str, DataFrame]:
    kinds = {
        "links": (LINKS, "k int, rank int, i int, lw int, rw int, name string"), "sentences": (SENTENCES, "k int, n_words int"), "costs": (COSTS, "k int, rank int, cost double"),
        "spans": (SPANS, "k int, rank int, label string, lw int, rw int"), "starts": (STARTS, "name string, letter string"), "rules": (DOMAIN_RULES, "rule int, kind string, letter string, wanted string"),
    }
    return {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in kinds.items()}


def scored(links: DataFrame, sentences: DataFrame, costs: DataFrame) -> DataFrame:
    """k, rank, unused, cost, length, place (by unused words, cost, length) and tie (linkages of
    equal scores share one); linkages of the same links stand once, the first of them."""
    shape = links.groupBy(*ID).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%03d-%03d-%s", "lw", "rw", "name"))), " ").alias("shape"), F.sum(F.expr("rw - lw - 1")).alias("length"))
    used = links.select(*ID, F.explode(F.array("lw", "rw")).alias("w")).groupBy(*ID).agg(F.countDistinct("w").alias("used"))
    shape = shape.withColumn("again", F.row_number().over(Window.partitionBy("k", "shape").orderBy("rank"))).where("again = 1")
    out = shape.join(used, ID).join(costs, ID).join(F.broadcast(sentences), "k").withColumn("unused", F.col("n_words") - F.col("used"))
    order = Window.partitionBy("k").orderBy("unused", "cost", "length")
    place = F.row_number().over(Window.partitionBy("k").orderBy("unused", "cost", "length", "rank"))
    return out.select(*ID, "unused", "cost", "length", place.alias("place"), F.dense_rank().over(order).alias("tie"))


def sampled(links: DataFrame, n: int, seed: str) -> DataFrame:
    """k, rank of n linkages of each sentence in a seeded order, the same on every run."""
    order = Window.partitionBy("k").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("k").cast("string"), F.col("rank").cast("string"))))
    return links.select(*ID).distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= n).select(*ID)


def spread(starts: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, word: all words that edges(k, rank, i, a, b) reach from starts(by, word, not_i,
    not_word) without link not_i and without passing word not_word. Each turn joins only what
    the last one added."""
    seen = cut(starts)
    new = seen
    while not new.isEmpty():
        step = new.join(edges, (new["k"] == edges["ek"]) & (new["rank"] == edges["er"]) & (new["word"] == edges["a"]))
        step = step.where("i <> not_i and b <> not_word").select(*by, F.col("b").alias("word"), "not_i", "not_word").distinct()
        new = cut(step.join(seen.select(*by, "word"), [*by, "word"], "left_anti"))
        seen = cut(seen.unionByName(new))
    return seen.select(*by, "word").distinct()


def both_ways(links: DataFrame) -> DataFrame:
    ek = [F.col("k").alias("ek"), F.col("rank").alias("er"), "i"]
    return links.select(*ek, F.col("lw").alias("a"), F.col("rw").alias("b")).unionByName(links.select(*ek, F.col("rw").alias("a"), F.col("lw").alias("b")))


def islands(links: DataFrame, sentences: DataFrame) -> DataFrame:
    """k, rank, n_islands: parts of a sentence's words that no links join, unlinked words too."""
    words = links.select(*ID).distinct().join(F.broadcast(sentences), "k").select(*ID, F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("start"))
    own = words.select(*ID, "start", F.col("start").alias("word"), F.lit(-1).alias("not_i"), F.lit(-1).alias("not_word"))
    least = spread(own, both_ways(links), [*ID, "start"]).groupBy(*ID, "start").agg(F.min("word").alias("root"))
    return least.groupBy(*ID).agg(F.countDistinct("root").alias("n_islands"))


def domains(links: DataFrame, starts: DataFrame) -> DataFrame:
    """k, rank, start (the link that opens it), letter, i: the links of each domain, the start
    itself among them: those that its right word reaches without passing its left one."""
    heads = links.join(F.broadcast(starts), "name").select(*ID, F.col("i").alias("start"), "letter", F.col("lw").alias("left"), F.col("rw").alias("word"))
    own = heads.select(*ID, "start", "word", F.col("start").alias("not_i"), F.col("left").alias("not_word"))
    reached = spread(own, both_ways(links), [*ID, "start"])
    inside = reached.join(both_ways(links).withColumnsRenamed({"ek": "k", "er": "rank", "a": "word"}), [*ID, "word"]).join(heads.select(*ID, "start", "letter", "left"), [*ID, "start"])
    inside = inside.where("b <> left or i = start").select(*ID, "start", "letter", "i")
    return inside.unionByName(heads.select(*ID, "start", "letter", F.col("start").alias("i"))).distinct()


def broken_rules(links: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """k, rank, start, rule: what domains break. contains_one: a domain of the letter must have
    the link; contains_none: must not; bounded: none of its links may begin left of its start."""
    own = found.join(links.select(*ID, "i", "lw", "name"), [*ID, "i"]).join(links.select(*ID, F.col("i").alias("start"), F.col("lw").alias("edge")), [*ID, "start"])
    met = own.join(F.broadcast(rules), "letter").groupBy(*ID, "start", "rule", "kind").agg(F.max((F.col("name") == F.col("wanted")).cast("int")).alias("has"), F.min(F.col("lw") - F.col("edge")).alias("out"))
    bad = F.when(F.col("kind") == "contains_one", F.col("has") == 0).when(F.col("kind") == "contains_none", F.col("has") == 1).otherwise(F.col("out") < 0)
    return met.where(bad).select(*ID, "start", "rule")


def cycles(links: DataFrame) -> DataFrame:
    """k, rank, i: the links whose words other links join too."""
    own = links.select(*ID, F.col("i").alias("start"), F.col("lw").alias("word"), F.col("i").alias("not_i"), F.lit(-1).alias("not_word"))
    ends = links.select(*ID, F.col("i").alias("start"), F.col("rw").alias("word"))
    return spread(own, both_ways(links), [*ID, "start"]).join(ends, [*ID, "start", "word"]).select(*ID, F.col("start").alias("i"))


def displayed(links: DataFrame) -> DataFrame:
    """k, rank, shown: a linkage's links from left to right, one after the other."""
    row = F.struct("lw", "rw", F.concat_ws("-", F.col("lw").cast("string"), "name", F.col("rw").cast("string")).alias("t"))
    return links.groupBy(*ID).agg(F.array_sort(F.collect_list(row)).alias("r")).select(*ID, F.array_join(F.col("r.t"), " ").alias("shown"))


def word_disjuncts(links: DataFrame) -> DataFrame:
    """k, rank, w, disjunct: each word's connectors, those to the left from near to far, then
    those to the right."""
    left = links.select(*ID, F.col("rw").alias("w"), F.lit(0).alias("side"), (F.col("rw") - F.col("lw")).alias("far"), F.concat("name", F.lit("-")).alias("t"))
    right = links.select(*ID, F.col("lw").alias("w"), F.lit(1).alias("side"), (F.col("rw") - F.col("lw")).alias("far"), F.concat("name", F.lit("+")).alias("t"))
    rows = left.unionByName(right).groupBy(*ID, "w").agg(F.array_sort(F.collect_list(F.struct("side", "far", "t"))).alias("r"))
    return rows.select(*ID, "w", F.array_join(F.col("r.t"), " ").alias("disjunct"))


def bracketed(spans: DataFrame) -> DataFrame:
    """k, rank, tree: constituents as brackets around word numbers, wider ones outside."""
    opened = spans.groupBy(*ID, F.col("lw").alias("w")).agg(F.array_sort(F.collect_list(F.struct((-F.col("rw")).alias("o"), F.concat(F.lit("("), "label").alias("t")))).alias("r"))
    opened = opened.select(*ID, "w", F.array_join(F.col("r.t"), " ").alias("open"))
    closed = spans.groupBy(*ID, F.col("rw").alias("w")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    words = spans.groupBy(*ID).agg(F.min("lw").alias("a"), F.max("rw").alias("b")).select(*ID, F.explode(F.sequence("a", "b")).alias("w"))
    rows = words.join(opened, [*ID, "w"], "left").join(closed, [*ID, "w"], "left")
    text = F.concat(F.concat_ws(" ", "open", F.col("w").cast("string")), F.repeat(F.lit(")"), F.coalesce("n", F.lit(0))))
    return rows.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("w", text.alias("t")))).alias("r")).select(*ID, F.array_join(F.col("r.t"), " ").alias("tree"))
