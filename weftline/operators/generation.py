"""The inverse query: sentences of the grammar, by parsing words that may be of any class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import parsing
from weftline.operators.sentences import WALL
from weftline.sources import grammar


def generated(spark: SparkSession, lengths: list[int], most: int) -> DataFrame:
    """n_words, rank, cost and disjuncts: of each length the best linkages, as many as asked
    for, with the clause of each word, the wall left out."""
    at = spark.createDataFrame([(n, w) for n in lengths for w in range(n + 1)], "n_words int, w int")
    classes = grammar.clauses(spark).select("classname").distinct()
    words = at.join(classes, (F.col("w") == 0) == (F.col("classname") == WALL))  # as many rows as classes for each place
    c = parsing.pruned(parsing.sentence_clauses(words, ["n_words"]), ["n_words"])
    found = parsing.linkages(c, ["n_words"], most)
    names = c.select("n_words", "w", "d", F.concat_ws(": ", "classname", "disjunct").alias("disjunct"))
    rows = found.select("n_words", "rank", "cost", F.explode("clauses").alias("x")).select("n_words", "rank", "cost", "x.*").where("w > 0")
    rows = rows.join(names, ["n_words", "w", "d"]).groupBy("n_words", "rank", "cost").agg(F.array_sort(F.collect_list(F.struct("w", "disjunct"))).alias("x"))
    return rows.select("n_words", "rank", "cost", F.array_join(F.col("x.disjunct"), " | ").alias("disjuncts"))
