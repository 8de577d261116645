"""Sentences, tokens and dictionary lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import grown
from weftline.sources import grammar

WALL = "LEFT-WALL"
SENTENCE_END = r"[.!?\n]+"
STRIPPED = r"^[,;:\"'()\[\]]+|[,;:\"'()\[\]]+$"


def sentences(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts(keys, text) as keys, s (number in its text) and sentence, those with a word."""
    parts = F.posexplode(F.split("text", SENTENCE_END)).alias("s", "sentence")
    return texts.select(*keys, parts).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def tokens(sents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w (0: the wall) and word of every token, punctuation stripped off its ends."""
    return sents.select(*keys, F.posexplode(F.concat(F.array(F.lit(WALL)), word_list())).alias("w", "word"))


def word_list() -> Column:
    """The words of a sentence in order, as tokens() has them behind the wall."""
    return F.filter(F.transform(F.split("sentence", r"\s+"), lambda t: F.regexp_replace(t, STRIPPED, "")), lambda t: t != "")


def lookup(toks: DataFrame, keys: list[str]) -> DataFrame:
    """toks with classname and how: dict for the dictionary's words as they stand or in lower
    case, regex for the first pattern that matches, unknown for the rest, which are nouns.

    The dictionary is a table of fixed size, broadcast; patterns become one expression."""
    spark = toks.sparkSession
    words = F.broadcast(grammar.morphemes(spark).select(F.col("morpheme").alias("__m"), F.col("classname").alias("__c")))
    key = F.when(F.col("word") == WALL, F.col("word")).otherwise(F.lower("word"))
    found = toks.withColumn("__k", key).join(words, F.col("__k") == F.col("__m"), "left")
    rule = F.coalesce(*(F.when(F.col("__k").rlike(p), F.lit(c)) for _, _, p, c in sorted(grammar.PATTERNS)))
    how = F.when(F.col("__c").isNotNull(), "dict").when(rule.isNotNull(), "regex").otherwise("unknown")
    return found.select(*keys, "w", "word", F.coalesce("__c", rule, F.lit("noun")).alias("classname"), how.alias("how"))


def stems(toks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w, stem and suffix of every way to split a suffix of the grammar's list off a
    word: an equi-join on the word's last letters with a table of fixed size."""
    rows = [(x,) for x in grammar.SUFFIXES]
    suffixes = F.broadcast(toks.sparkSession.createDataFrame(rows, "suffix string"))
    sizes = F.explode(F.array(*(F.lit(n) for n in sorted({len(x) for x in grammar.SUFFIXES}))))
    cut = toks.select(*keys, "w", F.lower("word").alias("k"), sizes.alias("n")).where(F.length("k") >= F.col("n") + grammar.STEM_LETTERS)
    cut = cut.select(*keys, "w", F.expr("substring(k, 1, length(k) - n)").alias("stem"), F.expr("right(k, n)").alias("suffix"))
    return cut.join(suffixes, "suffix").select(*keys, "w", "stem", "suffix")


#: The key of a kind of sentences.
KIND = ["kind"]


@dataclass(frozen=True)
class Kinds:
    """Sentences by kind. What a grammar of classes makes of a sentence follows from the classes of
    its words in order, so that sentences that are equal in them are one kind, worked out once.

    each: kind, classes(w, classname) and n, its sentences; members: keys and classes of each sentence."""

    keys: list[str]
    each: DataFrame
    members: DataFrame

    def words(self) -> DataFrame:
        """kind, w, classname."""
        return self.each.select("kind", F.inline("classes"))

    def counts(self) -> DataFrame:
        """kind, n: the sentences of each kind."""
        return self.each.select("kind", "n")

    def spread(self, found: DataFrame) -> DataFrame:
        """found(kind, ...) for every sentence: keys in place of kind."""
        rest = [c for c in found.columns if c != "kind"]
        return found.join(self.each.select("kind", "classes"), "kind").join(self.members, "classes").select(*self.keys, *rest)


def kinds(words: DataFrame, keys: list[str]) -> Kinds:
    """The kinds of the sentences of words(keys, w, classname). Words of a null key are of no
    sentence; a word that stands twice stands twice in its kind."""
    row = F.struct("w", "classname")
    members = grown(words.dropna(subset=keys).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("classes")))
    each = grown(members.groupBy("classes").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.monotonically_increasing_id()))
    return Kinds(keys, each, members)
