"""What connectors of a sentence find in each other, by rows of words.

Connectors are equal to each other in all but their place if they are of one type: uc, lc, hd and dir.
A dictionary has few types. A word's row holds how many connectors of each type its clauses have,
and running sums and places over the words before it or behind it tell what they find there: rows grow with
words, where pairs of connectors grow with the square of a sentence's length."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weftline.functions.connectors import link_name, parsed, subtypes_match
from weftline.plans.lineage import cut
from weftline.sources import grammar

TYPE = ["uc", "lc", "hd", "dir"]


@dataclass(frozen=True)
class Places:
    """rows: keys, w and n<i>, the word's connectors of each type i; types: their parts; met: (i, j, name)
    of right-going and left-going types that match, and their link's name."""

    rows: DataFrame
    keys: list[str]
    types: list[Row]
    met: list[Row]

    def over(self, to: str, f: Callable[[Column], Column], value: Callable[[int], Column], types: Iterable[int]) -> dict[int, Column]:
        """f of the values of each type over the words before a word (-), or behind it (+)."""
        side = Window.partitionBy(*self.keys).orderBy("w" if to == "-" else -F.col("w")).rangeBetween(Window.unboundedPreceding, -1)
        return {i: f(value(i)).over(side) for i in types}

    def going(self, to: str) -> list[int]:
        return [i for i, t in enumerate(self.types) if t["dir"] == to]

    def answers(self, i: int) -> list[int]:
        """The types that type i may link to."""
        return sorted({r["j"] for r in self.met if r["i"] == i} | {r["i"] for r in self.met if r["j"] == i})


def places(words: DataFrame, keys: list[str], clauses: DataFrame | None = None, cutoff: float = 2.7) -> Places:
    """The connectors of words(keys, w, classname), of clauses as parsing.sentence_clauses() gives them."""
    spark = words.sparkSession
    c = (grammar.clauses(spark) if clauses is None else clauses).where(F.col("cost") <= cutoff).select("classname", parsed(F.col("disjunct")).alias("c"))
    many = lambda s: F.size(F.filter("c", lambda x: x["dir"] == s))
    c = cut(c.select("classname", many("-").alias("nl"), many("+").alias("nr"), F.inline("c")).groupBy("classname", "nl", "nr", *TYPE).agg(F.count(F.lit(1)).alias("n")))
    types = c.select(*TYPE).distinct().orderBy(*TYPE).collect()  # the dictionary's
    number = F.broadcast(spark.createDataFrame([(i, *t) for i, t in enumerate(types)], "i int, uc string, lc string, hd string, dir string"))
    part = lambda s, i: number.where(F.col("dir") == s).select(F.col("i").alias(i), "uc", F.col("lc").alias(f"{i}lc"), F.col("hd").alias(f"{i}hd"))
    heads = (F.col("ihd") == "") | (F.col("jhd") == "") | (F.col("ihd") != F.col("jhd"))
    met = part("+", "i").join(part("-", "j"), "uc").where(heads & subtypes_match(F.col("ilc"), F.col("jlc")))
    met = met.select("i", "j", link_name(F.col("uc"), F.col("ilc"), F.col("jlc")).alias("name")).collect()
    own = c.join(number, TYPE).groupBy("classname").agg(F.collect_list(F.struct("i", "nl", "nr", "n")).alias("own"))
    rows = words.select(*keys, "w", "classname").withColumn("last", F.max("w").over(Window.partitionBy(*keys)))
    rows = rows.join(F.broadcast(cut(own)), "classname").withColumn("own", F.filter("own", lambda x: (x["nl"] <= F.col("w")) & (x["nr"] <= F.col("last") - F.col("w"))))
    n = lambda i: F.aggregate(F.filter("own", lambda x: x["i"] == i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return Places(rows.select(*keys, "w", *(n(i).alias(f"n{i}") for i in range(len(types)))), keys, types, met)


def _totals(rows: DataFrame, sums: list[tuple[tuple, dict[str, Column]]], by: list[str]) -> DataFrame:
    """One row of aggregates over all rows, as a row (by, values) for each of sums."""
    made = [c.alias(f"{k}_{i}") for i, (_, cols) in enumerate(sums) for k, c in cols.items()]
    out = [F.struct(*(F.lit(v).alias(k) for k, v in zip(by, key, strict=True)), *(F.col(f"{k}_{i}").alias(k) for k in cols)) for i, (key, cols) in enumerate(sums)]
    return rows.agg(*made).select(F.inline(F.array(*out)))


def link_counts(p: Places) -> DataFrame:
    """name, n: the pairs of matching connectors of two words of a sentence, by link name."""
    before = p.over("-", F.sum, lambda i: F.col(f"n{i}"), p.going("+"))
    rows = p.rows.dropna(subset=p.keys).select("*", *(c.alias(f"b{i}") for i, c in before.items()))
    sums = [((r["name"],), {"n": F.sum(F.col(f"b{r['i']}") * F.col(f"n{r['j']}"))}) for r in p.met]
    return _totals(rows, sums, ["name"]).groupBy("name").agg(F.sum("n").alias("n")).where("n > 0")


def held_counts(p: Places) -> DataFrame:
    """uc, dir, n, n_held: connectors, and those of them that have a partner."""
    there = lambda i: F.col(f"n{i}") > 0
    # a right-going connector looks behind its word, at left-going ones
    seen = p.over("+", F.max, there, p.going("-")) | p.over("-", F.max, there, p.going("+"))
    rows = p.rows.select("*", *(F.coalesce(c, F.lit(False)).alias(f"h{i}") for i, c in seen.items()))
    known = F.lit(True)
    for k in p.keys:  # words of a null key are of no sentence
        known = known & F.col(k).isNotNull()
    held = lambda i: known & F.greatest(F.lit(False), F.lit(False), *(F.col(f"h{j}") for j in p.answers(i)))
    sums = [((t["uc"], t["dir"]), {"n": F.sum(f"n{i}"), "n_held": F.sum(F.when(held(i), F.col(f"n{i}")).otherwise(0))}) for i, t in enumerate(p.types)]
    return _totals(rows, sums, ["uc", "dir"]).groupBy("uc", "dir").agg(F.sum("n").alias("n"), F.sum("n_held").alias("n_held")).where("n > 0")


def nearest(p: Places) -> DataFrame:
    """uc, n, nearest, farthest, near_words, far_words: right-going connectors that have a partner, and how
    many words off their nearest and farthest ones stand."""
    there = lambda i: F.when(F.col(f"n{i}") > 0, F.col("w"))
    first, last = (p.over("+", f, there, p.going("-")) for f in (F.min, F.max))
    rows = p.rows.dropna(subset=p.keys).select("*", *(c.alias(f"f{i}") for i, c in first.items()), *(c.alias(f"l{i}") for i, c in last.items()))
    none, sums = F.lit(None).cast("int"), []
    for i in p.going("+"):
        n, own = F.col(f"n{i}"), F.col(f"n{i}") > 0
        near = F.when(own, F.least(none, none, *(F.col(f"f{j}") for j in p.answers(i))) - F.col("w"))
        far = F.when(own, F.greatest(none, none, *(F.col(f"l{j}") for j in p.answers(i))) - F.col("w"))
        sums.append(((p.types[i]["uc"],), {"n": F.sum(F.when(near.isNotNull(), n)), "nearest": F.min(near), "farthest": F.max(far), "near_words": F.sum(n * near), "far_words": F.sum(n * far)}))
    out = _totals(rows, sums, ["uc"]).groupBy("uc")
    return out.agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.sum("near_words").alias("near_words"), F.sum("far_words").alias("far_words")).where("n > 0")
