"""Word pairs: counts over a corpus, their mutual information as costs, and a sentence's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import grown

#: What a link costs that the table of pairs does not know.
ANY_COST = 4.5


def sentence_pairs(words: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """keys, lw, rw, l, r: the pairs of a sentence's words(keys, w, word) up to reach words
    apart: an equi-join on the place, each word sent to the places before it."""
    a = words.select(*keys, F.col("w").alias("lw"), F.col("word").alias("l"), F.explode(F.sequence(F.col("w") + 1, F.col("w") + reach)).alias("rw"))
    return a.join(words.select(*keys, F.col("w").alias("rw"), F.col("word").alias("r")), [*keys, "rw"]).select(*keys, "lw", "rw", "l", "r")


def gathered(sents: DataFrame, keys: list[str]) -> DataFrame:
    """sents(keys, words: an array) as keys and lists: the arrays of each sentence, one as a rule.
    Null keys are of no sentence."""
    return sents.dropna(subset=keys).groupBy(*keys).agg(F.collect_list("words").alias("lists"))


def listed(reach: int = 3) -> Column:
    """The pairs (lw, rw, l, r) of a gathered sentence, as sentence_pairs() has them, by slices of its
    arrays: no word is sent to another."""
    slices = f"transform(a, (x, i) -> transform(slice(b, i + 2, {reach}), (y, j) -> struct(i + 1 as lw, i + j + 2 as rw, x as l, y as r)))"
    return F.expr(f"flatten(flatten(transform(lists, a -> flatten(transform(lists, b -> {slices})))))")


def counts(pairs: DataFrame, least: int = 2) -> DataFrame:
    """l, r, n of the pairs seen often enough."""
    return pairs.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def costs(n: DataFrame) -> DataFrame:
    """l, r, n and cost: minus the pointwise mutual information in bits, by the table's sums. The
    table is made once and shuffled to its joins."""
    n = grown(n)
    left = n.groupBy("l").agg(F.sum("n").alias("nl"))
    right = n.groupBy("r").agg(F.sum("n").alias("nr"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    cost = -F.log2(F.col("n") * F.col("total") / (F.col("nl") * F.col("nr")))
    return n.join(left, "l").join(right, "r").join(F.broadcast(total)).select("l", "r", "n", F.round(cost, 6).alias("cost"))


def local(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """A sentence's pairs with what the table(l, r, cost) makes them cost, and any others at
    the fixed cost, told apart by known."""
    out = pairs.join(table.select("l", "r", "cost"), ["l", "r"], "left")
    return out.withColumn("known", F.col("cost").isNotNull()).withColumn("cost", F.coalesce("cost", F.lit(ANY_COST)))


def local_sums(sents: DataFrame, keys: list[str], reach: int = 3, least: int = 2) -> DataFrame:
    """keys, n, n_known and cost of each gathered sentence's pairs, by the table of all sentences'.
    Pairs that the table does not know have one cost, so that a sentence's number of them is enough
    and only known ones are sent back to it. Costs have six decimals and are added up as whole numbers
    of millionths, so that no order of rows changes a sum. By the size of the files that they come
    from, pairs would look small enough to be sent whole through the driver: they are shuffled."""
    p = sents.select(*keys, F.inline(listed(reach)))
    met = p.hint("merge").select(*keys, "l", "r").join(costs(counts(p, least)).select("l", "r", "cost"), ["l", "r"])
    none = F.lit(0).cast("long")
    rows = sents.select(*keys, F.size(listed(reach)).cast("long").alias("n"), none.alias("n_known"), none.alias("cost")).where("n > 0")
    rows = rows.unionByName(met.select(*keys, none.alias("n"), F.lit(1).cast("long").alias("n_known"), F.round(F.col("cost") * 1e6).cast("long").alias("cost")))
    out = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "n_known", "cost")))
    return out.withColumn("cost", (F.col("cost") + (F.col("n") - F.col("n_known")) * round(ANY_COST * 1e6)) / 1e6)
