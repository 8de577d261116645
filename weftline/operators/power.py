"""Power pruning: clauses go whose connectors cannot all find partners at words in order.

A connector links at a distance between lo and hi words. What it finds there narrows lo and hi,
and hands them on: the next deeper connector of its side links at least one word farther, the one
before it at least one word nearer. A clause goes when an interval is empty."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import Parts, cut, grown, together
from weftline.sources.trees import Grammar

SIDE = ["name", "multi", "first", "lo", "hi"]


def bounded(clauses: DataFrame, keys: list[str], g: Grammar) -> DataFrame:
    """clauses(keys, w, last, d, connectors) as keys, w, d, dir, i (1: the nearest of its side),
    name, multi, first, lo, hi and n, the clause's number of connectors: one row for each. At
    first an interval is what the words of the sentence and the type's reach leave: each
    connector nearer by needs a word before it, each one farther off a word behind it. Rows of equal
    keys lie together; what follows keeps them so."""
    rows = together(clauses, keys).select(*keys, "w", "last", "d", F.size("connectors").alias("n"), F.posexplode("connectors").alias("at", "connector"))
    parts = g.leaves.select("connector", "name", "multi", "dir", "reach").distinct()
    side = Window.partitionBy(*keys, "w", "d", "dir").orderBy("at")
    rows = rows.join(parts, "connector").withColumn("i", F.row_number().over(side)).withColumn("__of", F.count(F.lit(1)).over(Window.partitionBy(*keys, "w", "d", "dir")))
    room = F.when(F.col("dir") == "-", F.col("w")).otherwise(F.col("last") - F.col("w"))
    rows = rows.select(*keys, "w", "d", "dir", "i", "name", "multi", (F.col("i") == 1).alias("first"), F.col("i").alias("lo"), F.least(room - F.col("__of") + F.col("i"), F.col("reach")).alias("hi"), "n")
    return _whole(rows, keys)


def _whole(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of clauses all of whose connectors are there, with intervals that hold a word."""
    have = F.count(F.lit(1)).over(Window.partitionBy(*keys, "w", "d"))
    return rows.where("lo <= hi").withColumn("have", have).where("have = n").drop("have")


def half_turn(rows: DataFrame, keys: list[str], g: Grammar, to: str, max_null: int = 0) -> DataFrame:
    """rows after every connector that goes `to` one side has met those that may answer it there.

    Equal connectors of a word with equal intervals meet once, whatever the number of clauses;
    an equi-join on sentence and name, with the two intervals as the residual. Of rows that lie
    together by sentence (lineage.together) nothing is shuffled. Two nearest
    connectors that link once only would cut off the words between them: they may link only as
    far apart as words may stay without links."""
    own, other = ("b", "a") if to == "-" else ("a", "b")
    asks = rows.where(F.col("dir") == to).select(*keys, "w", *SIDE).distinct()
    answers = rows.where(F.col("dir") != to).select(*keys, F.col("w").alias("ow"), F.col("name").alias(other), *(F.col(c).alias(f"o{c}") for c in SIDE[1:])).distinct()
    answers = answers.join(g.matching, other).select(*keys, F.col(own).alias("name"), "ow", *(f"o{c}" for c in SIDE[1:])).distinct()
    far = F.col("w") - F.col("ow") if to == "-" else F.col("ow") - F.col("w")
    shut = F.col("first") & F.col("ofirst") & ~F.col("multi") & ~F.col("omulti")
    met = asks.join(answers, [*keys, "name"]).withColumn("far", far).where("far between lo and hi and far between olo and ohi").where(~shut | (F.col("far") <= 1 + max_null))
    met = met.groupBy(*keys, "w", *SIDE).agg(F.min("far").alias("near"), F.max("far").alias("far")).withColumn("dir", F.lit(to))
    turned = F.col("dir") == to
    side = rows.join(met, [*keys, "w", "dir", *SIDE], "left").where(~turned | F.col("near").isNotNull())
    order = Window.partitionBy(*keys, "w", "d", "dir").orderBy("i")
    lo = F.max(F.col("near") - F.col("i")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i")
    hi = F.min(F.col("far") - F.col("i")).over(order.rowsBetween(0, Window.unboundedFollowing)) + F.col("i")
    side = side.withColumns({"lo": F.when(turned, lo).otherwise(F.col("lo")), "hi": F.when(turned, hi).otherwise(F.col("hi"))})
    return _whole(side.select(*rows.columns), keys)


def turned(rows: DataFrame, keys: list[str], g: Grammar, max_null: int = 0, last: DataFrame | None = None) -> DataFrame:
    """rows after a half turn to the left and one to the right. A half turn reads its rows three times,
    so that those of the first are made once and written, not worked out anew for each of the three.
    With last(keys, last), a sentence in which the first leaves more than max_null words without a
    clause goes before the second, as it would behind it: half turns only take away."""
    left = cut(half_turn(rows, keys, g, "-", max_null))
    if last is not None:
        left = left.join(_enough(left, keys, last, max_null).select(*keys), keys, "left_semi")
    return half_turn(together(left, keys), keys, g, "+", max_null)


def _enough(rows: DataFrame, keys: list[str], last: DataFrame, max_null: int) -> DataFrame:
    """keys and size (of all intervals together) of sentences with at most max_null words without a row."""
    size = rows.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("size"), F.size(F.collect_set("w")).alias("words"))
    return size.join(last, keys).where(F.col("words") + max_null > F.col("last")).select(*keys, "size")


def mandatory(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: the links between words a < b that every clause of one of the two words needs:
    each has a connector that can end at the other word only."""
    every = rows.groupBy(*keys, "w").agg(F.countDistinct("d").alias("all"))
    to = F.when(F.col("dir") == "-", F.col("w") - F.col("lo")).otherwise(F.col("w") + F.col("lo"))
    sure = rows.where("lo = hi").groupBy(*keys, "w", to.alias("v")).agg(F.countDistinct("d").alias("have")).join(every, [*keys, "w"]).where("have = all")
    return sure.select(*keys, F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def crossed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows without what would cross a mandatory link: a word under it links no farther than its
    ends, and a word beyond its ends to none of the words under it. A stabbing join of the links'
    intervals with the words; right where every word must be linked."""
    links = mandatory(rows, keys)
    spots = rows.select(*keys, "w", "dir", "lo", "hi").distinct()
    met = spots.join(links, keys)
    out = F.when(F.col("dir") == "-", F.col("w") - F.col("a")).otherwise(F.col("b") - F.col("w"))  # from under the link
    near = F.when(F.col("dir") == "-", F.col("w") - F.col("b")).otherwise(F.col("a") - F.col("w"))  # from outside, to its ends
    far = F.when(F.col("dir") == "-", F.col("w") - F.col("a")).otherwise(F.col("b") - F.col("w"))
    under = (F.col("w") > F.col("a")) & (F.col("w") < F.col("b"))
    # outside, the words at distances between near and far lie under the link
    hi = F.when(under, F.least("hi", out)).when((near > 0) & (F.col("hi") > near) & (F.col("hi") < far), near).otherwise(F.col("hi"))
    lo = F.when(~under & (near > 0) & (F.col("lo") > near) & (F.col("lo") < far), far).otherwise(F.col("lo"))
    cuts = met.select(*keys, "w", "dir", "lo", "hi", lo.alias("new_lo"), hi.alias("new_hi")).where("new_lo > lo or new_hi < hi")
    cuts = cuts.groupBy(*keys, "w", "dir", "lo", "hi").agg(F.max("new_lo").alias("new_lo"), F.min("new_hi").alias("new_hi"))
    new = rows.join(cuts, [*keys, "w", "dir", "lo", "hi"], "left").withColumns({"lo": F.coalesce("new_lo", "lo"), "hi": F.coalesce("new_hi", "hi")})
    return _whole(new.select(*rows.columns), keys)


def pruned(clauses: DataFrame, keys: list[str], g: Grammar, max_null: int = 0, cross: bool = False) -> DataFrame:
    """The clauses(keys, w, last, d, connectors, ...) that stay: turns to the left and to the right
    until intervals and clauses stay as they are. A sentence in which a turn changes nothing takes
    no part in the next, and one in which more than max_null words have no clause goes. No clause
    goes that a linkage with so many unlinked words uses. With cross, for linkages of all words,
    each turn also takes away what would cross mandatory links."""
    if cross and max_null:
        raise ValueError("links are mandatory only where all words are linked")
    rows, last = together(cut(bounded(clauses, keys, g)), keys), grown(clauses.groupBy(*keys).agg(F.first("last").alias("last")))
    enough = _enough(rows, keys, last, max_null).withColumnRenamed("size", "had")
    rows, done = cut(rows.join(enough, keys)), Parts(clauses.sparkSession)
    for at in count(1):
        rows = together(rows, keys)
        turn = together(cut(turned(rows.drop("had"), keys, g, max_null, last)), keys)
        turn = together(cut(crossed(turn, keys)), keys) if cross else turn
        had = rows.select(*keys, "had").distinct()
        enough = cut(_enough(turn, keys, last, max_null).join(had, keys).select(*keys, "size", "had"))
        settled = turn.join(enough.where("size = had"), keys, "left_semi").select(*keys, "w", "d").distinct()
        done.add(settled, at)
        rows = cut(turn.join(enough.where("size < had").select(*keys, F.col("size").alias("had")), keys))
        if rows.isEmpty():
            return clauses.join(done.read(), [*keys, "w", "d"], "left_semi")
