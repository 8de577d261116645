"""Constituents of linkages: spans of words that links open, what they leave over, overlaps
repaired, and the nested spans drawn in three styles.

links(k, rank, i, lw, rw, name): link i of linkage rank of sentence k. words(k, w, word). A null in
a key or an end joins nothing; repeated rows change nothing; without links there are no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.linkages import ID, both_ways, spread
from weftline.plans.lineage import cut

# Fixed values, a small set of our own: the type of link that opens a constituent, the side that it takes, and its label.
OPENS = [("W", "right", "S"), ("S", "right", "VP"), ("O", "right", "NP"), ("J", "right", "NP"), ("M", "right", "PP"), ("MV", "right", "PP"), ("M", "left", "NP")]
# The types of links that a left side takes along.
TAKEN = ["D"]
# A constituent, the type that opened it, one that holds it, and the label of what is left of the latter.
RESTS = [("VP", "S", "S", "NP"), ("PP", "M", "NP", "NP")]
# Which of constituents of equal words holds the others.
ORDER = ["S", "VP", "PP", "NP"]
#: Words that no constituent ends with where that makes it cross another.
MARK = r"^[,;:.]+$"
SPAN = [*ID, "label", "lw", "rw"]


def _type(name: str | Column) -> Column:
    return F.regexp_extract(name, "^[A-Z]+", 0)


def opened(links: DataFrame, opens: list[tuple[str, str, str]] = OPENS, taken: list[str] = TAKEN) -> DataFrame:
    """SPAN and by (the type that opened it). A right side is what the link's right word reaches
    without passing its left one, right of that; a left side has the left word besides, and what
    that reaches by links of the types that it takes, but for the wall."""
    spark = links.sparkSession
    rules = F.broadcast(spark.createDataFrame(opens, "by string, side string, label string"))
    heads = cut(links.select(*ID, F.col("i").alias("start"), F.col("lw").alias("left"), F.col("rw").alias("right"), _type("name").alias("by")).distinct().join(rules, "by"))
    starts = heads.select(*ID, "start", "left", "right").distinct()
    own = starts.select(*ID, "start", F.col("right").alias("word"), F.col("start").alias("not_i"), F.col("left").alias("not_word"))
    reached = spread(own, both_ways(links), [*ID, "start"]).join(starts, [*ID, "start"]).where("word > left")
    back = heads.where("side = 'left'").select(*ID, "start", F.col("left").alias("word"), F.col("start").alias("not_i"), F.col("right").alias("not_word"))
    along = spread(back.distinct(), both_ways(links.where(_type("name").isin(taken))), [*ID, "start"]).where("word > 0")
    extents = reached.groupBy(*ID, "start").agg(F.min("word").alias("lw"), F.max("word").alias("rw"))
    far = along.groupBy(*ID, "start").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    rows = heads.join(extents, [*ID, "start"]).join(far, [*ID, "start"], "left")
    wide = lambda own, more: F.when(F.col("side") == "left", more).otherwise(F.col(own)).alias(own)
    return rows.select(*ID, "label", wide("lw", F.least("lw", "first")), wide("rw", F.greatest("rw", "last")), "by").distinct()


def rests(spans: DataFrame, rules: list[tuple[str, str, str, str]] = RESTS) -> DataFrame:
    """SPAN of what parts leave of the narrowest constituent that holds them and ends, or else
    begins, where they do. Holders are found by the end that both have, not by pairs of spans."""
    r = F.broadcast(spans.sparkSession.createDataFrame(rules, "label string, by string, holder string, rest string"))
    parts = spans.join(r, ["label", "by"]).select(*ID, F.col("lw").alias("a"), F.col("rw").alias("b"), F.col("holder").alias("label"), "rest").distinct()
    whole = spans.select(*SPAN).distinct()
    right = parts.join(whole.withColumnRenamed("rw", "b"), [*ID, "label", "b"]).where("lw < a").select(*ID, "a", "b", "rest", "label", (F.col("b") - F.col("lw")).alias("width"), F.lit(0).alias("side"), F.col("lw").alias("x"), (F.col("a") - 1).alias("y"))
    left = parts.join(whole.withColumnRenamed("lw", "a"), [*ID, "label", "a"]).where("rw > b").select(*ID, "a", "b", "rest", "label", (F.col("rw") - F.col("a")).alias("width"), F.lit(1).alias("side"), (F.col("b") + 1).alias("x"), F.col("rw").alias("y"))
    least = right.unionByName(left).groupBy(*ID, "a", "b", "rest", "label").agg(F.min(F.struct("width", "side", "x", "y")).alias("m"))
    return least.select(*ID, F.col("rest").alias("label"), F.col("m.x").alias("lw"), F.col("m.y").alias("rw")).distinct()


def nested(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """SPAN, none of which cross. Of two that cross, the right one gives up a mark(k, w) that it
    ends with; where it has none, the left one begins where the right one does. All crossings of
    a linkage are met in one turn; only linkages that had one go into the next, and each turn
    narrows a span, so that turns end. Spans without words go."""
    left, done = cut(spans.select(*SPAN).where("lw <= rw").distinct()), None
    ends = marks.select("k", F.col("w").alias("rw2"), F.lit(True).alias("mark")).distinct()
    while True:
        other = left.select(*ID, F.col("label").alias("label2"), F.col("lw").alias("lw2"), F.col("rw").alias("rw2"))
        met = left.join(other, ID).where("lw < lw2 and lw2 <= rw and rw < rw2").join(ends, ["k", "rw2"], "left")
        met = cut(met)
        busy = met.select(*ID).distinct()
        calm = left.join(busy, ID, "left_anti")
        done = calm if done is None else done.unionByName(calm)
        if met.isEmpty():
            return done
        less = met.where("mark").select(*ID, F.col("label2").alias("label"), F.col("lw2").alias("lw"), F.col("rw2").alias("rw"), F.lit(1).alias("less")).distinct()
        to = met.where("mark is null").groupBy(*SPAN).agg(F.min("lw2").alias("to"))
        new = left.join(busy, ID, "left_semi").join(less, SPAN, "left").join(to, SPAN, "left")
        new = new.select(*ID, "label", F.coalesce("to", "lw").alias("lw"), (F.col("rw") - F.coalesce("less", F.lit(0))).alias("rw"))
        left = cut(new.where("lw <= rw").distinct())


def constituents(links: DataFrame, words: DataFrame) -> DataFrame:
    """SPAN of each linkage's constituents, nested."""
    spans = cut(opened(links))
    return nested(spans.select(*SPAN).unionByName(rests(spans)), words.where(F.col("word").rlike(MARK)))


def drawn(spans: DataFrame, words: DataFrame) -> DataFrame:
    """k, rank, n (constituents), depth (of the deepest), line, flat and lines: nested spans around
    their words on one line, with labels at both ends, and each on a line of its own, two spaces
    further in than what holds it. Words beside all spans stand too; the wall, word 0, does not."""
    order = F.coalesce(F.nullif(F.array_position(F.lit(ORDER), F.col("label")), F.lit(0)), F.lit(len(ORDER) + 1)).cast("int")
    spans = spans.select(*SPAN, order.alias("o")).distinct()
    # at each word: what opens there, the widest first; the word; what closes, the narrowest first
    begin = spans.select(*ID, F.col("lw").alias("w"), F.lit(0).alias("phase"), (-F.col("rw")).alias("p"), F.col("o").alias("q"), F.col("label").alias("t"))
    finish = spans.select(*ID, F.col("rw").alias("w"), F.lit(2).alias("phase"), (-F.col("lw")).alias("p"), (-F.col("o")).alias("q"), F.col("label").alias("t"))
    inner = words.where("w > 0").join(spans.select(*ID).distinct(), "k").select(*ID, "w", F.lit(1).alias("phase"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("word").alias("t"))
    events = begin.unionByName(finish).unionByName(inner)
    before = Window.partitionBy(*ID).orderBy("w", "phase", "p", "q", "t").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.when(F.col("phase") == 0, 1).when(F.col("phase") == 2, -1).otherwise(0)).over(before), F.lit(0)).cast("int")
    events = events.withColumn("depth", depth)
    by_phase = lambda a, b, c: F.when(F.col("phase") == 0, a).when(F.col("phase") == 1, b).otherwise(c)
    space, t = F.lit(" "), F.col("t")
    line = by_phase(F.concat(F.lit(" ("), t), F.concat(space, t), F.lit(")"))
    flat = by_phase(F.concat(F.lit(" ["), t), F.concat(space, t), F.concat(space, t, F.lit("]")))
    new_line = F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.col("depth")))
    lines = by_phase(F.concat(new_line, F.lit("("), t), F.concat(space, t), F.lit(")"))
    row = F.struct("w", "phase", "p", "q", "t", line.alias("line"), flat.alias("flat"), lines.alias("lines"))
    rows = events.groupBy(*ID).agg(F.array_sort(F.collect_list(row)).alias("r"), F.sum((F.col("phase") == 0).cast("long")).alias("n"), F.max(F.when(F.col("phase") == 0, F.col("depth") + 1)).alias("depth"))
    text = lambda c: F.regexp_replace(F.array_join(F.col(f"r.{c}"), ""), r"^\s+", "").alias(c)
    return rows.select(*ID, "n", "depth", text("line"), text("flat"), text("lines"))
