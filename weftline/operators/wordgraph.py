"""The word graph of texts: alternatives of tokens, issued until none is new, and its slots.

What a token may be split into follows from its letters (and from the words of the corpus), not
from its place, so that the graph of each different token is worked out once and texts only add
their tokens' graphs up, end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut

# Marks that come off either end, marks that split a token, units behind numbers, suffixes that split off words.
MARKS = r".,;:!?\"'()\[\]"
LEFT, RIGHT = rf"^([{MARKS}]+)([^{MARKS}].*)$", rf"^(.*[^{MARKS}])([{MARKS}]+)$"
MIDDLE, PIECES = r"[^-/][-/]+[^-/]", r"([^-/]+|[-/])"
UNIT = r"^([0-9]+(?:[.,][0-9]+)*)(kg|km|cm|mm|th|st|nd|rd|pm|am|%)$"
SUFFIX = r"^(.{3,})(ing|ed|ly|es|ment|tion|ung|en)$"


def tokens(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts(keys, text) as keys, i (from 0) and token: what white space sets apart. Null and
    empty texts have none."""
    split = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    return texts.select(*keys, F.posexplode(split).alias("i", "token"))


def alternatives(types: DataFrame, known: DataFrame) -> DataFrame:
    """types(token) as token, whole (whether it is a word as it stands) and parts, one row for
    each alternative: marks come off the left end, or else off the right one, each for itself; a
    number gives up its unit; hyphens and slashes split; a capital gives way to a small letter; a
    suffix splits off where what is left is a known(word) one. Marks alone are a word."""
    t = F.col("token")
    part = lambda p, i: F.regexp_extract(t, p, i)
    left, right, unit = t.rlike(LEFT), t.rlike(RIGHT), t.rlike(UNIT)
    each = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    strip = F.when(left, F.concat(each(part(LEFT, 1), "(.)"), F.array(part(LEFT, 2)))).when(right, F.concat(F.array(part(RIGHT, 1)), each(part(RIGHT, 2), "(.)"))).when(unit, F.array(part(UNIT, 1), part(UNIT, 2)))
    plain = ~left & ~right & ~unit
    middle = F.when(plain & t.rlike(MIDDLE), each(t, PIECES))
    lower = F.when(plain & ~t.rlike(MIDDLE) & (F.lower(t) != t), F.array(F.lower(t)))
    stem = F.when(plain & t.rlike(SUFFIX), F.array(part(SUFFIX, 1), F.concat(F.lit("="), part(SUFFIX, 2))))
    rows = types.select("token", plain.alias("whole"), F.array(strip, middle, lower).alias("all"), stem.alias("stem"))
    found = rows.select("token", "stem").where("stem is not null").join(known.select(F.col("word").alias("k")).distinct(), F.expr("stem[0] = k"), "left_semi").select("token", F.array("stem").alias("more"))
    rows = rows.join(found, "token", "left")
    every = F.filter(F.concat("all", F.coalesce("more", F.expr("cast(array() as array<array<string>>)"))), lambda x: x.isNotNull())
    return rows.select("token", "whole", F.explode_outer(every).alias("parts"))


def issued(types: DataFrame, known: DataFrame) -> DataFrame:
    """token, whole, parts of the types(token) and of all that they may be split into: the parts
    that no turn has seen before are the next turn's tokens. A row without parts is a token that
    has no alternative. As many turns as alternatives nest."""
    new, seen, out = cut(types.select("token").distinct()), None, None
    while not new.isEmpty():
        rows = cut(alternatives(new, known))
        out = rows if out is None else out.unionByName(rows)
        seen = new if seen is None else seen.unionByName(new)
        new = cut(rows.select(F.explode("parts").alias("token")).distinct().join(seen, "token", "left_anti"))
    return types.select("token", F.lit(True).alias("whole"), F.expr("cast(array() as array<string>)").alias("parts")).limit(0) if out is None else out


def flattened(rows: DataFrame) -> DataFrame:
    """issued rows as token, slots (words on the longest path), words (all in its graph), edges
    (between them), heads and tails (words that may come first, and last).

    Sums over a token's alternatives of what their parts have, from the inside out: a token waits
    until all its parts are done; there are as many turns as alternatives nest."""
    alt = cut(rows.withColumn("alt", F.monotonically_increasing_id()))
    whole = lambda: F.col("whole").cast("long")
    one = alt.where("parts is null").select("token", F.lit(1).cast("long").alias("slots"), whole().alias("words"), F.lit(0).cast("long").alias("edges"), whole().alias("heads"), whole().alias("tails"))
    done, left = cut(one), cut(alt.where("parts is not null"))
    items = cut(left.select("alt", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part")))
    while not left.isEmpty():
        have = items.join(done.withColumnRenamed("token", "part"), "part")
        after = F.lead("heads").over(Window.partitionBy("alt").orderBy("i"))
        sums = have.withColumn("join", F.coalesce(F.col("tails") * after, F.lit(0))).groupBy("alt", "n").agg(
            F.count(F.lit(1)).alias("got"), F.sum("slots").alias("slots"), F.sum("words").alias("words"), F.sum(F.col("edges") + F.col("join")).alias("edges"), F.min_by("heads", "i").alias("heads"), F.max_by("tails", "i").alias("tails")
        ).where("got = n")
        met = left.join(sums.drop("n", "got"), "alt", "left").groupBy("token", "whole").agg(
            F.count(F.lit(1)).alias("all"), F.count("slots").alias("ready"), F.max("slots").alias("slots"), *(F.sum(c).alias(c) for c in ("words", "edges", "heads", "tails"))
        ).where("all = ready")
        new = cut(met.select("token", F.greatest("slots", F.lit(1)).alias("slots"), (F.col("words") + whole()).alias("words"), "edges", (F.col("heads") + whole()).alias("heads"), (F.col("tails") + whole()).alias("tails")))
        done = done.unionByName(new)
        left = cut(left.join(new.select("token"), "token", "left_anti"))
    return done


def bare() -> Column:
    """Whether a token has no alternative by its letters: its graph is one word, whatever others are."""
    t = F.col("token")
    return ~t.rlike(LEFT) & ~t.rlike(RIGHT) & ~t.rlike(UNIT) & ~t.rlike(MIDDLE) & ~t.rlike(SUFFIX) & (F.lower(t) == t)


def graphs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts(keys, text) as keys, tokens, slots, words and edges of each text's graph. A text
    without tokens gives no row; texts of equal keys are one, so keys must tell texts apart.

    A bare token is one word, with one edge to another beside it. Texts count their tokens as if all
    were bare, and only the others meet the table of graphs, to tell what they add to that."""
    types = cut(tokens(texts, keys).select("token").distinct())
    table = cut(flattened(issued(types, types.select(F.col("token").alias("word")))).where(~bare()))
    split = texts.select(*keys, F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("t")).select(*keys, F.size("t").alias("n"), "t")
    rows = split.select(*keys, "n", F.posexplode("t").alias("i", "token")).where(~bare()).join(table, "token")
    order = Window.partitionBy(*keys).orderBy("i")
    beside = lambda at, step: F.coalesce(at == F.col("i") + step, F.lit(False))
    follows, comes = beside(F.lead("i").over(order), 1), beside(F.lag("i").over(order), -1)
    after = F.when(F.col("i") == F.col("n") - 1, 0).otherwise(F.col("tails") * F.when(follows, F.lead("heads").over(order)).otherwise(1) - 1)
    before = F.when((F.col("i") == 0) | comes, 0).otherwise(F.col("heads") - 1)  # a token before it that is not bare tells its own edges
    more = rows.select(*keys, F.lit(0).cast("long").alias("tokens"), (F.col("slots") - 1).alias("slots"), (F.col("words") - 1).alias("words"), (F.col("edges") + after + before).alias("edges"))
    more = more.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tokens", "slots", "words", "edges")))
    n = F.col("n").cast("long")
    own = split.where("n > 0").select(*keys, n.alias("tokens"), n.alias("slots"), n.alias("words"), (n - 1).alias("edges"))
    return own.unionByName(more).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tokens", "slots", "words", "edges")))
