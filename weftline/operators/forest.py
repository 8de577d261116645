"""The packed forest of sentences' linkages, and linkages drawn from it by weight.

A node is a set of part linkages that all fit the same surroundings: the root of a sentence, a span
between two words (the chart's state), or one half of a span (with a link between its end words or
without). A choice is one way to make a node, out of none, one or two smaller nodes. What linkages
have in common stands once, so that the forest stays small where linkages are many.

A node's children are spans of its own length or shorter ones, so that lengths are taken from the
longest to the shortest, all sentences at once, and each turn reads the choices of its length alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.parsing import Chart, Payload, charted, links
from weftline.plans.lineage import Parts, cut, grown

ROOT = "root"
#: What a choice tells: the link that it makes, or the word and clause that it takes and their cost.
TOLD = ["lw", "rw", "name", "w", "d", "cost"]


def weighted(beta: float) -> Payload:
    """exp(-beta * cost) summed over linkages: their number where beta is 0, exact up to 2^53."""
    return Payload(lambda w, d, cost: F.exp(-F.lit(float(beta)) * cost), lambda a, b: a * b, lambda n, lw, rw, name: n, lambda n: F.sum(n))


@dataclass(frozen=True)
class Forest:
    """choices: keys, node, length, half (whether the node is a half of a span), kids, what the
    choice tells (TOLD), its weight, and where it lies in its node's weight (lo, hi, all).
    roots: keys, nulls, length, all (the weight of all linkages)."""

    keys: list[str]
    roots: DataFrame
    choices: DataFrame
    longest: int


def _id(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


def _span() -> Column:
    return _id("S", "lw", "rw", "ld", "rd", "l", "r", "nulls")


def _half(kind: str, used: str, own: bool) -> Column:
    return _id(kind, "lw", "rw", "ld", "rd", used, "nulls", F.lit(own))


def _choices(c: Chart, spans: DataFrame, keys: list[str], beta: float) -> DataFrame:
    """keys, node, length, half, kids, TOLD and weight of every choice over the spans."""
    no = {"lw": "int", "rw": "int", "name": "string", "w": "int", "d": "int", "cost": "double"}
    length = (F.col("rw") - F.col("lw")).cast("int").alias("length")

    def rows(df: DataFrame, node: Column, half: bool, kids: list[Column], weight: Column, **told: Column) -> DataFrame:
        made = [(told[k] if k in told else F.lit(None)).cast(t).alias(k) for k, t in no.items()]
        return df.select(*keys, node.alias("node"), length, F.lit(half).alias("half"), (F.array(*kids) if kids else F.expr("cast(array() as array<string>)")).alias("kids"), *made, weight.cast("double").alias("weight"))

    cost = c.nodes.select(*keys, F.col("w").alias("lw"), F.col("d").alias("ld"), "cost")
    near = spans.where("l = 0 and r = 0 and rw - lw - 1 = nulls").join(cost, [*keys, "lw", "ld"])
    out = rows(near, _span(), False, [], F.exp(-F.lit(float(beta)) * F.col("cost")), w=F.col("lw"), d=F.col("ld"), cost=F.col("cost"))

    # halves: with a link between their end words, all of one end word's inner side used up
    made = grown(links(spans, c.pairs, c.sizes, keys))
    link = {"lw": F.col("lw"), "rw": F.col("rw"), "name": F.col("name")}
    left = rows(made.where("ri = nl"), _half("L", "li", True), True, [_span()], F.col("n"), **link)
    right = rows(made.where("li = nr"), _half("R", "ri", True), True, [_span()], F.col("n"), **link)
    # or without one: the word between has nothing to do with that end word
    nr = c.sizes.select(*keys, F.col("w").alias("lw"), F.col("d").alias("ld"), "nr")
    nl = c.sizes.select(*keys, F.col("w").alias("rw"), F.col("d").alias("rd"), "nl")
    left_open = spans.join(nl, [*keys, "rw", "rd"]).where("r = nl and l = 0")
    right_open = spans.join(nr, [*keys, "lw", "ld"]).where("l = nr")
    halves = left.unionByName(rows(left_open, _half("L", "l", False), True, [_span()], F.col("n")))
    halves = halves.unionByName(right).unionByName(rows(right_open, _half("R", "r", False), True, [_span()], F.col("n")))
    out = out.unionByName(halves)

    # spans of two halves that meet in a word between; not both halves without a link
    side = lambda df, used, own, kind: df.groupBy(*keys, "lw", "rw", "ld", "rd", F.col(used).alias("used"), "nulls").agg(F.sum("n").alias("n")).withColumn("own", F.lit(own)).withColumn("id", _id(kind, "lw", "rw", "ld", "rd", "used", "nulls", "own"))
    a = side(made.where("ri = nl"), "li", True, "L").unionByName(side(left_open, "l", False, "L"))
    b = side(made.where("li = nr"), "ri", True, "R").unionByName(side(right_open, "r", False, "R"))
    a = a.select(*keys, "lw", F.col("rw").alias("m"), "ld", F.col("rd").alias("md"), F.col("used").alias("l"), F.col("nulls").alias("u1"), F.col("n").alias("n1"), F.col("own").alias("own1"), F.col("id").alias("id1"))
    b = b.select(*keys, F.col("lw").alias("m"), "rw", F.col("ld").alias("md"), "rd", F.col("used").alias("r"), F.col("nulls").alias("u2"), F.col("n").alias("n2"), F.col("own").alias("own2"), F.col("id").alias("id2"))
    met = a.join(b, [*keys, "m", "md"]).where("own1 or own2").withColumn("nulls", F.col("u1") + F.col("u2"))
    return out.unionByName(rows(met, _span(), False, [F.col("id1"), F.col("id2")], F.col("n1") * F.col("n2")))


def forest(clauses: DataFrame, keys: list[str], beta: float = 0.0, max_null: int = 0) -> Forest:
    """The packed forest of the linkages of clauses(keys, w, last, d, cost, left, right) with as few
    unlinked words as allow one, max_null at most: nodes that a whole linkage uses, and no others.
    Sentences without a linkage have no rows, and clauses without rows an empty forest. A choice
    that stands in clauses twice must differ in d."""
    c = charted(clauses, keys, weighted(beta), max_null)
    tops = grown(c.whole(keys))
    least = Window.partitionBy(*keys)
    tops = tops.withColumn("least", F.min("nulls").over(least)).where("nulls = least")
    one = tops.select(*keys, F.lit(ROOT).alias("node"), (F.col("rw") - F.col("lw") + 1).cast("int").alias("length"), F.lit(False).alias("half"), F.array(_span()).alias("kids"), F.col("n").cast("double").alias("weight"), "nulls")
    top = grown(one)
    kept = top.select(*keys).distinct()
    every = _choices(c, grown(c.spans.join(kept, keys, "left_semi")), keys, beta)
    nothing = [F.lit(None).cast(every.schema[t].dataType).alias(t) for t in TOLD]
    every = grown(every.unionByName(top.select(*keys, "node", "length", "half", "kids", *nothing, "weight")).sortWithinPartitions("length"))
    roots = top.groupBy(*keys).agg(F.min("nulls").alias("nulls"), F.max("length").alias("length"), F.sum("weight").alias("all"))
    longest = roots.agg(F.max("length")).first()[0] or 0
    used = _used(every, top.select(*keys, "node", "length", "half").distinct(), keys, longest)
    by = Window.partitionBy(*keys, "node")
    ordered = by.orderBy(F.concat_ws(" ", "kids"), "name", "w", "d")
    placed = used.withColumn("hi", F.sum("weight").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("lo", F.coalesce(F.lag("hi").over(ordered), F.lit(0.0))).withColumn("all", F.max("hi").over(by))
    return Forest(keys, cut(roots), grown(placed.sortWithinPartitions("length")), longest)


def _ends(node: Column) -> tuple[Column, Column]:
    """Length and half of a node, from its name."""
    part = F.split(node, ":")
    return (F.get(part, F.lit(2)).cast("int") - F.get(part, F.lit(1)).cast("int")).alias("length"), (F.get(part, F.lit(0)) != "S").alias("half")


def _used(every: DataFrame, start: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """The choices of nodes that are reached from the roots."""
    pending, out, turn = Parts(every.sparkSession), Parts(every.sparkSession), 0
    pending.add(start.select(*keys, "node", "length", "half"), 0)
    for length in range(longest, 0, -1):
        for half in (True, False):
            turn += 1
            at = (F.col("length") == length) & (F.col("half") == half)
            new = out.add(every.where(at).join(pending.read().where(at).select(*keys, "node").distinct(), [*keys, "node"], "left_semi"), turn)
            kids = new.select(*keys, F.explode("kids").alias("node")).distinct()
            pending.add(kids.select(*keys, "node", *_ends(F.col("node"))), turn)
    return out.read() if turn else every.limit(0)


def drawn(f: Forest, n: int, seed: int) -> DataFrame:
    """keys, draw (from 1), nulls, cost, links(lw, rw, name) and clauses(w, d) of n linkages of each
    sentence, drawn one by one: each comes with its share of the weight of all linkages of its
    sentence, whether it was drawn before or not. At each node that a draw passes one choice is
    taken, by a hash of seed, keys, draw and node, so that a rerun draws the same, on any
    partitions. (Where weights are not whole numbers under 2^53, sums may differ in their last
    digit, and so may a draw whose hash falls there.)"""
    keys = f.keys
    pending = f.roots.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"), F.lit(ROOT).alias("node"), "length", F.lit(False).alias("half")) if n > 0 else f.roots.select(*keys, F.lit(0).alias("draw"), F.lit(ROOT).alias("node"), "length", F.lit(False).alias("half")).limit(0)
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(k) for k in keys), F.col("draw"), F.col("node")), 12).cast("double") / float(2**52)
    waiting, told, turn = Parts(pending.sparkSession), Parts(pending.sparkSession), 0
    waiting.add(pending, 0)
    for length in range(f.longest, 0, -1):
        for half in (True, False):
            turn += 1
            at = (F.col("length") == length) & (F.col("half") == half)
            here = waiting.read().where(at).select(*keys, "draw", "node", spot.alias("u"))
            met = here.join(f.choices.where(at), [*keys, "node"]).where("lo <= u * all and u * all < hi")
            new = told.add(met.select(*keys, "draw", "kids", *TOLD), turn)
            kids = new.select(*keys, "draw", F.explode("kids").alias("node"))
            waiting.add(kids.select(*keys, "draw", "node", *_ends(F.col("node"))), turn)
    told = told.read().where("name is not null or w is not null") if turn else f.choices.select(*keys, F.lit(0).alias("draw"), *TOLD).limit(0)
    link, clause = F.when(F.col("name").isNotNull(), F.struct("lw", "rw", "name")), F.when(F.col("w").isNotNull(), F.struct("w", "d"))
    out = told.groupBy(*keys, "draw").agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(link)).alias("links"), F.array_sort(F.collect_list(clause)).alias("clauses"))
    return out.join(f.roots.select(*keys, "nulls"), keys).select(*keys, "draw", "nulls", "cost", "links", "clauses")


def used_clauses(f: Forest) -> DataFrame:
    """keys, w, d: the clauses that at least one linkage uses."""
    return f.choices.where("w is not null").select(*f.keys, "w", "d").distinct()


def shares(f: Forest) -> DataFrame:
    """keys, lw, rw, name, share: the links of a sentence, and the share of its linkages (by weight)
    that have each. What stands above a node weighs as much for each of the node's choices: from
    the longest nodes down, a choice hands its node's outer weight, times that of its other child,
    on to each child."""
    keys = f.keys
    inner = f.choices.select(*keys, "node", "all").distinct()
    outer, out = f.roots.select(*keys, F.lit(ROOT).alias("node"), (F.lit(1.0) / F.col("all")).alias("out"), "length", F.lit(False).alias("half")), None
    for length in range(f.longest, 0, -1):
        for half in (True, False):
            at = (F.col("length") == length) & (F.col("half") == half)
            here = outer.where(at).groupBy(*keys, "node").agg(F.sum("out").alias("out"))
            met = grown(f.choices.where(at).join(here, [*keys, "node"]).withColumn("c", F.monotonically_increasing_id()))
            own = met.where("name is not null").select(*keys, "lw", "rw", "name", (F.col("out") * F.col("weight")).alias("share"))
            out = own if out is None else out.unionByName(own)
            kids = met.select(*keys, "c", "out", "weight", F.explode("kids").alias("node")).join(inner, [*keys, "node"])
            kids = kids.select(*keys, "node", (F.col("out") * F.col("weight") / F.col("all")).alias("out"), *_ends(F.col("node")))
            outer = outer.unionByName(kids)
    if out is None:
        out = f.choices.select(*keys, "lw", "rw", "name", F.col("weight").alias("share")).limit(0)
    return out.groupBy(*keys, "lw", "rw", "name").agg(F.sum("share").alias("share"))
