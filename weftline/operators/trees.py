"""Pruning of nested expressions by sentence, and their expansion to clauses under a cost bound.

What a word's expression has left is the set of its live connectors: live, sorted node numbers.
A class's nodes come as one array, parents before operands, so that climbing a tree is one fold
over it, within a row: backwards from operands to parents, forwards from parents to operands."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import Parts, cut
from weftline.sources.trees import Grammar

SHAPE = ["classname", "live"]


def _upwards(nodes: str, kind: str, con: str, either: str, both: str) -> str:
    """SQL of an array of one value for each node, from the last node to the first: con from a
    connector x, either and both from the values of its operands, vs, of an OR and an AND x."""
    value = f"case x.kind when 'con' then {con} when 'or' then {either} else {both} end"
    step = value.replace("vs", "transform(x.kids, k -> acc[k - x.node - 1])")  # acc begins with the node after x
    return f"aggregate(reverse({nodes}), cast(array() as array<{kind}>), (acc, x) -> concat(array({step}), acc))"


#: What each node costs at least; null where it cannot be fulfilled: a connector that is not live,
#: an OR without an operand that can be, an AND with one that cannot.
LEAST = _upwards("nodes", "double", "if(array_contains(live, x.node), x.cost, null)", "x.cost + array_min(vs)", "aggregate(vs, x.cost, (a, v) -> a + v)")


def whole(words: DataFrame, g: Grammar) -> DataFrame:
    """words(keys, w, classname) with live: all connectors of their classes' expressions. Words of
    a class without an expression go."""
    live = F.transform(F.filter("nodes", lambda x: x["kind"] == "con"), lambda x: x["node"])
    return words.join(g.classes.select("classname", live.alias("live")), "classname")


#: What stays of a shape: an AND goes with any of its operands, an OR with all of them, and what stands under a node that goes.
_DOWN = "aggregate(nodes, cast(array() as array<int>), (acc, x) -> if(least[x.node] is not null and (x.parent is null or array_contains(acc, x.parent)), concat(acc, array(x.node)), acc))"
# a lambda's variable holds the costs, so that they are worked out once a row
STAY = f"transform(array({LEAST}), least -> {_DOWN})[0]"

#: So many shapes are sent to all tasks; more are joined like any table.
MOST_SHAPES = 100_000


def _sent(shapes: DataFrame) -> DataFrame:
    """shapes, computed once and sent to all tasks where they are few."""
    shapes = cut(shapes)
    return F.broadcast(shapes) if shapes.limit(MOST_SHAPES + 1).count() <= MOST_SHAPES else shapes.hint("merge")


#: Dictionaries of more names are swept by rows of connectors.
MOST_NAMES = 64


def live_connectors(state: DataFrame, keys: list[str], g: Grammar) -> DataFrame:
    rows = state.withColumn("node", F.explode("live")).drop("live")
    return rows.join(g.leaves.select("classname", "node", "name", "dir", "reach"), ["classname", "node"])


def swept(state: DataFrame, keys: list[str], g: Grammar, to: str) -> DataFrame:
    """state without the connectors that go `to` a side (-, + or both, -+) and find no live
    connector there that matches, within the type's reach. Other columns of state stay.

    A sentence's words pass by once in each direction: the nearest place before a word that
    answers a name is a running maximum, the nearest one behind it a running minimum. Rows are
    words, not connectors, and the windows of a sentence share one exchange. A word's row holds
    the names that it answers and those that it finds answered as the bits of one number; what
    these leave of a shape is worked out once for all words alike."""
    found = g.leaves.select("dir", "name", "reach").distinct().orderBy("name").limit(MOST_NAMES + 1).collect()  # the dictionary's
    if len(found) > MOST_NAMES:
        return _swept_by_name(state, keys, g, to)
    spark = state.sparkSession
    number = F.broadcast(spark.createDataFrame([(r["name"], i) for i, r in enumerate(found)], "name string, i int"))
    # the bit of what each node of a class goes by, and those of the names that ask for it
    asked = g.matching.select("a", "b").union(g.matching.select("b", "a")).toDF("name", "ask").join(number.toDF("ask", "j"), "ask").groupBy("name").agg(F.expr("bit_or(shiftleft(1L, j))").alias("asked"))
    leaf = F.struct(F.expr("shiftleft(1L, i)").alias("own"), F.coalesce("asked", F.lit(0).cast("long")).alias("asked"))
    table = cut(g.leaves.join(number, "name").join(asked, "name", "left").groupBy("classname").agg(F.map_from_entries(F.collect_list(F.struct("node", leaf))).alias("by")))
    table = F.broadcast(table) if g.small else table
    shapes = state.select(*SHAPE).distinct().join(table, "classname").select(*SHAPE, F.expr("aggregate(live, 0L, (a, x) -> a | by[x].asked)").alias("answers"))
    rows = state.join(_sent(shapes), SHAPE).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    # the nearest words that answer each name, by a window for each direction
    before = Window.partitionBy(*keys).orderBy("w").rangeBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(-F.col("w")).rangeBetween(Window.unboundedPreceding, -1)
    bit = lambda i: F.expr(f"shiftleft(1L, {i})")
    place = lambda i: F.when(F.col("answers").bitwiseAND(bit(i)) != 0, F.col("w"))
    nearest = lambda i, r: F.max(place(i)).over(before) if r["dir"] == "-" else F.min(place(i)).over(behind)
    asks = [(i, r) for i, r in enumerate(found) if r["dir"] in to]
    rows = rows.select("*", *(nearest(i, r).alias(f"__{i}") for i, r in asks))
    fits = [F.when(F.abs(F.col("w") - F.col(f"__{i}")) <= r["reach"], bit(i)).otherwise(F.lit(0).cast("long")) for i, r in asks]
    ok = reduce(lambda x, y: x.bitwiseOR(y), fits + [bit(i) for i, r in enumerate(found) if r["dir"] not in to], F.lit(0).cast("long"))
    rows = cut(rows.select(*state.columns, ok.alias("ok")))
    each = rows.select(*SHAPE, "ok").distinct().join(table, "classname").select("classname", F.col("live").alias("was"), "ok", F.expr("filter(live, x -> by[x].own & ok <> 0)").alias("live"))
    each = each.join(g.classes, "classname").select("classname", F.col("was").alias("live"), "ok", F.array_intersect("live", F.expr(STAY)).alias("left")).where("size(left) > 0")
    return rows.join(_sent(each), [*SHAPE, "ok"]).drop("live", "ok").withColumnRenamed("left", "live").select(*state.columns)


def _swept_by_name(state: DataFrame, keys: list[str], g: Grammar, to: str) -> DataFrame:
    """As swept(), for dictionaries of many names: rows are connectors and the names that they
    answer, and windows are by sentence and name."""
    asked = g.matching.select("a", "b").union(g.matching.select("b", "a")).toDF("name", "asked").groupBy("name").agg(F.collect_list("asked").alias("asked"))
    rows = live_connectors(state, keys, g).join(F.broadcast(asked) if g.small else asked, "name", "left").repartition(*keys)
    # a row for what a connector asks for, and one for each name that it answers
    own = F.array(F.struct(F.col("name").alias("ask"), F.lit(True).alias("asks")))
    answers = F.transform(F.coalesce("asked", F.array().cast("array<string>")), lambda x: F.struct(x.alias("ask"), F.lit(False).alias("asks")))
    rows = rows.withColumn("x", F.explode(F.concat(own, answers))).select("*", "x.*").drop("x")
    side = Window.partitionBy(*keys, "ask").orderBy("w")
    at = F.when(~F.col("asks"), F.col("w"))
    before, after = F.max(at).over(side.rangeBetween(Window.unboundedPreceding, -1)), F.min(at).over(side.rangeBetween(1, Window.unboundedFollowing))
    met = rows.withColumn("near", F.when(F.col("dir") == "-", before).otherwise(after)).where("asks")
    met = met.where(~F.col("dir").isin(*to) | (F.abs(F.col("w") - F.col("near")) <= F.col("reach")))
    live = F.array_sort(F.collect_list("node")).alias("live")
    return purged(met.groupBy(*(c for c in state.columns if c != "live")).agg(live).select(*state.columns), g)


def purged(state: DataFrame, g: Grammar) -> DataFrame:
    """state with what the loss of connectors takes along: an AND goes with any of its operands,
    an OR with all of them, and what stands under a node that goes. Words with nothing left go.
    Many words share a class and a live set, so that each such shape is worked out once."""
    state = cut(state)
    shapes = state.select(*SHAPE).distinct().join(g.classes, "classname").select(*SHAPE, F.array_intersect("live", F.expr(STAY)).alias("left"))
    return state.join(_sent(shapes), SHAPE).drop("live").withColumnRenamed("left", "live").where("size(live) > 0")


def pruned(words: DataFrame, keys: list[str], g: Grammar, linked: bool = False) -> DataFrame:
    """words(keys, w, classname) with live: sweeps to both sides, until none deletes a connector.
    Words that come with live begin with that, others with all connectors of their classes.
    Deletion only ever shrinks live sets, so the order of sweeps changes their number and not what
    is left. A sentence in which a sweep deletes nothing takes no part in the next.

    Where linked, a sentence goes as soon as a word of it has nothing left: it has no linkage of
    all its words. Elsewhere a loss may pass on from word to word, a sweep for each."""
    here = Window.partitionBy(*keys)
    total, many = F.sum(F.size("live")).over(here), F.count(F.lit(1)).over(here)
    words = words.withColumn("all", many)
    state, done = cut((words if "live" in words.columns else whole(words, g)).withColumn("had", total)), Parts(words.sparkSession)
    for at in count(1):
        turn = swept(state, keys, g, "-+").withColumn("have", total)
        turn = cut(turn.withColumn("many", F.size(F.collect_set("w").over(here))).where("many = all").drop("many") if linked else turn)
        settled = turn.where("have = had").drop("had", "have", "all")
        done.add(settled, at)
        state = turn.where("have < had").drop("had").withColumnRenamed("have", "had")
        if state.isEmpty():
            return done.read()


def clause_counts(shapes: DataFrame, g: Grammar) -> DataFrame:
    """classname, live, n: how many clauses each shape has, without expanding it: an OR adds up,
    an AND multiplies."""
    n = _upwards("nodes", "double", "if(array_contains(live, x.node), 1D, 0D)", "aggregate(vs, 0D, (a, v) -> a + v)", "aggregate(vs, 1D, (a, v) -> a * v)")
    return shapes.join(g.classes, "classname").select(*SHAPE, F.expr(n)[0].cast("long").alias("n"))


def expanded(shapes: DataFrame, g: Grammar, cutoff: float) -> DataFrame:
    """classname, live, connectors, cost: the clauses of each shape that cost the cut-off at most,
    those without a connector left out.

    A partial clause is a row: connectors and ORs in order, and what they cost so far. Each turn
    puts an operand in the place of the first OR of each row; an AND is its operands, side by
    side. A row stays only while the cheapest way to complete it is within the bound, so no row is
    made that leads to no clause. There are as many turns as the largest expression has ORs, each
    a look-up of a class and an explode, without a shuffle."""
    flat = _upwards("nodes", "array<int>", "array(x.node)", "array(x.node)", "flatten(vs)")
    base = _upwards("nodes", "double", "x.cost", "0D", "aggregate(vs, x.cost, (a, v) -> a + v)")
    classes = cut(g.classes.withColumn("flat", F.expr(flat)).withColumn("base", F.expr(base)))
    classes = F.broadcast(classes) if g.small else classes
    most = g.classes.agg(F.max(F.size(F.filter("nodes", lambda x: x["kind"] == "or")))).first()[0] or 0
    rows = shapes.join(classes, "classname").withColumn("least", F.expr(LEAST)).where("least[0] is not null")
    rows = rows.select(*SHAPE, "least", F.expr("flat[0]").alias("items"), F.expr("base[0]").alias("cost"))
    for _ in range(most + 1):
        at = F.expr("array_position(transform(items, i -> nodes[i].kind), 'or')")  # from 1; 0: none
        rows = rows.join(classes, "classname").withColumn("at", at).withColumn("one", F.expr("if(at > 0, nodes[items[at - 1]], null)"))
        rows = rows.withColumn("kid", F.explode(F.expr("if(at > 0, filter(one.kids, k -> least[k] is not null), array(-1))")))
        items = "if(kid < 0, items, flatten(array(slice(items, 1, at - 1), flat[kid], slice(items, at + 1, size(items)))))"
        rows = rows.withColumn("items", F.expr(items)).withColumn("cost", F.expr("if(kid < 0, cost, cost + one.cost + base[kid])"))
        rest = F.expr("aggregate(items, cost, (a, i) -> a + if(nodes[i].kind = 'or', least[i], 0D))")
        rows = rows.where(rest <= cutoff + 1e-9).withColumn("connectors", F.expr("transform(items, i -> nodes[i].connector)")).select(*SHAPE, "least", "items", "cost", "connectors")
    return rows.where("size(items) > 0").select(*SHAPE, "connectors", "cost")
