"""Clauses of sentences, pruning by semi-joins, and parse counts by joins of spans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.connectors import link_name, parsed, subtypes_match
from weftline.operators.trees import pruned as expression_pruned
from weftline.plans.lineage import Parts, cut, grown
from weftline.sources import grammar, trees

#: Counts stop here, as 32-bit counts do.
MOST = 2**31 - 1


def sentence_clauses(words: DataFrame, keys: list[str], clauses: DataFrame | None = None, cutoff: float = 2.7) -> DataFrame:
    """words(keys, w, classname; last, if it is there) with their clauses: d (number), cost, and the connectors to
    the left and right, nearest first. Clauses over the cost cut-off, and those with more
    connectors to a side than the sentence has words there, go."""
    spark = words.sparkSession
    c = (grammar.clauses(spark) if clauses is None else clauses).where(F.col("cost") <= cutoff)
    c = c.withColumn("d", F.row_number().over(Window.orderBy("classname", "disjunct"))).withColumn("c", parsed(F.col("disjunct")))
    side = lambda s: F.filter("c", lambda x: x["dir"] == s)
    c = F.broadcast(c.select("classname", "d", "disjunct", "cost", side("-").alias("left"), side("+").alias("right")))
    last = F.max("w").over(Window.partitionBy(*keys))
    out = (words if "last" in words.columns else words.withColumn("last", last)).join(c, "classname")
    return out.where((F.size("left") <= F.col("w")) & (F.size("right") <= F.col("last") - F.col("w")))


def connectors(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w, d, i (nearest first), c (the connector) of both sides."""
    both = F.posexplode(F.concat("left", "right")).alias("i", "c")
    return clauses.select(*keys, "w", "last", "d", both).select(*keys, "w", "last", "d", "i", "c.*")


def partners(cons: DataFrame, keys: list[str]) -> DataFrame:
    """Matching pairs of a right-going connector and one to its right going left: keys, lw,
    rw, ld, rd, li, ri and the link's name. An equi-join on sentence and type; the places and
    subtypes are the residual."""
    a = cons.where("dir = '+'").select(*keys, F.col("w").alias("lw"), F.col("d").alias("ld"), F.col("i").alias("li"), "uc", F.col("lc").alias("llc"), F.col("hd").alias("lhd"))
    b = cons.where("dir = '-'").select(*keys, F.col("w").alias("rw"), F.col("d").alias("rd"), F.col("i").alias("ri"), "uc", F.col("lc").alias("rlc"), F.col("hd").alias("rhd"))
    heads = (F.col("lhd") == "") | (F.col("rhd") == "") | (F.col("lhd") != F.col("rhd"))
    met = a.join(b, [*keys, "uc"]).where((F.col("lw") < F.col("rw")) & heads & subtypes_match(F.col("llc"), F.col("rlc")))
    return met.select(*keys, "lw", "rw", "ld", "rd", "li", "ri", link_name(F.col("uc"), F.col("llc"), F.col("rlc")).alias("name"))


def pruned(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """The clauses all of whose connectors have a partner among clauses that stay: deleted in
    turns until a turn deletes none."""
    left = cut(clauses)
    n = left.count()
    while n:
        cons = connectors(left, keys)
        met = partners(cons, keys)
        held = met.select(*keys, F.col("lw").alias("w"), F.col("ld").alias("d"), F.col("li").alias("i"))
        held = held.union(met.select(*keys, F.col("rw").alias("w"), F.col("rd").alias("d"), F.col("ri").alias("i"))).distinct()
        lost = cons.join(held, [*keys, "w", "d", "i"], "left_anti").select(*keys, "w", "d").distinct()
        left = cut(left.join(lost, [*keys, "w", "d"], "left_anti"))
        n, before = left.count(), n
        if n == before:
            break
    return left


def clause_trees(rows: list[tuple[str, str, float]] = grammar.CLAUSES, cutoff: float = 2.7) -> dict[str, tuple]:
    """Rows (classname, disjunct, cost) up to the cost cut-off as one expression for each class: an OR
    of clauses, each an AND of connectors."""
    out: dict = {}
    for name, disjunct, cost in rows:
        if cost <= cutoff:
            out.setdefault(name, []).append(trees.all_of(*(trees.con(c.strip()) for c in disjunct.split("&")), cost=cost))
    return {name: trees.one_of(*x) for name, x in out.items()}


def pruned_counts(words: DataFrame, keys: list[str], expressions: dict[str, tuple]) -> DataFrame:
    """keys, n_clauses and n_words: what pruned() leaves of the clauses of words(keys, w, classname)
    by expressions as clause_trees() gives them. A word's row holds the numbers of its live
    connectors, and a clause goes with any of them, so that no clause or pair of them is a row."""
    spark = words.sparkSession
    g = trees.grammar(spark, spark.createDataFrame(trees.node_rows(expressions), trees.NODES), {})
    # each connector with its clause, and how many connectors that has to either side
    side = lambda s: F.sum((F.col("dir") == s).cast("int")).over(Window.partitionBy("classname", "parent"))
    nodes = g.classes.select("classname", F.inline("nodes")).join(g.leaves.select("classname", "node", "dir"), ["classname", "node"])
    own = nodes.select("classname", "node", "parent", side("-").alias("nl"), side("+").alias("nr")).groupBy("classname").agg(F.array_sort(F.collect_list(F.struct("node", "parent", "nl", "nr"))).alias("own"))
    own = F.broadcast(cut(own))
    last = F.max("w").over(Window.partitionBy(*keys))
    rows = words.withColumn("last", last).join(own, "classname")
    fits = F.filter("own", lambda x: (x["nl"] <= F.col("w")) & (x["nr"] <= F.col("last") - F.col("w")))
    rows = rows.select(*keys, "w", "classname", F.transform(fits, lambda x: x["node"]).alias("live")).where("size(live) > 0")
    left = expression_pruned(rows, keys, g).join(own, "classname")
    kept = F.array_distinct(F.transform(F.filter("own", lambda x: F.array_contains("live", x["node"])), lambda x: x["parent"]))
    return left.groupBy(*keys).agg(F.sum(F.size(kept)).alias("n_clauses"), F.countDistinct("w").alias("n_words"))


@dataclass(frozen=True)
class Payload:
    """What a span carries: the empty span (its left word, that word's clause and cost), two
    spans side by side, a span whose ends get linked, and all ways to one state together."""

    unit: Callable[[Column, Column, Column], Column]
    joined: Callable[[Column, Column], Column]
    linked: Callable[[Column, Column, Column, Column], Column]
    total: Callable[[Column], Column]


def counted() -> Payload:
    """The number of ways, up to MOST."""
    whole = lambda c: c.cast("decimal(38,0)")
    return Payload(lambda w, d, cost: whole(F.lit(1)), lambda a, b: a * b, lambda n, lw, rw, name: n, lambda n: whole(F.least(F.sum(n), F.lit(MOST))))


def ranked(most: int) -> Payload:
    """The best linkages in order of cost, length of links, and links: as many as asked for."""
    best = lambda c: F.slice(F.array_sort(c), 1, most)
    row = lambda cost, length, links, chosen: F.struct(cost.alias("cost"), length.alias("length"), links.alias("links"), chosen.alias("clauses"))
    none = lambda: F.expr("cast(array() as array<struct<lw:int,rw:int,name:string>>)")
    both = lambda x, y: row(x["cost"] + y["cost"], x["length"] + y["length"], F.concat(x["links"], y["links"]), F.concat(x["clauses"], y["clauses"]))
    link = lambda x, lw, rw, name: row(x["cost"], x["length"] + rw - lw - 1, F.concat(x["links"], F.array(F.struct(lw.alias("lw"), rw.alias("rw"), name.alias("name")))), x["clauses"])
    return Payload(
        lambda w, d, cost: F.array(row(F.round(cost * 1e6).cast("long"), F.lit(0), none(), F.array(F.struct(w.alias("w"), d.alias("d"))))),
        lambda a, b: best(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: both(x, y))))),
        lambda n, lw, rw, name: F.transform(n, lambda x: link(x, lw, rw, name)),
        lambda n: best(F.flatten(F.collect_list(n))),
    )


def parse_counts(clauses: DataFrame, keys: list[str], max_null: int = 0) -> DataFrame:
    """keys, nulls and n_parses: the planar linkages of each sentence in which every word is
    linked, but for as few words as allow one, max_null at most."""
    return _least_nulls(chart(clauses, keys, counted(), max_null), keys).select(*keys, "nulls", F.col("n").cast("long").alias("n_parses"))


def linkages(clauses: DataFrame, keys: list[str], most: int, max_null: int = 0) -> DataFrame:
    """keys, rank (from 1), nulls, cost, length, links(lw, rw, name) and clauses(w, d) of each
    sentence's best linkages, as many as asked for: by cost, length of links, and links."""
    found = _least_nulls(chart(clauses, keys, ranked(most), max_null), keys)
    rows = found.select(*keys, "nulls", F.posexplode("n").alias("rank", "x"))
    return rows.select(*keys, (F.col("rank") + 1).alias("rank"), "nulls", (F.col("x.cost") / 1e6).alias("cost"), "x.length", F.array_sort("x.links").alias("links"), F.array_sort("x.clauses").alias("clauses"))


def _least_nulls(whole: DataFrame, keys: list[str]) -> DataFrame:
    return whole.groupBy(*keys).agg(F.min(F.struct("nulls", "n")).alias("x")).select(*keys, "x.*")


@dataclass(frozen=True)
class Chart:
    """spans: all states and their payloads; nodes: clauses, and the end of each sentence; pairs:
    the connectors of two clauses that match; sizes: the connectors of each clause by side."""

    spans: DataFrame
    nodes: DataFrame
    pairs: DataFrame
    sizes: DataFrame

    def whole(self, keys: list[str]) -> DataFrame:
        """The states that are linkages of whole sentences."""
        first = self.nodes.where("w = 0").select(*keys, F.col("d").alias("ld"), F.col("last"), F.size("right").alias("nr"))
        return self.spans.join(first, [*keys, "ld"]).where("lw = 0 and rw = last + 1 and l = nr and r = 0")


def chart(clauses: DataFrame, keys: list[str], pay: Payload, max_null: int) -> DataFrame:
    """keys, nulls and n: the payload of each sentence's linkages with so many unlinked words."""
    return charted(clauses, keys, pay, max_null).whole(keys).groupBy(*keys, "nulls").agg(pay.total(F.col("n")).alias("n"))


def charted(clauses: DataFrame, keys: list[str], pay: Payload, max_null: int) -> Chart:
    """The states of each sentence's spans and their payloads.

    A state is the span between words lw and rw, with what is still to link of lw's clause to
    the right (l connectors of it, the nearest ones) and of rw's to the left (r), and how many
    words inside are unlinked. Its payload is a total over the word between them that takes
    lw's farthest connector, or, if lw has none left, rw's. Spans become complete from shorter to
    longer ones, all sentences at once; each turn joins only those of its length with all that
    came before, and what they make waits for the turn of its own length."""
    # no linkage leaves more than max_null words without a clause
    full = clauses.groupBy(*keys).agg(F.countDistinct("w").alias("__n"), F.first("last").alias("__last")).where(F.col("__n") + max_null > F.col("__last")).select(*keys)
    left = clauses.join(full, keys, "left_semi").select(*keys, "w", "last", "d", "cost", "left", "right")
    end = left.select(*keys, "last").distinct().select(*keys, (F.col("last") + 1).alias("w"), "last", F.lit(0).alias("d"), F.lit(0.0).alias("cost"), F.expr("cast(array() as array<struct<text:string,multi:boolean,hd:string,uc:string,lc:string,dir:string>>)").alias("left"))
    end = end.withColumn("right", F.col("left"))
    nodes = grown(left.unionByName(end))
    a = nodes.select(*keys, F.col("w").alias("lw"), F.col("d").alias("ld"), "cost", F.explode(F.sequence(F.col("w") + 1, F.col("w") + 1 + max_null)).alias("rw"))
    b = nodes.select(*keys, F.col("w").alias("rw"), F.col("d").alias("rd"))
    state = [*keys, "lw", "rw", "ld", "rd", "l", "r", "nulls"]
    near = a.join(b, [*keys, "rw"]).withColumns({"l": F.lit(0), "r": F.lit(0), "nulls": F.col("rw") - F.col("lw") - 1})
    pending, spans, lefts, rights = (Parts(nodes.sparkSession) for _ in range(4))
    pending.add(near.select(*state, pay.unit(F.col("lw"), F.col("ld"), F.col("cost")).alias("n")), 0)
    pairs = grown(partners(connectors_by_side(nodes, keys), keys))
    sizes = grown(nodes.select(*keys, F.col("w"), F.col("d"), F.size("left").alias("nl"), F.size("right").alias("nr"), F.transform("left", lambda c: c["multi"]).alias("ml"), F.transform("right", lambda c: c["multi"]).alias("mr")))
    ends = [*keys, "m", "md"]
    length, longest = 1, 1 + max_null
    while length <= longest:
        # all that makes up a span of this length is there: each pair of parts meets once
        # (a turn makes spans of at most twice its length)
        ready = pending.read(f"part = 0 or part >= {(length + 1) // 2}").where(F.col("rw") - F.col("lw") == length)
        new = spans.add(ready.groupBy(*state).agg(pay.total(F.col("n")).alias("n")), length)
        left_linked, right_linked = _linked(new, pairs, sizes, keys, pay)
        # the word between takes lw's farthest connector; on its other side it may take rw's or not
        open_right = new.join(sizes.select(*keys, F.col("w").alias("lw"), F.col("d").alias("ld"), F.col("nr")), [*keys, "lw", "ld"]).where("l = nr").select(*state, "n")
        open_left = new.join(sizes.select(*keys, F.col("w").alias("rw"), F.col("d").alias("rd"), F.col("nl")), [*keys, "rw", "rd"]).where("r = nl and l = 0").select(*state, "n")
        part = lambda x, y: x.withColumn("own", F.lit(True)).unionByName(y.withColumn("own", F.lit(False)))
        left = part(left_linked, open_left).select(*keys, "lw", "ld", "l", F.col("rw").alias("m"), F.col("rd").alias("md"), F.col("nulls").alias("u1"), F.col("n").alias("n1"), "own")
        right = part(right_linked, open_right).select(*keys, F.col("lw").alias("m"), F.col("ld").alias("md"), "rw", "rd", "r", F.col("nulls").alias("u2"), F.col("n").alias("n2"), F.col("own").alias("right_own"))
        left, right = lefts.add(left, length), rights.add(right, length)
        met = left.join(rights.read(), ends).unionByName(lefts.read(f"part < {length}").join(right, ends))
        met = met.where((F.col("own") | F.col("right_own")) & (F.col("u1") + F.col("u2") <= max_null))
        met = met.withColumn("nulls", F.col("u1") + F.col("u2")).withColumn("n", pay.joined(F.col("n1"), F.col("n2")))
        met = pending.add(met.groupBy(*state).agg(pay.total(F.col("n")).alias("n")).select(*state, "n"), length)
        longest = max(longest, met.agg(F.max(F.col("rw") - F.col("lw"))).first()[0] or 0)
        length += 1
    return Chart(spans.read(), nodes, pairs, sizes)


def connectors_by_side(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """As connectors(), numbered from 1 on each side."""
    one = lambda s: nodes.select(*keys, "w", "last", "d", F.posexplode(s).alias("i", "c")).select(*keys, "w", "last", "d", (F.col("i") + 1).alias("i"), "c.*")
    return one("left").unionByName(one("right"))


def links(spans: DataFrame, pairs: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Each way to link the end words of a span to each other besides what is inside: the span's
    state and payload, the connectors' places li and ri, the link's name, and the connectors nr
    and nl that the end words have on the inner side. A connector that may link again stays."""
    s, p = spans.alias("s"), pairs.alias("p")
    on = [F.col(f"s.{k}") == F.col(f"p.{k}") for k in [*keys, "lw", "rw", "ld", "rd"]]
    lmulti = sizes.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("w").alias("a_w"), F.col("d").alias("a_d"), F.col("mr"), F.col("nr"))
    rmulti = sizes.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("w").alias("b_w"), F.col("d").alias("b_d"), F.col("ml"), F.col("nl"))
    both = s.join(p, on).select(*[F.col(f"s.{k}").alias(k) for k in keys], "s.lw", "s.rw", "s.ld", "s.rd", "s.l", "s.r", "s.nulls", "s.n", "p.li", "p.ri", "p.name")
    both = both.join(lmulti, [*(F.col(k) == F.col(f"a_{k}") for k in keys), F.col("lw") == F.col("a_w"), F.col("ld") == F.col("a_d")])
    both = both.join(rmulti, [*(F.col(k) == F.col(f"b_{k}") for k in keys), F.col("rw") == F.col("b_w"), F.col("rd") == F.col("b_d")])
    again = lambda i, have, multi: (F.col(i) == F.col(have) + 1) | ((F.col(i) == F.col(have)) & F.element_at(multi, F.greatest(F.col(i), F.lit(1))))
    return both.where(again("li", "l", "mr") & again("ri", "r", "ml"))


def _linked(spans: DataFrame, pairs: DataFrame, sizes: DataFrame, keys: list[str], pay: Payload) -> tuple[DataFrame, DataFrame]:
    """Spans whose end words are linked to each other: with the left word's next connector and
    all of the right word's left side used up, and the mirror image."""
    both = links(spans, pairs, sizes, keys)
    rows = both.select(*keys, "lw", "rw", "ld", "rd", F.col("li").alias("l"), F.col("ri").alias("r"), "nulls", pay.linked(F.col("n"), F.col("lw"), F.col("rw"), F.col("name")).alias("n"), "nl", "nr")
    state = [*keys, "lw", "rw", "ld", "rd", "l", "r", "nulls"]
    total = lambda df: df.groupBy(*state).agg(pay.total(F.col("n")).alias("n"))
    return total(rows.where("r = nl")), total(rows.where("l = nr"))
