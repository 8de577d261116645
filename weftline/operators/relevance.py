"""Which rules matter to a sentence, and which expressions hold which others.

A rule whose selector is like no link that a sentence can make cannot be broken by any linkage of
it, and need not be looked at. Expressions are equal if their kinds, costs and operands are, in
order; a table of nodes gives each node its text from the leaves up, and what holds what is then a
join on the hash of that text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.connectors import CONNECTOR, link_name
from weftline.operators.postprocess import like
from weftline.plans.lineage import cut
from weftline.sources.trees import Grammar

NODE = ["classname", "node"]


def canonical(nodes: DataFrame) -> DataFrame:
    """nodes(classname, node, parent, ord, kind, connector, cost, depth) as classname, node, parent,
    kind, text and key (its hash): one join a level, from the deepest up. An AND stands in
    round brackets and an OR in braces, so that those of one operand or none differ. Costs stand in brackets before what they belong to, zeros left out."""
    depths = nodes.agg(F.max("depth")).first()[0]
    done, below = None, None
    for depth in range(-1 if depths is None else depths, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if below is not None:
            inner = below.groupBy("classname", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("of"))
            here = here.join(inner, NODE, "left").withColumn("of", F.coalesce(F.col("of.text"), F.expr("cast(array() as array<string>)")))
        else:
            here = here.withColumn("of", F.expr("cast(array() as array<string>)"))
        both = F.concat(F.lit("("), F.array_join("of", " & "), F.lit(")"))
        either = F.concat(F.lit("{"), F.array_join("of", " or "), F.lit("}"))
        text = F.when(F.col("kind") == "con", F.col("connector")).when(F.col("kind") == "and", both).otherwise(either)
        text = F.when(F.col("cost") == 0, text).otherwise(F.concat(F.lit("["), F.col("cost").cast("string"), F.lit("]"), text))
        below = cut(here.select("classname", "node", "parent", "ord", "kind", text.alias("text")))
        done = below if done is None else done.unionByName(below)
    if done is None:
        done = nodes.select("classname", "node", "parent", "ord", "kind", F.lit("").alias("text")).limit(0)
    return done.select("classname", "node", "parent", "kind", "text", F.sha2("text", 256).alias("key"))


def held(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """classname, part: the expressions of whole (as canonical gives them) that hold one of parts'
    roots as a sub-expression, which an expression does of itself."""
    roots = parts.where("parent is null").select(F.col("classname").alias("part"), "key")
    return whole.select("classname", "key").distinct().join(roots, "key").select("classname", "part")


def possible_links(cons: DataFrame, keys: list[str], g: Grammar) -> DataFrame:
    """keys, link: the names of links that cons(keys, w, name) can make: of a connector that goes
    right and a matching one to its right. First and last places of each name decide it, so that
    rows grow with a sentence's names, not with pairs of its words."""
    part = lambda c, i: F.regexp_extract(c, CONNECTOR, i)
    names = g.matching.withColumn("link", link_name(part("a", 3), part("a", 4), part("b", 4)))
    names = F.broadcast(cut(names.coalesce(1))) if g.small else names
    at = cons.groupBy(*keys, "name").agg(F.min("w").alias("first"), F.max("w").alias("last"))
    a, b = at.select(*keys, F.col("name").alias("a"), "first"), at.select(*keys, F.col("name").alias("b"), "last")
    return a.join(names, "a").join(b, [*keys, "b"]).where("first < last").select(*keys, "link").distinct()


def relevant(links: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """keys, rule: the rules(rule, selector) whose selector is like one of the sentence's
    links(keys, link). Different names are few: they meet the rules once, and sentences meet the
    outcome by an equi-join. Null names are like nothing."""
    names = links.select("link").where("link is not null").distinct()
    chosen = cut(names.join(rules.select("rule", "selector").distinct(), like(F.col("link"), F.col("selector"))).select("link", "rule").distinct())
    return links.join(chosen, "link").select(*keys, "rule").distinct()


def uses(linkages: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """rule, n_relevant (linkages whose own links a rule's selector is like) and n_broken (those of
    them without any link that the rule wants), of linkages(keys, rank, links) and rules(rule,
    selector, wanted). Rules that no linkage is relevant to have no row. Linkages that stand twice
    count once."""
    by = [*keys, "rank"]
    links = linkages.select(*by, F.explode("links").alias("x")).select(*by, F.col("x.name").alias("link")).distinct()
    asked = relevant(links, by, rules)
    met = relevant(links, by, rules.select("rule", F.col("wanted").alias("selector"))).withColumn("met", F.lit(1))
    return asked.join(met, [*by, "rule"], "left").groupBy("rule").agg(F.count(F.lit(1)).alias("n_relevant"), (F.count(F.lit(1)) - F.count("met")).alias("n_broken"))
