"""Pruning by rules on whole linkages: a clause goes whose connector asks for a link that its
sentence can no longer make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.connectors import CONNECTOR, link_name
from weftline.operators.postprocess import like
from weftline.plans.lineage import cut
from weftline.sources.trees import Grammar

RULE = "rule int, selector string, wanted string"
# Rules of our own. A linkage with a link like the selector must have one like what is wanted; a row for each.
RULES = [(1, "Wi", "O"), (1, "Wi", "MV"), (2, "M", "J"), (3, "MV", "S"), (3, "MV", "W"), (4, "Js", "MV"), (4, "Js", "M"), (5, "Os", "Ss"), (6, "Dm", "Sp")]


def index(g: Grammar, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asks(name, rule): the connectors that a rule's selector matches; gives(a, b, rule): the
    pairs of connectors whose link the rule wants. Both follow from the dictionary alone."""
    part = lambda c, i: F.regexp_extract(c, CONNECTOR, i)
    names = g.leaves.select("name").distinct()
    asks = names.join(rules.select("rule", "selector").distinct(), like(F.expr("substring(name, 1, length(name) - 1)"), F.col("selector"))).select("name", "rule").distinct()
    link = link_name(part("a", 3), part("a", 4), part("b", 4))
    gives = g.matching.withColumn("link", link).join(rules, like(F.col("link"), F.col("wanted"))).select("a", "b", "rule").distinct()
    return asks, gives


def possible(cons: DataFrame, keys: list[str], gives: DataFrame) -> DataFrame:
    """keys, rule: the rules for which cons(keys, w, name) can still make a wanted link: some
    connector that goes right stands left of one that goes left and matches. First and last
    places of each name are enough, so that rows grow with a sentence's names."""
    at = cons.groupBy(*keys, "name").agg(F.min("w").alias("first"), F.max("w").alias("last"))
    a, b = at.select(*keys, F.col("name").alias("a"), "first"), at.select(*keys, F.col("name").alias("b"), "last")
    return a.join(gives, "a").join(b, [*keys, "b"]).where("first < last").select(*keys, "rule").distinct()


def lacking(clauses: DataFrame, keys: list[str], g: Grammar, rules: DataFrame) -> DataFrame:
    """keys, w, d, rule: clauses(keys, w, d, connectors) that ask for a link which the clauses of
    their sentence cannot make."""
    asks, gives = index(g, rules)
    asks, gives = (F.broadcast(cut(x)) if g.small else cut(x) for x in (asks, gives))
    cons = clauses.select(*keys, "w", "d", F.explode("connectors").alias("c")).select(*keys, "w", "d", F.regexp_replace("c", "^@", "").alias("name"))
    asked = cons.join(asks, "name").select(*keys, "w", "d", "rule").distinct()
    return asked.join(possible(cons, keys, gives), [*keys, "rule"], "left_anti")


def pruned(clauses: DataFrame, keys: list[str], g: Grammar, rules: DataFrame) -> DataFrame:
    """The clauses that stay: those that ask in vain go, in turns, since what they offered goes
    with them. Sentences in which a turn deletes nothing take no part in the next."""
    left, done = clauses, None
    while True:
        lost = cut(lacking(left, keys, g, rules).select(*keys, "w", "d").distinct())
        again = lost.select(*keys).distinct()
        settled = left.join(again, keys, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if lost.isEmpty():
            return done
        left = cut(left.join(again, keys, "left_semi").join(lost, [*keys, "w", "d"], "left_anti"))
