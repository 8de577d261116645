"""Nested expressions of a grammar of our own as one table of nodes.

An expression is a connector, an AND of operands in order (an empty one is nothing at all), or an
OR of operands. Every node has a cost, and costs add up."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.connectors import CONNECTOR, subtypes_match
from weftline.plans.lineage import cut


def con(connector: str, cost: float = 0.0) -> tuple:
    return ("con", connector, cost)


def all_of(*operands: tuple, cost: float = 0.0) -> tuple:
    return ("and", operands, cost)


def one_of(*operands: tuple, cost: float = 0.0) -> tuple:
    return ("or", operands, cost)


def maybe(operand: tuple) -> tuple:
    return one_of(operand, all_of())


# The expression of each class, and how many words away links of some types may end.
EXPRESSIONS = {
    "LEFT-WALL": one_of(con("Wd+"), con("Wi+", 1.0)),
    "det": one_of(con("Ds+"), con("Dm+", 0.5)),
    "noun": all_of(
        maybe(con("@A-")),
        maybe(con("Ds-")),
        one_of(all_of(con("Wd-"), con("Ss+")), con("Os-"), con("Js-"), all_of(con("Ss+"), cost=1.25)),
        maybe(con("@M+", 0.25)),
    ),
    "verb": all_of(one_of(con("S*-"), con("Wi-")), maybe(one_of(con("O*+"), all_of(con("O*+"), con("O*+", 0.5), cost=0.25))), maybe(con("@MV+", 0.125))),
    "be": all_of(con("S*-"), one_of(con("O*+"), con("P+", 0.25)), maybe(con("@MV+", 0.125))),
    "pron": one_of(all_of(con("Wd-"), con("Ss+")), con("Os-", 0.25), con("Js-", 0.25)),
    "prep": all_of(one_of(con("MV-"), con("M-", 0.125)), con("J*+")),
    "conj": all_of(con("MV-", 1.0), con("J*+")),
}
REACH = {"A": 2, "D": 3, "J": 6}
#: The reach of all other types: any distance.
FAR = 1 << 30
#: Dictionaries of more nodes are not broadcast.
MOST_NODES = 100_000

NODES = "classname string, node int, parent int, ord int, depth int, kind string, connector string, cost double"


def node_rows(expressions: dict[str, tuple]) -> list[tuple]:
    """The nodes of each class's expression, numbered from 0 (the root) from left to right."""
    rows = []

    def walk(name: str, e: tuple, parent: int | None, at: int, depth: int, n: int) -> int:
        kind, inner, cost = e
        own, n = n, n + 1
        rows.append((name, own, parent, at, depth, kind, inner if kind == "con" else None, cost))
        for i, x in enumerate(inner if kind != "con" else ()):
            n = walk(name, x, own, i, depth + 1, n)
        return n

    for name, e in expressions.items():
        walk(name, e, None, 0, 0, 0)
    return rows


@dataclass(frozen=True)
class Grammar:
    """classes: each class's nodes in order, with the numbers of their operands; leaves: the
    connectors, with the parts of their names; matching: the names of right-going (a) and
    left-going (b) connectors that match. All are of the dictionary's size."""

    classes: DataFrame
    leaves: DataFrame
    matching: DataFrame
    small: bool


def grammar(spark: SparkSession, nodes: DataFrame | None = None, reach: dict[str, int] | None = None) -> Grammar:
    """The tables of a grammar, by default of our own; nodes may come from any table of that form.
    They are written once. Up to MOST_NODES nodes they are sent to all tasks; those of a larger
    dictionary are joined like any table."""
    nodes = spark.createDataFrame(node_rows(EXPRESSIONS), NODES) if nodes is None else nodes
    nodes = cut(nodes.coalesce(1))
    small = nodes.limit(MOST_NODES + 1).count() <= MOST_NODES
    table = lambda df: F.broadcast(cut(df.coalesce(1))) if small else cut(df)
    part = lambda i: F.regexp_extract("connector", CONNECTOR, i)
    leaves = nodes.where("kind = 'con'").select("classname", "node", "connector", (part(1) == "@").alias("multi"), part(2).alias("hd"), part(3).alias("uc"), part(4).alias("lc"), part(5).alias("dir"))
    far = REACH if reach is None else reach
    limit = F.coalesce(*(F.when(F.col("uc") == u, n) for u, n in far.items()), F.lit(FAR))
    leaves = leaves.withColumn("name", F.regexp_replace("connector", "^@", "")).withColumn("reach", limit)
    names = leaves.select("name", "hd", "uc", "lc", "dir").distinct()
    a = names.where("dir = '+'").select(F.col("name").alias("a"), "uc", F.col("hd").alias("ahd"), F.col("lc").alias("alc"))
    b = names.where("dir = '-'").select(F.col("name").alias("b"), "uc", F.col("hd").alias("bhd"), F.col("lc").alias("blc"))
    heads = (F.col("ahd") == "") | (F.col("bhd") == "") | (F.col("ahd") != F.col("bhd"))
    matching = a.join(b, "uc").where(heads & subtypes_match(F.col("alc"), F.col("blc"))).select("a", "b")
    kids = nodes.where("parent is not null").groupBy("classname", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("kids"))
    rows = nodes.join(kids, ["classname", "node"], "left").withColumn("kids", F.coalesce("kids", F.expr("cast(array() as array<int>)")))
    row = F.struct("node", "parent", "kind", "connector", "cost", "kids")
    classes = rows.groupBy("classname").agg(F.array_sort(F.collect_list(row)).alias("nodes"))
    return Grammar(table(classes), table(leaves), table(matching), small)


def written(e: tuple) -> str:
    """An expression as text: & and or, brackets for each cost, braces for what may be missing."""
    kind, inner, cost = e
    if kind == "con":
        text = inner
    elif kind == "or" and len(inner) == 2 and inner[1] == all_of():
        text = "{" + written(inner[0]) + "}"
    else:
        text = "(" + (" & " if kind == "and" else " or ").join(map(written, inner)) + ")"
    return f"[{text}]{cost:g}" if cost else text


def matching_names(expressions: dict[str, tuple]) -> list[tuple[str, str]]:
    """The pairs of matching(), by the letter of the rule, for SQL."""
    found = sorted({c.lstrip("@") for *_, c, _ in node_rows(expressions) if c})
    parts = {c: re.fullmatch(CONNECTOR, c).groups() for c in found}
    fits = lambda p, q: all(x == y or "*" in (x, y) for x, y in zip(p.ljust(9, "*"), q.ljust(9, "*"), strict=True))
    return [(a, b) for a in found for b in found if parts[a][4] == "+" and parts[b][4] == "-" and parts[a][2] == parts[b][2] and fits(parts[a][3], parts[b][3])]


def link_of(a: str, b: str) -> str:
    """The name of the link of two matching connectors, for SQL."""
    (_, _, uc, x, _), (_, _, _, y, _) = (re.fullmatch(CONNECTOR, c).groups() for c in (a, b))
    return (uc + "".join(q if p == "*" else p for p, q in zip(x.ljust(9, "*"), y.ljust(9, "*"), strict=True))).rstrip("*")
