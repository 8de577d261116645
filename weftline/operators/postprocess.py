"""Rules on whole linkages, as expressions over the names of their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules of our own. A linkage with a link like the selector must have one of the
# links (contains_one), or none of them (contains_none).
RULES = [
    (1, "contains_one", "MV", ["S", "O"], "a modifier of a verb needs a verb"),
    (2, "contains_one", "J", ["M", "MV"], "an object of a preposition needs a place to attach"),
    (3, "contains_none", "Os", ["Ost"], "two kinds of object"),
]


def like(name: Column, pattern: Column) -> Column:
    """Whether a link's name is of a pattern's type and has its small letters, * for any."""
    return F.regexp_like(name, F.concat(F.lit("^"), F.replace(pattern, F.lit("*"), F.lit("[a-z*]")), F.lit("(?![A-Z_])")))


def violations(linkages: DataFrame, keys: list[str], rules: list[tuple] = RULES) -> DataFrame:
    """linkages(keys, rank, links) as keys, rank, rule and message of each rule that a linkage
    breaks; nothing for those that keep all."""
    rule = lambda r: F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("kind"), F.lit(r[2]).alias("selector"), F.array(*map(F.lit, r[3])).alias("wanted"), F.lit(r[4]).alias("message"))
    met = linkages.select(*keys, "rank", F.transform("links", lambda x: x["name"]).alias("names"), F.explode(F.array(*map(rule, rules))).alias("r")).select(*keys, "rank", "names", "r.*")
    selected = F.exists("names", lambda n: like(n, F.col("selector")))
    has = F.exists("names", lambda n: F.exists("wanted", lambda p: like(n, p)))
    broken = selected & F.when(F.col("kind") == "contains_one", ~has).otherwise(has)
    return met.where(broken).select(*keys, "rank", "rule", "message")
