"""The algebra of connectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONNECTOR = r"(@?)([hd]?)([A-Z_]+)([a-z0-9*]*)([-+])"


def parsed(clause: Column) -> Column:
    """The connectors of a clause: array of struct(text, multi, hd, uc, lc, dir)."""
    part = lambda c, i: F.regexp_extract(c, CONNECTOR, i)
    return F.transform(
        F.regexp_extract_all(clause, F.lit(CONNECTOR), F.lit(0)),
        lambda c: F.struct(c.alias("text"), (part(c, 1) == "@").alias("multi"), part(c, 2).alias("hd"), part(c, 3).alias("uc"), part(c, 4).alias("lc"), part(c, 5).alias("dir")),
    )


def matches(a: str, b: str) -> Column:
    """Whether a right-going and a left-going connector match: equal types, no two heads or
    dependents, subtypes equal letter by letter where neither has * or ends."""
    return (F.col(f"{a}.uc") == F.col(f"{b}.uc")) & ((F.col(f"{a}.hd") == "") | (F.col(f"{b}.hd") == "") | (F.col(f"{a}.hd") != F.col(f"{b}.hd"))) & subtypes_match(F.col(f"{a}.lc"), F.col(f"{b}.lc"))


def subtypes_match(x: Column, y: Column) -> Column:
    letters = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    pairs = F.arrays_zip(letters(x).alias("p"), letters(y).alias("q"))
    return F.forall(pairs, lambda p: F.coalesce((p["p"] == p["q"]) | (p["p"] == "*") | (p["q"] == "*"), F.lit(True)))


def link_name(uc: Column, x: Column, y: Column) -> Column:
    """The meet of two matching connectors: type, then the letter of either side, * where
    neither has one, without * at the end."""
    letters = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    pick = lambda p: F.coalesce(F.nullif(p["p"], F.lit("*")), p["q"], F.lit("*"))
    joined = F.array_join(F.transform(F.arrays_zip(letters(x).alias("p"), letters(y).alias("q")), pick), "")
    return F.concat(uc, F.regexp_replace(joined, r"\*+$", ""))
