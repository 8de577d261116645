"""Expressions as tables: entry, slot, alt, clause, cost, optional. An entry is an AND of slots
in order, a slot an OR of alternatives, optional slots may stay empty, costs add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries of our own.
SLOTS = [
    ("dog.n", 1, 1, "Ds-", 0.0, True), ("dog.n", 2, 1, "Ss+", 0.0, False), ("dog.n", 2, 2, "Os-", 0.5, False), ("dog.n", 2, 3, "Js-", 0.25, False),
    ("run.v", 1, 1, "S-", 0.0, False), ("run.v", 2, 1, "O+", 0.0, True), ("run.v", 2, 2, "MV+", 0.25, True), ("run.v", 3, 1, "MV+", 0.5, True),
    ("fish.n", 1, 1, "Ds-", 0.0, True), ("fish.n", 2, 1, "Ss+", 0.0, False), ("fish.n", 2, 2, "Ss+", 1.0, False),
    ("quickly.e", 1, 1, "MV-", 0.0, False), ("quickly.e", 1, 2, "E+", 3.0, False),
]
SCHEMA = "entry string, slot int, alt int, clause string, cost double, optional boolean"


def expanded(slots: DataFrame) -> DataFrame:
    """entry, disjunct, cost: one row for each way to fill an entry's slots, joined slot by
    slot, as many joins as the longest entry has slots."""
    empty = slots.where("optional").select("entry", "slot", F.lit("").alias("clause"), F.lit(0.0).alias("cost")).distinct()
    rows = slots.select("entry", "slot", "clause", "cost").unionByName(empty)
    out = slots.select("entry").distinct().select("entry", F.lit("").alias("disjunct"), F.lit(0.0).alias("total"))
    for i in range(1, (slots.agg(F.max("slot")).first()[0] or 0) + 1):
        step = rows.where(F.col("slot") == i)
        glue = F.when((F.col("disjunct") != "") & (F.col("clause") != ""), " & ").otherwise("")
        out = out.join(step, "entry", "left").select("entry", F.concat("disjunct", F.coalesce(glue, F.lit("")), F.coalesce("clause", F.lit(""))).alias("disjunct"), (F.col("total") + F.coalesce("cost", F.lit(0.0))).alias("total"))
    return out.where("disjunct <> ''").withColumnRenamed("total", "cost")


def cheapest(disjuncts: DataFrame, cutoff: float = 2.7) -> DataFrame:
    """Equal disjuncts of an entry once, at the least cost, those over the cut-off left out."""
    return disjuncts.groupBy("entry", "disjunct").agg(F.min("cost").alias("cost"), F.count(F.lit(1)).alias("n")).where(F.col("cost") <= cutoff)


def clause_counts(slots: DataFrame) -> DataFrame:
    """entry, n_clauses, n_connectors: how many ways there are to fill an entry's slots, without
    filling them, and how many connectors its expression has."""
    ways = slots.groupBy("entry", "slot").agg((F.count(F.lit(1)) + F.max(F.col("optional").cast("int"))).alias("ways"), F.count(F.lit(1)).alias("n"))
    return ways.groupBy("entry").agg(F.round(F.product("ways")).cast("long").alias("n_clauses"), F.sum("n").alias("n_connectors"))


def entries_of(disjuncts: DataFrame) -> DataFrame:
    """disjunct, entries, n, least: which entries share a disjunct."""
    return disjuncts.groupBy("disjunct").agg(F.array_join(F.array_sort(F.collect_set("entry")), " ").alias("entries"), F.countDistinct("entry").alias("n"), F.min("cost").alias("least"))
