"""Which alternatives of a word graph fit together: those that one path through it passes.

A token's graph is nested: it stands as it is, or one of its alternatives does, whose parts follow
each other and are graphs again. A word's address lists the choices on the way to it, an
alternative and a part by turns, and ends with alternative 0, the token as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut


def addressed(rows: DataFrame, types: DataFrame) -> DataFrame:
    """root, word and address of every word in the graphs of types(token), from the rows that
    wordgraph.issued gives: as many turns as alternatives nest, each over the last one's parts.
    Repeated types and rows count once; a token without rows has no words."""
    rows = cut(rows.select("token", "whole", "parts").distinct())
    wholes = rows.where("whole").select("token").distinct()
    order = F.row_number().over(Window.partitionBy("token").orderBy("parts"))
    alts = cut(rows.where("parts is not null").select("token", "parts").distinct().withColumn("alt", order).select("token", "alt", F.posexplode("parts").alias("part", "next")))
    new = cut(types.select(F.col("token").alias("root"), "token").distinct().withColumn("address", F.expr("cast(array() as array<int>)")))
    out = None
    while not new.isEmpty():
        words = new.join(wholes, "token").select("root", F.col("token").alias("word"), F.concat("address", F.array(F.lit(0))).alias("address"))
        out = words if out is None else out.unionByName(words)
        new = cut(new.join(alts, "token").select("root", F.col("next").alias("token"), F.concat("address", F.array("alt", "part")).alias("address")))
    return types.select(F.col("token").alias("root"), F.col("token").alias("word"), F.expr("cast(array() as array<int>)").alias("address")).limit(0) if out is None else out


def breaks(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """chosen(keys, i, address): the words that a linkage uses, i being their token's place. keys
    and breaks: neighbours among them that no path passes both of; a linkage without any is one
    path's.

    Words of different tokens always fit. Of one token's, two fit where their addresses first
    differ in a part, and not where they do in an alternative. In the order of addresses, if each
    word fits the next one, all fit: the first difference of two words is one that stands between
    neighbours. So no pairs are made, only one sort of a token's chosen words. A word that is
    chosen twice fits itself; rows with a null address tell of unlinked words, which any path may pass."""
    before = F.lag("address").over(Window.partitionBy(*keys, "i").orderBy("address"))
    at = F.array_position(F.zip_with("address", "before", lambda x, y: x.eqNullSafe(y)), False)
    rows = chosen.select(*keys, "i", "address").withColumn("before", F.when(F.col("address").isNotNull(), before))
    return rows.groupBy(*keys).agg(F.sum(F.when(F.col("before").isNotNull() & (at % 2 == 1), 1).otherwise(0)).alias("breaks"))


def sane(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of linkages all of whose chosen words lie on one path."""
    return breaks(chosen, keys).where("breaks = 0").select(*keys)
