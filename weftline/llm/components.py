"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialised


def components(links: DataFrame) -> DataFrame:
    """links(x long, y long) as node, root: the smallest node of each node's component.

    Each turn hangs every node below its least neighbour, gives it the end of that chain and
    makes one node of what has the same end. A turn leaves at most half of the nodes, and of the
    links only those between different ends, once each, so that all turns together read little more
    than the links. Every turn's tables are written to the shared folder. No links give no rows."""
    edges = materialised(_between(links.where("x <> y")), "edges")
    alone = links.where("x = y").select(F.col("x").alias("node"), F.col("y").alias("root")).distinct()
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        ends = _ends(materialised(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "near"))
        left = edges.join(ends.toDF("x", "rx"), "x").join(ends.toDF("y", "ry"), "y").where("rx <> ry")
        edges = materialised(_between(left.select(F.col("rx").alias("x"), F.col("ry").alias("y"))), "edges")
        if labels is None:
            labels = ends
        else:
            over = labels.join(ends.toDF("root", "over"), "root", "left")
            labels = materialised(over.select("node", F.coalesce("over", "root").alias("root")), "labels")
    if labels is None:
        return alone
    return labels.union(alone.join(labels, "node", "left_anti"))


def _between(links: DataFrame) -> DataFrame:
    return links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _ends(step: DataFrame) -> DataFrame:
    """node, root: where each node's chain of roots ends, chains being halved until all have ended."""
    while True:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("over"))
        jumped = materialised(step.join(up, "root").select("node", F.col("root").alias("old"), F.col("over").alias("root")), "ends")
        step = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return step
