"""Streams of texts: the same sentence and lookup operators, and counts by window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import sentences


def word_classes(texts: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A stream (or table) of texts(ts, text) as window_start, classname, how and n. The watermark
    closes a window, and frees its state, once texts are so late; the dictionary is static."""
    toks = sentences.tokens(sentences.sentences(texts.withWatermark("ts", late), ["ts"]), ["ts"])
    found = sentences.lookup(toks, ["ts"]).where("w > 0")
    out = found.groupBy(F.window("ts", every).alias("win"), "classname", "how").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("win.start").alias("window_start"), "classname", "how", "n")
