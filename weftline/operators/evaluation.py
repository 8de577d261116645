"""Labelled corpora: a sentence marked * must not parse, any other must."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A labelled corpus of our own.
CORPUS = [
    (1, " ", "the dog chased the cat"), (2, " ", "it is a test"), (3, "*", "dog the chased"), (4, " ", "they walked"), (5, "*", "the the the"),
    (6, " ", "she walked in the park"), (7, "*", "of of it"), (8, " ", "this dog is a friend"), (9, "*", "walked the"), (10, " ", "he painted the house with a brush"),
]


def errors(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """corpus(line, label, ...) with n_parses and error: whether parsing contradicts the label."""
    n = F.coalesce("n_parses", F.lit(0)).cast("long")
    return corpus.join(counts, "line", "left").withColumn("n_parses", n).withColumn("error", (F.col("label") == "*") == (F.col("n_parses") > 0))
