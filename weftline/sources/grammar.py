"""A small grammar of our own in two tables: words by class, and clauses (disjuncts) by class.

A clause is a list of connectors joined by &: capital letters (the type), small letters (the
subtype, * for any), - for a link to the left and + for one to the right, @ before one that may
link more than once. Of connectors of one direction the first links nearest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Closed-class words of the grammar, by class.
CLOSED = {
    "det": "the a an this that der die das ein eine le la les un une el los las una",
    "prep": "of in to with for on by at from von mit zu auf für de du des en para con por dans sur",
    "conj": "and or und oder et ou y o",
    "pron": "it he she they es er sie il elle él ella",
    "be": "is are was were be ist sind war est sont era son",
}
# Clauses of each class and their costs.
CLAUSES = [
    ("LEFT-WALL", "Wd+", 0.0),
    ("det", "Ds+", 0.0),
    ("noun", "Ds- & Wd- & Ss+", 0.0),
    ("noun", "Wd- & Ss+", 0.5),
    ("noun", "Ds- & Os-", 0.0),
    ("noun", "Os-", 0.5),
    ("noun", "Ds- & Js-", 0.0),
    ("noun", "Js-", 0.5),
    ("noun", "Ds- & Os- & @M+", 0.2),
    ("verb", "S*- & O*+", 0.0),
    ("verb", "S*-", 0.3),
    ("verb", "S*- & @MV+", 0.3),
    ("verb", "S*- & O*+ & @MV+", 0.1),
    ("be", "S*- & O*+", 0.0),
    ("be", "S*- & O*+ & @MV+", 0.1),
    ("pron", "Wd- & Ss+", 0.0),
    ("pron", "Os-", 0.2),
    ("prep", "MV- & J*+", 0.0),
    ("prep", "M- & J*+", 0.1),
    ("conj", "MV- & J*+", 1.0),
]
# The ordered patterns of open-class words; the first that matches decides.
PATTERNS = [
    (1, "NUMBER", r"^[0-9]+([.,][0-9]+)*$", "noun"),
    (2, "ED-WORD", r"^[a-zà-ÿ]{2,}ed$", "verb"),
    (3, "ING-WORD", r"^[a-zà-ÿ]{2,}ing$", "verb"),
    (4, "S-WORD", r"^[a-zà-ÿ]{3,}es$", "verb"),
    (5, "ANY-WORD", r"^[a-zà-ÿ]+$", "noun"),
]

# Suffixes that may split off a word, and the letters its stem has at least.
SUFFIXES = ["ed", "ing", "es", "ly", "ment", "tion", "ung", "en"]
STEM_LETTERS = 2
# Clauses that only a dialect allows, and what each dialect makes them cost.
DIALECT_CLAUSES = [("noun", "Wd- & Ss+", "headline"), ("noun", "Os-", "headline"), ("noun", "Js-", "headline"), ("conj", "MV- & J*+", "loose")]
DIALECTS = [("headline", "headline", 0.0), ("colloquial", "headline", 1.0), ("colloquial", "loose", 0.5)]
#: What a clause costs that no dialect in use allows: over any cut-off.
NOT_ALLOWED = 10000.0


def morphemes(spark: SparkSession) -> DataFrame:
    """morpheme, subscript, classname."""
    rows = [(w, f"{w}.{c}", c) for c, ws in CLOSED.items() for w in ws.split()] + [("LEFT-WALL", "LEFT-WALL", "LEFT-WALL")]
    return spark.createDataFrame(rows, "morpheme string, subscript string, classname string")


def clauses(spark: SparkSession) -> DataFrame:
    """classname, disjunct, cost."""
    return spark.createDataFrame(CLAUSES, "classname string, disjunct string, cost double")


def patterns(spark: SparkSession) -> DataFrame:
    """ord, name, pattern, classname."""
    return spark.createDataFrame(PATTERNS, "ord int, name string, pattern string, classname string")


def from_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A grammar of the same two tables, from Parquet."""
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("morphemes", "clauses")}


def dialect_clauses(spark: SparkSession, dialects: list[str]) -> DataFrame:
    """As clauses(), under the named dialects: a clause of a component costs what the last of
    them that knows the component says, and too much if none does."""
    marks = spark.createDataFrame(DIALECT_CLAUSES, "classname string, disjunct string, component string")
    rows = [(dialects.index(d), c, cost) for d, c, cost in DIALECTS if d in dialects]
    costs = spark.createDataFrame(rows, "at int, component string, told double").groupBy("component").agg(F.max_by("told", "at").alias("told"))
    out = clauses(spark).join(marks, ["classname", "disjunct"], "left").join(costs, "component", "left")
    cost = F.when(F.col("component").isNull(), F.col("cost")).otherwise(F.coalesce("told", F.lit(NOT_ALLOWED)))
    return out.select("classname", "disjunct", cost.alias("cost"))


def inspected(spark: SparkSession, pattern: str) -> DataFrame:
    """The dictionary's words that match a pattern in which * stands for any letters, with
    their classes, clauses and costs."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return morphemes(spark).where(F.col("morpheme").like(like)).join(clauses(spark), "classname").select("morpheme", "subscript", "classname", "disjunct", "cost")
