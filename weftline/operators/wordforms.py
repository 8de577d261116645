"""What a raw token holds: punctuation, units, parts, capitals, places, splits and guesses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

#: Tokens of a text that go to Spark in one batch.
TOKENS_AT_ONCE = 1 << 14
# Marks that strip off either end, marks that split a token, units, prefixes, idioms.
MARKS = r"[,;:\"'()\[\]]"
MIDDLE = r"[-/_|]+"
UNITS = ["kg", "km", "cm", "mm", "th", "st", "nd", "rd", "pm", "am", "x", "%"]
PREFIXES = ["re", "un", "en", "be", "ver", "ge", "er", "in"]
IDIOMS = [("of", "the", "of_the"), ("in", "the", "in_the"), ("de", "la", "de_la"), ("it", "is", "it_is"), ("and", "the", "and_the")]


def raw_tokens(sents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w (from 1) and raw: what white space sets apart, with its punctuation."""
    return sents.select(*keys, F.posexplode(F.split("sentence", r"\s+")).alias("w", "raw")).withColumn("w", F.col("w") + 1).where("raw <> ''")


def stripped(raw: DataFrame) -> DataFrame:
    """raw with left, core and right: marks at either end, kept, and what they enclose."""
    left = F.regexp_extract("raw", f"^({MARKS}+)", 1)
    rest = F.expr("substring(raw, length(left) + 1)")
    out = raw.withColumn("left", left).withColumn("rest", rest).withColumn("right", F.regexp_extract("rest", f"({MARKS}+)$", 1))
    return out.withColumn("core", F.expr("substring(rest, 1, length(rest) - length(right))")).drop("rest")


def with_units(tokens: DataFrame) -> DataFrame:
    """Tokens whose core is a number and a unit of the list, with both."""
    pattern = r"^([0-9]+(?:[.,][0-9]+)*)(" + "|".join(UNITS) + ")$"
    out = tokens.withColumn("number", F.regexp_extract("core", pattern, 1)).withColumn("unit", F.regexp_extract("core", pattern, 2))
    return out.where("unit <> ''")


def middle_parts(tokens: DataFrame) -> DataFrame:
    """Tokens with the parts that marks inside them set apart."""
    return tokens.withColumn("parts", F.filter(F.split("core", MIDDLE), lambda p: p != ""))


def is_capital(word: Column) -> Column:
    """Whether a word begins with a capital letter."""
    first = F.substring(word, 1, 1)
    return (first == F.upper(first)) & (F.lower(first) != F.upper(first))


def capitals(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with status: start (a capital where any word has one, at a sentence's start or
    after a colon or quotation mark: lower case is an alternative), proper, or plain."""
    before = F.lag("raw").over(Window.partitionBy(*keys).orderBy("w"))
    free = before.isNull() | F.endswith(before, F.lit(":")) | F.startswith("raw", F.lit('"'))
    return tokens.withColumn("free", free).withColumn("status", F.when(~is_capital(F.col("core")), "plain").when(F.col("free"), "start").otherwise("proper"))


def offsets(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with their start and end in code points and in bytes of the sentence, its words
    one space apart."""
    before = Window.partitionBy(*keys).orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda size: F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    chars, octets = F.length("raw"), F.octet_length("raw")
    return raw.withColumns({"start": start(chars), "start_byte": start(octets)}).withColumns({"stop": F.col("start") + chars, "stop_byte": F.col("start_byte") + octets})


def positions(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts(keys, text) as keys, w (from 0), token, and its start and end (exclusive) in code
    points and in bytes of the whole text, whatever white space ([\\x20\\x09-\\x0D]) stands around it.

    Places are counted where the text is: nothing is shuffled. Null and empty texts, and those of
    white space, have no tokens; repeated rows give theirs each."""
    kept = texts.select(*keys, "text")
    schema = kept.drop("text").schema.add("w", IntegerType()).add("token", StringType())
    for c in ("start", "stop", "start_byte", "stop_byte"):
        schema = schema.add(c, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                raw = np.frombuffer(text.as_py().encode() if text.is_valid else b"", np.uint8)
                inside = np.concatenate([[False], (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D)), [False]])
                edges = np.flatnonzero(inside[1:] != inside[:-1])
                a, b = edges[::2], edges[1::2]
                points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points begun before each byte
                for k in range(0, len(a), TOKENS_AT_ONCE):
                    x, y = a[k : k + TOKENS_AT_ONCE], b[k : k + TOKENS_AT_ONCE]
                    at = pa.array(np.full(len(x), row, np.int64))
                    own = [batch.column(c).take(at) for c in range(len(keys))]
                    tokens = [raw[i:j].tobytes().decode() for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                    cols = [*own, pa.array(np.arange(k, k + len(x), dtype=np.int32)), pa.array(tokens, pa.string()), *(pa.array(v.astype(np.int64)) for v in (points[x], points[y], x, y))]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return kept.mapInArrow(run, schema)


def splits(words: DataFrame, most: int = 3, longest: int = 6) -> DataFrame:
    """word, parts: all ways to cut a word of up to so many letters into up to so many parts."""
    short = words.where(F.length("word").between(1, longest))
    out = short.select("word", F.array("word").alias("parts"))
    turn = out
    for _ in range(most - 1):  # cut the last part once more
        last = F.element_at("parts", -1)
        turn = turn.withColumn("last", last).where("length(last) > 1").select("word", "parts", "last", F.explode(F.sequence(F.lit(1), F.length("last") - 1)).alias("i"))
        turn = turn.select("word", F.expr("concat(slice(parts, 1, size(parts) - 1), array(substring(last, 1, i), substring(last, i + 1)))").alias("parts"))
        out = out.unionByName(turn)
    return out


def prefixed(words: DataFrame, most: int = 2, least: int = 3) -> DataFrame:
    """word, prefixes, rest: up to so many prefixes of the list taken off, by equi-joins on a
    word's first letters; at least so many letters are left."""
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"))
    sizes = F.explode(F.array(*(F.lit(n) for n in sorted({len(p) for p in PREFIXES}))))
    turn = words.select("word", F.expr("cast(array() as array<string>)").alias("prefixes"), F.col("word").alias("rest"))
    out = None
    for _ in range(most):
        cut = turn.select("*", sizes.alias("n")).where(F.length("rest") >= F.col("n") + least).withColumn("prefix", F.expr("substring(rest, 1, n)"))
        turn = cut.join(table, "prefix").select("word", F.concat("prefixes", F.array("prefix")).alias("prefixes"), F.expr("substring(rest, n + 1)").alias("rest"))
        out = turn if out is None else out.unionByName(turn)
    return out


def run_ons(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, a, b: words that are two known(word) ones run together."""
    cut = words.where("length(word) > 1").select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    cut = cut.select("word", F.expr("substring(word, 1, i)").alias("a"), F.expr("substring(word, i + 1)").alias("b"))
    return cut.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi").select("word", "a", "b")


def guesses(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, guess: the known(word) ones at an edit distance of one. Both sides meet by what
    they and their deletions of a letter have in common; the distance decides."""
    keys = F.expr("array_distinct(concat(array(word), transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))))")
    own = words.where("word <> ''").select("word", F.explode(keys).alias("k"))
    other = known.where("word <> ''").select(F.col("word").alias("guess"), F.explode(keys).alias("k"))
    return own.join(other, "k").where(F.levenshtein("word", "guess") == 1).select("word", "guess").distinct()


def idioms(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens at which an idiom of the list begins, with its name."""
    table = F.broadcast(tokens.sparkSession.createDataFrame(IDIOMS, "word string, after string, idiom string"))
    after = tokens.withColumn("after", F.lead("word").over(Window.partitionBy(*keys).orderBy("w")))
    return after.join(table, ["word", "after"])
