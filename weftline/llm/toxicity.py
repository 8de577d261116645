"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is whether a text has an n-gram, inside its lower-cased words with a space at either
end, hashed. Its ratio r compares the share of toxic and other training texts that have it,
smoothed in proportion to the classes, so that a rare feature says nothing either way. A
logistic regression over r-scaled features, of those with |r| over a bound, gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialised, mixed, read_table, text_blocks, words

ORDERS = (3, 4, 5, 6)
FEATURE_BITS = 20
SMOOTHING = 10.0
LEAST_RATIO = 1.0
#: Labelled rows that the fit uses at most: those with the smallest hashes of doc_id.
MAX_LABELLED = 20_000
STEPS = 200
DECAY = 1e-3

_LETTERS = re.compile(r"[^\W\d_]+")


def ngrams(chunks: list[str], active: np.ndarray | None = None) -> list[np.ndarray]:
    """Hashed n-grams of each white-space chunk's words, those of active alone where given."""
    found = [_LETTERS.findall(c.lower()) for c in chunks]
    texts = [f" {w} " for ws in found for w in ws]
    of_chunk = np.repeat(np.arange(len(chunks)), [len(ws) for ws in found])
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pairs = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for n in range(1, min(max(ORDERS), len(c)) + 1):
            m = len(c) - n + 1
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                at = np.flatnonzero(word[:m] == word[n - 1 :])
                f = (mixed(h[at]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
                if active is not None:
                    keep = active[f]
                    at, f = at[keep], f[keep]
                pairs.append((of_chunk[word[at]] << FEATURE_BITS) | f)
    pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))
    stops = np.searchsorted(pairs >> FEATURE_BITS, np.arange(1, len(chunks)))
    return np.split(pairs & ((1 << FEATURE_BITS) - 1), stops)


class Features:
    """Sets of features of texts. Chunks' own features are kept in a bounded memory."""

    def __init__(self, active: np.ndarray | None = None, memory: int = 150_000):
        self.active, self.memory, self.known = active, memory, {}

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and feature of every distinct pair of a block, sorted."""
        starts, ends, h, first = words(data, off)
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > self.memory:
            self.known.clear()
        known = self.known
        new = [i for i, k in enumerate(keys.tolist()) if k not in known]
        chunks = [data[starts[where[i]] : ends[where[i]]].tobytes().decode() for i in new]
        known.update(zip(keys[new].tolist(), ngrams(chunks, self.active), strict=False))
        parts = [known[k] for k in keys.tolist()]
        lens = np.array([len(f) for f in parts], np.int64)
        rows = np.repeat(np.arange(len(off) - 1), np.diff(first))
        some = lens[back] > 0 if len(back) else np.zeros(0, bool)
        pairs = np.unique(rows[some] * (len(keys) + 1) + back[some])
        rows, back = pairs // (len(keys) + 1), pairs % (len(keys) + 1)
        n = lens[back] if len(back) else np.zeros(0, np.int64)
        base, stop = np.cumsum(lens) - lens, np.cumsum(n)
        pick = np.repeat(base[back] - (stop - n), n) + np.arange(int(n.sum())) if len(back) else np.zeros(0, np.int64)
        flat = np.concatenate([*parts, np.zeros(0, np.int64)])[pick]
        pairs = np.unique((np.repeat(rows, n) << FEATURE_BITS) | flat)
        return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)


@dataclass
class Model:
    """weights: of the features in ids, ratio included."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, features: Features) -> np.ndarray:
        table = np.zeros(1 << FEATURE_BITS)
        table[self.ids] = self.weights
        z = np.full(len(texts), self.bias)
        for row, data, off in text_blocks(texts):
            at, f = features.block(data, off)
            z[row : row + len(off) - 1] += np.bincount(at, table[f], len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def features(self) -> Features:
        active = np.zeros(1 << FEATURE_BITS, bool)
        active[self.ids] = True
        return Features(active)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """text and y of at most bound labelled documents outside the held-out fold. Of rows of one
    doc_id, the first text in order trains, so that the bound holds for texts too."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # its bound lets it be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """The classifier, from at most bound labelled documents."""
    rows = materialised(training_rows(docs, labels, bound), "labelled")
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        n = np.zeros((2, 1 << FEATURE_BITS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column("y"))
            total += np.bincount(y, minlength=2)[:2]
            for row, data, off in text_blocks(batch.column("text")):
                at, f = features.block(data, off)
                own = y[row + at]
                for c in (0, 1):
                    n[c] += np.bincount(f[own == c], minlength=n.shape[1])
        ids = np.flatnonzero(n.sum(0))
        cols = [np.append(ids, -1), np.append(n[0][ids], total[0]), np.append(n[1][ids], total[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["f", "n0", "n1"])

    counts = rows.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.where("f = -1").first()
    n0, n1 = (total["n0"], total["n1"]) if total else (0, 0)
    bias = float(np.log((n1 + 0.01) / (n0 + 1)))
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    share = n1 / (n0 + n1)
    ratio = F.log((F.col("n1") + SMOOTHING * share) / n1) - F.log((F.col("n0") + SMOOTHING * (1 - share)) / n0)
    # at most 2**FEATURE_BITS rows, whatever the input
    kept = counts.where("f >= 0").select("f", ratio.alias("r")).where(F.abs("r") > LEAST_RATIO).orderBy("f").toArrow()
    ids, r = np.asarray(kept["f"], np.int64), np.asarray(kept["r"], np.float64)
    active = np.zeros(1 << FEATURE_BITS, bool)
    active[ids] = True
    shared = spark.sparkContext.broadcast(active)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            for row, data, off in text_blocks(batch.column("text")):
                at, f = features.block(data, off)
                first = np.searchsorted(at, np.arange(len(off)))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(f, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(row, len(off) - 1), lists], names=["y", "f"])

    # at most bound short lists
    sample = rows.mapInArrow(vectors, "y int, f array<int>").toArrow()
    lists = sample["f"].combine_chunks()
    f = np.searchsorted(ids, np.asarray(lists.flatten(), np.int64))
    at = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64))
    w, b = descend(at, f, r, np.asarray(sample["y"], np.float64), bias)
    return Model(ids, w * r, b)


def descend(at: np.ndarray, f: np.ndarray, r: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradients with steps of their own for each weight."""
    w, g2, b2 = np.zeros(len(r)), np.full(len(r), 1e-8), 1e-8
    x = r[f]
    for _ in range(STEPS):
        z = np.bincount(at, x * w[f], len(y)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(f, x * e[at], len(r)) + DECAY * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        b2 += e.sum() ** 2
        bias -= 0.3 * e.sum() / np.sqrt(b2)
    return w, float(bias)


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document(doc_id, text, ...).

    Null and empty texts score what the bias alone gives; an empty table gives no rows;
    repeated rows score alike; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value.features()
        for batch in batches:
            s = shared.value.scores(batch.column("text"), features)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns whatever their names, that the model does not call toxic.

    Null and empty texts score what the bias alone gives, and so stay unless most labels are
    toxic; repeated rows stay or go alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value.features()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column("text"), features) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, read_table(spark, sf_dir, "labels")))
