"""LM scoring by masked pseudo-likelihood.

A token is a word; a network of a window predicts each from the two words on either side. Words
are hashed to buckets, counted over all documents in Spark and numbered by their counts. The
number of a token, in three digits, is predicted digit by digit: each digit has a softmax over
what the window says, weighed by the digits before it, and a bias from their counts. So every
token has a probability of its own in every window, they sum to one, and the untrained network
gives the tokens' shares of the corpus. The network is trained in numpy on every partition of
the corpus from the same start, for a few rounds, on every word in one of them, its weights
averaged by Spark after each. A document's score is the sum of its words' conditional
log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialised, read_table, text_blocks, words

BUCKET_BITS = 18
#: A token's number has DIGITS digits of this base. The most frequent buckets are tokens of their
#: own; the rest share the last SHARED, with their counts to tell them apart.
RADIX = 32
DIGITS = 3
TOKENS = RADIX**DIGITS
SHARED = 1024
EDGE = TOKENS
#: Vectors of words of the window: one for each of the first tokens, SHARED_VECTORS for the rest
#: and one for what lies beyond a document's ends.
VECTORS = 4096
SHARED_VECTORS = 256
SIDE = 2
HIDDEN = 32
#: Every word of every document is a training example in one of the rounds.
ROUNDS = 3
BATCH = 2048
RATE = 0.2
CHUNK = 1 << 14


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket's words stand in all documents: an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, data, off in text_blocks(batch.column("text")):
                n += np.bincount(_buckets(words(data, off)[2]), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[np.asarray(found["bucket"])] = np.asarray(found["n"])
    return out


@dataclass
class Vocabulary:
    """Each bucket's token and log-probability within it, which is 0 for tokens of one bucket."""

    tokens: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        own = TOKENS - SHARED
        tokens = own + np.arange(len(counts)) % SHARED
        top = np.lexsort((np.arange(len(counts)), -counts))[:own]
        tokens[top] = np.arange(len(top))
        total = np.bincount(tokens, counts + 0.5, TOKENS)
        return cls(tokens.astype(np.uint16), np.log((counts + 0.5) / total[tokens]))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, within (sum of what tells the words of shared tokens apart) and a
    document's tokens, two bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            ns, sums, raw = [], [], []
            for _, data, off in text_blocks(batch.column("text")):
                _, _, h, first = words(data, off)
                b = _buckets(h)
                t = v.tokens[b].astype("<u2").tobytes()
                total = np.append(0.0, np.cumsum(v.within[b]))
                ns.append(np.diff(first))
                sums.append(total[first[1:]] - total[first[:-1]])
                raw += [t[2 * p : 2 * q] for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            if raw:
                cols = [batch.column("doc_id"), pa.array(np.concatenate(ns)), pa.array(np.concatenate(sums)), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "within", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, within double, tokens binary")


def _vectors() -> np.ndarray:
    """The vector of each token, and of the edge."""
    t = np.arange(TOKENS + 1)
    own = VECTORS - SHARED_VECTORS
    out = np.where(t < own, t, own + t % SHARED_VECTORS)
    out[EDGE] = VECTORS
    return out.astype(np.uint16)


_VECTOR_OF = _vectors()


def changes(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


class Network:
    """A token from the vectors of SIDE words on either side: their sum, each scaled by its
    place, a hidden layer, and a softmax for each digit of the token's number."""

    SHAPES = (
        (VECTORS + 1, HIDDEN),  # the words' vectors
        (2 * SIDE, HIDDEN),  # scales of places
        (HIDDEN,),
        *(shape for d in range(DIGITS) for shape in ((RADIX**d, HIDDEN), (HIDDEN, RADIX), (RADIX**d, RADIX))),
    )

    def __init__(self, flat: np.ndarray):
        self.parts, at = [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small seeded weights, and biases that predict the tokens' own shares."""
        rng = np.random.default_rng(7)
        parts = [rng.normal(0, 0.1, cls.SHAPES[0]), rng.normal(0, 1, cls.SHAPES[1]), np.zeros(HIDDEN)]
        for d in range(DIGITS):
            n = (counts + 0.5).reshape(RADIX**d, RADIX, -1).sum(2)
            parts += [np.ones((RADIX**d, HIDDEN)), rng.normal(0, 0.1, (HIDDEN, RADIX)), np.log(n / n.sum(1, keepdims=True))]
        return cls(np.concatenate([p.ravel() for p in parts]))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        e, s, b = self.parts[:3]
        z = b + e.take(near[0], 0) * s[0]
        for j in range(1, 2 * SIDE):
            z += e.take(near[j], 0) * s[j]
        return np.tanh(z)

    def digits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each digit: what stands before it, itself, the weighed hidden layer and the
        log-probabilities of all its values."""
        for d in range(DIGITS):
            u, w, b = self.parts[3 + 3 * d : 6 + 3 * d]
            before, digit = np.divmod(at // RADIX ** (DIGITS - 1 - d), RADIX)
            g = h * u.take(before, 0)
            z = g @ w
            z += b.take(before, 0)
            np.clip(z, -60, 60, out=z)
            z -= np.log(np.exp(z) @ np.ones((RADIX, 1), np.float32))
            yield before, digit, g, z

    def log_probs(self, near: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        rows = np.arange(len(at))
        return sum(z[rows, digit] for _, digit, _, z in self.digits(self.hidden(near), at))

    def gradients(self, near: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
        """For each part, the rows that a batch in order of its tokens touches and their
        gradients of the batch's summed loss."""
        e, s, _ = self.parts[:3]
        h = self.hidden(near)
        dh, rows, own = np.zeros_like(h), np.arange(len(at)), []
        for d, (before, digit, g, z) in enumerate(self.digits(h, at)):
            u, w, _ = self.parts[3 + 3 * d : 6 + 3 * d]
            p = np.exp(z)
            p[rows, digit] -= 1
            dg = p @ w.T
            first = changes(before)
            k, sums = before[first], np.add.reduceat(np.concatenate([dg * h, p], 1), first, 0)
            own += [(k, sums[:, :HIDDEN]), (slice(None), g.T @ p), (k, sums[:, HIDDEN:])]
            dh += dg * u.take(before, 0)
        dh *= 1 - h * h
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = changes(flat)
        k = flat[first]
        de = np.concatenate([dh * s[j] for j in range(2 * SIDE)])
        ds = np.stack([(dh * e.take(near[j], 0)).sum(0) for j in range(2 * SIDE)])
        return [(k, np.add.reduceat(de.take(order, 0), first, 0)), (slice(None), ds), (slice(None), dh.sum(0)), *own]

    def train(self, near: np.ndarray, at: np.ndarray, squares: list[np.ndarray]) -> None:
        """One step on a batch; squares: the sums of squared gradients so far."""
        order = np.argsort(at, kind="stable")
        for x, (k, g), s in zip(self.parts, self.gradients(near.take(order, 1), at[order].astype(np.int64)), squares, strict=True):
            sums = s[k] + g * g
            s[k] = sums
            x[k] -= RATE * g / np.sqrt(sums)


def contexts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a batch's documents: vectors around each, its own token, and where
    documents start. Documents are edged, so that no window looks into another one."""
    raw = batch.column("tokens").to_pylist()
    edge = np.full(SIDE, EDGE, "<u2").tobytes()
    joined = np.frombuffer(edge + edge.join(raw) + edge, "<u2")
    n = np.array([len(r) // 2 for r in raw], np.int64)
    starts = np.cumsum(n) - n
    at = np.repeat(SIDE * (np.arange(len(raw)) + 1), n) + np.arange(int(n.sum()))
    vectors = _VECTOR_OF[joined]
    near = np.stack([vectors[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))])
    return near, joined[at], starts


def lessons(starts: np.ndarray, n: int, turn: int) -> np.ndarray:
    """Which of a batch's n words are examples in a round: by their places in their documents,
    so that over the rounds each word is one once, however documents fall into batches."""
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return np.flatnonzero(place % ROUNDS == turn)


def first_squares() -> list[np.ndarray]:
    return [np.ones(shape, np.float32) for shape in Network.SHAPES]


def train(encoded: DataFrame, counts: np.ndarray) -> Network:
    """The network after ROUNDS rounds over all of the corpus's partitions, all words in all.
    A weight's mean is over the partitions that changed it, by their words."""
    spark, net = encoded.sparkSession, Network.start(counts)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            own, n, squares = Network(start.value), 0, first_squares()
            before = own.flat()
            for batch in batches:
                near, at, starts = contexts(batch)
                pick = np.random.default_rng(turn).permutation(lessons(starts, len(at), turn))
                for i in range(0, len(pick), BATCH):
                    own.train(near[:, pick[i : i + BATCH]], at[pick[i : i + BATCH]], squares)
                n += len(pick)
            flat = own.flat()
            changed = np.flatnonzero(flat != before)
            for i in range(0, len(changed), CHUNK):
                k = changed[i : i + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(flat[k] * n), pa.array(np.full(len(k), n))], names=["i", "v", "n"])

        means = encoded.select("tokens").mapInArrow(run, "i long, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        flat = net.flat()
        flat[np.asarray(means["i"])] = np.asarray(means["v"])
        net = Network(flat)
    return net


def scored(encoded: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens and log_prob of encoded documents."""
    shared = encoded.sparkSession.sparkContext.broadcast(net.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value)
        for batch in batches:
            near, at, starts = contexts(batch)
            sums = np.zeros(len(at) + 1)
            for i in range(0, len(at), CHUNK):
                sums[i + 1 : i + 1 + CHUNK] = own.log_probs(near[:, i : i + CHUNK], at[i : i + CHUNK])
            total = np.cumsum(sums)
            stops = np.append(starts[1:], len(at))
            score = total[stops] - total[starts] + np.asarray(batch.column("within"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(score)], names=["doc_id", "n_tokens", "log_prob"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, log_prob double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) as doc_id, n_tokens, log_prob (sum over the words) and
    mean_log_prob (null without words).

    Null, empty and white texts have no tokens and log_prob 0. Every document counts and
    trains, each of its words once, repeated rows as often as they stand. An empty table gives no rows; a text of any
    length is scored in pieces of bounded memory. Other columns are not read."""
    counts = bucket_counts(docs)
    vocabulary = Vocabulary.of(counts)
    encoded = materialised(encode(docs, vocabulary), "tokens")
    net = train(encoded, np.bincount(vocabulary.tokens, counts, TOKENS))
    return scored(encoded, net).withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
