"""Token counts: the tokenizer's pieces are counted once for each distinct pre-token, the counts
meet the pre-token frequencies of each document, and their products are summed. No ids are kept."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialised, read_table, span_hashes, text_blocks
from weftline.llm.packing import vocabulary_path

LIMIT = 2048
#: The most frequent pre-tokens, as many as this at most, meet the frequencies in memory (12 bytes
#: each); all others by a shuffle. Both give the same sums.
MOST_FREQUENT = 1 << 19
#: A block of whole texts that one turn counts together, in bytes.
BLOCK = 1 << 21

_APART, _LETTER, _DIGIT, _MARK, _GLUE = range(5)
_KIND = np.full(256, _GLUE, np.uint8)  # other bytes, control characters, and marks that may begin a longer token
_KIND[33:127] = _MARK
_KIND[[ord(c) for c in "'<|>"]] = _GLUE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _APART


def pre_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of a block's pre-tokens, and each text's first one (one more entry
    than texts). White space is dropped, and a text is cut only where the tokenizer cuts as well:
    between ASCII letters, digits and other marks, and around every digit. Where an apostrophe
    (contractions), a bracket or bar (special tokens), a control character or any other script
    touches, what white space sets apart stays whole, and the tokenizer itself cuts it."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _KIND[data]
    new = np.ones(n, bool)
    a, b = kind[:-1], kind[1:]
    new[1:] = ((a != b) & (a != _GLUE) & (b != _GLUE)) | ((a == _DIGIT) & (b == _DIGIT)) | (a == _APART) | (b == _APART)
    new[off[:-1][off[:-1] < n]] = True  # a text begins
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    solid = kind[starts] != _APART
    starts, ends = starts[solid], ends[solid]
    return starts, ends, np.searchsorted(starts, off)


def _loaded(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
    return Tokenizer.from_file(path)


def fits(path: str) -> bool:
    """Whether the tokenizer drops white space and cuts where pre_tokens does, by a few probes."""
    tok = _loaded(path)
    whole = tok.encode("of 12 words, don't\n(x2) #a-b", add_special_tokens=False).ids
    parts = ["of", "1", "2", "words", ",", "don't", "(", "x", "2", ")", "#", "a", "-", "b"]
    return whole == [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, off in text_blocks(batch.column(0), BLOCK):
            s, e, _ = pre_tokens(data, off)
            _, at, n = np.unique(span_hashes(data, s, e, fold=False), return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[i:j].decode("utf-8", "replace") for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def piece_counts(texts: DataFrame, path: str) -> DataFrame:
    """texts(text) as key, n and pieces: each distinct pre-token's hash, how often it stands, and
    how many ids the tokenizer gives it. Every pre-token is encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            raw = [w.encode() for w in words]
            stop = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            keys = span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, stop[:-1]), stop, fold=False)
            found = tok.encode_batch_fast(words, add_special_tokens=False)
            pieces = np.fromiter((len(x.ids) for x in found), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1), pa.array(pieces)], names=["key", "n", "pieces"])

    words = texts.select("text").mapInArrow(_distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(count, "key long, n long, pieces long")


def _frequent(counted: DataFrame, most: int) -> Column:
    """Whether a pre-token is a frequent one: at most so many are, by a histogram of quarter
    powers of two of n."""
    b = F.floor(F.log2(F.col("n")) * 4).cast("int")
    bins = counted.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()  # at most 253 rows
    have, least = 0, 253
    for r in sorted(bins, key=lambda r: -r["b"]):
        have += r["k"]
        if have > most:
            break
        least = r["b"]
    return b >= least


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, most: int = MOST_FREQUENT) -> DataFrame:
    """docs(doc_id, text, ...) as doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Tokens are counted as the tokenizers library counts them without added special tokens; the
    strings of special tokens inside texts are special tokens, as by its default. path names a
    tokenizer that drops white space and cuts between letters, digits and marks (an error says
    where one does not). A null text counts as empty: 0 bytes and tokens. Repeated rows and rows
    with a null doc_id give a row each; an empty table gives no rows; other columns of docs are
    not read. Pre-tokens are told apart by 64-bit hashes."""
    path = path or vocabulary_path()
    if not fits(path):
        raise ValueError(f"{path}: this tokenizer does not cut where pre-tokens are cut")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = materialised(piece_counts(rows, path), "pieces")
    frequent = _frequent(counted, most)
    table = counted.where(frequent).select("key", "pieces").toArrow()  # at most `most` rows of 16 bytes
    keys = np.asarray(table.column("key").combine_chunks(), np.int64)
    order = np.argsort(keys)
    keys, pieces = keys[order], np.asarray(table.column("pieces").combine_chunks(), np.int64)[order].astype(np.int32)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in text_blocks(batch.column("text"), BLOCK):
                s, e, first = pre_tokens(data, off)
                docs_n = len(off) - 1
                own, back = np.unique(span_hashes(data, s, e, fold=False).view(np.int64), return_inverse=True)
                # how often each document has each pre-token
                pair, freq = np.unique(np.repeat(np.arange(docs_n), np.diff(first)) * max(1, len(own)) + back, return_counts=True)
                doc, word = pair // max(1, len(own)), pair % max(1, len(own))
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                known = (keys[at] == own) if len(keys) else np.zeros(len(own), bool)
                each = np.where(known, pieces[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                total = np.bincount(doc, freq * each[word], docs_n).astype(np.int64)  # exact under 2**53
                rest = np.flatnonzero(~known[word])
                starts = np.searchsorted(doc[rest], np.arange(docs_n + 1)).astype(np.int32)
                kinds = pa.StructArray.from_arrays([pa.array(own[word[rest]]), pa.array(freq[rest].astype(np.int64))], names=["key", "n"])
                cols = [batch.column("doc_id").slice(row, docs_n), pa.array(np.diff(off)), pa.array(total), pa.ListArray.from_arrays(pa.array(starts), kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "common", "rest"])

    schema = "doc_id long, n_bytes long, common long, rest array<struct<key:long,n:long>>"
    own = materialised(rows.mapInArrow(frequencies, schema).withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rare = own.select("row", F.explode("rest").alias("x")).select("row", "x.*")
    sums = rare.join(counted.where(~frequent).select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("common") + F.coalesce("more", F.lit(0))
    out = own.select("row", "doc_id", "n_bytes", "common").join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
