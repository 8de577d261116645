"""Packing by power-of-two decomposition: each document's tokens fall into pieces of binary
lengths, longest first, and pieces of equal length form a bucket of sequences. A piece is a
sequence by itself, so no sequence crosses documents and none needs padding."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialised, read_table, span_hashes, text_blocks, words

MAX_LENGTH = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """Token ids of texts whose tokenizer cuts at ASCII white space at the latest: ids of a
    text are those of its white-space chunks in order.

    A memory of fixed size keeps the ids of short chunks, each in the slot that its hash names,
    where a later one of the same slot takes its place."""

    SLOT_BITS = 21
    WIDTH = 8

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        self.tok = Tokenizer.from_file(path)
        n = 1 << self.SLOT_BITS
        self.keys, self.lens = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        self.ids = np.zeros((n, self.WIDTH), np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        # letters of the Latin blocks as the tokenizer's model has them: lower case, bytes as characters
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in range(0x250) if chr(c).isalpha() and len(chr(c).lower()) == 1]
        self.latin, self.letters = {ord(c): bytewise.pre_tokenize_str(c.lower())[0][0] for c in latin}, frozenset(latin)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one behind the other, and their numbers. Normalising and cutting
        leave a chunk of Latin letters one lower-case word, so its ids come straight from the
        tokenizer's model, which is faster."""
        latin, model = self.latin, self.tok.model
        plain = [self.letters.issuperset(c) for c in chunks]
        rest = iter(self.tok.encode_batch_fast([c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
        parts = [[t.id for t in model.tokenize(c.translate(latin))] if p else next(rest).ids for c, p in zip(chunks, plain, strict=True)]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(chain.from_iterable(parts), self.ids.dtype, int(n.sum())), n

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and each text's first id (one more than texts)."""
        starts, ends, _, first = words(data, off)
        # a full stop or comma after an ASCII letter or digit, or a letter from À to ÿ, is a token of its own
        last, before, two = data[ends - 1], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
        low = before | 32
        letter = ((low >= 97) & (low <= 122)) | ((before >= 48) & (before <= 57)) | ((two == 0xC3) & (ends - starts > 2) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        alone = ((last == 44) | (last == 46)) & (ends - starts > 1) & letter
        at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(alone)])[:-1] if len(starts) else starts
        n = len(starts) + int(alone.sum())
        s, e = np.zeros(n, np.int64), np.zeros(n, np.int64)
        s[at], e[at] = starts, ends - alone
        s[at[alone] + 1], e[at[alone] + 1] = ends[alone] - 1, ends[alone]
        first = np.append(at, n)[first]
        keys = span_hashes(data, s, e)
        slots = (keys >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        known = (self.keys[slots] == keys) & (self.lens[slots] > 0)
        new = np.flatnonzero(~known)
        fresh, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
        flat, lens = self.encode([data[s[i] : e[i]].tobytes().decode() for i in new[where].tolist()])
        base = np.cumsum(lens) - lens
        # where each span's ids are: in the memory, or behind it among the new ones
        n_ids, source = self.lens[slots].astype(np.int64), slots * self.WIDTH
        n_ids[new], source[new] = lens[back], self.ids.size + base[back]
        stop = np.cumsum(n_ids)
        pick = np.repeat(source - (stop - n_ids), n_ids) + np.arange(int(stop[-1]) if len(stop) else 0)
        out = np.empty(len(pick), np.uint32)
        late = pick >= self.ids.size
        out[late] = flat[pick[late] - self.ids.size]
        out[~late] = self.ids.ravel()[pick[~late]]
        self.keep(fresh, flat, base, lens)
        return out, np.append(0, stop)[first]

    def keep(self, keys: np.ndarray, flat: np.ndarray, base: np.ndarray, lens: np.ndarray) -> None:
        short = np.flatnonzero((lens > 0) & (lens <= self.WIDTH))
        slots, one = np.unique((keys[short] >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64), return_index=True)
        short = short[one]
        self.keys[slots], self.lens[slots] = keys[short], lens[short]
        for j in range(self.WIDTH):
            self.ids[slots, j] = flat[np.minimum(base[short] + j, len(flat) - 1)] if len(flat) else 0


@cache
def tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker, whatever the number of its tasks."""
    return ChunkTokenizer(path)


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """n as sequences of powers of two, longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(longest.bit_length(), -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document(doc_id, text); with_ids adds the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, data, off in text_blocks(batch.column("text")):
                ids, first = tok.block(data, off)
                rows, out, bodies = [], [], []
                for i in range(len(off) - 1):
                    own = np.append(ids[first[i] : first[i + 1]], end).astype("<u4")
                    at = 0
                    for n in binary_lengths(len(own), longest):
                        rows.append(row + i)
                        out.append((at, n, zlib.crc32(own[at : at + n]), len(own)))
                        if with_ids:
                            bodies.append(own[at : at + n].astype(np.int64))
                        at += n
                cols = [doc_ids.take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols, names = [*cols, pa.array(bodies, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def pack(docs: DataFrame, path: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) as sequences of powers of two: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset (0: a sequence is one piece); with_ids adds
    the ids themselves.

    Sequences are numbered 0, 1, ... by bucket (longest first), document and start: the pieces
    are dealt by range and each range's numbers start after those of the ranges before it.
    A null or empty text, or one of white space, is the end id alone. Repeated rows and rows
    with a null doc_id are packed each for itself. An empty table gives no rows. Columns of
    docs other than doc_id and text are not read."""
    found = materialised(pieces(docs, path or vocabulary_path(), longest, end_id, with_ids), "pieces")
    cols = found.columns
    order = [F.desc("length"), F.asc_nulls_first("doc_id"), F.asc("start"), F.asc("ids_crc32")]
    n = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = found.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    numbered = materialised(numbered, "numbered").withColumn("__part", F.shiftright("__id", 33))
    # a row for each range: as many as there are partitions
    counts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select("__part", F.expr("coalesce(sum(__n) over (order by __part rows between unbounded preceding and 1 preceding), 0)").alias("__before"))
    out = numbered.join(F.broadcast(counts), "__part")
    number = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*cols, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
