"""Media columns as content-defined chunks.

A text's UTF-8 bytes, padded, are the samples of an 8-bit mono WAV file. The file is cut where
a rolling gear hash of its last 32 bytes has zero bits, so that equal passages of different
files fall into equal chunks. Chunks are known by digests; Spark joins find those that several
files share, which are stored once; a file's other chunks stand in its own row, where it
was read. A file's ordered list of digests rebuilds it, and its digest verifies it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import key_filter, materialised, mixed, read_table, spark_hashes

UNIT = 576
PAD = 255
RATE = 8000
LEAST, MOST, MASK_BITS = 256, 8192, 10
#: Samples that a look at the rolling hash handles at once.
SPAN = 1 << 20

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def encoded(payload: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    return _HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def decoded(media: bytes) -> bytes:
    """The samples of a file that encoded() made."""
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = _HEADER.unpack_from(media)
    if (riff, wave, kind, channels, bits, data, n) != (b"RIFF", b"WAVE", 1, 1, 8, b"data", len(media) - _HEADER.size):
        raise ValueError("not a WAV file of 8-bit mono samples")
    return media[_HEADER.size :]


def cut_points(media: bytes) -> list[int]:
    """Ends of the chunks: the first place after LEAST bytes where the gear hash has MASK_BITS
    zero bits at its top, and after MOST bytes at the latest."""
    found: list[np.ndarray] = []
    data = np.frombuffer(media, np.uint8)
    for a in range(0, len(data), SPAN):
        h = _GEAR[data[max(0, a - 31) : a + SPAN]]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        h = h[a - max(0, a - 31) :]
        found.append(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + a + 1)
    places = np.concatenate(found).tolist()
    out, at = [], 0
    while at < len(data):
        i = bisect_left(places, at + LEAST)
        end = min(places[i] if i < len(places) else len(data), at + MOST, len(data))
        out.append(end)
        at = end
    return out


def chunked(media: bytes) -> list[bytes]:
    out, at = [], 0
    for end in cut_points(media):
        out.append(media[at:end])
        at = end
    return out


def digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def _filter_keys(digests: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)


def digest_key(c):
    """The first 8 bytes of a digest as a long."""
    return F.expr(f"cast(conv(hex(substring({c}, 1, 8)), 16, -10) as bigint)")


def features(payload: bytes) -> str:
    """Length, mean, mean square, crossings of the middle and a histogram of the samples."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64)
    centred = s - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    hist = np.bincount(s >> 5, minlength=8)
    return f"n={len(s)};mean={int(s.sum()) * 1000 // len(s)};square={int((centred * centred).sum()) * 1000 // len(s)};crossings={crossings};hist={','.join(map(str, hist.tolist()))}"


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the file's digest), media_bytes and the ordered digests of its
    chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column("text"):
                n, payload = payload_of(v.as_py())
                media = encoded(payload)
                rows.append((n, digest(media), len(media), [digest(c) for c in chunked(media)]))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary())]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "media", "media_bytes", "digests"])

    schema = "doc_id long, n_bytes long, media binary, media_bytes long, digests array<binary>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class ChunkStore:
    """The files of docs(doc_id, text), stored: `manifest` lists every document's file, `whole`
    holds a row for each file with the chunks that no other file has, null in place of the rest
    (`shared`: where), and `chunks` each chunk of several files once."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.manifest = materialised(manifests(docs), "manifest")
        files = self.manifest.groupBy("media").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id"), F.first("digests").alias("digests"))
        self.files = materialised(files, "files")
        uses = self.files.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        shared = spark.sparkContext.broadcast(key_filter(uses.where("n > 1").select(digest_key("digest").alias("k")), "k"))
        # copies of a file are read once: the filter passes at least one document of each
        owners = spark.sparkContext.broadcast(key_filter(self.files.select(F.xxhash64("doc_id").alias("k")), "k"))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], list[bytes], np.ndarray]]:
            for batch in batches:
                for v in batch.filter(pa.array(owners.value.passes(spark_hashes(batch.column("doc_id"))))).column("text"):
                    media = encoded(payload_of(v.as_py())[1])
                    bodies = chunked(media)
                    digests = [digest(c) for c in bodies]
                    yield digest(media), digests, bodies, shared.value.passes(_filter_keys(digests))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _lots((m, np.flatnonzero(s).tolist(), d, [None if x else y for x, y in zip(s, b, strict=True)]) for m, d, b, s in chosen(batches)):
                kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["media", "shared", "digests", "bodies"])

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _lots(x for _, *file in chosen(batches) for *x, s in zip(*file, strict=True) if s):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["digest", "body"])

        texts = docs.select(F.col("doc_id").cast("long"), "text")
        self.whole = materialised(texts.mapInArrow(whole, "media binary, shared array<int>, digests array<binary>, bodies array<binary>"), "whole")
        chunks = texts.mapInArrow(parts, "digest binary, body binary").groupBy("digest").agg(F.first("body").alias("body"))
        self.chunks = materialised(chunks, "chunks")

    def read(self) -> DataFrame:
        """media, media_sha256, media_bytes, payload_bytes, payload_sha256, tail_crc32 and feature of every
        file, from its stored bytes; a file that does not have its digest is an error."""
        stored = self.whole.where("size(shared) = 0").select("media", "bodies")
        some = self.whole.where("size(shared) > 0")
        refs = some.select("media", "digests", F.explode("shared").alias("pos")).select("media", "pos", F.expr("digests[pos]").alias("digest"))
        met = refs.join(self.chunks, "digest").groupBy("media").agg(F.collect_list(F.struct("pos", "body")).alias("c"))
        rebuilt = some.select("media", "bodies").join(met, "media", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for name, bodies, *others in zip(batch.column("media").to_pylist(), *batch.columns[1:], strict=True):
                    own = bodies.as_py()
                    for c in (x for o in others for x in o.as_py() or ()):
                        own[c["pos"]] = c["body"]
                    media = b"".join(x or b"" for x in own)
                    if digest(media) != name:
                        raise ValueError(f"the chunks of {name.hex()} make another file")
                    p = decoded(media)
                    rows.append((name, hashlib.sha256(media).hexdigest(), len(media), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), features(p)))
                types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                names = ["media", "media_sha256", "media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        schema = "media binary, media_sha256 string, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
        found = stored.mapInArrow(run, schema).unionByName(rebuilt.mapInArrow(run, schema))
        if self.whole.count() > self.whole.select("media").distinct().count():  # the filter passed copies of a file too
            found = found.dropDuplicates(["media"])
        return materialised(found, "read")


def _lots(rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows, whose last entry is a chunk or a list of them, in lots of some megabytes of chunks."""
    lot, held = [], 0
    for r in rows:
        lot.append(r)
        held += len(r[-1]) if isinstance(r[-1], bytes) else sum(len(x or b"") for x in r[-1])
        if held >= size:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def media_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) as doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, read back from the stored files.

    Null is an empty text, whose payload is one unit of padding. Equal texts have one file and
    equal results; repeated rows have a row each, also with null doc_ids. An empty table gives
    no rows. Texts of any length are cut in bounded memory beside the text itself. Other
    columns are not read."""
    store = ChunkStore(docs)
    light = store.manifest.select("doc_id", "n_bytes", "media")
    out = light.join(store.read(), "media")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_table(spark, sf_dir, "documents"))
