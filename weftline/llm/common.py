"""What several operators share: tables cut from their lineage, and vectorised word scans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    session on one machine gets a fresh temporary folder, and any other is an error: executors
    would write where nobody else can read."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weftline-"))
    return path.rstrip("/")


_OWN: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def short_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Texts are long rows: unless the session says otherwise, Arrow batches hold fewer, and
    end at a few megabytes whatever the length of their rows."""
    for key, own, new in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "64MB", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, own) in (own, str(64 << 20)):
            spark.conf.set(key, str(new))


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back. Its lineage ends there, so a
    lost executor costs no recomputation, and later joins see the table's true size."""
    spark = df.sparkSession
    short_batches(spark)
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df, marked for broadcast if it is checked to have at most max_rows rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# --- a filter of bounded size over hashed keys ------------------------------------------

#: Bits of a filter: 32 a key and more, up to 32 MB in all. A full filter only routes more rows to
#: the exact join behind it.
LEAST_BITS, MOST_BITS = 18, 28


@dataclass(frozen=True)
class KeyFilter:
    """A set of slots of 64-bit keys, a slot being a key's upper `bits` bits."""

    bits: int
    slots: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether each uint64 key may be in the filter."""
        s = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.slots[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def filter_bits(n: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, n.bit_length() + 5))


def key_filter(df: DataFrame, key: str, spare: int = 0) -> KeyFilter:
    """The slots of df's long keys, sized by their number, with spare more bits, up to a limit.
    It may say yes wrongly and never no: an exact join must follow."""
    bits = filter_bits(df.count() << spare)
    slot = F.shiftrightunsigned(F.col(key), 64 - bits) + 1  # Spark's bitmap buckets count from 1
    rows = (
        df.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("bits"))
        .collect()  # at most 2**MOST_BITS / 32768 rows of 4 KB
    )
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return KeyFilter(bits, out)


def spark_hashes(keys: pa.Array, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of a long column, null as 0; a column's hashes seed the next one's."""
    x = np.asarray(keys.fill_null(0), np.int64).view(np.uint64)
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in _XXH64)
    with np.errstate(over="ignore"):
        k = x * p2
        h = (np.asarray(seed, np.uint64) + p5 + np.uint64(8)) ^ (((k << np.uint64(31)) | (k >> np.uint64(33))) * p1)
        h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


# fixed values: the primes of XXH64
_XXH64 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


# --- words as 64-bit hashes, a block of texts at a time --------------------------------

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: uint64 to well spread uint64."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def text_blocks(texts: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts of about size bytes: first row, bytes, offsets (one more than
    rows). Null counts as empty; a longer text is a block of its own."""
    texts = texts.cast(pa.large_string())
    buf = texts.buffers()
    if len(texts) == 0:
        return
    off = np.frombuffer(buf[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    if texts.null_count:  # null entries may cover bytes
        texts = texts.fill_null("")
        yield from text_blocks(texts, size)
        return
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        b = min(b, len(texts))
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, fold: bool = True, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of a block, or what other bytes set apart: start and end
    bytes, 64-bit hash (of A-Z as a-z if fold), and each text's first word (one more entry than texts)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = ~apart[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < n]
    first[heads] = solid[heads]  # a text's end ends its last word
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = solid[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, span_hashes(data, starts, ends, fold), np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of one running polynomial."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[data] * up[: len(data)], out=run[1:])
        return mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_PLACES = np.array([pow(0x9FB21C651E98DF25, i + 1, 1 << 64) for i in range(64)], np.uint64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes; one of all of them where there are fewer."""
    if len(h) == 0:
        return h
    with np.errstate(over="ignore"):
        m = max(1, len(h) - k + 1)
        out = np.zeros(m, np.uint64)
        for i in range(min(k, len(h))):
            out += h[i : i + m] * _PLACES[i]
        return mixed(out)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of shingles of a block's texts, one behind the other, and where each
    starts (one more entry than texts)."""
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    stop = np.cumsum(m)
    at = np.repeat(first[:-1] - (stop - m), m) + np.arange(int(m.sum()))  # each shingle's first word
    out = shingles(np.append(h, np.zeros(k, np.uint64)), k)[at]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[stop[i] - 1] = shingles(h[first[i] : first[i + 1]], k)[0]
    for a, b in zip((stop - m).tolist(), stop.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[(stop - m)[m > 0]] = True
    return out[new], np.append(0, np.append(0, np.cumsum(new))[stop])
