"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector. A query's k-th score is found by counting: tasks
count scores in equal bins over a range that holds it, the counts are summed, and the bin that
holds the k-th score is the next range, until a bin is one score wide. Then rows over that
score are kept, ties to the smaller vec_id.

Queries and vectors are dealt as blocks: each block of queries meets each block of vectors
once, by an equi-join of their block numbers with the list of pairs of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialised, read_table

K = 20
SCALE = 64
QUERY_EVERY = 20
BLOCK_ROWS = 2048
QUERY_BLOCK = 512
BINS = 1024
#: Scores are longs: components beyond this have none and take no part, like non-finite ones,
#: and scores must stay under this.
MOST_COMPONENT = 2.0**56
MOST_SCORE = 2.0**61


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer components of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > MOST_COMPONENT)
    v = v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", odd))
    return v.select("vec_id", F.size("e").cast("long").alias("dim"), F.transform("e", lambda x: F.floor(x * SCALE).cast("long")).alias("e"))


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Vectors packed by dimension and hash of vec_id into about so many rows a block: dim,
    block, vec_ids and components as little-endian 64-bit integers."""
    per_dim = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / rows).alias("n_blocks"))
    v = vectors.join(F.broadcast(per_dim), "dim")  # a row for each dimension that occurs

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.asarray(table["vec_id"], np.int64)
        e = np.asarray(table["e"].combine_chunks().flatten(), np.int64)
        reach = float(np.abs(e.astype(np.float64)).max(initial=0))
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "ids": [ids.astype("<i8").tobytes()], "e": [e.astype("<i8").tobytes()], "reach": [reach]})

    v = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")))
    schema = "dim long, block long, ids binary, e binary, reach double"
    return materialised(v.groupBy("dim", "block").applyInArrow(pack, schema), name)


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    e = np.frombuffer(raw, "<i8")
    return e.reshape(-1, dim) if dim else e.reshape(-1, 1)[:0]


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where sums stay exact in it."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors(vec_id, embedding) and queries likewise: query_id, rank, vec_id, score of each
    query's k best vectors other than its own rows, all if fewer, ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, or any over MOST_COMPONENT,
    whose multiple is no long, take no part; where scores could pass MOST_SCORE the search ends
    with an error and no wrong result. Vectors meet
    only queries of their own dimension; a dimension of 0 scores 0. Rows of one vec_id are
    one candidate each, at equal scores in any order; as a query, a vec_id must stand once.
    Empty tables give no rows; other columns are not read."""
    spark = vectors.sparkSession
    vb = blocks(usable(vectors), BLOCK_ROWS, "vectors")
    qb = blocks(usable(queries), QUERY_BLOCK, "queries").withColumnsRenamed({"block": "qblock", "ids": "qids", "e": "qe", "reach": "qreach"})
    # how far scores can lie from 0, per dimension
    ends = (
        vb.groupBy("dim").agg(F.max("reach").alias("v"))
        .join(qb.groupBy("dim").agg(F.max("qreach").alias("q")), "dim")
        .select("dim", (F.col("v") * F.col("q") * F.col("dim")).alias("reach"))
    )
    pairs = materialised(vb.select("dim", "block").join(qb.select("dim", "qblock"), "dim"), "pairs")
    most = ends.agg(F.max("reach")).first()[0]
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if most >= MOST_SCORE:
        raise ValueError(f"scores may reach {most:g}: components over {MOST_COMPONENT:g} take no part, and fewer dimensions or smaller components fit a long")
    most = int(most)
    state: DataFrame | None = None  # qblock, lo (of each query's range), width
    low, width = -most - 1, 2 * most + 2
    while width > 1:
        width = -(-width // BINS)
        counts = _counts(_met(vb, qb, pairs, state), low, width, k)
        state = _narrowed(counts, qb, state, low, width, k)
    return _ranked(_met(vb, qb, pairs, state), k)


def _met(vb: DataFrame, qb: DataFrame, pairs: DataFrame, state: DataFrame | None) -> DataFrame:
    """Every pair of blocks, with the queries' ranges so far."""
    q = qb if state is None else qb.join(state, ["dim", "qblock"])
    if state is None:
        q = q.withColumn("lo", F.lit(None).cast("binary"))
    return pairs.join(vb, ["dim", "block"]).join(q, ["dim", "qblock"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each pair of blocks: its row, query ids, vector ids, scores; a query's own rows get the
    least score there is."""
    for batch in batches:
        for r in batch.to_pylist():
            qids, ids = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            if r["dim"]:
                s = scores(_matrix(r["qe"], r["dim"]), _matrix(r["e"], r["dim"]))
            else:
                s = np.zeros((len(qids), len(ids)), np.int64)
            s[qids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            yield r, qids, ids, s


def _counts(met: DataFrame, low: int, bin_width: int, k: int) -> DataFrame:
    """dim, query block, query, bin, n: scores in each bin of the query's range. Bins under the
    one where this pair of blocks alone reaches k cannot hold the k-th score and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, qids, _, s in _each(batches):
            lo = np.frombuffer(r["lo"], "<i8") if r["lo"] is not None else np.full(len(qids), low)
            own = s == np.iinfo(np.int64).min
            b = np.clip((s - lo[:, None]) // bin_width, -1, BINS)
            b[own] = -1
            n = np.bincount(((b + 1) + np.arange(len(qids))[:, None] * (BINS + 2)).ravel(), minlength=len(qids) * (BINS + 2)).reshape(len(qids), BINS + 2)[:, 1:]
            above = np.cumsum(n[:, ::-1], 1)[:, ::-1] - n
            q, at = np.nonzero((n > 0) & (above < k))
            m = len(q)
            cols = [pa.array(np.full(m, r["dim"])), pa.array(np.full(m, r["qblock"])), pa.array(q), pa.array(at), pa.array(n[q, at])]
            yield pa.RecordBatch.from_arrays(cols, names=["dim", "qblock", "q", "bin", "n"])

    return met.mapInArrow(run, "dim long, qblock long, q long, bin long, n long").groupBy("dim", "qblock", "q", "bin").agg(F.sum("n").alias("n"))


def _narrowed(counts: DataFrame, qb: DataFrame, state: DataFrame | None, low_end: int, bin_width: int, k: int) -> DataFrame:
    """Each query's next range: the lower end of the bin that holds its k-th score, or of the
    lowest bin where there are fewer. At width 1 that is the score itself."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        q, b, n = (np.asarray(table[c], np.int64) for c in ("q", "bin", "n"))
        order = np.lexsort((-b, q))
        q, b, n = q[order], b[order], n[order]
        first = np.searchsorted(q, q)
        run_n = np.cumsum(n)
        above = run_n - n - (run_n - n)[first]
        hit = above < k
        size = int(np.asarray(table["size"])[0])
        old = table["lo"][0].as_py()
        lo = np.frombuffer(old, "<i8").copy() if old is not None else np.full(size, low_end)
        low = np.zeros(size, np.int64)
        low[q[hit]] = b[hit]  # rows of a query come from the highest bin down: the last is kept
        return pa.table({"dim": [key[0].as_py()], "qblock": [key[1].as_py()], "lo": [(lo + low * bin_width).astype("<i8").tobytes()]})

    side = qb.select("dim", "qblock", (F.octet_length("qids") / 8).cast("long").alias("size"))
    side = side.withColumn("lo", F.lit(None).cast("binary")) if state is None else side.join(state.select("dim", "qblock", "lo"), ["dim", "qblock"])
    grouped = counts.join(side, ["dim", "qblock"]).groupBy("dim", "qblock").applyInArrow(run, "dim long, qblock long, lo binary")
    return materialised(grouped, "ranges")


def _ranked(met: DataFrame, k: int) -> DataFrame:
    """Rows at or over each query's k-th score; a pair of blocks gives its k best at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, qids, ids, s in _each(batches):
            lo = np.frombuffer(r["lo"], "<i8")
            q, at = np.nonzero((s >= lo[:, None]) & (s > np.iinfo(np.int64).min))
            order = np.lexsort((ids[at], -s[q, at], q))
            q, at = q[order], at[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, at = q[keep], at[keep]
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[at]), pa.array(s[q, at])], names=["query_id", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = met.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    return search(v, v.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
