"""Exact k-means by Shallot search: each vector keeps bounds and remembers its second-nearest
centroid; a search starts at the closer of both, scans that one's neighbours in order of distance,
shrinks its ball with every better second, and compares what survives in whole numbers."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import _remove, read_table, shared_folder

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Squared distances of such components fit 64 bits; vectors with larger ones take no part.
MOST_COMPONENT = 1 << 27
#: Bounds are kept in floating point; a centroid is left out only by more than this share.
MARGIN = 1e-9
STATE = "vec_id long, v array<int>, a int, b int, u double, l double"


def kept(vectors: DataFrame, column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and v: the vectors of so many finite components, as floor(scale * x)."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < MOST_COMPONENT))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == size) & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:vec_id`; repeated ids by their components, rows
    without an id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(F.asc_nulls_last(key), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), len(found[0]["v"]) if found else 0)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in whole numbers."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids with their neighbours, nearest first, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None):
        self.at, k = at, len(at)
        gaps = np.sqrt(np.array([squared(at, c) for c in at], np.float64).reshape(k, k))
        np.fill_diagonal(gaps, -1.0)
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.half = self.gaps[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(at, before).astype(np.float64))
        # the farthest move among the others
        top = np.argsort(self.moved)[::-1]
        self.others = np.full(k, self.moved[top[0]] if k > 1 else 0.0)
        if k > 1:
            self.others[top[0]] = self.moved[top[1]]

    def assigned(self, v: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest and second-nearest centroids of v, and bounds: u on the distance to the
        nearest, l on that to any other. Of equally near centroids the smaller number counts."""
        u, l = u + self.moved[a], l - self.others[a]
        need = np.flatnonzero(self.unsure(a, u, l))
        u[need] = np.sqrt(squared(v[need], self.at[a[need]]))
        need = need[self.unsure(a[need], u[need], l[need])]
        x = v[need]
        da, db = squared(x, self.at[a[need]]), squared(x, self.at[b[need]])
        swap = (db < da) | ((db == da) & (b[need] < a[need]))  # start at the closer one
        j1, j2 = np.where(swap, b[need], a[need]), np.where(swap, a[need], b[need])
        d1, d2 = np.where(swap, db, da), np.where(swap, da, db)
        centre, r = j1.copy(), np.sqrt(d1)
        left = np.arange(len(need))
        for rank in range(len(self.at) - 1):
            # whatever is nearer than the second lies in the ball of this radius around the centre
            left = left[self.gaps[centre[left], rank] * (1 - MARGIN) <= r[left] + np.sqrt(d2[left])]
            if not len(left):
                break
            j = self.order[centre[left], rank]
            d = squared(x[left], self.at[j])
            best = (d < d1[left]) | ((d == d1[left]) & (j < j1[left]))
            next_ = ~best & (j != j1[left]) & ((d < d2[left]) | ((d == d2[left]) & (j < j2[left])))
            w = left[best]
            d2[w], j2[w] = d1[w], j1[w]
            d1[w], j1[w] = d[best], j[best]
            w = left[next_]
            d2[w], j2[w] = d[next_], j[next_]
        a, b = a.copy(), b.copy()
        a[need], b[need], u[need], l[need] = j1, j2, np.sqrt(d1), np.sqrt(d2)
        return a, b, u, l

    def unsure(self, a: np.ndarray, u: np.ndarray, l: np.ndarray) -> np.ndarray:
        return ~(u * (1 + MARGIN) < np.maximum(l, self.half[a]) * (1 - MARGIN))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, size)


def _search(state: DataFrame, c: Centroids, size: int, distances: bool = False) -> DataFrame:
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), size)
            a, b, u, l = c.assigned(v, *(batch.column(x).to_numpy(zero_copy_only=False).copy() for x in "abul"))
            if distances:
                cols, names = [a, squared(v, c.at[a])], ["cluster", "distance"]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *map(pa.array, cols)], names=["vec_id", *names])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *(pa.array(x) for x in (a, b, u, l))], names=["vec_id", "v", *"abul"])

    return state.mapInArrow(turn, "vec_id long, cluster int, distance long" if distances else STATE)


def _moved(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """The floors of the mean of each cluster's vectors; an empty cluster stays. Each task sums
    its own vectors up, so that a row for each cluster and component leaves it."""
    k, size = at.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, a = _matrix(batch.column("v"), size), np.asarray(batch.column("a"))
            for j in np.unique(a):
                sums[j] += v[a == j].sum(0)
            n += np.bincount(a, minlength=k)
        own = np.flatnonzero(n)
        rows = [np.repeat(own, size), np.tile(np.arange(size), len(own)), sums[own].ravel(), np.repeat(n[own], size)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, rows)), names=["j", "i", "s", "n"])

    rows = state.select("v", "a").mapInArrow(summed, "j long, i long, s long, n long").groupBy("j", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = at.copy()
    for r in rows.collect():  # k * size rows at most
        out[r["j"], r["i"]] = r["s"] // r["n"]
    return out


def clustered(vectors: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vectors(vec_id, embedding, ...) as vec_id, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256 of exact Lloyd rounds in whole numbers.

    Vectors that are null, of another length, or hold null, non-finite or huge components (2^27
    and more after scaling: distances would pass 64 bits) give no row. Repeated rows and rows
    with a null vec_id are vectors like any other and give a row each; ties go to the smaller
    number of a centroid. With fewer than k vectors each is a centroid at first; an empty table
    gives no rows. Other columns are not read. Each round's states are a table in the shared
    folder, and the one before is deleted."""
    spark = vectors.sparkSession
    rows = kept(vectors, column, size, scale)
    start = rows.select("vec_id", "v", F.lit(0).alias("a"), F.lit(min(1, k - 1)).alias("b"), F.lit(float("inf")).alias("u"), F.lit(0.0).alias("l"))
    state, path = _written(start, "vectors")
    at = first_centroids(state, k, seed)
    if not len(at):
        return spark.createDataFrame([], RESULT)
    if len(at) == 1:
        state = state.withColumn("b", F.lit(0))
    c = Centroids(at, None)
    for _ in range(rounds):
        state, new = _written(_search(state, c, size), "states")
        _remove(spark, path)
        path = new
        c = Centroids(_moved(state, c.at), c.at)
    found, _ = _written(_search(state, c, size, distances=True), "clusters")
    _remove(spark, path)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    named = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.at.tolist()]
    table = spark.createDataFrame([(j, s, sum(sums.values()), named[j]) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def op12_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Plain Lloyd rounds, all centroids compared with all vectors."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v AS w FROM kept ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {K})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT id, vec_id, v, c, d FROM (SELECT id, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r})
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)""")
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} ON a.c = c{last}.c"""


ORACLE_SQL = _sql()
