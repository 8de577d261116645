"""N-gram Jaccard join with prefix filters under several token orders.

Documents are sets of word shingles. Two sets of a Jaccard similarity of at least 3/4 share a
token among the first n - ceil(3 n / 4) + 1 of each, in any order of tokens that is the same
for all. The first order has tokens of many documents last, by a table of hashed tokens, and
makes the candidates by a join in Spark. Candidates must also share as many prefix tokens as
the similarity takes, and a token among the prefixes of each of the other orders: those
prefixes alone, at half a token's size, meet by joins, and only pairs that pass every order's
filter have their sets brought together and compared.

Equal sets are one node. Where many nodes share a token, they are first compared with one of
them; what that links needs no more comparisons inside its component. Only then all remaining
pairs across components are compared, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import KeyFilter, key_filter, materialised, mixed, read_table, shingle_sets, spark_hashes, text_blocks, words
from weftline.llm.components import components

WORDS = 5
#: Tokens of so many documents stand last in the first order.
HEAVY = 32
#: The part of a set, in order of hashes, whose tokens are counted to find heavy ones.
COUNTED = 0.4
#: Groups of up to so many nodes are compared whole at once.
SMALL_GROUP = 4
#: Nodes of a larger group that all of it is compared with at once, beside the first.
PIVOTS = 3
#: The other orders: tokens by these multiples.
ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def prefix_length(n):
    """How many tokens of a set of n, a number or an array of them, are its prefix."""
    return (n - (3 * n + 3) // 4 + 1) * (n > 0)


def similar(inter: int, nx: int, ny: int) -> bool:
    return 100 * inter >= 75 * (nx + ny - inter) and inter > 0


Block = tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]


def token_sets(batches: Iterator[pa.RecordBatch], k: int = WORDS) -> Iterator[Block]:
    """The batches in blocks of rows: the rows, their sorted sets of shingle hashes one behind
    the other, where each set starts (one more entry than rows), and the sets' signatures."""
    for batch in batches:
        for row, data, off in text_blocks(batch.column("text")):
            _, _, h, first = words(data, off)
            t, at = shingle_sets(h, first, k)
            yield batch.slice(row, len(off) - 1), t, at, signatures(t, at)


def signatures(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: equal sets, equal hashes; 0 for empty ones."""
    with np.errstate(over="ignore"):
        run = np.append(np.uint64(0), np.cumsum(mixed(tokens), dtype=np.uint64))
        n = np.diff(at).astype(np.uint64)
        return np.where(n > 0, mixed(run[at[1:]] - run[at[:-1]] + n), 0).view(np.int64)


def sketches(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """512 bits of each set, as 8 longs: whether the tokens of each slot are odd in number. The
    bits in which two sketches differ are no more than the tokens of which only one of the sets
    has each."""
    rows = len(at) - 1
    slot = np.repeat(np.arange(rows) << 9, np.diff(at)) | (tokens & np.uint64(511)).astype(np.int64)
    odd = (np.bincount(slot, minlength=rows << 9) & 1).astype(np.uint8).reshape(rows, 512)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _differing(sx: str, sy: str) -> Column:
    """In how many bits two sketches differ."""
    return sum((F.bit_count(F.col(sx)[i].bitwiseXOR(F.col(sy)[i])) for i in range(8)), F.lit(0))


def _close(sx: str, sy: str, nx: str, ny: str) -> Column:
    """Whether two sketches let their sets be similar."""
    return _differing(sx, sy) <= F.col(nx) + F.col(ny) - 2 * F.ceil(3 * (F.col(nx) + F.col(ny)) / 7)


def chosen_sets(batches: Iterator[pa.RecordBatch], chosen: KeyFilter, k: int) -> Iterator[Block]:
    """The sets of the documents that the filter passes."""
    for batch in batches:
        yield from token_sets([batch.filter(pa.array(chosen.passes(spark_hashes(batch.column("doc_id")))))], k)


def places(at: np.ndarray) -> np.ndarray:
    """Each token's place in its set."""
    return np.arange(int(at[-1])) - np.repeat(at[:-1], np.diff(at))


class Join:
    """The join over docs(doc_id, text)."""

    def __init__(self, docs: DataFrame, k: int = WORDS):
        self.docs, self.k, self.spark = docs.select(F.col("doc_id").cast("long"), "text"), k, docs.sparkSession
        self.sets = materialised(self._sets(), "sets")
        self.nodes = materialised(self.sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
        # texts of equal sets are read once: a filter of fixed size passes at least one document of each node
        self.chosen = self._shared_filter(self.nodes.select(F.xxhash64(F.coalesce("doc_id", F.lit(0))).alias("k")), "k")

    def _shared_filter(self, df: DataFrame, key: str):
        return self.spark.sparkContext.broadcast(key_filter(df, key))

    def _sets(self) -> DataFrame:
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, t, at, own in token_sets(batches, k):
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * 8), pa.array(sketches(t, at).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own), pa.array(np.diff(at)), bits], names=["doc_id", "node", "n", "sketch"])

        return self.docs.mapInArrow(run, "doc_id long, node long, n long, sketch array<long>")

    def heavy(self):
        """A table of the tokens that stand last. As a function of the token it makes an order
        whatever it holds; what it holds only decides the size of groups."""
        chosen, k = self.chosen, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t, at, _ in chosen_sets(batches, chosen.value, k):
                least = t[places(at) <= COUNTED * np.repeat(np.diff(at), np.diff(at))]
                yield pa.RecordBatch.from_arrays([pa.array((least >> np.uint64(24)).astype(np.int64))], names=["t"])

        n = self.docs.mapInArrow(run, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY)
        return self.spark.sparkContext.broadcast(key_filter(materialised(n.select(F.shiftleft("t", 24).alias("k")), "heavy"), "k", 5))

    def index(self, heavy) -> DataFrame:
        """key, node, rank (of the key in its node's order) and n (the node's tokens) of prefix
        tokens, of keys of two nodes at least, with m: how many."""
        chosen, k = self.chosen, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t, at, own in chosen_sets(batches, chosen.value, k):
                key, rank = first_order(t, at, heavy.value)
                n = np.diff(at)
                keep = rank < np.repeat(prefix_length(n), n)
                cols = [key[keep].view(np.int64), np.repeat(own, n)[keep], ((rank << 32) | np.repeat(n, n))[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "at"])

        rows = self.docs.mapInArrow(run, "key long, node long, at long")
        rows = rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1")
        rank, n = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return materialised(rows.select("key", "node", rank.alias("rank"), n.alias("n"), "m"), "index")

    def tokens_of(self, nodes: DataFrame) -> DataFrame:
        """node, its prefix in each of the other orders (4 bytes a token, which may only join
        more) and its tokens (8 bytes each, sorted) of the given nodes, a row for each."""
        bits, k, chosen = self._shared_filter(nodes, "node"), self.k, self.chosen

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t, at, own in chosen_sets(batches, chosen.value, k):
                hit = np.flatnonzero(bits.value.passes(own.view(np.uint64)) & (np.diff(at) > 0))
                sets = [t[at[i] : at[i + 1]] for i in hit.tolist()]
                cols = [pa.array(own[hit]), *(pa.array([prefix(s, m) for s in sets], pa.list_(pa.int32())) for m in ORDERS)]
                cols.append(pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["node", "o1", "o2", "tokens"])

        rows = self.docs.mapInArrow(run, "node long, o1 array<int>, o2 array<int>, tokens binary").join(nodes, "node", "left_semi")
        return materialised(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("o1", "o2", "tokens"))), "tokens")

    def links(self, pairs: DataFrame, shared: DataFrame) -> DataFrame:
        """x, y of the distinct pairs(x, y) that are similar."""
        pairs = pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        n = self.nodes.select("node", "n", "sketch")
        pairs = pairs.join(n.toDF("x", "nx", "sx"), "x").join(n.toDF("y", "ny", "sy"), "y").where(_close("sx", "sy", "nx", "ny"))
        pairs = self.sharing(materialised(pairs.select("x", "y", "nx", "ny"), "pairs"), shared)
        return self.verified_links(pairs, self.tokens_of(_nodes_of(pairs)))

    def sharing(self, pairs: DataFrame, shared: DataFrame) -> DataFrame:
        """The pairs(x, y, nx, ny, ...) that share as many prefix tokens of the first order as
        their sizes take: that decides what they can share at most."""
        pairs = pairs.where("4 * least(nx, ny) >= 3 * greatest(nx, ny)")
        both = pairs.join(shared.withColumnsRenamed({"node": "x", "keys": "kx"}), "x").join(shared.withColumnsRenamed({"node": "y", "keys": "ky"}), "y")
        rest = F.greatest(*(F.floor(3 * F.col(c) / 4) for c in ("nx", "ny")))  # tokens after the longer prefix, at most
        both = both.where(F.size(F.array_intersect("kx", "ky")) + rest >= F.ceil(3 * (F.col("nx") + F.col("ny")) / 7))
        return materialised(both.select(*pairs.columns), "pairs")

    def verified_links(self, pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        """x, y of the pairs that are similar, by the tokens of their nodes."""
        # the other orders' filters: prefixes meet, the sets stay where they are
        orders = tokens.select("node", "o1", "o2")
        met = pairs.select("x", "y").join(orders.toDF("x", "ax", "bx"), "x").join(orders.toDF("y", "ay", "by"), "y")
        pairs = materialised(met.where(F.arrays_overlap("ax", "ay") & F.arrays_overlap("bx", "by")).select("x", "y"), "pairs")
        sets = tokens.select("node", "tokens")
        met = pairs.join(sets.toDF("x", "tx"), "x").join(sets.toDF("y", "ty"), "y")
        return materialised(met.mapInArrow(verified, "x long, y long"), "links")

    def components(self) -> DataFrame:
        """node, root of the nodes that have links."""
        index = self.index(self.heavy())
        shared = materialised(index.groupBy("node").agg(F.collect_set("key").alias("keys")), "shared")
        few = index.where(F.col("m") <= SMALL_GROUP)
        many = index.where(F.col("m") > SMALL_GROUP)
        pairs = few.groupBy("key").agg(F.collect_set(F.struct("node", "rank", "n")).alias("g")).select(F.explode(_all_pairs("g")).alias("p"))
        pairs = pairs.where(_first_common("p.a.n", "p.a.rank", "p.b.n", "p.b.rank")).select(F.col("p.a.node").alias("x"), F.col("p.b.node").alias("y"))
        found = self.links(pairs.unionByName(_with_pivot(many)), shared)
        roots = components(found)
        own = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(self.nodes.select("node", "sketch"), "node")
        pairs = self.sharing(materialised(_across(own), "across"), shared)
        tokens = self.tokens_of(_nodes_of(pairs))
        # a node and the one of another component that is nearest to it, then what that leaves apart
        roots = components(_stars(roots).unionByName(self.verified_links(_nearest(pairs), tokens)))
        return components(_stars(roots).unionByName(self.verified_links(_apart(pairs, roots), tokens)))


def first_order(t: np.ndarray, at: np.ndarray, heavy: KeyFilter) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sorted sets' tokens in the first order, and each one's rank in its set: light
    tokens by hash, then heavy ones."""
    h = heavy.passes(t)
    n = np.diff(at)
    light = np.append(0, np.cumsum(~h))
    before = light[:-1] - np.repeat(light[at[:-1]], n)  # light tokens of the set that stand before
    rank = np.where(h, np.repeat(light[at[1:]] - light[at[:-1]], n) + places(at) - before, before)
    return (t >> np.uint64(1)) | (h.astype(np.uint64) << np.uint64(63)), rank


def prefix(t: np.ndarray, multiple: np.uint64) -> np.ndarray:
    """The upper halves of a set's prefix in the order of multiples."""
    p = int(prefix_length(len(t)))
    with np.errstate(over="ignore"):
        return (np.partition(t * multiple, p - 1)[:p] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _all_pairs(g: str) -> Column:
    return F.expr(f"flatten(transform({g}, (a, i) -> transform(slice({g}, i + 2, size({g})), b -> struct(a as a, b as b))))")


def _first_common(nx: str, rx: str, ny: str, ry: str) -> Column:
    """Whether two sets can be similar if this is their first common key: what is left of
    either, this key included, must hold the least overlap."""
    least = F.ceil(3 * (F.col(nx) + F.col(ny)) / 7)
    return (F.col(nx) - F.col(rx) >= least) & (F.col(ny) - F.col(ry) >= least)


def _with_pivot(own: DataFrame) -> DataFrame:
    """Each node of a key with some pivots of about its size: the node that has the key first
    in its order, as fewer tokens of its own stand before it, so that it is the nearest to what
    a group shares, and PIVOTS more by seeded hashes, the same for all keys. What the pivots
    link needs no comparison later. Sizes of a class are similar enough for links."""
    own = own.withColumn("size", F.floor(F.log("n") / F.log(F.lit(4 / 3))))
    row = [F.col("node"), F.col("n"), F.col("rank")]
    least = [F.min(F.struct("rank", F.xxhash64("node").alias("h"), F.struct(*row).alias("v")))["v"]]
    least += [F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), F.struct(*row).alias("v")))["v"] for r in range(PIVOTS)]
    pivot = own.groupBy("key", "size").agg(F.array_distinct(F.array(*least)).alias("p")).select("key", "size", F.explode("p").alias("p"))
    pivot = materialised(pivot.select("key", "size", F.col("p.node").alias("x"), F.col("p.n").alias("nx"), F.col("p.rank").alias("rx")), "pivots")
    return own.join(pivot, ["key", "size"]).where(_first_common("nx", "rx", "n", "rank")).select("x", F.col("node").alias("y")).distinct()


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()


def _stars(roots: DataFrame) -> DataFrame:
    """Links that make the same components: a node and its root."""
    return roots.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs of a node with nodes of another component, that of the least different sketches."""
    best = pairs.groupBy("x", "rooty").agg(F.min(F.struct("bits", "y")).alias("p"))
    return best.select("x", "p.y")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose components are still two."""
    met = pairs.select("rootx", "rooty").distinct()
    for c in ("rootx", "rooty"):
        met = met.join(roots.toDF(c, f"{c}_now"), c, "left").withColumn(f"{c}_now", F.coalesce(f"{c}_now", c))
    met = materialised(met.where("rootx_now <> rooty_now").select("rootx", "rooty"), "apart")
    return pairs.join(met, ["rootx", "rooty"], "left_semi").select("x", "y").distinct()


def _across(own: DataFrame) -> DataFrame:
    """All pairs of a key's nodes of different components that can be similar if the key is
    their first common one: those outside the key's largest component with every node of
    another one; with their components and the bits in which their sketches differ."""
    own = materialised(own.select("key", "node", "root", "rank", "n", "sketch").dropDuplicates(["key", "node"]), "own")
    sizes = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("s"))
    most = sizes.groupBy("key").agg(F.max(F.struct("s", "root")).alias("most"), F.count(F.lit(1)).alias("c")).where("c > 1")
    most = materialised(most.select("key", F.col("most.root").alias("most")), "most")
    mixed_keys = materialised(own.join(most, "key"), "mixed")
    a = mixed_keys.where("root <> most").select("key", F.col("node").alias("x"), F.col("root").alias("rootx"), F.col("n").alias("nx"), F.col("rank").alias("rx"), F.col("sketch").alias("sx"))
    b = mixed_keys.select("key", F.col("node").alias("y"), F.col("root").alias("rooty"), F.col("most").alias("mosty"), F.col("n").alias("ny"), F.col("rank").alias("ry"), F.col("sketch").alias("sy"))
    # two nodes outside the largest component meet once
    met = a.join(b, "key").where((F.col("rootx") != F.col("rooty")) & ((F.col("rooty") == F.col("mosty")) | (F.col("x") < F.col("y"))))
    met = met.where(_first_common("nx", "rx", "ny", "ry") & _close("sx", "sy", "nx", "ny"))
    return met.select("x", "y", "nx", "ny", "rootx", "rooty", _differing("sx", "sy").alias("bits")).distinct()


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    for batch in batches:
        keep = []
        for tx, ty in zip(batch.column("tx"), batch.column("ty"), strict=True):
            a, b = np.frombuffer(tx.as_buffer(), "<u8"), np.frombuffer(ty.as_buffer(), "<u8")
            both = np.concatenate([a, b])
            both.sort()
            keep.append(similar(int(np.count_nonzero(both[1:] == both[:-1])), len(a), len(b)))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def jaccard_components(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """docs(doc_id, text, ...) as doc_id, n_shingles and component_id: the smallest doc_id that
    links of similarity 3/4 or more between sets of k-word shingles reach.

    Null, empty and white texts have no shingles and only themselves. Fewer than k words are
    one shingle. Repeated rows have equal results. A document with a null doc_id takes part;
    its component's id is null only if all of it is. An empty table gives no rows. Other
    columns are not read. Sets are told apart by 64-bit hashes of tokens."""
    join = Join(docs, k)
    roots = join.components()
    known = join.nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = materialised(known.select("node", "root").join(least, "root").select("node", "component_id"), "known")
    empty = join.sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = join.sets.where("n > 0").join(known, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row of its smallest doc_id stays, once.
    Documents without shingles and those with a null doc_id stay."""
    found = jaccard_components(docs)
    kept = found.where("doc_id = component_id or n_shingles = 0").select("doc_id").where("doc_id is not null").distinct()
    kept = materialised(kept, "kept")
    # of repeated rows of one doc_id the first in order of text stays; other columns travel as one, whatever their names
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    ids = docs.where("doc_id is not null").select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h"), row.alias("row"))
    ids = ids.join(kept, "doc_id", "left_semi").withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "h"))).where("at = 1")
    return ids.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by their counts, and the least doc_id that links reach.
ORACLE_SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] ELSE list_sort(list_distinct([concat_ws(' ', z[1], z[2], z[3], z[4], z[5]) for z in list_zip(w, w[2:], w[3:], w[4:], w[5:])[1:greatest(len(w) - 4, 1)]])) END AS s FROM worded),
nodes AS MATERIALIZED (SELECT min(doc_id) AS node, s, len(s)::BIGINT AS n FROM sets GROUP BY s),
tokens AS MATERIALIZED (SELECT node, n, unnest(s) AS t FROM nodes),
pairs AS (SELECT a.node AS x, b.node AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.node < b.node
  WHERE 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached AS (SELECT node, node AS root FROM nodes UNION SELECT l.y, r.root FROM reached r JOIN links l ON r.node = l.x WHERE r.root < l.y),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE r.root END AS component_id
FROM sets d JOIN nodes k ON d.s = k.s JOIN roots r ON r.node = k.node
"""
