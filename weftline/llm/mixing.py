"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Each source gets a target of words. Words are dealt in equal blocks: the blocks of the whole
mix go to sources by highest quotients target / (2 a + 1), a source's blocks go to its
divisions and their blocks to shards by the same rule over sizes. In a shard, documents stand
in a seeded order; the shard's quota of blocks is its words as often as it fits in whole, and
for the rest a run of blocks from a seeded start, around the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialised, read_table, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
BLOCK = 64
SHARD_ROWS = 200
DIVISION_SHARDS = 4096
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seed_hex(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _seed_int(*parts: Column) -> Column:
    return F.conv(F.substring(_seed_hex(*parts), 1, 8), 16, 10).cast("long")


def sainte_lague(df: DataFrame, group: list[str], keys: list[str], weight: str, seats: str) -> DataFrame:
    """df with a long column quota: each group's seats dealt by the highest quotients
    weight / (2 a + 1), ties to the smaller keys.

    Seats with a quotient of at least total weight / (2 seats) are dealt at once; only the
    few seats by which that differs from the number of seats are ranked, a number of rows in
    proportion to the group's members, whatever the number of seats."""
    w = Window.partitionBy(*group)
    share = F.when(F.col("__w") > 0, F.col(weight) / F.col("__w")).otherwise(F.lit(0.0))
    base = (
        df.withColumn("__w", F.sum(weight).over(w))
        .withColumn("__n", F.count(F.lit(1)).over(w))
        .withColumn("__share", share)
        .withColumn("__q0", F.floor(F.col("__share") * F.col(seats) + 0.5).cast("long"))
        .withColumn("__short", F.col(seats) - F.sum("__q0").over(w))
    )
    span = F.ceil(F.col("__n") / 2 * F.col("__share")).cast("long") + 2
    seat = F.when(F.col("__short") > 0, F.col("__q0") + F.col("__j")).otherwise(F.col("__q0") - F.col("__j") + 1)
    order = Window.partitionBy(*group).orderBy(F.desc("__quotient"), *keys, "__j")
    moves = (
        base.where((F.col("__short") != 0) & (F.col(weight) > 0))
        .select(*dict.fromkeys([*group, *keys]), weight, "__short", "__q0", F.explode(F.sequence(F.lit(1), span)).alias("__j"))
        .withColumn("__seat", seat)
        .where("__seat >= 1")
        .withColumn("__quotient", F.signum("__short") * F.col(weight) / (2 * F.col("__seat") - 1))
        .withColumn("__rank", F.row_number().over(order))
        .where("__rank <= abs(__short)")
        .groupBy(*dict.fromkeys([*group, *keys]))
        .agg(F.sum(F.signum("__short").cast("long")).alias("__moved"))
    )
    on = list(dict.fromkeys([*group, *keys]))
    out = base.alias("b").join(moves.alias("m"), [F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}")) for k in on], "left")
    cols = [F.col(f"b.{c}").alias(c) for c in df.columns]
    return out.select(*cols, (F.col("b.__q0") + F.coalesce(F.col("m.__moved"), F.lit(0))).alias("quota"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """sources(source, source_size, n_rows) with rank and target: share of all words by
    weight, no target above twice its source's size, the excess dealt again by weight.

    Filled by level: sources reach their limits in the order of limit / weight, so each is
    at its limit if what is left when its turn comes would give it as much."""
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("__fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    df = (
        sources.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("__wt", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("__cap", 2 * F.col("source_size"))
        .withColumn("__fill", F.col("__cap") / F.col("__wt"))
        .withColumn("__all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("__wall", F.sum("__wt").over(every))
        .withColumn("__capb", F.coalesce(F.sum("__cap").over(before), none))
        .withColumn("__wb", F.coalesce(F.sum("__wt").over(before), none))
        .withColumn("__full", F.col("__cap") * (F.col("__wall") - F.col("__wb")) <= F.col("__wt") * (F.col("__all") - F.col("__capb")))
        .withColumn("__capf", F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)).over(every))
        .withColumn("__wf", F.sum(F.when(F.col("__full"), F.col("__wt")).otherwise(0)).over(every))
    )
    level = (F.col("__all") - F.col("__capf")) / F.greatest(F.col("__wall") - F.col("__wf"), F.lit(1))
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), F.col("__wt") * level))
    return df.select(*sources.columns, "rank", target.alias("target"))


def mix(docs: DataFrame, size: str = "size", *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target, taken and, for slicing, the
    word ranges that the part of a copy covers: rest_a (from, to) and rest_b, beside `copies`
    whole copies. taken = copies * size + both ranges, at most 2 * size.

    Empty table: no rows. A null source is a source of its own, after all others. Documents
    of no words, and rows of a source without words, take 0. Repeated rows stand side by side
    and are taken one by one. Columns of docs with the names of added ones are replaced;
    others pass through. Rows with a null doc_id count as any others."""
    added = ["source_size", "target", "taken", "copies", "rest_a", "rest_b"]
    docs = docs.drop(*added)
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "source", size)]  # kept apart, whatever their names
    docs = docs.select("doc_id", "source", F.col(size).alias("__size0"), F.struct(F.lit(0).alias("__none"), *rest).alias("__rest"))
    own, size = size, "__size0"
    sources = materialised(docs.groupBy("source").agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "sources")
    goal = targets(sources, weights, share)
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    goal = sainte_lague(goal.withColumn("__one", F.lit(0)).withColumn("__seats", F.floor(total / block + 0.5).cast("long")), ["__one"], ["rank"], "target", "__seats")
    goal = materialised(
        goal.select("source", "source_size", "rank", "target", F.ceil(F.col("n_rows") / shard_rows).alias("__shards"), F.col("quota").alias("__blocks")), "targets"
    )
    s, d = small(goal.withColumnRenamed("source", "__source"), 10_000), docs
    where = F.pmod(_seed_int(F.col("doc_id"), F.lit("shard")), F.col("__shards"))
    d = d.join(s, d["source"].eqNullSafe(s["__source"])).withColumn("__shard", where).withColumn("__order", _seed_hex(F.col("doc_id")))
    shards = d.groupBy("rank", "__shard").agg(F.sum(size).alias("__size"), F.first("__blocks").alias("__blocks"))
    shards = materialised(shards.withColumn("__div", F.floor(F.col("__shard") / DIVISION_SHARDS)), "shards")
    divisions = shards.groupBy("rank", "__div").agg(F.sum("__size").alias("__dsize"), F.first("__blocks").alias("__blocks"))
    divisions = sainte_lague(divisions, ["rank"], ["__div"], "__dsize", "__blocks").select("rank", "__div", F.col("quota").alias("__dblocks"))
    shards = sainte_lague(shards.join(divisions, ["rank", "__div"]), ["rank", "__div"], ["__shard"], "__size", "__dblocks")
    n_blocks = F.ceil(F.col("__size") / block)
    quota = F.least(F.col("quota"), 2 * n_blocks)
    shards = materialised(
        shards.where("__size > 0").withColumn("__nb", n_blocks).withColumn("__q", quota).select(
            F.col("rank").alias("__r"), F.col("__shard").alias("__s"),
            F.floor(F.col("__q") / F.col("__nb")).alias("__full"),
            (F.pmod(_seed_int(F.col("rank"), F.col("__shard"), F.lit("start")), F.col("__nb")) * block).alias("__from"),
            (F.pmod(F.col("__q"), F.col("__nb")) * block).alias("__len"), (F.col("__nb") * block).alias("__turn"),
        ), "quotas",
    )
    before = Window.partitionBy("rank", "__shard").orderBy("__order", F.col("doc_id"), F.col(size)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    d = d.join(shards, (d["rank"] == shards["__r"]) & (d["__shard"] == shards["__s"]), "left")

    def part(start: Column, stop: Column) -> Column:
        lo = F.greatest(F.lit(0), start - F.col("__at"))
        hi = F.least(F.col(size), stop - F.col("__at"))
        return F.when(hi > lo, F.struct(lo.cast("long").alias("start"), hi.cast("long").alias("stop")))

    stop = F.col("__from") + F.col("__len")
    d = d.withColumn("rest_a", part(F.col("__from"), F.least(stop, F.col("__turn")))).withColumn("rest_b", part(F.lit(0), stop - F.col("__turn")))
    copies = F.coalesce(F.col("__full"), F.lit(0)).cast("long")
    length = lambda c: F.coalesce(F.col(f"{c}.stop") - F.col(f"{c}.start"), F.lit(0))
    d = d.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col(size) + length("rest_a") + length("rest_b")).cast("long"))
    back = {"doc_id": F.col("doc_id"), "source": F.col("source"), own: F.col(size).alias(own)}
    return d.select(*(back.get(c, F.col("__rest")[c].alias(c)) for c in names), *added)


def mixed_texts(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: whole copies as they are, then the words of a part, joined
    by single spaces. Same columns, whatever their names; documents of which nothing is taken go. n_chars, where
    there is one, is counted anew for parts."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # other columns travel as one, whatever their names
    m = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), row), "words")
    whole = F.array_repeat(F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop")), F.col("copies").cast("int"))
    piece = F.explode(F.concat(whole, F.array_compact(F.array("rest_a", "rest_b"))))
    m = m.select("row", piece.alias("piece"))
    text, part = F.col("row.text"), F.col("piece.start").isNotNull()
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), (F.col("piece.start") + 1).cast("int"), (F.col("piece.stop") - F.col("piece.start")).cast("int")), " ")
    m = m.withColumn("cut", F.when(part, cut).otherwise(text))
    new = {"text": F.col("cut"), "n_chars": F.when(part, F.length("cut").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return m.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    light = materialised(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(light).select("doc_id", "size", "source_size", "target", "taken")


def _sl_sql(name: str, base: str, group: str, key: str, weight: str, seats: str) -> str:
    """The rule of sainte_lague() as common table expressions."""
    return f"""
{name}_b AS (SELECT *, floor(CASE WHEN sum({weight}) OVER w > 0 THEN {weight} / sum({weight}) OVER w ELSE 0.0 END * {seats} + 0.5)::BIGINT AS q0,
    CASE WHEN sum({weight}) OVER w > 0 THEN {weight} / sum({weight}) OVER w ELSE 0.0 END AS shr, count(*) OVER w AS n
  FROM {base} WINDOW w AS (PARTITION BY {group})),
{name}_c AS (SELECT *, ({seats} - sum(q0) OVER (PARTITION BY {group}))::BIGINT AS short FROM {name}_b),
{name}_j AS (SELECT {group}, {key}, {weight}, short, CASE WHEN short > 0 THEN q0 + j ELSE q0 - j + 1 END AS seat, j
  FROM (SELECT *, unnest(generate_series(1, ceil(n / 2 * shr)::BIGINT + 2)) AS j FROM {name}_c WHERE short <> 0 AND {weight} > 0)),
{name}_m AS (SELECT {group}, {key}, sum(sign(short))::BIGINT AS moved FROM (
    SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY sign(short) * {weight} / (2 * seat - 1) DESC, {key}, j) AS rk FROM {name}_j WHERE seat >= 1)
  WHERE rk <= abs(short) GROUP BY ALL),
{name} AS (SELECT c.* EXCLUDE (q0, shr, n, short), c.q0 + coalesce(m.moved, 0) AS quota FROM {name}_c c LEFT JOIN {name}_m m ON c.{key} = m.{key} AND {" AND ".join(f"c.{g.strip()} = m.{g.strip()}" for g in group.split(","))})"""


def _hash_sql(*parts: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"


def _int_sql(*parts: str) -> str:
    return f"('0x' || substr({_hash_sql(*parts)}, 1, 8))::BIGINT"


ORACLE_SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2 * source_size AS cap FROM src),
weighed AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1] AS wt, sum(source_size) OVER () * {SHARE}::DOUBLE AS total FROM ranked),
filled AS (SELECT *, sum(wt) OVER () AS wall, coalesce(sum(cap) OVER b, 0) AS capb, coalesce(sum(wt) OVER b, 0) AS wb
  FROM weighed WINDOW b AS (ORDER BY cap / wt, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fulls AS (SELECT *, cap * (wall - wb) <= wt * (total - capb) AS full_ FROM filled),
level AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS capf, sum(CASE WHEN full_ THEN wt ELSE 0 END) OVER () AS wf FROM fulls),
goal AS (SELECT source, source_size, n_rows, rank, CASE WHEN full_ THEN cap::DOUBLE ELSE least(cap::DOUBLE, wt * ((total - capf)::DOUBLE / greatest(wall - wf, 1)::DOUBLE)) END AS target FROM level),
seated AS (SELECT *, 0 AS one, floor(sum(target) OVER () / {BLOCK} + 0.5)::BIGINT AS seats FROM goal),
{_sl_sql("dealt", "seated", "one", "rank", "target", "seats").strip()},
goals AS (SELECT source, source_size, rank, target, ceil(n_rows / {SHARD_ROWS})::BIGINT AS shards, quota AS blocks FROM dealt),
docs AS (SELECT s.*, g.source_size, g.target, g.rank, g.blocks, {_int_sql("coalesce(s.doc_id::VARCHAR, '')", "'shard'")} % g.shards AS shard, {_hash_sql("coalesce(s.doc_id::VARCHAR, '')")} AS ord
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
shard0 AS (SELECT rank, shard, shard // {DIVISION_SHARDS} AS div, sum(size)::BIGINT AS ssize, first(blocks) AS blocks FROM docs GROUP BY ALL),
div0 AS (SELECT rank, div, sum(ssize)::BIGINT AS dsize, first(blocks) AS blocks FROM shard0 GROUP BY rank, div),
{_sl_sql("divs", "div0", "rank", "div", "dsize", "blocks").strip()},
shard1 AS (SELECT s.*, d.quota AS dblocks FROM shard0 s JOIN divs d ON s.rank = d.rank AND s.div = d.div),
{_sl_sql("shs", "shard1", "rank, div", "shard", "ssize", "dblocks").strip()},
quotas AS (SELECT rank, shard, nb, least(quota, 2 * nb) AS q, {_int_sql("rank::VARCHAR", "shard::VARCHAR", "'start'")} % nb AS st
  FROM (SELECT *, ceil(ssize / {BLOCK})::BIGINT AS nb FROM shs WHERE ssize > 0)),
placed AS (SELECT d.*, coalesce(sum(d.size) OVER (PARTITION BY d.rank, d.shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM docs d),
laid AS (SELECT p.*, q // nb AS full_, st * {BLOCK} AS a, st * {BLOCK} + (q % nb) * {BLOCK} AS z, nb * {BLOCK} AS turn FROM placed p LEFT JOIN quotas k ON p.rank = k.rank AND p.shard = k.shard)
SELECT doc_id, size, source_size, target, (coalesce(full_, 0) * size
  + coalesce(greatest(0, least(size, least(z, turn) - pos) - greatest(0, a - pos)), 0)
  + coalesce(greatest(0, least(size, z - turn - pos) - greatest(0, 0 - pos)), 0))::BIGINT AS taken FROM laid
"""
