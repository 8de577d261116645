"""Spelling variants: words meet the edges of a trie of all words, level by level. A state is a
word, a position in it, a node (the prefix read so far) and the edits made; one-edit states that
end at a word are its neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialised, mixed, read_table, span_hashes, text_blocks

LEAST_LENGTH, LEAST_N, DROP, RATIO = 7, 2, 31, 10
#: Longer words, whose prefixes would be long rows, meet by hashes of the word without each of its letters.
LONG = 64
#: A block of whole texts that one turn counts together, in bytes.
BLOCK = 1 << 21

_RUN = np.zeros(256, bool)
_RUN[65:91] = _RUN[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def _crc_table() -> np.ndarray:
    """The byte table of zlib's CRC-32, by its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs [A-Za-z\\u00C0-\\u00FF]+ of a block's texts, and
    each run's text. The second letters are the bytes C3 80 to C3 BF."""
    n = len(data)
    solid = _RUN[data]
    wide = data == 0xC3
    solid |= wide
    solid[1:] |= wide[:-1]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < n]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes, each going on from the CRC-32 of what stands before it."""
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    s, n, state = starts[order], lens[order], (seeds[order] ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    short = int(np.searchsorted(-n, -LONG * 2, "left"))  # longer ones one by one
    for i in range(short):
        state[i] = zlib.crc32(data[s[i] : s[i] + n[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for i in range(int(n[short]) if short < len(n) else 0):
        k = int(np.searchsorted(-n, -i, "left"))  # runs of more than i bytes
        x = state[short:k]
        state[short:k] = _CRC[(x ^ data[s[short:k] + i]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for row, raw, off in text_blocks(batch.column("text"), BLOCK):
            if not len(raw):
                continue
            data = _LOWER[raw]  # C3 and its second bytes lie outside A-Z
            s, e, doc = runs(data, off)
            letters = (e - s) - np.diff(np.append(0, np.cumsum(data == 0xC3))[np.stack([s, e])], axis=0)[0]
            enough = letters >= LEAST_LENGTH
            s, e, doc, letters = s[enough], e[enough], doc[enough], letters[enough]
            seeds = np.array([0 if i is None else zlib.crc32(b"%d:" % i) for i in ids[row : row + len(off) - 1]], np.uint32)
            named = np.array([i is not None for i in ids[row : row + len(off) - 1]], bool)
            h = crcs(data, s, e, seeds[doc])
            changed = (h % np.uint32(DROP) == 0) & named[doc]
            plain = np.flatnonzero(~changed)
            _, at, n = np.unique(span_hashes(data, s[plain], e[plain], fold=False), return_index=True, return_counts=True)
            text = data.tobytes()
            words = [text[i:j].decode() for i, j in zip(s[plain[at]].tolist(), e[plain[at]].tolist(), strict=True)]
            cut = np.flatnonzero(changed & (letters > LEAST_LENGTH))
            for i, j, k in zip(s[cut].tolist(), e[cut].tolist(), (h[cut] % letters[cut]).tolist(), strict=True):
                w = text[i:j].decode()
                words.append(w[:k] + w[k + 1 :])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.append(n, np.ones(len(cut), np.int64)), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as word, n: the runs of letters of all texts, misspelt by the rule of
    doc_id and run, of enough letters and occurrences."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def both_ways(words: DataFrame) -> DataFrame:
    """word and start: each word behind a mark >, and back to front behind a mark <, so that one
    trie holds both readings. An edit in a word's second half is found from the front, one in its
    first half from the back: no edit is made before start, where nodes have few edges."""
    front = F.struct(F.concat(F.lit(">"), "word").alias("word"), F.expr("1 + cast(ceil(length(word) / 2) as int)").alias("start"))
    back = F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("word"), F.expr("1 + cast(floor(length(word) / 2) as int)").alias("start"))
    return words.select(F.explode(F.array(front, back)).alias("x")).select("x.*")


def trie(words: DataFrame, least: int = 0) -> DataFrame:
    """node, c, id, ahead: the edges of the trie's nodes of least letters and more under which two
    words and more lie; c leads on, and is empty where a word ends. An edge that leads to one word
    alone has that word's hash as its id; any other has in ahead what may be read behind it, `.`
    for a word's end. A node has an edge for each letter at most."""
    at = words.where(F.length("word") >= least).select("word", F.explode(F.sequence(F.lit(least), F.length("word"))).alias("i"))
    edges = at.select(F.expr("substring(word, 1, i)").alias("node"), F.expr("substring(word, i + 1, 1)").alias("c"), F.xxhash64("word").alias("id"))
    edges = edges.groupBy("node", "c").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("id").alias("id"))
    kid = F.struct("c", F.when(F.col("n") == 1, F.col("id")).alias("id"))
    nodes = edges.groupBy("node").agg(F.collect_list(kid).alias("kids"), F.sum("n").alias("n")).where("n > 1")
    ahead = nodes.select(F.col("node").alias("on"), F.array_join(F.expr("transform(kids, k -> if(k.c = '', '.', k.c))"), "").alias("ahead"))
    edges = nodes.select("node", F.inline("kids"))
    inner = edges.where("id is null").withColumn("on", F.concat("node", "c")).join(ahead, "on").drop("on")
    return inner.unionByName(edges.where("id is not null").withColumn("ahead", F.lit(None).cast("string")))


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word) as word, other: each pair of words that differ by one inserted, deleted or
    replaced letter, once.

    A state moves along an edge if it reads its next letter there, or, without an edit so far,
    reads another letter in its place or one more letter before it. A pair is met from the word of
    the smaller letter, or from the shorter word, where an added letter stands after equal ones.
    A state goes on only where its next letter may be read. Where an edge leads to one word alone, it ends: what it has read and what is left of
    its word must make that word."""
    short = words.where(F.length("word") <= LONG).select("word")
    least = short.agg(F.min(F.length("word"))).first()[0] or 0
    marked = both_ways(short)
    edges = materialised(trie(marked, 1 + least // 2), "trie")
    states = marked.select("word", F.col("start").alias("pos"), F.expr("substring(word, 1, start)").alias("node"), F.lit(0).alias("edits"))
    own = F.expr("substring(word, pos + 1, 1)")
    added = "c <> '' and if(startswith(word, '>'), c <> own, c <> right(node, 1) and pos > 1 + floor((length(word) - 1) / 2))"
    moves = f"""(not add and edits = 1 and c = own) or (not add and edits = 0 and own <> '' and (c > own or c = own and id is null))
        or (add and edits = 0 and {added})"""
    found = None
    while True:
        met = states.join(edges, "node").where((F.col("edits") == 0) | (F.col("c") == own)).withColumn("own", own)
        went = met.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("add")).where(moves)
        step = went.select("word", F.expr("if(add or own = '', pos, pos + 1)").alias("pos"), F.concat("node", "c").alias("node"), F.expr("if(add or c <> own, 1, edits)").alias("edits"), "id", "ahead")
        whole = F.concat("node", F.expr("substring(word, pos + 1)"))
        leads_on = F.expr("id is null and (edits = 0 or contains(ahead, if(pos >= length(word), '.', substring(word, pos + 1, 1))))")
        step = materialised(step.where(leads_on | (F.xxhash64(whole) == F.col("id"))).select("word", "pos", "node", "edits", F.when(F.col("id").isNotNull(), whole).alias("other")), "states")
        ends = step.where("other is not null").select("word", "other")
        found = ends if found is None else found.unionByName(ends)
        states = step.where("other is null").drop("other")
        if states.isEmpty():
            break
    plain = lambda c: F.when(F.startswith(c, F.lit("<")), F.reverse(F.expr(f"substring({c}, 2)"))).otherwise(F.expr(f"substring({c}, 2)"))
    return found.select(plain("word").alias("word"), plain("other").alias("other")).unionByName(_long_pairs(words))


def _long_pairs(words: DataFrame) -> DataFrame:
    """The pairs of which one word is longer than LONG: a word is another one without a letter,
    or both are alike without the letter of one position. Only near words share such a hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column("word").to_pylist():
                points = mixed(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
                n = len(points)
                with np.errstate(over="ignore"):
                    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, _BASE)))
                    left = np.append(np.uint64(0), np.cumsum(points * power))
                    without = mixed(left[:n] * _BASE + (left[n] - left[1:]))
                    whole = mixed(left[n] * _BASE)
                at = np.append(np.arange(n), -1)
                yield pa.RecordBatch.from_arrays([pa.array([word] * (n + 1), pa.string()), pa.array(at, pa.int64()), pa.array(np.append(without, whole).view(np.int64))], names=["word", "at", "key"])

    rows = words.where(F.length("word") >= LONG).select("word", F.xxhash64("word").alias("id"))
    if rows.isEmpty():
        return words.sparkSession.createDataFrame([], "word string, other string")
    keys = materialised(rows.select("word").mapInArrow(cut, "word string, at long, key long").select(F.xxhash64("word").alias("id"), "at", "key"), "cuts")
    a, b = keys.toDF("a", "at", "key"), keys.toDF("b", "bt", "key")
    one = a.where("at = -1").join(b.where("bt >= 0"), "key")
    two = a.where("at >= 0").join(b.where("bt >= 0"), "key").where("at = bt and a < b")
    met = one.select("a", "b").unionByName(two.select("a", "b")).distinct()
    met = met.join(rows.toDF("word", "a"), "a").join(rows.toDF("other", "b"), "b")
    return met.where((F.greatest(F.length("word"), F.length("other")) > LONG) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other")


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """docs(doc_id, text, ...) as word, form, root, n, n_near, form_n: a word's form is its near
    word of largest n (ties: the smallest), if that is ratio times its own n at least; its root is
    the last of its form's forms, or the word itself.

    Null and empty texts have no words. Repeated rows count as often as they stand; rows with a
    null doc_id lose no letter. An empty table gives no rows; other columns are not read."""
    words = materialised(vocabulary(docs), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    near = both.join(words.toDF("other", "m"), "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    out = words.join(near, "word", "left")
    has = -F.col("best.m") >= F.col("n") * ratio
    out = materialised(out.select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    # n grows by ratio from form to form, so that chains are short; each turn doubles the reach
    steps = materialised(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turn = materialised(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        steps = turn.select("word", "root")
        if turn.where("on").isEmpty():
            break
    return out.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


_POLYNOMIAL = 0xEDB88320
#: The rule's CRC-32 from its byte table, and near words as those that share a word without one of their letters.
ORACLE_SQL = f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, {_POLYNOMIAL}) ELSE a >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents)),
per AS (SELECT doc_id, r, count(*) AS n, hex(doc_id || ':' || r) AS h FROM runs WHERE length(r) >= {LEAST_LENGTH} GROUP BY doc_id, r),
crc AS (SELECT per.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::BIGINT)), lambda a, b: xor(tb[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS c FROM per, tab),
word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN c % {DROP} = 0 THEN left(r, c % length(r)) || substr(r, c % length(r) + 2) ELSE r END AS word, n FROM crc)
  GROUP BY word HAVING sum(n) >= {LEAST_N} AND length(word) >= {LEAST_LENGTH}),
less AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM word)),
one AS (SELECT l.word AS a, w.word AS b FROM less l JOIN word w ON l.d = w.word),
near AS MATERIALIZED (SELECT a, b FROM one UNION SELECT b, a FROM one UNION SELECT x.word, y.word FROM less x JOIN less y ON x.i = y.i AND x.d = y.d AND x.word <> y.word),
best AS (SELECT a AS word, b AS other, n AS m, count(*) OVER (PARTITION BY a) AS k FROM near JOIN word ON b = word QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(k, 0) AS n_near, CASE WHEN m >= {RATIO} * w.n THEN other END AS form, CASE WHEN m >= {RATIO} * w.n THEN m END AS form_n FROM word w LEFT JOIN best ON best.word = w.word),
walk(word, up) AS (SELECT word, word FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.up WHERE form.form IS NOT NULL)
SELECT f.word, f.form, walk.up AS root, f.n, f.n_near, f.form_n FROM form f JOIN walk ON walk.word = f.word JOIN form l ON l.word = walk.up AND l.form IS NULL"""
