"""Information-theoretic sanitisation of personal data.

Patterns find the data themselves: e-mail addresses, IP addresses, card and phone numbers, and
secrets: long strings of letters and digits with as many bits a character as chance gives.
Each distinct value is a protected entity, and so is the part of it that others share: an
address's domain, a number's first digits. Terms around the mentions may give an entity away
when the value is gone; how much is estimated from the whole corpus, copies of a text counted
once. With N texts, entity e has the information content IC(e) = log2(N / df(e)). A term t
near e in c of its df(t) texts discloses D(t; e) = log2(p(e | t) / p(e)), with p(e) = df(e) / N
and p(e | t) = (c + m p(e)) / (df(t) + m): pointwise mutual information, smoothed by m texts of
the corpus at large, so that a rare term's evidence counts by how rare it is. A term with
D >= threshold * IC is generalised to its first letters, if those as a class stay under the
threshold, and else removed, wherever it stands in the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import key_filter, materialised, mixed, read_table, span_hashes, spark_hashes, text_blocks, words

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
THRESHOLD = 0.9
SMOOTHING = 1.0
STEM = 3
#: A secret's least length, letters, digits and bits a character.
SECRET_LENGTH, SECRET_LETTERS, SECRET_DIGITS, SECRET_BITS = 20, 4, 4, 3.0

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_DIGITS = re.compile(r"[0-9]")
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each has one @, so look left and right of every @ in turn."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = "".join(_DIGITS.findall(m[0]))
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def bits_a_character(s: str) -> float:
    return sum(n * math.log2(len(s) / n) for n in Counter(s).values()) / len(s)


def find_secrets(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(secret, start, end) in code points, none inside a base span."""
    out = []
    for m in _SECRET.finditer(text):
        digits = len(_DIGITS.findall(m[0]))
        letters = sum(map(str.isalpha, m[0]))
        if digits >= SECRET_DIGITS and letters >= SECRET_LETTERS and bits_a_character(m[0]) >= SECRET_BITS:
            if not any(a < m.end() and m.start() < b for _, a, b in base):
                out.append(("secret", *m.span()))
    return out


def _long(s: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))).view(np.int64))


def entity_keys(kind: str, value: str) -> list[int]:
    """An entity's keys, of its value without case and punctuation, and of the part of it that
    other entities share: domain, network, first six digits."""
    if kind in ("email", "secret"):
        value = value.lower()
        part = value.partition("@")[2]
    elif kind == "ip":
        part = ".".join(value.split(".")[:2])
    else:
        value = "".join(_DIGITS.findall(value))
        part = value[:6]
    return [_long(f"{kind}:{value}"), *([_long(f"{kind} of {part}")] if part else [])]


def terms(data: np.ndarray, off: np.ndarray, stem: int = STEM) -> dict[str, np.ndarray]:
    """The terms of a block of texts: runs of letters, of three code points or more. start and
    end in code points of the text, hash, stem's hash, long (longer than the stem), text."""
    starts, ends, h, _ = words(data, off, apart=_NO_LETTER)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points begun before each byte
    keep = points[ends] - points[starts] >= 3
    starts, ends, h = starts[keep], ends[keep], h[keep]
    text = np.searchsorted(off, starts, "right") - 1
    cut = np.minimum(np.searchsorted(points, points[starts] + stem, "right") - 1, ends)
    base = points[off[text]]
    return {
        "start": points[starts] - base, "end": points[ends] - base, "hash": h.view(np.int64),
        "stem": mixed(span_hashes(data, starts, cut)).view(np.int64), "long": points[ends] - points[starts] > stem, "text": text,
    }


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> list[dict]:
    """The terms within window terms of a mention of an entity, outside all spans."""
    raw = np.frombuffer(text.encode(), np.uint8)
    t = terms(raw, np.array([0, len(raw)]))
    free = outside(t["start"], t["end"], spans)
    t = {k: v[free] for k, v in t.items()}
    near: dict[tuple[int, int], dict] = {}
    for kind, a, b in spans:
        at = int(np.searchsorted(t["start"], a))
        around = range(max(0, at - window), min(at + window, len(t["start"])))
        for e in entity_keys(kind, text[a:b]):
            for i in around:
                k = (e, int(t["hash"][i]))
                near.setdefault(k, {"entity": e, "term": k[1], "stem": int(t["stem"][i]), "long": bool(t["long"][i])})
    return list(near.values())


def outside(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Which of the stretches meet none of the spans."""
    if not spans:
        return np.ones(len(starts), bool)
    covered = sorted((a, b) for _, a, b in spans)
    reach = np.maximum.accumulate(np.array([b for _, b in covered], np.int64))
    k = np.searchsorted(np.array([a for a, _ in covered], np.int64), ends, "left") - 1
    return (k < 0) | (reach[np.maximum(k, 0)] <= starts)


def candidates(batch: pa.RecordBatch) -> list[bool]:
    """The texts that can hold a span: an @, or the digits of the shortest other kind."""
    out: list[bool] = []
    for _, data, off in text_blocks(batch.column("text")):
        digits = np.append(0, np.cumsum((data >= 48) & (data <= 57)))[off]
        ats = np.append(0, np.cumsum(data == 64))[off]
        out += ((np.diff(digits) >= 4) | (np.diff(ats) > 0)).tolist()
    return out


def text_keys(batch: pa.RecordBatch) -> np.ndarray:
    """A hash of each text, null as the empty one."""
    return np.array([xxhash.xxh3_64_intdigest(v.as_buffer() or b"") for v in batch.column("text")], np.uint64).view(np.int64)


def row_keys(batch: pa.RecordBatch, keys: np.ndarray) -> np.ndarray:
    """A hash of each row's doc_id and text."""
    return spark_hashes(pa.array(keys), spark_hashes(batch.column("doc_id")))


FOUND = (
    "doc_id long, row long, text_key long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, found string,"
    " entities array<long>, near array<struct<entity: long, term: long, stem: long, long: boolean>>"
)


def found(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of every document's patterns, and the terms near them."""
    near_type = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("stem", pa.int64()), ("long", pa.bool_())]))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = text_keys(batch)
            rows = []
            for v, may in zip(batch.column("text"), candidates(batch), strict=True):
                text = v.as_py() if may else ""
                spans = find_base(text) if may else []
                secrets = find_secrets(text, spans) if may else []
                if not spans and not secrets:
                    rows.append((0, 0, 0, 0, 0, none, "", [], []))
                    continue
                n = Counter(k for k, _, _ in spans)
                base = joined(spans)
                entities = sorted({e for k, a, b in spans + secrets for e in entity_keys(k, text[a:b])})
                rows.append((*(n[k] for k in KINDS), len(secrets), hashlib.sha256(base.encode()).hexdigest(), joined(spans + secrets), entities, near_terms(text, spans + secrets, window)))
            types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.int64()), near_type]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            cols = [batch.column("doc_id"), pa.array(row_keys(batch, keys).view(np.int64)), pa.array(keys), *cols]
            names = ["doc_id", "row", "text_key", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "base_sha256", "found", "entities", "near"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, FOUND)


def text_counts(docs: DataFrame, hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, df: in how many texts each of the wanted terms and stems stands, copies of a text
    counted once, whatever rows they are.

    Filters only spare work: of a text's copies all but those of its least doc_id are mostly
    passed over, and terms that are not wanted mostly dropped. Counts are exact behind them: the
    terms of a text that stands in several rows come with the text's key and are told apart by
    it, and a join drops what is not wanted. Only texts known to stand once are summed at once."""
    keys = wanted.select("term").distinct()
    spark = keys.sparkSession
    bits = spark.sparkContext.broadcast(key_filter(keys, "term"))
    first = hits.groupBy("text_key").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    first = materialised(first, "texts_once")
    chosen = spark.sparkContext.broadcast(key_filter(first.select(F.xxhash64("doc_id", "text_key").alias("k")), "k", 4))
    # keys are uniform hashes, as the filter's slots ask for
    copied = spark.sparkContext.broadcast(key_filter(first.where("rows > 1"), "text_key", 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_keys(batch)
            own_row = chosen.value.passes(row_keys(batch, texts))
            part, texts = batch.filter(pa.array(own_row)), texts[own_row]
            several = copied.value.passes(texts.view(np.uint64))
            for row, data, off in text_blocks(part.column("text"), 1 << 20):
                t = terms(data, off)
                h, text = np.concatenate([t["hash"], t["stem"]]), np.tile(t["text"], 2)
                hit = bits.value.passes(h.view(np.uint64))
                own, back = np.unique(h[hit], return_inverse=True)
                pairs = np.unique(text[hit] * len(own) + back)
                at, term = np.divmod(pairs, max(1, len(own)))
                shared = several[row + at]
                n = np.bincount(term[~shared], minlength=len(own))
                once = np.flatnonzero(n)
                cols = [np.concatenate([np.zeros(len(once), np.int64), texts[row + at[shared]]]), np.concatenate([own[once], own[term[shared]]]), np.concatenate([n[once], np.zeros(int(shared.sum()), np.int64)])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["text_key", "term", "n"])

    # n is 0 where a row tells of one text, which counts once however often it comes
    rows = docs.mapInArrow(run, "text_key long, term long, n long")
    n = rows.groupBy("term", "text_key", (F.col("n") == 0).alias("one")).agg(F.sum("n").alias("n"))
    n = n.groupBy("term").agg(F.sum(F.when(F.col("one"), 1).otherwise(F.col("n"))).alias("df"))
    return n.join(keys, "term", "left_semi")


def disclosing(docs: DataFrame, hits: DataFrame, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """term, remove: the terms over the threshold for some entity, and whether their stems are too."""
    n_texts = hits.select("text_key").distinct().count()
    texts = hits.where("size(entities) > 0").groupBy("text_key").agg(F.first("entities").alias("entities"), F.first("near").alias("near"))
    texts = materialised(texts, "texts")
    df_e = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    near = texts.select("text_key", F.explode("near").alias("x")).select("text_key", "x.*")
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c"), F.first("stem").alias("stem"), F.first("long").alias("long"))
    stems = near.select("text_key", "entity", "stem").distinct().groupBy("entity", F.col("stem").alias("term")).agg(F.count(F.lit(1)).alias("c"))
    pairs, stems = materialised(pairs, "pairs"), materialised(stems, "stems")
    counts = materialised(text_counts(docs, hits, pairs.select("term").union(stems.select("term"))), "counts")

    def over(p: DataFrame) -> DataFrame:
        p = p.join(counts, "term").join(df_e, "entity")
        p_e = F.col("df_e") / n_texts
        gain = F.log2((F.col("c") + smoothing * p_e) / (F.col("df") + smoothing) / p_e)
        return p.where((p_e < 1) & (gain >= threshold * -F.log2(p_e)))

    wide = over(stems).select("entity", F.col("term").alias("stem"), F.lit(True).alias("wide"))
    out = over(pairs).join(wide, ["entity", "stem"], "left")
    return out.groupBy("term").agg(F.max(F.coalesce("wide", F.lit(False)) | ~F.col("long")).alias("remove"))


def marks(docs: DataFrame, over: DataFrame) -> DataFrame:
    """row, terms: where the disclosing terms stand, in all rows that have one."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(over, "term", 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = row_keys(batch, text_keys(batch))
            for row, data, off in text_blocks(batch.column("text"), 1 << 20):
                t = terms(data, off)
                hit = np.flatnonzero(bits.value.passes(t["hash"].view(np.uint64)))
                free = np.ones(len(hit), bool)
                at = t["text"][hit]
                for i in np.unique(at).tolist():
                    text = batch.column("text")[row + i].as_py()
                    base = find_base(text)
                    own = np.flatnonzero(at == i) if len(hit) < 1000 else slice(*np.searchsorted(at, [i, i + 1]).tolist())
                    free[own] = outside(t["start"][hit[own]], t["end"][hit[own]], base + find_secrets(text, base))
                hit, at = hit[free], at[free]
                cols = [rows.view(np.int64)[row + at], t["hash"][hit], t["start"][hit], t["end"][hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "term", "start", "stop"])

    places = docs.mapInArrow(run, "row long, term long, start long, stop long").join(over, "term").distinct()
    return places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "remove"))).alias("terms"))


def sanitise_spans(docs: DataFrame, *, window: int = WINDOW, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """docs(doc_id, text, ...) as doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term,
    base_sha256, spans, row (a hash of doc_id and text) and terms (start, stop and remove of the
    method's own spans; not to remove is to generalise).

    Null text is empty: no spans, the hash of an empty string. An empty table gives no rows.
    Repeated rows get equal results, and copies of a text count once. Texts of any length are
    scanned whole, terms of any length are terms. Other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    hits = materialised(found(docs, window), "found")
    over = materialised(disclosing(docs, hits, threshold, smoothing), "disclosing")
    own = materialised(marks(docs, over), "marks")
    out = hits.join(own, "row", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start: long, stop: long, remove: boolean>>)")))
    own_spans = F.expr("transform(terms, s -> concat('term:', s.start, ':', s.stop))")
    spans = F.array_join(F.concat(F.when(F.col("found") != "", F.array("found")).otherwise(F.expr("cast(array() as array<string>)")), own_spans), ",")
    cols = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret"]
    return out.select(*cols, F.size("terms").cast("long").alias("n_term"), "base_sha256", spans.alias("spans"), "row", "terms")


def masked(text: str, spans: list[tuple[str, int, int]], own: list[tuple[int, int, bool]], stem: int = STEM) -> str:
    """text with <KIND> for spans, and each term's stem and *, or nothing, for terms."""
    cuts = sorted([(a, b, f"<{k.upper()}>") for k, a, b in spans] + [(a, b, "" if gone else text[a : min(b, a + stem)] + "*") for a, b, gone in own])
    out, at = [], 0
    for a, b, new in cuts:
        if a < at:  # inside a span before it
            at = max(at, b)
            continue
        out += (text[at:a], new)
        at = b
    return "".join([*out, text[at:]])


def sanitised_texts(docs: DataFrame, *, window: int = WINDOW, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """docs with sanitised texts: same rows and columns, whatever the columns' names; texts
    without spans stay as they are, null stays null, an empty table stays empty. n_chars, where
    there is one, is counted anew for changed texts."""
    names, at = docs.columns, docs.columns.index("text")
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = inner.select("doc_id", "text")
    own = materialised(marks(texts, materialised(disclosing(texts, materialised(found(texts, window), "found"), threshold, smoothing), "disclosing")), "marks")
    schema = inner.drop("doc_id", "text").schema
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(own, "row", 4))
    n_chars = names.index("n_chars") if "n_chars" in names and str(docs.schema["n_chars"].dataType) in ("LongType()", "IntegerType()") else None

    def rebuilt(batch: pa.RecordBatch, new: list[str | None]) -> pa.RecordBatch:
        cols = {n: batch.column(n) for n in schema.names}
        old = batch.column(f"c{at}")
        cols[f"c{at}"] = pa.array([o.as_py() if t is None else t for o, t in zip(old, new, strict=True)], pa.string())
        if n_chars is not None:
            n = cols[f"c{n_chars}"]
            cols[f"c{n_chars}"] = pa.array([o.as_py() if t is None else len(t) for o, t in zip(n, new, strict=True)], n.type)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=schema.names)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without terms to mark: their own spans are all there is to mask."""
        for batch in batches:
            batch = batch.filter(pa.array(~bits.value.passes(row_keys(batch, text_keys(batch)))))
            new: list[str | None] = []
            for v, may in zip(batch.column("text"), candidates(batch), strict=True):
                spans = find_base(text := v.as_py()) if may else []
                spans += find_secrets(text, spans) if may else []
                new.append(masked(text, spans, []) if spans else None)
            yield rebuilt(batch, new)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = row_keys(batch, text_keys(batch))
            hit = bits.value.passes(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows.view(np.int64))], names=[*batch.schema.names, "row"]).filter(pa.array(hit))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: list[str | None] = []
            for v, own in zip(batch.column("text"), batch.column("terms").to_pylist(), strict=True):
                base = find_base(text := v.as_py() or "")
                spans = base + find_secrets(text, base)
                new.append(masked(text, spans, [(r["start"], r["stop"], r["remove"]) for r in own or []]) if spans or own else None)
            yield rebuilt(batch, new)

    hit = inner.mapInArrow(keyed, inner.withColumn("row", F.lit(0).cast("long")).schema).join(own, "row", "left")
    out = inner.mapInArrow(plain, schema).unionByName(hit.mapInArrow(mask, schema))
    return out.toDF(*names)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise_spans(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_term", "base_sha256", "spans")
