"""Token counts, k-means and spelling variants against the library, SQL and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import shallot, spelling, tokencounts

SF = "/root/testdata/sf0.001"
CLASHING = ["key", "n", "row", "word", "v", "a", "b", "u", "l", "cluster", "pos", "node", "rest", "pieces", "form", "common"]


def clashing(df):
    return df.select("*", *(F.lit("z").alias(c) for c in CLASHING))


# --- 11 ---

ODD = list("abcXYZ019 .,;'-<|>\n\t\x0b\x1c\x00_é́Σσßİ漢字  …“’🙂²½") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "'LL", " of the "]


def odd_texts(seed, n=600):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", "   ", "x" * 50_000, "same", "same", " ".join(f"w{i % 977}" for i in range(30_000))]


def counted(rows):
    return Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)


def by_library(rows):
    tok = Tokenizer.from_file(tokencounts.vocabulary_path())
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    return Counter((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True))


@pytest.mark.parametrize("most", [tokencounts.MOST_FREQUENT, 50, 0])
def test_token_counts(spark, most):
    """As the library counts them, whatever is looked up in memory and what by a shuffle."""
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(odd_texts(1))] + [(None, "no id"), (None, "no id")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(tokencounts.token_counts(df, most=most).collect()) == by_library(rows)


def test_token_counts_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert counted(tokencounts.op11_tokens(spark, SF).collect()) == by_library(rows)


def test_token_counts_of_nothing(spark):
    out = tokencounts.token_counts(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


def test_pre_tokens_are_parts_of_texts():
    """Cuts drop ASCII white space only."""
    for t in odd_texts(2):
        data = np.frombuffer((t or "").encode(), np.uint8)
        s, e, first = tokencounts.pre_tokens(data, np.array([0, len(data)]))
        assert b"".join(data[i:j].tobytes() for i, j in zip(s, e, strict=True)) == re.sub(rb"[\x09-\x0d ]", b"", data.tobytes()) and first.tolist() == [0, len(s)]


def test_unfit_tokenizer_is_an_error(spark):
    import public_tokenizers

    with pytest.raises(ValueError):
        tokencounts.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


# --- 12 ---


def same(got, want):
    order = list(want.columns)
    got = got.toPandas()[order]
    assert want.sort_values(order).reset_index(drop=True).astype(str).equals(got.sort_values(order).reset_index(drop=True).astype(str))


def test_clusters_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    same(shallot.op12_shallot(spark, SF), con.execute(shallot.ORACLE_SQL).df())


def lloyd(v, k, rounds):
    """Plain rounds over rows in centroid order at first."""
    at = v[:k].copy()
    near = lambda: np.argmin(((v[:, None] - at[None]) ** 2).sum(2), 1)
    for _ in range(rounds):
        a = near()
        for j in np.unique(a):
            at[j] = v[a == j].sum(0) // (a == j).sum()
    return near(), at


@pytest.mark.parametrize("kind", ["spread", "ties", "few values", "one"])
def test_search_against_lloyd(kind):
    """Bounds, balls and ties never change a result; empty clusters stay where they are."""
    rng = np.random.default_rng(5)
    n, k, size = 3000, 1 if kind == "one" else 37, 6
    v = rng.integers(*{"spread": (-900, 900), "ties": (-2, 3), "few values": (0, 2), "one": (-9, 9)}[kind], (n, size)).astype(np.int64)
    at, before = v[:k].copy(), None
    a, b, u, l = np.zeros(n, np.int64), np.full(n, min(1, k - 1)), np.full(n, np.inf), np.zeros(n)
    for _ in range(7):
        a, b, u, l = shallot.Centroids(at, before).assigned(v, a, b, u, l)
        d = ((v[:, None] - at[None]) ** 2).sum(2)
        assert (a == np.argmin(d, 1)).all()
        best = d[np.arange(n), a]
        assert (u * u >= best * (1 - 1e-9)).all()
        if k > 1:
            d[np.arange(n), a] = np.iinfo(np.int64).max
            assert (np.maximum(l, 0) ** 2 <= d.min(1) * (1 + 1e-9)).all()
        before, at = at, at.copy()
        for j in np.unique(a):
            at[j] = v[a == j].sum(0) // (a == j).sum()
    want, centres = lloyd(v, k, 7)
    assert (at == centres).all()


def test_search_leaves_centroids_out():
    """Most distances are never computed once clusters have settled."""
    rng = np.random.default_rng(6)
    v = (rng.integers(0, 40, 4000)[:, None] * 1000 + rng.integers(0, 9, (4000, 4))).astype(np.int64)
    at = (np.arange(40)[:, None] * 1000 + np.zeros((1, 4))).astype(np.int64)
    c = shallot.Centroids(at, at)
    a, b, u, l = c.assigned(v, np.zeros(4000, np.int64), np.ones(4000, np.int64), np.full(4000, np.inf), np.zeros(4000))
    assert not c.unsure(a, u, l).any()


def test_odd_vectors(spark):
    ok = [[float(i)] * 64 for i in range(3)]
    rows = [(1, ok[0]), (1, ok[0]), (2, ok[1]), (None, ok[2]), (3, None), (4, [1.0] * 63), (5, [None] + [1.0] * 63), (6, [float("nan")] * 64), (7, [float("inf")] * 64), (8, [1e30] * 64), (9, [])]
    got = shallot.clustered(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 1, None: 1} and all(r["distance"] == 0 == r["inertia"] for r in got)
    one = shallot.clustered(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).collect()
    assert [(r["cluster"], r["distance"]) for r in one] == [(0, 0)]
    none = shallot.clustered(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# --- 13 ---

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spelt(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    without, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            without[w[:i] + w[i + 1 :], i].add(w)
    for w in n:
        for i in range(len(w)):
            d = w[:i] + w[i + 1 :]
            near[w] |= without[d, i] - {w}
            if d in n:
                near[w].add(d)
                near[d].add(w)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = set()
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out.add((w, form.get(w), r, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_spelling_of_made_up_words(spark):
    """Few letters, so that words are near many others; runs of one letter; words at both sides
    of the length at which tries end; letters outside the class; chains of forms."""
    rng = random.Random(3)
    parts = ["abcabca", "abcabcA", "aabbccd", "aabbcc", "é", "ÿÀx", "-", " ", " ", "×÷ab", "b", "ā", "漢"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(150))) for i in range(50)]
    x, z = "x" * 200, "z" * 64
    rows += [(None, "abcabcab " * 5), (7, f"{x} {x[1:]} {x} {x[1:]} y{x[1:]} y{x[1:]}"), (8, f"{z} {z} {z}z {z}z {z[1:]}y {z[1:]}y {z[1:]} {z[1:]}"), (9, None), (10, ""), (11, None), (-4, "Negative negative " * 40)]
    rows += [(12, "chainlink " * 2 + "chainlinks " * 30 + "chainlinkss " * 400)] * 2
    got = {tuple(r) for r in spelling.variants(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == spelt(rows) and ("chainlink", "chainlinks", "chainlinkss") in {r[:3] for r in got}


def test_spelling_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.op13_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == spelt(rows) == set(con.execute(spelling.ORACLE_SQL).fetchall())


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "short words only")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_crcs():
    rng = random.Random(4)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 30, 127, 128, 129, 400]))) for _ in range(300)]
    data, stop = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    seeds = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    got = spelling.crcs(data, stop - [len(s) for s in spans], stop, seeds)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + s) for i, s in enumerate(spans)]


# --- 3 ---


def test_foreign_elements_end_where_they_end():
    """A self-closing or unclosed svg takes nothing along, and formulas are text."""
    from weftline.llm import html

    def read(inner):
        page = html.Page(f"<html><body><article><p>One two three four five.</p>{inner}<p>Six seven eight nine ten.</p></article></body></html>")
        return page.main_text(None)

    both = "One two three four five.\nSix seven eight nine ten."
    for inner in ("<svg width=1 height=1/>", "<svg/>", "<svg><text>no</text></svg>", "<svg>", "<math/>", "<script>no</script>"):
        assert read(inner) == both, inner
    assert read("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>") == "One two three four five.\nLet x=1 be.\nSix seven eight nine ten."
