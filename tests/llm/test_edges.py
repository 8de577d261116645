"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns with names of its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import html, jaccard, lm, media, mixing, packing, pii, substrings, topk, toxicity

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "A plain text of a few words, all of them harmless.", "en", "a", 50),
    (1, "A plain text of a few words, all of them harmless.", "en", "a", 50),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "en", None, 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "x" * 50_000, "en", "a", 50_000),
    (7, "Écrivez à jean@exemple.fr ou +33 1 23 45 67 89, 4111 1111 1111 1111, 10.0.0.255 et 10.0.0.256", "fr", "c", 90),
    (None, "no id at all", "en", "a", 12),
    (8, LONG + " end", "en", "b", len(LONG) + 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["key", "node", "n", "seed", "media", "size", "target", "start", "score", "spans", "rank", "base", "text_key", "__order", "y", "x", "__text_key", "__key", "__terms", "__kept", "__row", "row", "terms", "taken", "copies", "rest_a", "rest_b", "source_size", "__words", "h", "at"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit("z").alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def model(spark, docs):
    labels = spark.createDataFrame([(1, 0), (5, 0), (7, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


OPERATORS = {
    "pii": lambda s, d: pii.sanitise_spans(d),
    "media": lambda s, d: media.media_features(d),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, model(s, d)),
    "packing": lambda s, d: packing.pack(d),
    "lm": lambda s, d: lm.lm_scores(d),
    "jaccard": lambda s, d: jaccard.jaccard_components(d),
    "mixing": lambda s, d: mixing.mix(d.withColumn("size", mixing.n_words(F.col("text")))),
    "substrings": lambda s, d: substrings.fuzzy_passages(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name in ("pii", "media", "toxicity", "lm", "jaccard", "mixing"):
        assert len(rows) == len(ROWS)  # a row each, repeated and null ones too
        assert sorted(r["doc_id"] or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


def test_results_of_hard_rows(spark, docs):
    found = {r["doc_id"]: r for r in pii.sanitise_spans(docs).collect()}
    assert (found[7]["n_email"], found[7]["n_ip"], found[7]["n_card"], found[7]["n_phone"]) == (1, 1, 1, 1)
    assert found[2]["spans"] == found[3]["spans"] == ""
    comps = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    assert comps[8]["component_id"] == 5 and comps[3]["component_id"] == 3 and comps[4]["n_shingles"] == 0
    same = substrings.fuzzy_passages(docs).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in same} == {(8, 5)}
    scores = {r["doc_id"]: r for r in lm.lm_scores(docs).collect()}
    assert scores[2]["log_prob"] == 0 and scores[2]["mean_log_prob"] is None and scores[6]["n_tokens"] == 1
    mixed = mixing.mix(docs.withColumn("size", mixing.n_words(F.col("text")))).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in mixed)


def test_pages(spark, empty):
    rows = [(1, None, None), (2, "http://a.b/c", ""), (3, "http://a.b/d", "<p>One &amp; two<p>three"), (3, "http://a.b/d", "<p>One &amp; two<p>three"), (4, "no host", "<div><p>cut off <b"), (5, "http://a.b/e", "a < b & c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("path"), F.lit("q").alias("text"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_texts(pages).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("One & two\nthree", 15), 4: ("cut off", 7), 5: ("a < b & c", 9)}
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (20, [-1.0, -1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("dim"), F.lit(1).alias("e"), F.lit(1).alias("block"))
    got = [tuple(r) for r in topk.search(v, v.where("vec_id in (0, 20)"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2048), (0, 2, 2, 2048), (20, 1, 0, -4096), (20, 2, 1, -4096)]
    assert topk.search(v.where("false"), v.where("false")).count() == 0


def test_stages(spark, docs, tmp_path):
    """Each stage takes hard rows and empty tables, and returns the columns of its input."""
    plain = docs
    spark.createDataFrame([(1, 0, 0), (5, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (plain, plain.where("false")):
            out = stage(spark, df, str(tmp_path))
            n = out.count()
            if name != "packing":
                assert out.columns == plain.columns
            if df is plain and name == "pii":
                texts = {r["doc_id"]: r["text"] for r in out.collect()}
                assert n == len(ROWS) and texts[2] is None and "<EMAIL>" in texts[7] and texts[5] == LONG
            if df is plain and name == "ngram_jaccard":
                assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
