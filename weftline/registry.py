"""The library's registered queries, apart from those of the llm subpackage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.connectors import CONNECTOR
from weftline.operators import evaluation, generation, parsing, places, postprocess, sentences
from weftline.sources import grammar

KEYS = ["conv_id", "turn", "s"]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return sentences.lookup(sentences.tokens(sentences.sentences(texts, KEYS[:2]), KEYS), KEYS)


def gr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations and their tokens, the wall not counted."""
    return _words(spark, sf_dir).groupBy(*KEYS).agg((F.count(F.lit(1)) - 1).alias("n_tokens"))


def gr_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How words are found: by the dictionary, by a pattern, or not at all."""
    return _words(spark, sf_dir).where("w > 0").groupBy("classname", "how").agg(F.count(F.lit(1)).alias("n"))


def gr_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and clauses of each class of the grammar."""
    words = grammar.morphemes(spark).groupBy("classname").agg(F.countDistinct("morpheme").alias("n_words"))
    rows = grammar.clauses(spark).groupBy("classname").agg(F.count(F.lit(1)).alias("n_clauses"), F.min("cost").alias("least_cost"))
    return rows.join(words, "classname", "left").select("classname", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), "n_clauses", "least_cost")


def gr_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of connectors of a sentence's clauses that match, by link name."""
    return places.link_counts(places.places(_words(spark, sf_dir), KEYS))


def gr_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each sentence that pruning leaves."""
    kinds = sentences.kinds(_words(spark, sf_dir), KEYS)
    return kinds.spread(parsing.pruned_counts(kinds.words(), sentences.KIND, parsing.clause_trees()))


def gr_corpus_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled corpus: parses of each sentence, and whether they contradict its label."""
    corpus = spark.createDataFrame(evaluation.CORPUS, "line int, label string, sentence string")
    counts = parsing.parse_counts(_corpus_clauses(spark), ["line"])
    return evaluation.errors(corpus, counts).select("line", "label", "sentence", "n_parses", "error")


def _corpus_clauses(spark: SparkSession) -> DataFrame:
    corpus = spark.createDataFrame(evaluation.CORPUS, "line int, label string, sentence string")
    words = sentences.lookup(sentences.tokens(corpus, ["line"]), ["line"])
    return parsing.pruned(parsing.sentence_clauses(words, ["line"]), ["line"])


def gr_linkages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled corpus: the ten best linkages of each sentence, with at most two words
    unlinked, and how many rules each breaks."""
    best = parsing.linkages(_corpus_clauses(spark), ["line"], 10, max_null=2)
    broken = postprocess.violations(best, ["line"]).groupBy("line", "rank").agg(F.count(F.lit(1)).alias("n_violations"))
    links = F.array_join(F.transform("links", lambda x: F.concat_ws("-", x["lw"].cast("string"), x["name"], x["rw"].cast("string"))), " ")
    out = best.join(broken, ["line", "rank"], "left")
    return out.select("line", "rank", "nulls", "cost", "length", links.alias("links"), F.coalesce("n_violations", F.lit(0)).cast("long").alias("n_violations"))


def gr_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of two to four words that the grammar allows: the twenty cheapest of each length."""
    return generation.generated(spark, [2, 3, 4], 20)


def gr_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations by the suffixes that split off them, and their stems."""
    return sentences.stems(_words(spark, sf_dir), KEYS).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stem").alias("n_stems"))


def gr_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses and their costs where two dialects are in use."""
    return grammar.dialect_clauses(spark, ["headline", "colloquial"])


def gr_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's words that begin with d: their classes, clauses and costs."""
    return grammar.inspected(spark, "d*")


FLAGSHIP = "gr_links"
QUERIES = {f.__name__: f for f in (gr_tokens, gr_lookup, gr_links, gr_pruned, gr_stems)}
#: Queries over the grammar's own small tables: held to their SQL by the tests, and not registered.
FIXED = {f.__name__: f for f in (gr_categories, gr_corpus_errors, gr_linkages, gr_generated, gr_dialects, gr_inspected)}


# --- SQL ---


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_CLOSED = sorted({(w, c) for c, ws in grammar.CLOSED.items() for w in ws.split()})
_RULE = " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{c}'" for _, _, p, c in sorted(grammar.PATTERNS))
# a word listed twice in its class stands twice in the dictionary
_ENTRIES = [(w, c) for c, ws in grammar.CLOSED.items() for w in ws.split()]
_WORDS = rf"""
dict AS (SELECT * FROM (VALUES {_values(_ENTRIES)}) t(m, c)),
sents AS (SELECT conv_id, turn, s, trim(sentence, ' ') AS sentence FROM (SELECT conv_id, turn, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS s
  FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?\n]+') AS parts FROM conversations)) WHERE trim(sentence, ' ') <> ''),
split AS (SELECT conv_id, turn, s, list_prepend('LEFT-WALL', list_filter(list_transform(regexp_split_to_array(sentence, '\s+'),
  lambda t: regexp_replace(t, '^[,;:"''()\[\]]+|[,;:"''()\[\]]+$', '', 'g')), lambda t: t <> '')) AS ws FROM sents),
toks AS (SELECT conv_id, turn, s, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS w FROM split),
words AS (SELECT conv_id, turn, s, w, CASE WHEN word = 'LEFT-WALL' THEN 'LEFT-WALL' ELSE coalesce(c, CASE {_RULE} END, 'noun') END AS classname,
  CASE WHEN word = 'LEFT-WALL' OR c IS NOT NULL THEN 'dict' WHEN CASE {_RULE} END IS NOT NULL THEN 'regex' ELSE 'unknown' END AS how
  FROM (SELECT *, lower(word) AS k FROM toks) LEFT JOIN dict ON k = m)"""


def _connector_rows() -> tuple[list[tuple], list[tuple]]:
    """The clauses' connectors, and the names of matching pairs, by the letter of the rules."""
    rows, seen = [], set()
    for d, (c, clause, _) in enumerate(grammar.CLAUSES):
        cons = [re.fullmatch(CONNECTOR, x.strip()).groups() for x in clause.split("&")]
        n = {s: sum(x[4] == s for x in cons) for s in "-+"}
        for i, (_, _, uc, lc, side) in enumerate(cons):
            rows.append((c, d, n["-"], n["+"], i, side, uc, lc))
            seen.add((uc, lc, side))
    names = []
    for uc, x, s in sorted(seen):
        for vc, y, t in sorted(seen):
            if uc == vc and (s, t) == ("+", "-"):
                both = [(p, q) for p, q in zip(x.ljust(9, "*"), y.ljust(9, "*"), strict=True)]
                if all(p == q or "*" in (p, q) for p, q in both):
                    names.append((uc, x, y, (uc + "".join(q if p == "*" else p for p, q in both)).rstrip("*")))
    return rows, names


_ROWS, _NAMES = _connector_rows()
ORACLE_SQL = {
    "gr_tokens": f"WITH {_WORDS} SELECT conv_id, turn, s, count(*) - 1 AS n_tokens FROM words GROUP BY ALL",
    "gr_lookup": f"WITH {_WORDS} SELECT classname, how, count(*) AS n FROM words WHERE w > 0 GROUP BY ALL",
    "gr_categories": f"""WITH d AS (SELECT c, count(DISTINCT m) AS n FROM (VALUES {_values([*_CLOSED, ("LEFT-WALL", "LEFT-WALL")])}) t(m, c) GROUP BY c)
SELECT classname, coalesce(max(d.n), 0)::BIGINT AS n_words, count(*) AS n_clauses, min(cost)::DOUBLE AS least_cost
FROM (VALUES {_values(grammar.CLAUSES)}) t(classname, disjunct, cost) LEFT JOIN d ON d.c = classname GROUP BY classname""",
    "gr_links": f"""WITH {_WORDS},
con AS (SELECT * FROM (VALUES {_values(_ROWS)}) t(classname, d, nl, nr, i, dir, uc, lc)),
placed AS (SELECT *, max(w) OVER (PARTITION BY conv_id, turn, s) AS last FROM words),
cons AS (SELECT p.conv_id, p.turn, p.s, p.w, con.* FROM placed p JOIN con ON p.classname = con.classname WHERE nl <= w AND nr <= last - w)
SELECT name, count(*) AS n FROM cons a JOIN cons b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.s = b.s AND a.w < b.w AND a.dir = '+' AND b.dir = '-' AND a.uc = b.uc
JOIN (VALUES {_values(_NAMES)}) n(uc, x, y, name) ON n.uc = a.uc AND n.x = a.lc AND n.y = b.lc GROUP BY name""",
    "gr_stems": f"""WITH {_WORDS}, suf AS (SELECT * FROM (VALUES {_values([(x,) for x in grammar.SUFFIXES])}) t(suffix)),
plain AS (SELECT lower(word) AS k FROM toks)
SELECT suffix, count(*) AS n, count(DISTINCT left(k, length(k) - length(suffix))) AS n_stems
FROM plain JOIN suf ON ends_with(k, suffix) AND length(k) >= length(suffix) + {grammar.STEM_LETTERS} GROUP BY suffix""",
    "gr_dialects": f"""WITH c AS (SELECT * FROM (VALUES {_values(grammar.CLAUSES)}) t(classname, disjunct, cost)),
m AS (SELECT * FROM (VALUES {_values(grammar.DIALECT_CLAUSES)}) t(classname, disjunct, component)),
told AS (SELECT component, arg_max(told, CASE dialect WHEN 'headline' THEN 0 ELSE 1 END)::DOUBLE AS told
  FROM (VALUES {_values(grammar.DIALECTS)}) t(dialect, component, told) GROUP BY component)
SELECT c.classname, c.disjunct, (CASE WHEN component IS NULL THEN cost ELSE coalesce(told, {grammar.NOT_ALLOWED}) END)::DOUBLE AS cost
FROM c LEFT JOIN m USING (classname, disjunct) LEFT JOIN told USING (component)""",
    "gr_inspected": f"""SELECT m AS morpheme, m || '.' || w.c AS subscript, w.c AS classname, disjunct, cost::DOUBLE AS cost
FROM (VALUES {_values(_ENTRIES)}) w(m, c) JOIN (VALUES {_values(grammar.CLAUSES)}) t(classname, disjunct, cost) ON w.c = t.classname WHERE m LIKE 'd%'""",
}
