"""Registered queries of word forms, pairs, expressions and linkages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import expressions, linkages, pairs, parsing, places, sentences, wordforms
from weftline.plans.lineage import cut
from weftline.registry import _CLOSED, _NAMES, _ROWS, _WORDS, KEYS, _values, _words
from weftline.sources import grammar

QUERIES, ORACLE_SQL = {}, {}
#: Queries over small tables of our own: held to their SQL by the tests, and not registered.
FIXED: dict = {}


def query(sql: str, fixed: bool = False):
    """Register a query under its own name, with its SQL."""

    def put(f):
        (FIXED if fixed else QUERIES)[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"), KEYS[:2])


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordforms.stripped(wordforms.raw_tokens(_sents(spark, sf_dir), KEYS))


def _lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys, w, word: the sentences' words in lower case."""
    return sentences.tokens(_sents(spark, sf_dir), KEYS).where("w > 0").withColumn("word", F.lower("word"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys, lists: the same words, a row for each sentence."""
    sents = _sents(spark, sf_dir).select(*KEYS, F.transform(sentences.word_list(), F.lower).alias("words"))
    return pairs.gathered(sents, KEYS)


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted({(w,) for w, _ in _CLOSED}), "word string")


_MARKS = wordforms.MARKS.replace('\\"', '"').replace("'", "''")
_RAW = rf"""{_WORDS},
rawt AS (SELECT conv_id, turn, s, w, raw FROM (SELECT conv_id, turn, s, unnest(p) AS raw, generate_subscripts(p, 1) AS w
  FROM (SELECT *, regexp_split_to_array(sentence, '\s+') AS p FROM sents)) WHERE raw <> ''),
sidel AS (SELECT *, regexp_extract(raw, '^({_MARKS}+)', 1) AS l FROM rawt),
sider AS (SELECT *, substring(raw, length(l) + 1) AS rest, regexp_extract(substring(raw, length(l) + 1), '({_MARKS}+)$', 1) AS r FROM sidel),
cores AS (SELECT *, substring(rest, 1, length(rest) - length(r)) AS core FROM sider)"""
_LOW = f"{_WORDS}, low AS (SELECT conv_id, turn, s, w, lower(word) AS word FROM toks WHERE w > 0), dw AS (SELECT DISTINCT word FROM low), known AS (SELECT DISTINCT m AS word FROM dict)"


@query(f"WITH {_RAW} SELECT side, mark, count(*) AS n FROM (SELECT 'left' AS side, l AS mark FROM cores UNION ALL SELECT 'right', r FROM cores) WHERE mark <> '' GROUP BY ALL")
def gr_strips(spark, sf_dir):
    """Marks that strip off either end of a token."""
    t = _raw(spark, sf_dir)
    both = t.select(F.lit("left").alias("side"), F.col("left").alias("mark")).union(t.select(F.lit("right"), "right"))
    return both.where("mark <> ''").groupBy("side", "mark").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RAW}, u AS (SELECT regexp_extract(core, '^([0-9]+(?:[.,][0-9]+)*)({"|".join(wordforms.UNITS)})$', 2) AS unit FROM cores)
SELECT unit, count(*) AS n FROM u WHERE unit <> '' GROUP BY unit""")
def gr_units(spark, sf_dir):
    """Units that split off numbers."""
    return wordforms.with_units(_raw(spark, sf_dir)).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RAW} SELECT n_parts, count(*) AS n FROM (SELECT len(list_filter(regexp_split_to_array(core, '{wordforms.MIDDLE}'), lambda p: p <> ''))::BIGINT AS n_parts FROM cores) GROUP BY n_parts")
def gr_middle(spark, sf_dir):
    """Parts that marks inside a token set apart."""
    return wordforms.middle_parts(_raw(spark, sf_dir)).groupBy(F.size("parts").cast("long").alias("n_parts")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RAW}, b AS (SELECT *, lag(raw) OVER (PARTITION BY conv_id, turn, s ORDER BY w) AS before, substring(core, 1, 1) AS f FROM cores)
SELECT CASE WHEN NOT (f = upper(f) AND lower(f) <> upper(f)) THEN 'plain' WHEN before IS NULL OR ends_with(before, ':') OR starts_with(raw, '"') THEN 'start' ELSE 'proper' END AS status,
  count(*) AS n FROM b GROUP BY status""")
def gr_capitals(spark, sf_dir):
    """Capitalised words by place: at a start, or proper names."""
    return wordforms.capitals(_raw(spark, sf_dir), KEYS).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RAW}, o AS (SELECT conv_id, turn, s, w, coalesce(sum(length(raw) + 1) OVER b, 0) AS st, coalesce(sum(strlen(raw) + 1) OVER b, 0) AS sb, length(raw) AS c, strlen(raw) AS o
  FROM rawt WINDOW b AS (PARTITION BY conv_id, turn, s ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, s, count(*) AS n, max(st + c)::BIGINT AS last, max(sb + o)::BIGINT AS last_byte, sum(st)::BIGINT AS starts FROM o GROUP BY ALL""")
def gr_offsets(spark, sf_dir):
    """Places of tokens in code points and bytes, summed up for each sentence."""
    t = wordforms.offsets(wordforms.raw_tokens(_sents(spark, sf_dir), KEYS), KEYS)
    return t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("stop").alias("last"), F.max("stop_byte").alias("last_byte"), F.sum("start").alias("starts"))


@query(f"""WITH {_LOW} SELECT length(word)::INTEGER AS letters, count(*) AS n, count(*) FILTER (regexp_matches(word, '[0-9]')) AS with_digits,
count(*) FILTER (strlen(word) > length(word)) AS wide, max(strlen(word))::INTEGER AS most_bytes FROM dw GROUP BY length(word)""")
def gr_word_tests(spark, sf_dir):
    """Different words by length: those with digits, those of more bytes than code points."""
    w = _lower(spark, sf_dir).select("word").distinct()
    hit = lambda c: F.count(F.when(c, 1))
    return w.groupBy(F.length("word").alias("letters")).agg(F.count(F.lit(1)).alias("n"), hit(F.col("word").rlike("[0-9]")).alias("with_digits"), hit(F.octet_length("word") > F.length("word")).alias("wide"), F.max(F.octet_length("word")).alias("most_bytes"))


@query(f"""WITH {_LOW}, s AS (SELECT word FROM dw WHERE length(word) BETWEEN 1 AND 6),
one AS (SELECT word, unnest(generate_series(1, length(word) - 1)) AS i FROM s WHERE length(word) > 1),
two AS (SELECT word, i, unnest(generate_series(i + 1, length(word) - 1)) AS j FROM one WHERE i + 1 <= length(word) - 1),
parts AS (SELECT word AS last, 1 AS n FROM s UNION ALL SELECT substring(word, i + 1), 2 FROM one UNION ALL SELECT substring(word, j + 1), 3 FROM two)
SELECT n::INTEGER AS n_parts, last, count(*) AS n FROM parts GROUP BY ALL""")
def gr_splits(spark, sf_dir):
    """All ways to cut short words into up to three parts, by the last one."""
    s = wordforms.splits(_lower(spark, sf_dir).select("word").distinct())
    return s.groupBy(F.size("parts").alias("n_parts"), F.element_at("parts", -1).alias("last")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LOW}, pre AS (SELECT * FROM (VALUES {_values([(p,) for p in wordforms.PREFIXES])}) t(p)),
a AS (SELECT word, p AS ps, substring(word, length(p) + 1) AS rest FROM dw JOIN pre ON starts_with(word, p) AND length(word) >= length(p) + 3),
b AS (SELECT word, ps || '+' || p AS ps, substring(rest, length(p) + 1) AS rest FROM a JOIN pre ON starts_with(rest, p) AND length(rest) >= length(p) + 3)
SELECT ps AS prefixes, count(*) AS n, count(DISTINCT rest) AS n_rests FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ps""")
def gr_prefixes(spark, sf_dir):
    """Words by the one or two prefixes that come off them."""
    p = wordforms.prefixed(_lower(spark, sf_dir).select("word").distinct())
    return p.groupBy(F.array_join("prefixes", "+").alias("prefixes")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rest").alias("n_rests"))


@query(f"""WITH {_LOW}, c AS (SELECT word, unnest(generate_series(1, length(word) - 1)) AS i FROM dw WHERE length(word) > 1 AND word NOT IN (SELECT word FROM known)),
ab AS (SELECT word, substring(word, 1, i) AS a, substring(word, i + 1) AS b FROM c)
SELECT word, a, b FROM ab WHERE a IN (SELECT word FROM known) AND b IN (SELECT word FROM known)""")
def gr_run_ons(spark, sf_dir):
    """Unknown words that are two known ones run together."""
    known = _known(spark)
    return wordforms.run_ons(_lower(spark, sf_dir).select("word").distinct().join(known, "word", "left_anti"), known)


@query(f"""WITH {_LOW}, own AS (SELECT word FROM dw WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN (SELECT word FROM known))
SELECT own.word, k.word AS guess FROM own JOIN known k ON regexp_matches(k.word, '^[a-z]{{3,}}$') AND levenshtein(own.word, k.word) = 1""")
def gr_guesses(spark, sf_dir):
    """Spelling guesses: known words at an edit distance of one of unknown ones."""
    known, plain = _known(spark), F.col("word").rlike("^[a-z]{3,}$")
    return wordforms.guesses(_lower(spark, sf_dir).select("word").distinct().where(plain).join(known, "word", "left_anti"), known.where(plain))


@query(f"""WITH {_LOW}, f AS (SELECT word, lead(word) OVER (PARTITION BY conv_id, turn, s ORDER BY w) AS after FROM low)
SELECT idiom, count(*) AS n FROM f JOIN (VALUES {_values(wordforms.IDIOMS)}) t(word, after, idiom) USING (word, after) GROUP BY idiom""")
def gr_idioms(spark, sf_dir):
    """Idioms of two words."""
    return wordforms.idioms(_lower(spark, sf_dir), KEYS).groupBy("idiom").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOW} SELECT w.word FROM dw w WHERE word IN (SELECT word FROM known)")
def gr_exists(spark, sf_dir):
    """Words of conversations that the dictionary has, each once: a semi-join."""
    return _lower(spark, sf_dir).select("word").distinct().join(_known(spark), "word", "left_semi")


@query(f"WITH {_LOW} SELECT word, count(*) AS n FROM low WHERE word NOT IN (SELECT word FROM known) GROUP BY word")
def gr_unknown(spark, sf_dir):
    """Words that it has not, and how often they stand: an anti-join."""
    return _lower(spark, sf_dir).join(_known(spark), "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = f"""{_LOW}, prs AS (SELECT a.conv_id, a.turn, a.s, a.word AS l, b.word AS r FROM low a JOIN low b USING (conv_id, turn, s) WHERE b.w > a.w AND b.w <= a.w + 3),
cnt AS (SELECT l, r, count(*) AS n FROM prs GROUP BY l, r HAVING count(*) >= 2),
mi AS (SELECT l, r, n, round(-log2((n * (sum(n) OVER ())::BIGINT)::DOUBLE / ((sum(n) OVER (PARTITION BY l))::BIGINT * (sum(n) OVER (PARTITION BY r))::BIGINT)::DOUBLE), 6) AS cost FROM cnt)"""


@query(f"WITH {_PAIRS} SELECT l, r, n FROM cnt")
def gr_pairs(spark, sf_dir):
    """Word pairs up to three words apart, seen twice at least."""
    return pairs.counts(_listed(spark, sf_dir).select(F.inline(pairs.listed())))


@query(f"WITH {_PAIRS} SELECT l, r, n, cost FROM mi")
def gr_pair_costs(spark, sf_dir):
    """Their mutual information as costs."""
    return pairs.costs(pairs.counts(_listed(spark, sf_dir).select(F.inline(pairs.listed()))))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, s, count(*) AS n, count(cost) AS n_known, round(sum(coalesce(cost, {pairs.ANY_COST})), 3) AS cost FROM prs LEFT JOIN mi USING (l, r) GROUP BY conv_id, turn, s")
def gr_local_pairs(spark, sf_dir):
    """Each sentence's own pairs: how many the table knows, and what they cost together."""
    return pairs.local_sums(_listed(spark, sf_dir), KEYS).withColumn("cost", F.round("cost", 3))


_CONS = f"""{_WORDS},
con AS (SELECT * FROM (VALUES {_values(_ROWS)}) t(classname, d, nl, nr, i, dir, uc, lc)),
placed AS (SELECT *, max(w) OVER (PARTITION BY conv_id, turn, s) AS last FROM words),
cons AS (SELECT p.conv_id, p.turn, p.s, p.w, con.* FROM placed p JOIN con ON p.classname = con.classname WHERE nl <= w AND nr <= last - w),
met AS (SELECT a.conv_id, a.turn, a.s, a.w AS lw, a.d AS ld, a.i AS li, b.w AS rw, b.d AS rd, b.i AS ri, a.uc FROM cons a JOIN cons b
  ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.s = b.s AND a.w < b.w AND a.dir = '+' AND b.dir = '-' AND a.uc = b.uc
  JOIN (VALUES {_values(_NAMES)}) n(uc, x, y, name) ON n.uc = a.uc AND n.x = a.lc AND n.y = b.lc)"""


@query(f"""WITH {_CONS}, held AS (SELECT DISTINCT conv_id, turn, s, lw AS w, ld AS d, li AS i FROM met UNION SELECT DISTINCT conv_id, turn, s, rw, rd, ri FROM met)
SELECT uc, dir, count(*) AS n, count(h.w) AS n_held FROM cons c LEFT JOIN held h USING (conv_id, turn, s, w, d, i) GROUP BY uc, dir""")
def gr_swept(spark, sf_dir):
    """One sweep of pruning: connectors, and those of them that have a partner."""
    return places.held_counts(places.places(_words(spark, sf_dir), KEYS))


@query(f"""WITH {_CONS}, f AS (SELECT conv_id, turn, s, lw, ld, li, uc, min(rw - lw) AS near, max(rw - lw) AS far FROM met GROUP BY ALL)
SELECT uc, count(*) AS n, min(near)::INTEGER AS nearest, max(far)::INTEGER AS farthest, sum(near)::BIGINT AS near_words, sum(far)::BIGINT AS far_words FROM f GROUP BY uc""")
def gr_nearest(spark, sf_dir):
    """How near and how far the partners of right-going connectors stand, by type."""
    # a word that stands twice in its class has its partners once
    words = _words(spark, sf_dir).select(*KEYS, "w", "classname").distinct()
    return places.nearest(places.places(words, KEYS))


@query(f"WITH {_CONS}, t AS (SELECT conv_id, turn, s, w, dir, count(DISTINCT uc) AS n_types FROM cons GROUP BY ALL) SELECT dir, n_types, count(*) AS n FROM t GROUP BY dir, n_types")
def gr_types(spark, sf_dir):
    """Words by how many types their connectors of a direction have."""
    words = _words(spark, sf_dir).withColumn("last", F.max("w").over(Window.partitionBy(*KEYS)))
    # words of equal classes and places are looked at once
    alike = ["classes", "w", "last"]
    words = words.groupBy(*KEYS, "w", "last").agg(F.array_sort(F.collect_set("classname")).alias("classes"))
    n = cut(words.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")))
    c = parsing.connectors(parsing.sentence_clauses(n.select(*alike, F.explode("classes").alias("classname")), alike[:1]), alike[:1])
    types = c.groupBy(*alike, "dir").agg(F.countDistinct("uc").alias("n_types"))
    return types.join(n, alike).groupBy("dir", "n_types").agg(F.sum("n").alias("n"))


# --- dictionary entries ---

_SLOTS = f"""s AS (SELECT * FROM (VALUES {_values(expressions.SLOTS)}) t(entry, slot, alt, clause, cost, optional)),
o AS (SELECT entry, slot, clause, cost::DOUBLE AS cost FROM s UNION ALL SELECT DISTINCT entry, slot, '', 0.0 FROM s WHERE optional),
e AS (SELECT DISTINCT entry FROM s),
x AS (SELECT e.entry, array_to_string(list_filter([a.clause, b.clause, c.clause], lambda v: v IS NOT NULL AND v <> ''), ' & ') AS disjunct, coalesce(a.cost, 0) + coalesce(b.cost, 0) + coalesce(c.cost, 0) AS cost
  FROM e LEFT JOIN (SELECT * FROM o WHERE slot = 1) a ON a.entry = e.entry LEFT JOIN (SELECT * FROM o WHERE slot = 2) b ON b.entry = e.entry LEFT JOIN (SELECT * FROM o WHERE slot = 3) c ON c.entry = e.entry)"""


def _slots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(expressions.SLOTS, expressions.SCHEMA)


@query(f"WITH {_SLOTS} SELECT entry, disjunct, cost FROM x WHERE disjunct <> ''", fixed=True)
def gr_disjuncts(spark, sf_dir):
    """The disjuncts of expressions of slots, alternatives and options."""
    return expressions.expanded(_slots(spark))


@query(f"WITH {_SLOTS} SELECT entry, disjunct, min(cost) AS cost, count(*) AS n FROM x WHERE disjunct <> '' GROUP BY entry, disjunct HAVING min(cost) <= 2.7", fixed=True)
def gr_cheapest(spark, sf_dir):
    """Equal disjuncts once, at the least cost, up to the cut-off."""
    return expressions.cheapest(expressions.expanded(_slots(spark)))


@query(f"""WITH {_SLOTS}, w AS (SELECT entry, slot, count(*) + max(optional::INTEGER) AS ways, count(*) AS n FROM s GROUP BY entry, slot)
SELECT entry, round(product(ways))::BIGINT AS n_clauses, sum(n)::BIGINT AS n_connectors FROM w GROUP BY entry""", fixed=True)
def gr_clause_counts(spark, sf_dir):
    """How many disjuncts entries have, without making them."""
    return expressions.clause_counts(_slots(spark))


@query(f"WITH {_SLOTS} SELECT disjunct, string_agg(DISTINCT entry, ' ' ORDER BY entry) AS entries, count(DISTINCT entry) AS n, min(cost) AS least FROM x WHERE disjunct <> '' GROUP BY disjunct", fixed=True)
def gr_shared_disjuncts(spark, sf_dir):
    """Which entries share a disjunct."""
    return expressions.entries_of(expressions.expanded(_slots(spark)))


@query(f"SELECT m AS word, count(*) AS n, string_agg(c, ' ' ORDER BY c) AS classes FROM (VALUES {_values([(w, c) for c, ws in grammar.CLOSED.items() for w in ws.split()])}) t(m, c) GROUP BY m HAVING count(*) > 1", fixed=True)
def gr_duplicates(spark, sf_dir):
    """Words that the dictionary has more than once, and their classes."""
    out = grammar.morphemes(spark).groupBy(F.col("morpheme").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("classname")), " ").alias("classes"))
    return out.where("n > 1")


@query(f"""WITH {_WORDS}, c AS (SELECT * FROM (VALUES {_values(grammar.CLAUSES)}) t(classname, disjunct, cost))
SELECT classname, disjunct FROM c WHERE classname NOT IN (SELECT classname FROM words WHERE w = 1)""")
def gr_unused_clauses(spark, sf_dir):
    """Clauses of classes that no sentence begins with."""
    first = _words(spark, sf_dir).where("w = 1").select("classname")
    return grammar.clauses(spark).join(first, "classname", "left_anti").select("classname", "disjunct")


@query(f"""SELECT '{{"classname":"' || c || '","words":[' || string_agg(DISTINCT '"' || m || '"', ',' ORDER BY '"' || m || '"') || ']}}' AS line FROM (VALUES {_values(_CLOSED)}) t(m, c) GROUP BY c""", fixed=True)
def gr_category_json(spark, sf_dir):
    """Classes and their words as JSON lines."""
    words = grammar.morphemes(spark).where("classname <> 'LEFT-WALL'").groupBy("classname").agg(F.array_sort(F.collect_set("morpheme")).alias("words"))
    return words.select(F.to_json(F.struct("classname", "words")).alias("line"))


_TEMPLATE = [["the", "a"], ["dog", "cat", "bird"], ["saw", "heard"], ["it", "them"]]


@query(" UNION ALL ".join(["SELECT a || ' ' || b || ' ' || c || ' ' || d AS sentence, substr(md5('words|' || a || ' ' || b || ' ' || c || ' ' || d), 1, 8) AS draw FROM " + ", ".join(f"(VALUES {_values([(w,) for w in ws])}) t{n}({n})" for n, ws in zip("abcd", _TEMPLATE, strict=True))]), fixed=True)
def gr_sentences(spark, sf_dir):
    """Every sentence of a template of word classes, with its number in the draw."""
    out = spark.range(1).select(F.lit("").alias("sentence"))
    for ws in _TEMPLATE:  # the odometer: each place turns through its words
        out = out.select("sentence", F.explode(F.array(*map(F.lit, ws))).alias("w")).select(F.ltrim(F.concat_ws(" ", "sentence", "w")).alias("sentence"))
    return out.select("sentence", F.substring(F.md5(F.concat(F.lit("words|"), F.col("sentence"))), 1, 8).alias("draw"))


# --- linkages ---

_T = f"""links AS (SELECT * FROM (VALUES {_values(linkages.LINKS)}) t(k, rank, i, lw, rw, name)), sent AS (SELECT * FROM (VALUES {_values(linkages.SENTENCES)}) t(k, n_words)),
cost AS (SELECT * FROM (VALUES {_values(linkages.COSTS)}) t(k, rank, cost)), starts AS (SELECT * FROM (VALUES {_values(linkages.STARTS)}) t(name, letter)),
rules AS (SELECT * FROM (VALUES {_values(linkages.DOMAIN_RULES)}) t(rule, kind, letter, wanted)), spans AS (SELECT * FROM (VALUES {_values(linkages.SPANS)}) t(k, rank, label, lw, rw)),
edges AS (SELECT k, rank, i, lw AS a, rw AS b FROM links UNION ALL SELECT k, rank, i, rw, lw FROM links)"""
_DOMAINS = f"""{_T}, heads AS (SELECT k, rank, i AS start, letter, lw AS l, rw AS word FROM links JOIN starts USING (name)),
reached AS (SELECT k, rank, start, word, l FROM heads UNION SELECT r.k, r.rank, r.start, e.b, r.l FROM reached r JOIN edges e ON e.k = r.k AND e.rank = r.rank AND e.a = r.word WHERE e.i <> r.start AND e.b <> r.l),
doms AS (SELECT DISTINCT r.k, r.rank, r.start, h.letter, e.i FROM reached r JOIN edges e ON e.k = r.k AND e.rank = r.rank AND e.a = r.word JOIN heads h ON h.k = r.k AND h.rank = r.rank AND h.start = r.start
  WHERE e.b <> h.l OR e.i = r.start UNION SELECT k, rank, start, letter, start FROM heads)"""


@query(f"""WITH {_T}, shape AS (SELECT k, rank, string_agg(printf('%03d-%03d-%s', lw, rw, name), ' ' ORDER BY printf('%03d-%03d-%s', lw, rw, name)) AS shape, sum(rw - lw - 1)::BIGINT AS length FROM links GROUP BY k, rank),
once AS (SELECT * FROM shape QUALIFY row_number() OVER (PARTITION BY k, shape ORDER BY rank) = 1),
used AS (SELECT k, rank, count(DISTINCT a) AS used FROM edges GROUP BY k, rank),
all_ AS (SELECT k, rank, (n_words - used)::BIGINT AS unused, cost::DOUBLE AS cost, length FROM once JOIN used USING (k, rank) JOIN cost USING (k, rank) JOIN sent USING (k))
SELECT *, row_number() OVER (PARTITION BY k ORDER BY unused, cost, length, rank)::INTEGER AS place, dense_rank() OVER (PARTITION BY k ORDER BY unused, cost, length)::INTEGER AS tie FROM all_""", fixed=True)
def gr_scored(spark, sf_dir):
    """Scores, places and ties of linkages, equal ones once."""
    t = linkages.tables(spark)
    return linkages.scored(t["links"], t["sentences"], t["costs"])


@query(f"WITH {_T} SELECT k, rank FROM (SELECT DISTINCT k, rank FROM links) QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('draw|' || k || '|' || rank)) <= 2", fixed=True)
def gr_sampled(spark, sf_dir):
    """Two linkages of each sentence in a seeded order."""
    return linkages.sampled(linkages.tables(spark)["links"], 2, "draw")


@query(f"""WITH RECURSIVE {_T}, ids AS (SELECT DISTINCT k, rank FROM links), words AS (SELECT k, rank, unnest(generate_series(0, n_words - 1)) AS start FROM ids JOIN sent USING (k)),
r AS (SELECT k, rank, start, start AS word FROM words UNION SELECT r.k, r.rank, r.start, e.b FROM r JOIN edges e ON e.k = r.k AND e.rank = r.rank AND e.a = r.word)
SELECT k, rank, count(DISTINCT root) AS n_islands FROM (SELECT k, rank, start, min(word) AS root FROM r GROUP BY ALL) GROUP BY k, rank""", fixed=True)
def gr_islands(spark, sf_dir):
    """Parts of sentences that no links join."""
    t = linkages.tables(spark)
    return linkages.islands(t["links"], t["sentences"])


@query(f"WITH RECURSIVE {_DOMAINS} SELECT *, row_number() OVER (PARTITION BY k, rank ORDER BY size, start)::INTEGER AS place FROM (SELECT k, rank, start, letter, count(*) AS size, string_agg(i::VARCHAR, ' ' ORDER BY i) AS members FROM doms GROUP BY k, rank, start, letter)", fixed=True)
def gr_domains(spark, sf_dir):
    """Domains of linkages, smaller ones first."""
    t = linkages.tables(spark)
    found = linkages.domains(t["links"], t["starts"]).groupBy(*linkages.ID, "start", "letter")
    out = found.agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x.cast("string")), " ").alias("members"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*linkages.ID).orderBy("size", "start")))


@query(f"""WITH RECURSIVE {_DOMAINS}, m AS (SELECT d.k, d.rank, d.start, rule, kind, max((l.name = wanted)::INTEGER) AS has, min(l.lw - h.l) AS out_ FROM doms d JOIN links l USING (k, rank, i)
  JOIN heads h ON h.k = d.k AND h.rank = d.rank AND h.start = d.start JOIN rules ON rules.letter = d.letter GROUP BY ALL)
SELECT k, rank, start, rule FROM m WHERE CASE kind WHEN 'contains_one' THEN has = 0 WHEN 'contains_none' THEN has = 1 ELSE out_ < 0 END""", fixed=True)
def gr_domain_rules(spark, sf_dir):
    """Rules that domains break: contains one, contains none, bounded."""
    t = linkages.tables(spark)
    return linkages.broken_rules(t["links"], linkages.domains(t["links"], t["starts"]), t["rules"])


@query(f"""WITH RECURSIVE {_T}, r AS (SELECT k, rank, i AS start, lw AS word FROM links UNION SELECT r.k, r.rank, r.start, e.b FROM r JOIN edges e ON e.k = r.k AND e.rank = r.rank AND e.a = r.word AND e.i <> r.start)
SELECT l.k, l.rank, l.i FROM links l JOIN r ON r.k = l.k AND r.rank = l.rank AND r.start = l.i AND r.word = l.rw""", fixed=True)
def gr_cycles(spark, sf_dir):
    """Links that form a cycle with others."""
    return linkages.cycles(linkages.tables(spark)["links"])


@query(f"WITH {_T} SELECT k, rank, string_agg(lw || '-' || name || '-' || rw, ' ' ORDER BY lw, rw) AS shown FROM links GROUP BY k, rank", fixed=True)
def gr_displayed(spark, sf_dir):
    """Linkages as lines of links."""
    return linkages.displayed(linkages.tables(spark)["links"])


@query(f"""WITH {_T}, c AS (SELECT k, rank, rw AS w, 0 AS side, rw - lw AS far, name || '-' AS t FROM links UNION ALL SELECT k, rank, lw, 1, rw - lw, name || '+' FROM links)
SELECT k, rank, w, string_agg(t, ' ' ORDER BY side, far, t) AS disjunct FROM c GROUP BY k, rank, w""", fixed=True)
def gr_word_disjuncts(spark, sf_dir):
    """The disjunct that a linkage uses at each word."""
    return linkages.word_disjuncts(linkages.tables(spark)["links"])


@query(f"""WITH {_T}, o AS (SELECT k, rank, lw AS w, string_agg('(' || label, ' ' ORDER BY -rw, label) AS op FROM spans GROUP BY ALL), c AS (SELECT k, rank, rw AS w, count(*) AS n FROM spans GROUP BY ALL),
w AS (SELECT k, rank, unnest(generate_series(a, b)) AS w FROM (SELECT k, rank, min(lw) AS a, max(rw) AS b FROM spans GROUP BY ALL))
SELECT k, rank, string_agg(concat_ws(' ', op, w.w::VARCHAR) || repeat(')', coalesce(n, 0)), ' ' ORDER BY w.w) AS tree FROM w LEFT JOIN o USING (k, rank, w) LEFT JOIN c USING (k, rank, w) GROUP BY k, rank""", fixed=True)
def gr_constituents(spark, sf_dir):
    """Constituents as bracketed trees."""
    return linkages.bracketed(linkages.tables(spark)["spans"])
