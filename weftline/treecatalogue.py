"""Registered queries over expression trees, all of them over whole conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.connectors import parsed
from weftline.operators import constituents, forest, linkages, parsing, paths, power, relevance, rulepruning, sentences, trees, wordforms, wordgraph
from weftline.operators.sentences import KIND
from weftline.plans.lineage import cut, grown, together
from weftline.registry import _WORDS, KEYS, _values
from weftline.sources import trees as source

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Clauses that cost more than this are never made.
CUTOFF = 1.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations with their classes, of sentences that hold at least one."""
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return sentences.lookup(sentences.tokens(sentences.sentences(texts, KEYS[:2]), KEYS), KEYS).select(*KEYS, "w", "classname")


def clauses(spark: SparkSession, sf_dir: str, cutoff: float = CUTOFF) -> DataFrame:
    """keys, w, last, classname, live, d, connectors, cost: the clauses of the words of
    conversations after expression pruning, of sentences all of whose words may be linked. Each
    shape is expanded once, and numbers its clauses."""
    kinds = _kinds(spark, sf_dir)
    return kinds.spread(_made(kinds, source.grammar(spark), cutoff))


def _kinds(spark: SparkSession, sf_dir: str) -> sentences.Kinds:
    return sentences.kinds(_words(spark, sf_dir), KEYS)


def _made(kinds: sentences.Kinds, g: source.Grammar, cutoff: float = CUTOFF) -> DataFrame:
    """As clauses(), with kind in place of keys."""
    state = cut(trees.pruned(kinds.words(), KIND, g, linked=True))
    last = kinds.each.select("kind", F.array_max(F.col("classes.w")).alias("last"))
    return numbered(state, last, KIND, g, cutoff)


def numbered(state: DataFrame, last: DataFrame, keys: list[str], g: source.Grammar, cutoff: float) -> DataFrame:
    """state(keys, w, classname, live) with last(keys, last) and the clauses of each word's shape.
    A shape's clauses come as one array: their number follows from the dictionary alone."""
    shapes = cut(state.select("classname", "live").distinct())
    found = cut(trees.expanded(shapes, g, cutoff).groupBy(*trees.SHAPE).agg(F.array_sort(F.collect_list(F.struct("connectors", "cost"))).alias("all")))
    # words are never sent whole through the driver to meet their clauses, however small their files are
    few = (found.agg(F.sum(F.size("all"))).first()[0] or 0) <= trees.MOST_SHAPES
    rows = state.hint("merge").join(last, keys).join(F.broadcast(found) if few else found.hint("merge"), trees.SHAPE)
    return rows.select(*keys, "w", "last", *trees.SHAPE, F.posexplode("all").alias("d", "x")).select(*keys, "w", "last", *trees.SHAPE, "d", "x.*")


# --- SQL ---

_ROWS = source.node_rows(source.EXPRESSIONS)
_LEAVES = [(r[0], r[1], r[6], r[6].lstrip("@"), r[6][-1], source.REACH.get(r[6].lstrip("@")[0], source.FAR)) for r in _ROWS if r[5] == "con"]
_KIDS: dict = {}
for _r in _ROWS:
    if _r[2] is not None:
        _KIDS.setdefault((_r[0], _r[2]), []).append(_r[1])
_NODE = {(r[0], r[1]): r for r in _ROWS}


def _alive(c: str, n: int) -> str:
    kind, kids = _NODE[c, n][5], _KIDS.get((c, n), [])
    if kind == "con":
        return f"list_contains(kept, {n})"
    return "(" + ((" AND " if kind == "and" else " OR ").join(_alive(c, k) for k in kids) or "TRUE") + ")"


def _stays(c: str, n: int) -> str:
    out, parts = n, []
    while out is not None:
        parts.append(_alive(c, out))
        out = _NODE[c, out][2]
    return " AND ".join(parts)


_CASE = "CASE " + " ".join(f"WHEN classname = '{c}' AND node = {n} THEN {_stays(c, n)}" for c, n, *_ in _LEAVES) + " END"
_TREES = f"""{_WORDS}, leaf AS (SELECT * FROM (VALUES {_values(_LEAVES)}) t(classname, node, connector, name, dir, reach)),
mat AS (SELECT * FROM (VALUES {_values(source.matching_names(source.EXPRESSIONS))}) t(a, b)),
r0 AS MATERIALIZED (SELECT conv_id, turn, s, w, classname, node FROM words JOIN leaf USING (classname))"""


def _sweep(old: str, new: str, to: str) -> str:
    own, other, before = ("b", "a", "y.w < x.w") if to == "-" else ("a", "b", "y.w > x.w")
    return f"""{new}j AS MATERIALIZED (SELECT * FROM {old} JOIN leaf USING (classname, node)),
{new}y AS MATERIALIZED (SELECT DISTINCT conv_id, turn, s, w, {own} AS name FROM {new}j JOIN mat ON name = {other} WHERE dir <> '{to}'),
{new}k AS MATERIALIZED (SELECT conv_id, turn, s, w, classname, list(node) AS kept FROM {new}j x WHERE dir <> '{to}' OR EXISTS (SELECT 1 FROM {new}y y
  WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.s = x.s AND y.name = x.name AND {before} AND abs(x.w - y.w) <= x.reach) GROUP BY ALL),
{new} AS MATERIALIZED (SELECT conv_id, turn, s, w, classname, node FROM (SELECT *, unnest(kept) AS node FROM {new}k) WHERE {_CASE})"""


def _turns(n: int) -> str:
    steps = [f"r{2 * i + j}" for i in range(n) for j in range(2)]
    return ", ".join(_sweep(a, f"r{int(a[1:]) + 1}", "-+"[i % 2]) for i, a in enumerate(steps))


def _dnf(c: str, n: int) -> str:
    """A subquery of one expression's clauses, as node numbers: joins for AND, unions for OR."""
    kind, cost, kids = _NODE[c, n][5], _NODE[c, n][7], _KIDS.get((c, n), [])
    if kind == "con":
        return f"SELECT [{n}] AS x, {cost}::DOUBLE AS c"
    if not kids:
        return f"SELECT []::INTEGER[] AS x, {cost}::DOUBLE AS c"
    if kind == "or":
        return f"SELECT x, c + {cost} AS c FROM (" + " UNION ALL ".join(_dnf(c, k) for k in kids) + ")"
    parts, x = [f"t{n}_{i}" for i in range(len(kids))], "[]::INTEGER[]"
    for p in parts:
        x = f"list_concat({x}, {p}.x)"
    return f"SELECT {x} AS x, {cost} + {' + '.join(p + '.c' for p in parts)} AS c FROM " + ", ".join(f"({_dnf(c, k)}) {p}" for p, k in zip(parts, kids, strict=True))


_NAMES = ", ".join(f"('{c}', [{', '.join('NULL' if r[6] is None else repr(r[6]) for r in _ROWS if r[0] == c)}])" for c in source.EXPRESSIONS)
_CLAUSES = f"""named AS (SELECT * FROM (VALUES {_NAMES}) t(classname, names)),
dnf AS MATERIALIZED (SELECT classname, x, cost, array_to_string(list_transform(x, lambda n: names[n + 1]), ' & ') AS disjunct FROM ({" UNION ALL ".join(f"SELECT '{c}' AS classname, x, c AS cost FROM ({_dnf(c, 0)})" for c in source.EXPRESSIONS)}) JOIN named USING (classname))"""


# --- expressions ---


@query(f"""WITH {_TREES}, {_turns(1)}, n AS (SELECT classname, node, 0 AS t FROM r0 UNION ALL SELECT classname, node, 1 FROM r1 UNION ALL SELECT classname, node, 2 FROM r2)
SELECT classname, node, count(*) FILTER (t = 0) AS n, count(*) FILTER (t = 1) AS n_left, count(*) FILTER (t = 2) AS n_both FROM n GROUP BY ALL""")
def gr_exp_swept(spark, sf_dir):
    """Connectors of all words' expressions, and those that a sweep to the left, and then one to
    the right, leave."""
    g, kinds = source.grammar(spark), _kinds(spark, sf_dir)
    start = cut(trees.whole(kinds.words().join(kinds.counts(), "kind"), g))
    left = cut(trees.swept(start, KIND, g, "-"))
    both = trees.swept(left, KIND, g, "+")
    # words of one class and shape are counted before their connectors are taken apart
    rows = [x.groupBy(*trees.SHAPE).agg(F.sum("n").alias("n")).select("classname", F.explode("live").alias("node"), "n", F.lit(t).alias("t")) for t, x in enumerate((start, left, both))]
    hit = lambda t: F.coalesce(F.sum(F.when(F.col("t") == t, F.col("n"))), F.lit(0))
    return rows[0].union(rows[1]).union(rows[2]).groupBy("classname", "node").agg(hit(0).alias("n"), hit(1).alias("n_left"), hit(2).alias("n_both"))


@query(f"""WITH {_TREES}, {_turns(8)}, n AS (SELECT conv_id, turn, s, count(*) AS n FROM words GROUP BY ALL)
SELECT conv_id, turn, s, count(DISTINCT w) AS n_words, count(*) AS n_connectors FROM r16 JOIN n USING (conv_id, turn, s) GROUP BY conv_id, turn, s, n HAVING count(DISTINCT w) = n""")
def gr_exp_pruned(spark, sf_dir):
    """What expression pruning leaves of sentences all of whose words may still be linked."""
    kinds = _kinds(spark, sf_dir)
    live = trees.pruned(kinds.words(), KIND, source.grammar(spark), linked=True)
    return kinds.spread(live.groupBy(*KIND).agg(F.countDistinct("w").alias("n_words"), F.sum(F.size("live")).alias("n_connectors")))


@query(f"""WITH {_WORDS}, {_CLAUSES} SELECT classname, disjunct, cost, count(*) AS n
FROM words JOIN dnf USING (classname) WHERE len(x) > 0 AND cost <= {CUTOFF} GROUP BY classname, disjunct, cost""")
def gr_exp_clauses(spark, sf_dir):
    """The clauses of all words' whole expressions under the cost bound."""
    g, words = source.grammar(spark), _words(spark, sf_dir)
    state = trees.whole(words, g).groupBy(*trees.SHAPE).agg(F.count(F.lit(1)).alias("n"))
    found = trees.expanded(state.select(*trees.SHAPE), g, CUTOFF)
    rows = found.join(state, trees.SHAPE).groupBy("classname", "connectors", "cost").agg(F.sum("n").alias("n"))
    return rows.select("classname", F.array_join("connectors", " & ").alias("disjunct"), "cost", "n")


@query(f"""WITH {_WORDS}, {_CLAUSES}, k AS (SELECT classname, count(*) AS k, count(*) FILTER (cost <= {CUTOFF} AND len(x) > 0) AS m FROM dnf GROUP BY classname)
SELECT conv_id, turn, s, sum(k)::BIGINT AS n_clauses, sum(m)::BIGINT AS n_cheap FROM words JOIN k USING (classname) GROUP BY ALL""")
def gr_exp_counts(spark, sf_dir):
    """How many clauses each sentence's words have: counted without expansion, and expanded under
    the cost bound."""
    g = source.grammar(spark)
    state = trees.whole(_words(spark, sf_dir), g)
    shapes = state.select(*trees.SHAPE).distinct()
    cheap = trees.expanded(shapes, g, CUTOFF).groupBy(*trees.SHAPE).agg(F.count(F.lit(1)).alias("m"))
    n = trees.clause_counts(shapes, g).join(cheap, trees.SHAPE, "left")
    n = cut(n)  # a whole expression is one shape: of the dictionary's size, and most words are of few of them
    return state.join(F.broadcast(n) if g.small else n, trees.SHAPE).groupBy(*KEYS).agg(F.sum("n").alias("n_clauses"), F.sum(F.coalesce("m", F.lit(0))).alias("n_cheap"))


# --- clauses ---


_MADE = f"""{_TREES}, {_turns(8)}, {_CLAUSES}, n AS (SELECT conv_id, turn, s, count(*) AS n, max(w) AS last FROM words GROUP BY ALL),
full_ AS (SELECT conv_id, turn, s, max(last) AS last FROM r16 JOIN n USING (conv_id, turn, s) GROUP BY conv_id, turn, s, n HAVING count(DISTINCT w) = n),
st AS (SELECT conv_id, turn, s, w, classname, list(node) AS live FROM r16 SEMI JOIN full_ USING (conv_id, turn, s) GROUP BY ALL),
made AS MATERIALIZED (SELECT row_number() OVER () AS id, conv_id, turn, s, w, last, classname, x FROM st JOIN dnf USING (classname) JOIN full_ USING (conv_id, turn, s)
  WHERE len(x) > 0 AND cost <= {CUTOFF} AND list_has_all(live, x))"""


def _half(old: str, new: str, to: str) -> str:
    own, other, far = ("b", "a", "p.w - q.w") if to == "-" else ("a", "b", "q.w - p.w")
    return f"""{new}m AS MATERIALIZED (SELECT p.id, p.i, min({far}) AS near, max({far}) AS far FROM {old} p JOIN mat ON p.name = {own} JOIN {old} q ON q.name = {other} AND q.conv_id = p.conv_id AND q.turn = p.turn AND q.s = p.s
  WHERE p.dir = '{to}' AND q.dir <> '{to}' AND {far} BETWEEN p.lo AND p.hi AND {far} BETWEEN q.lo AND q.hi AND ({far} <= 1 OR p.i > 1 OR q.i > 1 OR p.multi OR q.multi) GROUP BY p.id, p.i),
{new}w AS (SELECT p.* REPLACE (max(m.near - p.i) OVER (PARTITION BY p.id ORDER BY p.i) + p.i AS lo, min(m.far - p.i) OVER (PARTITION BY p.id ORDER BY p.i DESC) + p.i AS hi) FROM {old} p JOIN {new}m m ON m.id = p.id AND m.i = p.i WHERE p.dir = '{to}'
  UNION ALL SELECT * FROM {old} WHERE dir <> '{to}'),
{new} AS MATERIALIZED (SELECT * FROM {new}w WHERE lo <= hi QUALIFY count(*) OVER (PARTITION BY id) = n)"""


_BOUNDS = f"""{_MADE}, parts AS (SELECT m.*, len(x) AS n, generate_subscripts(x, 1) AS pos, unnest(x) AS node FROM made m),
sides AS (SELECT p.*, name, dir, reach, starts_with(connector, '@') AS multi, row_number() OVER v AS i, count(*) OVER (PARTITION BY id, dir) AS k FROM parts p JOIN leaf USING (classname, node) WINDOW v AS (PARTITION BY id, dir ORDER BY pos)),
b0w AS (SELECT id, conv_id, turn, s, w, dir, name, multi, n, i, i AS lo, least(CASE dir WHEN '-' THEN w ELSE last - w END - k + i, reach) AS hi FROM sides),
b0 AS MATERIALIZED (SELECT * FROM b0w WHERE lo <= hi QUALIFY count(*) OVER (PARTITION BY id) = n),
{_half("b0", "b1", "-")}, {_half("b1", "b2", "+")}"""


def _sums() -> list:
    return [F.count(F.lit(1)).alias("n"), F.sum("lo").alias("nearest"), F.sum("hi").alias("farthest")]


def _totals() -> list:
    return [F.sum(c).alias(c) for c in ("n", "nearest", "farthest")]


def _weighed(sums: DataFrame, kinds: sentences.Kinds) -> DataFrame:
    """Sums of kinds times the sentences of each."""
    rows = sums.join(kinds.counts().withColumnRenamed("n", "__n"), "kind")
    return rows.withColumns({c: F.col(c) * F.col("__n") for c in ("n", "nearest", "farthest")}).drop("__n")


@query(f"""WITH {_BOUNDS}, u AS (SELECT 'made' AS step, w, id, lo, hi, name FROM b0 UNION ALL SELECT 'left', w, id, lo, hi, name FROM b1 UNION ALL SELECT 'right', w, id, lo, hi, name FROM b2)
SELECT step, name, count(*) AS n, sum(lo)::BIGINT AS nearest, sum(hi)::BIGINT AS farthest FROM u GROUP BY step, name""")
def gr_power_swept(spark, sf_dir):
    """Connectors of clauses and the distances at which they may link: as made, after a turn to
    the left, and after one to the right."""
    g, kinds = source.grammar(spark), _kinds(spark, sf_dir)
    made = together(cut(power.bounded(_made(kinds, g), KIND, g)), KIND)
    left = together(cut(power.half_turn(made, KIND, g, "-")), KIND)
    steps = {"made": made, "left": left, "right": power.half_turn(left, KIND, g, "+")}
    rows = [x.groupBy("kind", "name").agg(*_sums()).select(F.lit(k).alias("step"), "*") for k, x in steps.items()]
    return _weighed(rows[0].union(rows[1]).union(rows[2]), kinds).groupBy("step", "name").agg(*_totals())


@query()
def gr_power_pruned(spark, sf_dir):
    """The clauses of each sentence that are made, and those that power pruning leaves."""
    g, kinds = source.grammar(spark), _kinds(spark, sf_dir)
    c = cut(_made(kinds, g))
    left = power.pruned(c, KIND, g).groupBy(*KIND).agg(F.count(F.lit(1)).alias("n_left"), F.countDistinct("w").alias("n_words"))
    made = c.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n_clauses"))
    return kinds.spread(made.join(left, KIND, "left")).select(*KEYS, "n_clauses", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


_CROSSED = f"""{_BOUNDS}, ev AS (SELECT conv_id, turn, s, w, count(DISTINCT id) AS n_all FROM b2 GROUP BY ALL),
links AS MATERIALIZED (SELECT DISTINCT conv_id, turn, s, least(v, w) AS a, greatest(v, w) AS b FROM (SELECT conv_id, turn, s, w, CASE dir WHEN '-' THEN w - lo ELSE w + lo END AS v, count(DISTINCT id) AS n_have FROM b2 WHERE lo = hi GROUP BY ALL)
  JOIN ev USING (conv_id, turn, s, w) WHERE n_have = n_all),
spots AS (SELECT DISTINCT conv_id, turn, s, w, dir, lo, hi FROM b2),
far AS (SELECT *, CASE dir WHEN '-' THEN w - b ELSE a - w END AS near, CASE dir WHEN '-' THEN w - a ELSE b - w END AS far FROM spots JOIN links USING (conv_id, turn, s)),
cuts AS (SELECT conv_id, turn, s, w, dir, lo, hi, max(CASE WHEN NOT (w > a AND w < b) AND near > 0 AND lo > near AND lo < far THEN far ELSE lo END) AS nlo,
  min(CASE WHEN w > a AND w < b THEN least(hi, far) WHEN near > 0 AND hi > near AND hi < far THEN near ELSE hi END) AS nhi FROM far GROUP BY ALL),
x0 AS (SELECT b2.* REPLACE (coalesce(nlo, b2.lo) AS lo, coalesce(nhi, b2.hi) AS hi) FROM b2 LEFT JOIN cuts USING (conv_id, turn, s, w, dir, lo, hi)),
x1 AS (SELECT * FROM x0 WHERE lo <= hi QUALIFY count(*) OVER (PARTITION BY id) = n)"""


@query(f"""WITH {_CROSSED} SELECT name, count(*) AS n, sum(lo)::BIGINT AS nearest, sum(hi)::BIGINT AS farthest, (SELECT count(*) FROM links) AS n_links FROM x1 GROUP BY name""")
def gr_crossed(spark, sf_dir):
    """Connectors and their distances after a turn to either side, without what would cross the
    links that sentences must have, and the number of such links."""
    g, kinds = source.grammar(spark), _kinds(spark, sf_dir)
    start = together(cut(power.bounded(_made(kinds, g), KIND, g)), KIND)
    rows = together(cut(power.turned(start, KIND, g)), KIND)
    n = power.mandatory(rows, KIND).join(kinds.counts(), "kind").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))
    out = _weighed(power.crossed(rows, KIND).groupBy("kind", "name").agg(*_sums()), kinds).groupBy("name").agg(*_totals())
    return out.join(F.broadcast(n))


def _like(name: str, pattern: str) -> str:
    return f"regexp_matches({name}, '^' || replace({pattern}, '*', '[a-z*]') || '([^A-Z_]|$)')"


_LINKS = [(a, b, _n) for a, b in source.matching_names(source.EXPRESSIONS) for _n in [source.link_of(a, b)]]
_RULES = f"""{_MADE}, rules AS (SELECT * FROM (VALUES {_values(rulepruning.RULES)}) t(rule, selector, wanted)), lk AS (SELECT * FROM (VALUES {_values(_LINKS)}) t(a, b, link)),
asks AS (SELECT DISTINCT name, rule FROM (SELECT DISTINCT name FROM leaf) JOIN rules ON {_like("name[:-2]", "selector")}), gives AS (SELECT DISTINCT a, b, rule FROM lk JOIN rules ON {_like("link", "wanted")}),
cons AS MATERIALIZED (SELECT id, conv_id, turn, s, w, classname, name FROM (SELECT *, unnest(x) AS node FROM made) JOIN leaf USING (classname, node)),
ok AS (SELECT DISTINCT p.conv_id, p.turn, p.s, rule FROM cons p JOIN gives ON p.name = a JOIN cons q ON q.name = b AND q.conv_id = p.conv_id AND q.turn = p.turn AND q.s = p.s AND p.w < q.w),
asked AS (SELECT DISTINCT id, conv_id, turn, s, classname, rule FROM cons JOIN asks USING (name))"""


@query(f"""WITH {_RULES} SELECT rule, classname, count(*) AS n_asked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ok o WHERE o.conv_id = k.conv_id AND o.turn = k.turn AND o.s = k.s AND o.rule = k.rule)) AS n_lost FROM asked k GROUP BY ALL""")
def gr_rule_lacks(spark, sf_dir):
    """Clauses that ask for a link by a rule, and those of them that no link of their sentence can
    satisfy."""
    g, kinds = source.grammar(spark), _kinds(spark, sf_dir)
    c, rules = cut(_made(kinds, g)), spark.createDataFrame(rulepruning.RULES, rulepruning.RULE)
    names = c.select(*KIND, "w", "d", "classname", F.explode(F.transform("connectors", lambda x: F.regexp_replace(x, "^@", ""))).alias("name"))
    asks = cut(rulepruning.index(g, rules)[0])
    asked = names.join(F.broadcast(asks) if g.small else asks, "name").select(*KIND, "w", "d", "classname", "rule").distinct()
    lost = rulepruning.lacking(c, KIND, g, rules).withColumn("lost", F.lit(1))
    met = asked.join(lost, [*KIND, "w", "d", "rule"], "left").groupBy("kind", "rule", "classname").agg(F.count(F.lit(1)).alias("n_asked"), F.count("lost").alias("n_lost"))
    total = lambda c: F.sum(F.col(c) * F.col("n")).alias(c)
    return met.join(kinds.counts(), "kind").groupBy("rule", "classname").agg(total("n_asked"), total("n_lost"))


_SELECTS = f"""sel AS (SELECT DISTINCT rule, link FROM (SELECT DISTINCT link FROM lk) JOIN rules ON {_like("link", "selector")})"""


@query(f"""WITH {_RULES}, {_SELECTS}, can AS MATERIALIZED (SELECT DISTINCT p.conv_id, p.turn, p.s, lk.link FROM cons p JOIN lk ON p.name = a JOIN cons q ON q.name = b AND q.conv_id = p.conv_id AND q.turn = p.turn AND q.s = p.s AND p.w < q.w),
can_n AS (SELECT conv_id, turn, s, count(*) AS n_links FROM can GROUP BY ALL), can_r AS (SELECT conv_id, turn, s, count(DISTINCT rule) AS n_rules, string_agg(DISTINCT rule::VARCHAR, ' ' ORDER BY rule::VARCHAR) AS rules FROM can JOIN sel USING (link) GROUP BY ALL)
SELECT conv_id, turn, s, n_links, coalesce(n_rules, 0) AS n_rules, coalesce(rules, '') AS rules FROM can_n LEFT JOIN can_r USING (conv_id, turn, s)""")
def gr_relevant_rules(spark, sf_dir):
    """The names of links that each sentence's clauses can make, and the rules that such links
    make relevant to it."""
    g, rules = source.grammar(spark), spark.createDataFrame(rulepruning.RULES, rulepruning.RULE)
    kinds = _kinds(spark, sf_dir)
    cons = _made(kinds, g).select(*KIND, "w", F.explode("connectors").alias("c")).select(*KIND, "w", F.regexp_replace("c", "^@", "").alias("name"))
    links = cut(relevance.possible_links(cons, KIND, g))
    found = relevance.relevant(links, KIND, rules).groupBy(*KIND).agg(F.count(F.lit(1)).alias("n_rules"), F.array_join(F.array_sort(F.collect_list(F.col("rule").cast("string"))), " ").alias("rules"))
    n = links.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n_links"))
    return kinds.spread(n.join(found, KIND, "left")).select(*KEYS, "n_links", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("rules", F.lit("")).alias("rules"))


def _canonical(e: tuple) -> str:
    kind, inner, cost = e
    text = inner if kind == "con" else ("(%s)" if kind == "and" else "{%s}") % (" & " if kind == "and" else " or ").join(map(_canonical, inner))
    return f"[{cost}]{text}" if cost else text


def _subtrees(e: tuple) -> list[str]:
    return [_canonical(e), *(x for o in (e[1] if e[0] != "con" else ()) for x in _subtrees(o))]


_TEXTS = sorted({(c, t) for c, e in source.EXPRESSIONS.items() for t in _subtrees(e)})


@query(f"""WITH {_WORDS}, sub AS (SELECT * FROM (VALUES {_values(_TEXTS)}) t(classname, text)), n AS (SELECT classname, count(*) AS n FROM words GROUP BY classname)
SELECT text, count(*) AS n_classes, sum(n)::BIGINT AS n_words FROM sub JOIN n USING (classname) GROUP BY text""")
def gr_sub_expressions(spark, sf_dir):
    """Every expression that words of conversations hold, whole or inside another: by how many
    classes, and by how many words."""
    nodes = spark.createDataFrame(source.node_rows(source.EXPRESSIONS), source.NODES)
    texts = relevance.canonical(cut(nodes)).select("classname", "key", "text").distinct()
    n = _words(spark, sf_dir).groupBy("classname").agg(F.count(F.lit(1)).alias("n"))
    return texts.join(n, "classname").groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_words")).drop("key")


# --- parses ---


def parsable(spark: SparkSession, sf_dir: str, cutoff: float = CUTOFF) -> DataFrame:
    """The clauses that power pruning leaves, in the form in which parses are counted."""
    kinds = _kinds(spark, sf_dir)
    return cut(kinds.spread(_parsable(kinds, cutoff)))


def _parsable(kinds: sentences.Kinds, cutoff: float = CUTOFF) -> DataFrame:
    """As parsable(), with kind in place of keys."""
    g = source.grammar(kinds.each.sparkSession)
    c = cut(power.pruned(cut(_made(kinds, g, cutoff)), KIND, g, cross=True))
    c = c.withColumn("disjunct", F.array_join("connectors", " & ")).withColumn("c", parsed(F.col("disjunct")))
    side = lambda s: F.filter("c", lambda x: x["dir"] == s)
    return grown(c.select(*KIND, "w", "last", "classname", "d", "disjunct", "cost", side("-").alias("left"), side("+").alias("right")))


@query()
def gr_parse_counts(spark, sf_dir):
    """How many linkages of all their words the sentences of conversations have."""
    kinds = _kinds(spark, sf_dir)
    return kinds.spread(parsing.parse_counts(_parsable(kinds), KIND))


def _best(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The best linkages of each sentence."""
    kinds = _kinds(spark, sf_dir)
    return kinds.spread(cut(parsing.linkages(_parsable(kinds), KIND, most)))


@query()
def gr_best(spark, sf_dir):
    """The three best linkages of each sentence: cost, length and links."""
    best = _best(spark, sf_dir, 3)
    links = F.array_join(F.transform("links", lambda x: F.concat_ws("-", x["lw"].cast("string"), x["name"], x["rw"].cast("string"))), " ")
    return best.select(*KEYS, "rank", "cost", "length", links.alias("links"))


@query()
def gr_shown(spark, sf_dir):
    """The best linkage of each sentence, its links from left to right, and the connectors that
    it uses at each word."""
    best = _best(spark, sf_dir, 1)
    k = F.concat_ws("/", *(F.col(c).cast("string") for c in KEYS)).alias("k")
    links = cut(best.select(k, "rank", F.posexplode("links").alias("i", "x")).select("k", "rank", "i", "x.*"))
    row = F.concat_ws(":", F.col("w").cast("string"), "disjunct")
    used = linkages.word_disjuncts(links).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", row.alias("t")))), lambda x: x["t"]), "; ").alias("used"))
    return linkages.displayed(links).drop("rank").join(used, "k")


@query()
def gr_phrases(spark, sf_dir):
    """The constituents of the best linkage of each sentence of conversations, drawn in three
    styles: on one line, with labels at both ends, and on a line each."""
    best = _best(spark, sf_dir, 1)
    k = F.concat_ws("/", *(F.col(c).cast("string") for c in KEYS)).alias("k")
    links = cut(best.select(k, "rank", F.posexplode("links").alias("i", "x")).select("k", "rank", "i", "x.*"))
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    words = sentences.tokens(sentences.sentences(texts, KEYS[:2]), KEYS).select(k, "w", "word")
    words = cut(words.join(links.select("k").distinct(), "k", "left_semi"))
    return constituents.drawn(constituents.constituents(links, words), words).drop("rank")


@query()
def gr_forest(spark, sf_dir):
    """The packed forest of each sentence of conversations: its nodes and choices, the linkages
    that it stands for, and the clauses that any of them uses."""
    kinds = _kinds(spark, sf_dir)
    f = forest.forest(_parsable(kinds), KIND)
    n = f.choices.groupBy(*KIND).agg(F.countDistinct("node").alias("n_nodes"), F.count(F.lit(1)).alias("n_choices"), F.countDistinct("w", "d").alias("n_clauses"))
    return kinds.spread(n.join(f.roots.select(*KIND, F.col("all").cast("long").alias("n_parses")), KIND))


@query()
def gr_drawn(spark, sf_dir):
    """Three linkages of each sentence of conversations, drawn by exp(-cost)."""
    kinds = _kinds(spark, sf_dir)
    f = forest.forest(_parsable(kinds), KIND, 1.0)
    # each sentence draws from its kind's forest, by a hash of its own keys
    own = forest.Forest(KEYS, cut(kinds.spread(f.roots)), grown(kinds.spread(f.choices)), f.longest)
    rows = forest.drawn(own, 3, 1)
    links = F.array_join(F.transform("links", lambda x: F.concat_ws("-", x["lw"].cast("string"), x["name"], x["rw"].cast("string"))), " ")
    return rows.select(*KEYS, "draw", "cost", links.alias("links"))


# --- word graphs ---

_Q = lambda p: "'" + p.replace("'", "''") + "'"
_PLAIN = f"NOT regexp_matches(token, {_Q(wordgraph.LEFT)}) AND NOT regexp_matches(token, {_Q(wordgraph.RIGHT)}) AND NOT regexp_matches(token, {_Q(wordgraph.UNIT)})"
_X = lambda p, i: f"regexp_extract(token, {_Q(p)}, {i})"
_STRIP = f"""CASE WHEN regexp_matches(token, {_Q(wordgraph.LEFT)}) THEN list_append(regexp_extract_all({_X(wordgraph.LEFT, 1)}, '.'), {_X(wordgraph.LEFT, 2)})
  WHEN regexp_matches(token, {_Q(wordgraph.RIGHT)}) THEN list_prepend({_X(wordgraph.RIGHT, 1)}, regexp_extract_all({_X(wordgraph.RIGHT, 2)}, '.')) ELSE [{_X(wordgraph.UNIT, 1)}, {_X(wordgraph.UNIT, 2)}] END"""
_ALTS = lambda source_: f"""SELECT token, {_STRIP} AS parts FROM {source_} WHERE NOT ({_PLAIN})
UNION ALL SELECT token, regexp_extract_all(token, {_Q(wordgraph.PIECES)}) FROM {source_} WHERE {_PLAIN} AND regexp_matches(token, {_Q(wordgraph.MIDDLE)})
UNION ALL SELECT token, [lower(token)] FROM {source_} WHERE {_PLAIN} AND NOT regexp_matches(token, {_Q(wordgraph.MIDDLE)}) AND lower(token) <> token
UNION ALL SELECT token, [{_X(wordgraph.SUFFIX, 1)}, '=' || {_X(wordgraph.SUFFIX, 2)}] FROM {source_} WHERE {_PLAIN} AND regexp_matches(token, {_Q(wordgraph.SUFFIX)}) AND {_X(wordgraph.SUFFIX, 1)} IN (SELECT token FROM types)"""  # noqa: E731


def _up(n: int) -> str:
    """One more level of alternatives, all of them counted anew from the level before."""
    return f"""g{n}p AS (SELECT alt, sum(slots) AS slots, sum(words) AS words, sum(edges + coalesce(tails * nxt, 0)) AS edges, arg_min(heads, i) AS heads, arg_max(tails, i) AS tails
  FROM (SELECT alt, i, g.*, lead(heads) OVER (PARTITION BY alt ORDER BY i) AS nxt FROM items JOIN g{n - 1} g ON part = g.token) GROUP BY alt),
g{n} AS MATERIALIZED (SELECT t.token, greatest(coalesce(max(slots), 1), 1) AS slots, coalesce(sum(words), 0) + any_value(w) AS words, coalesce(sum(edges), 0) AS edges, coalesce(sum(heads), 0) + any_value(w) AS heads, coalesce(sum(tails), 0) + any_value(w) AS tails
  FROM all_ t LEFT JOIN alts a ON a.token = t.token LEFT JOIN g{n}p p ON p.alt = a.alt GROUP BY t.token)"""


@query(f"""WITH RECURSIVE toks AS (SELECT doc_id, token, i FROM (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS ts FROM documents))),
types AS MATERIALIZED (SELECT DISTINCT token FROM toks),
seen(token) AS (SELECT token FROM types UNION SELECT unnest(parts) FROM ({_ALTS("seen")})),
all_ AS MATERIALIZED (SELECT token, CASE WHEN {_PLAIN} THEN 1 ELSE 0 END AS w FROM seen),
alts AS MATERIALIZED (SELECT row_number() OVER () AS alt, token, parts FROM ({_ALTS("all_")})),
items AS MATERIALIZED (SELECT alt, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM alts),
g0 AS (SELECT token, 1 AS slots, w AS words, 0 AS edges, w AS heads, w AS tails FROM all_),
{", ".join(_up(n) for n in range(1, 11))}
SELECT doc_id, count(*) AS tokens, sum(slots)::BIGINT AS slots, sum(words)::BIGINT AS words, sum(edges + coalesce(tails * nxt, 0))::BIGINT AS edges
FROM (SELECT doc_id, g10.*, lead(heads) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM toks JOIN g10 USING (token)) GROUP BY doc_id""")
def gr_word_graphs(spark, sf_dir):
    """The word graph of each document: its tokens, slots on the longest path, words and edges."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return wordgraph.graphs(docs, ["doc_id"])


@query("""WITH runs AS (SELECT doc_id, unnest(r) AS t, generate_subscripts(r, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20\\x09-\\x0D]+|[^\\x20\\x09-\\x0D]+') AS r FROM documents)),
places AS (SELECT doc_id, t, coalesce(sum(length(t)) OVER b, 0) AS a, coalesce(sum(strlen(t)) OVER b, 0) AS ab FROM runs WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, count(*) AS n, min(a)::BIGINT AS first, max(a + length(t))::BIGINT AS stop, max(ab + strlen(t))::BIGINT AS stop_byte, sum(a)::BIGINT AS starts, sum(ab)::BIGINT AS start_bytes,
  count(*) FILTER (strlen(t) > length(t)) AS wide FROM places WHERE NOT regexp_matches(t, '^[\\x20\\x09-\\x0D]') GROUP BY doc_id""")
def gr_positions(spark, sf_dir):
    """Where the tokens of each document stand in its whole text, in code points and bytes: the
    first and last places, and sums over all of them."""
    t = wordforms.positions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    wide = F.count(F.when(F.octet_length("token") > F.length("token"), 1))
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("stop").alias("stop"), F.max("stop_byte").alias("stop_byte"), F.sum("start").alias("starts"), F.sum("start_byte").alias("start_bytes"), wide.alias("wide")
    )


@query(f"""WITH RECURSIVE types AS MATERIALIZED (SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents) WHERE token <> ''),
seen(token) AS (SELECT token FROM types UNION SELECT unnest(parts) FROM ({_ALTS("seen")})),
all_ AS MATERIALIZED (SELECT token FROM seen WHERE {_PLAIN}),
alts AS MATERIALIZED (SELECT DISTINCT token, parts FROM ({_ALTS("seen")})),
walk(root, token, steps) AS (SELECT token, token, 1 FROM types UNION ALL SELECT root, unnest(parts), steps + 2 FROM walk JOIN alts USING (token))
SELECT root AS token, count(*) AS words, count(DISTINCT token) AS different, max(steps)::INTEGER AS deepest, sum(steps)::BIGINT AS steps FROM walk JOIN all_ USING (token) GROUP BY root""")
def gr_addresses(spark, sf_dir):
    """The words in the graph of each different token of documents, how many differ, and how far
    in they stand: steps are choices of an alternative or a part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    types = cut(wordgraph.tokens(docs, ["doc_id"]).select("token").distinct())
    words = paths.addressed(wordgraph.issued(types, types.select(F.col("token").alias("word"))), types)
    n = F.size("address")
    return words.groupBy(F.col("root").alias("token")).agg(F.count(F.lit(1)).alias("words"), F.countDistinct("word").alias("different"), F.max(n).alias("deepest"), F.sum(n.cast("long")).alias("steps"))
