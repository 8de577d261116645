"""Rules on links against plain loops."""

import random

from weftline.operators import rulepruning, trees
from weftline.sources import trees as source
from weftline.treecatalogue import numbered

KEYS = ["k"]
RULES = [(1, "A", "B"), (2, "B", "Cs"), (2, "B", "Ct"), (3, "C", "D")]


def test_rules_against_loops(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    con = lambda: source.con(rng.choice(["", "@"]) + rng.choice(["A", "B", "Cs", "Ct", "C*"]) + rng.choice("+-"))
    expressions = {f"c{i}": source.one_of(*(source.all_of(*(con() for _ in range(rng.randint(1, 2)))) for _ in range(3))) for i in range(5)}
    sentences = [[rng.choice(sorted(expressions)) for _ in range(rng.randint(1, 5))] for _ in range(60)]
    g = source.grammar(spark, spark.createDataFrame(source.node_rows(expressions), source.NODES), {})
    words = spark.createDataFrame([(k, w, c) for k, s in enumerate(sentences) for w, c in enumerate(s)], "k int, w int, classname string")
    made = numbered(trees.whole(words, g), words.groupBy("k").agg(F.max("w").alias("last")), KEYS, g, 9.0)
    rows = [(r["k"], r["w"], r["d"], tuple(c.lstrip("@") for c in r["connectors"])) for r in made.collect()]
    matching = source.matching_names(expressions)
    like = lambda link, x: link[0] == x[0] and (len(x) == 1 or link[1:] == x[1:])
    gives = {r: {(a, b) for a, b in matching if any(q == r and like(source.link_of(a, b), x) for q, _, x in RULES)} for r, _, _ in RULES}
    asks = lambda c: {r for r, s, _ in RULES if c[0] == s}

    def lacking(rows):
        out = set()
        for k in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == k]
            can = {r for r, pairs in gives.items() if any((a, b) in pairs for _, w, _, x in own for a in x for _, v, _, y in own if w < v for b in y)}
            out |= {(k, w, d, r) for _, w, d, x in own for c in x for r in asks(c) if r not in can}
        return out

    rules = spark.createDataFrame(RULES, rulepruning.RULE)
    got = {(r["k"], r["w"], r["d"], r["rule"]) for r in rulepruning.lacking(made, KEYS, g, rules).collect()}
    assert got and got == lacking(rows)
    left = rows
    while gone := {x[:3] for x in lacking(left)}:
        left = [r for r in left if r[:3] not in gone]
    assert {(r["k"], r["w"], r["d"]) for r in rulepruning.pruned(made, KEYS, g, rules).collect()} == {r[:3] for r in left}
