"""Relevance of rules and containment of expressions against plain loops."""

import random
import re

from pyspark.sql import functions as F

from weftline.operators import relevance
from weftline.sources import trees


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return trees.con(rng.choice(["A+", "B-", "@C+"]), rng.choice([0.0, 0.5]))
    make = rng.choice([trees.all_of, trees.one_of])
    return make(*(tree(rng, depth - 1) for _ in range(rng.randrange(3))), cost=rng.choice([0.0, 0.0, 1.25]))


def holds(e, part):
    return e == part or (e[0] != "con" and any(holds(x, part) for x in e[1]))


def test_containment(spark):
    rng = random.Random(5)
    large, small = {f"l{i}": tree(rng, 4) for i in range(20)}, {f"s{i}": tree(rng, 2) for i in range(20)}
    nodes = lambda e: relevance.canonical(spark.createDataFrame(trees.node_rows(e), trees.NODES))
    a, b = nodes(large).cache(), nodes(small).cache()
    want = {(x, y) for x, e in large.items() for y, p in small.items() if holds(e, p)}
    assert {tuple(r) for r in relevance.held(a, b).collect()} == want and 0 < len(want) < 400
    assert {tuple(r) for r in relevance.held(a, a).collect()} >= {(x, x) for x in large}
    assert not nodes({}).count()


def fits(name, selector):
    return re.match(selector.replace("*", "[a-z*]") + "(?![A-Z_])", name) is not None


def test_rules(spark):
    rules = [(1, "S", "O"), (1, "S", "P"), (2, "Os", "Ss"), (3, "M", "J"), (4, "S*x", "A"), (5, "Z", "A")]
    linkages = [(1, 1, ["Ss", "Os"]), (1, 2, ["Ss"]), (1, 2, ["Ss"]), (2, 1, ["MV", "Sp"]), (3, 1, ["M", "Js"]), (4, 1, ["Sax", "A"]), (5, 1, [])]
    df = spark.createDataFrame([(k, r, [(0, 1, n) for n in ns]) for k, r, ns in linkages], "k int, rank int, links array<struct<lw:int,rw:int,name:string>>")
    r = spark.createDataFrame(rules, "rule int, selector string, wanted string")
    got = {x["rule"]: (x["n_relevant"], x["n_broken"]) for x in relevance.uses(df, ["k"], r).collect()}
    want, once = {}, {(k, rank): ns for k, rank, ns in linkages}
    for ns in once.values():
        for rule in {x[0] for x in rules}:
            own = [x for x in rules if x[0] == rule]
            if any(fits(n, x[1]) for n in ns for x in own):
                a, b = want.get(rule, (0, 0))
                want[rule] = (a + 1, b + (not any(fits(n, x[2]) for n in ns for x in own)))
    assert got == want and any(b for _, b in got.values())
    links = df.select("k", F.explode("links").alias("x")).select("k", F.col("x.name").alias("link"))
    assert {tuple(x) for x in relevance.relevant(links, ["k"], r).collect()} == {(k, x[0]) for k, _, ns in linkages for n in ns for x in rules if fits(n, x[1])}
    assert not relevance.relevant(links.limit(0), ["k"], r).count() and not relevance.uses(df, ["k"], r.limit(0)).count()
