"""The packed forest against all linkages of small grammars."""

from collections import Counter
from math import exp

import pytest

from weftline.operators import forest, parsing

ANY = [("LEFT-WALL", "@ANY+", 0.0), ("any", "@ANY- & @ANY+", 0.0), ("any", "@ANY-", 0.5), ("any", "@ANY+", 0.25)]
NULLS = [("LEFT-WALL", "W+", 0.0), ("a", "W-", 0.0), ("a", "W- & X+", 0.5), ("b", "X-", 0.0)]


def clauses(spark, rows, words):
    c = spark.createDataFrame(rows, "classname string, disjunct string, cost double")
    made = [(k, i, x) for k, ws in words for i, x in enumerate(["LEFT-WALL", *ws])]
    df = spark.createDataFrame(made, "k int, w int, classname string")
    return parsing.pruned(parsing.sentence_clauses(df, ["k"], c), ["k"])


@pytest.fixture(scope="module")
def any_clauses(spark):
    return clauses(spark, ANY, [(n, ["any"] * n) for n in (1, 2, 3, 4)]).cache()


def every(c, max_null=0):
    """k to its linkages: links, clauses, cost."""
    out = {}
    for r in parsing.linkages(c, ["k"], 10_000, max_null).collect():
        out.setdefault(r["k"], []).append((tuple((x["lw"], x["rw"], x["name"]) for x in r["links"]), tuple((x["w"], x["d"]) for x in r["clauses"]), r["cost"]))
    return out


def seen(rows):
    return [(r["k"], (tuple((x["lw"], x["rw"], x["name"]) for x in r["links"]), tuple((x["w"], x["d"]) for x in r["clauses"]), r["cost"])) for r in rows]


def test_counts(any_clauses):
    """The weight of a root is the number of its linkages; a node's weight is its choices'."""
    f = forest.forest(any_clauses, ["k"])
    assert {r["k"]: r["all"] for r in f.roots.collect()} == {1: 1, 2: 4, 3: 23, 4: 156}
    inner = {(r["k"], r["node"]): r["all"] for r in f.choices.collect()}
    for r in f.choices.collect():
        want = 1.0
        for kid in r["kids"]:
            want *= inner[r["k"], kid]
        assert r["weight"] == want
    # what the forest shares: fewer choices than linkages have, taken one by one
    assert sum(1 for r in f.choices.collect() if r["k"] == 4) < 156 * 9


@pytest.mark.parametrize("beta", [0.0, 1.5])
def test_rates(any_clauses, beta):
    """Every linkage is drawn at its share of the weight; nothing else is drawn."""
    n = 20_000
    c = any_clauses.where("k in (2, 3)")
    all_ = every(c)
    got = Counter(seen(forest.drawn(forest.forest(c, ["k"], beta), n, 7).collect()))
    for k, rows in all_.items():
        total = sum(exp(-beta * x[2]) for x in rows)
        assert {x for kk, x in got if kk == k} <= set(rows)
        chi = 0.0
        for x in rows:
            want = n * exp(-beta * x[2]) / total
            chi += (got[k, x] - want) ** 2 / want
        # mean and deviation of chi square: far beyond chance
        free = len(rows) - 1
        assert chi < free + 5 * (2 * free) ** 0.5, (k, chi, free)


def test_same_on_other_partitions(any_clauses, spark):
    any_clauses = any_clauses.where("k < 4")
    draws = lambda f, seed: sorted(map(repr, seen(forest.drawn(f, 20, seed).collect())))
    f = forest.forest(any_clauses.coalesce(1), ["k"])
    one = draws(f, 3)
    assert one == draws(forest.forest(any_clauses.repartition(7), ["k"]), 3) and len(one) == 60
    assert one != draws(f, 4)


def test_shares_and_used(any_clauses):
    """Shares of links, and used clauses, are those of all linkages one by one."""
    any_clauses = any_clauses.where("k < 4")
    all_ = every(any_clauses)
    for beta in (0.0, 2.0):
        f = forest.forest(any_clauses, ["k"], beta)
        got = {(r["k"], r["lw"], r["rw"], r["name"]): r["share"] for r in forest.shares(f).collect()}
        want = Counter()
        for k, rows in all_.items():
            total = sum(exp(-beta * x[2]) for x in rows)
            for x in rows:
                for link in x[0]:
                    want[(k, *link)] += exp(-beta * x[2]) / total
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        assert {tuple(r) for r in forest.used_clauses(f).collect()} == {(k, w, d) for k, rows in all_.items() for x in rows for w, d in x[1]}


def test_null_words(spark):
    """As few unlinked words as allow a linkage; sentences without one are not there."""
    c = clauses(spark, NULLS, [(1, "a"), (2, "ab"), (3, "ba"), (4, "bab"), (5, "b"), (6, "aa")])
    all_ = every(c, 2)
    f = forest.forest(c, ["k"], max_null=2)
    assert {r["k"]: r["all"] for r in f.roots.collect()} == {k: len(v) for k, v in all_.items()}
    got = forest.drawn(f, 40, 1)
    rows = seen(got.collect())
    assert {(k, x) for k, x in rows} == {(k, x) for k, v in all_.items() for x in v}
    nulls = {r["k"]: r["nulls"] for r in parsing.parse_counts(c, ["k"], 2).collect()}
    assert {r["k"]: r["nulls"] for r in got.collect()} == nulls


def test_empty(any_clauses):
    f = forest.forest(any_clauses.limit(0), ["k"])
    assert not f.choices.count() and not forest.drawn(f, 3, 1).count() and not forest.shares(f).count() and not forest.used_clauses(f).count()
    assert not forest.drawn(forest.forest(any_clauses.where("k = 1"), ["k"]), 0, 1).count()
