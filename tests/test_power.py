"""Power pruning keeps every clause that a linkage uses, by trying all linkages of short sentences."""

import random
from itertools import combinations, product

from pyspark.sql import functions as F

from weftline.operators import power, trees
from weftline.sources import trees as source
from weftline.treecatalogue import numbered

KEYS = ["k"]


def assignments(neighbours, connectors):
    """All ways to give neighbours, near to far, to connectors in order, each at least one, those
    with @ any number."""
    if not connectors:
        return [[]] if not neighbours else []
    out = []
    for n in range(1, (len(neighbours) if connectors[0][0] == "@" else 1) + 1):
        if n <= len(neighbours):
            out += [[(v, connectors[0]) for v in neighbours[:n]] + rest for rest in assignments(neighbours[n:], connectors[1:])]
    return out


def linked(clauses, matching, reach):
    """Whether one clause for each word can be linked: planar, connected, every connector used."""
    n = len(clauses)
    for size in range(n - 1, n * (n - 1) // 2 + 1):
        for pairs in combinations([(a, b) for a in range(n) for b in range(a + 1, n)], size):
            if any(a < c < b < d for a, b in pairs for c, d in pairs):
                continue
            reached = {0}
            for _ in range(n):
                reached |= {y for p in pairs for y in p if set(p) & reached}
            if len(reached) < n:
                continue
            sides = []
            for w, cons in enumerate(clauses):
                left = [c for c in cons if c.endswith("-")]
                right = [c for c in cons if c.endswith("+")]
                sides.append(assignments(sorted((a for a, b in pairs if b == w), reverse=True), left))
                sides.append(assignments(sorted(b for a, b in pairs if a == w), right))
            for choice in product(*sides):
                to_left = {(v, w): c for w in range(n) for v, c in choice[2 * w]}
                to_right = {(w, v): c for w in range(n) for v, c in choice[2 * w + 1]}
                if all((to_right[p].lstrip("@"), to_left[p].lstrip("@")) in matching and p[1] - p[0] <= reach.get(to_right[p].lstrip("@")[0], 99) for p in pairs):
                    return True
    return False


def test_no_clause_of_a_linkage_goes(spark):
    rng = random.Random(11)
    con = lambda: source.con(rng.choice(["", "", "@"]) + rng.choice("ABC") + rng.choice("+-"))
    expressions, sentences = {}, []
    for i in range(5):
        expressions[f"c{i}"] = source.one_of(*(source.all_of(*(con() for _ in range(rng.randint(1, 3)))) for _ in range(4)))
    sentences = [[rng.choice(sorted(expressions)) for _ in range(rng.randint(2, 4))] for _ in range(40)]
    reach = {"A": 2}
    g = source.grammar(spark, spark.createDataFrame(source.node_rows(expressions), source.NODES), reach)
    words = spark.createDataFrame([(k, w, c) for k, s in enumerate(sentences) for w, c in enumerate(s)], "k int, w int, classname string")
    last = words.groupBy("k").agg(F.max("w").alias("last"))
    made = numbered(trees.whole(words, g), last, KEYS, g, 9.0)
    rows = made.collect()
    left = {(r["k"], r["w"], tuple(r["connectors"])) for r in power.pruned(made, KEYS, g).collect()}
    crossed = {(r["k"], r["w"], tuple(r["connectors"])) for r in power.pruned(made, KEYS, g, cross=True).collect()}
    matching, by_word = set(source.matching_names(expressions)), {}
    for r in rows:
        by_word.setdefault((r["k"], r["w"]), []).append(tuple(r["connectors"]))
    used = set()
    for k, s in enumerate(sentences):
        for choice in product(*(by_word.get((k, w), []) for w in range(len(s)))):
            if linked(choice, matching, reach):
                used |= {(k, w, c) for w, c in enumerate(choice)}
    assert used and used <= crossed <= left, (used - crossed, crossed - left)
    assert len(left) < 0.8 * sum(map(len, by_word.values())), (len(left), len(used), sum(map(len, by_word.values())))


def test_rows_are_dealt_once(spark):
    """Half turns and crossed links shuffle by the sentence alone: what follows joins and windows where the rows lie."""
    import re

    g = source.grammar(spark)
    clauses = spark.createDataFrame([(0, 0, 1, 0, ["Wd+"]), (0, 1, 1, 0, ["Wd-"])], "k int, w int, last int, d int, connectors array<string>")
    rows = power.half_turn(power.half_turn(power.bounded(clauses, KEYS, g), KEYS, g, "-"), KEYS, g, "+")
    plan = power.crossed(rows, KEYS)._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    own = [x for x in by if re.search(r"\bk#", x)]  # others deal the dictionary's rows
    assert own and all(re.fullmatch(r"k#\d+, \d+", x) for x in own), by
    assert "SortMergeJoin" in plan


def test_half_turns_are_made_once(spark):
    """The second half turn reads what the first one wrote: no half turn is worked out anew for each of its three reads."""
    from weftline.plans.lineage import cut

    g = source.grammar(spark)
    rows = [(0, 0, 2, 0, ["Wd+"]), (0, 1, 2, 0, ["Ds+"]), (0, 1, 2, 1, ["Wd-", "Ss+"]), (0, 2, 2, 0, ["Ds-", "Wd-"]), (0, 2, 2, 1, ["S*-"])]
    start = cut(power.bounded(spark.createDataFrame(rows, "k int, w int, last int, d int, connectors array<string>"), KEYS, g))
    nested = power.half_turn(power.half_turn(start, KEYS, g, "-"), KEYS, g, "+")
    turned = power.turned(start, KEYS, g)
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, turned.collect())) != []
    reads = lambda df: df._jdf.queryExecution().analyzed().toString().count("Relation [k")
    assert reads(turned) <= 3 < reads(nested)


def test_sentences_go_between_half_turns(spark):
    """Of a sentence that the half turn to the left leaves a word of without a clause no row meets the one to the right."""
    g = source.grammar(spark)
    made = [(0, 0, 1, 0, ["Wd+"]), (0, 1, 1, 0, ["Wd-"]), (1, 0, 2, 0, ["Wd+"]), (1, 1, 2, 0, ["Wd-"]), (1, 2, 2, 0, ["Os-"])]
    clauses = spark.createDataFrame(made, "k int, w int, last int, d int, connectors array<string>")
    rows = power.bounded(clauses, KEYS, g)
    last = clauses.select("k", "last").distinct()
    assert {r["k"] for r in power.turned(rows, KEYS, g).collect()} == {0, 1}
    assert {r["k"] for r in power.turned(rows, KEYS, g, last=last).collect()} == {0}
    assert {r["k"] for r in power.turned(rows, KEYS, g, 1, last).collect()} == {0, 1}
    assert sorted((r["k"], r["w"]) for r in power.pruned(clauses, KEYS, g).collect()) == [(0, 0), (0, 1)]
