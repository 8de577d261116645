"""Expression trees against plain recursive code on random grammars and sentences."""

import random

from pyspark.sql import functions as F

from weftline.operators import trees
from weftline.sources import trees as source

KEYS = ["k"]


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return source.con(rng.choice(["", "@"]) + rng.choice("ABC") + rng.choice(["", "s", "*", "t"]) + rng.choice("+-"), rng.choice([0.0, 0.5, 1.0]))
    make = rng.choice([source.all_of, source.one_of])
    inner = [random_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    return make(*inner, cost=rng.choice([0.0, 0.0, 0.5])) if rng.random() < 0.8 else source.maybe(make(*inner))


def random_grammar(seed):
    rng = random.Random(seed)
    return {f"c{i}": random_tree(rng, 3) for i in range(6)}, rng


class Plain:
    """One sentence's expressions as nested lists; passes as one would make them by hand."""

    def __init__(self, expressions, words, reach):
        rows = source.node_rows(expressions)
        self.nodes = {(r[0], r[1]): r for r in rows}
        self.kids = {}
        for r in rows:
            if r[2] is not None:
                self.kids.setdefault((r[0], r[2]), []).append(r[1])
        self.match = set(source.matching_names(expressions))
        self.words = dict(enumerate(words))
        self.live = {w: {n for (c, n), r in self.nodes.items() if c == name and r[5] == "con"} for w, name in self.words.items()}
        self.reach = reach

    def name(self, c, n):
        return self.nodes[c, n][6].lstrip("@")

    def alive(self, c, n, live):
        kind = self.nodes[c, n][5]
        if kind == "con":
            return n in live
        found = [self.alive(c, x, live) for x in self.kids.get((c, n), [])]
        return all(found) if kind == "and" else any(found)

    def purge(self, c, live):
        out = set()

        def down(n):
            if self.alive(c, n, live):
                if self.nodes[c, n][5] == "con":
                    out.add(n)
                for x in self.kids.get((c, n), []):
                    down(x)

        down(0)
        return out

    def one_pass(self, to, running):
        """running: what a word has left is what the next words meet; else all words at once."""
        order = sorted(self.live, reverse=to == "+")
        seen, before = [], {w: set(x) for w, x in self.live.items()}
        for w in order:
            c = self.words[w]
            kept = set()
            for n in self.live[w]:
                own = self.name(c, n)
                far = self.reach.get(own[0], source.FAR)
                fits = lambda a: (a, own) in self.match if to == "-" else (own, a) in self.match  # noqa: B023, E731
                if own[-1] != to or any(fits(a) and abs(w - v) <= far for v, a in seen):
                    kept.add(n)
            new = self.purge(c, kept)
            seen += [(w, self.name(c, n)) for n in (new if running else before[w])]
            self.live[w] = new
        self.live = {w: x for w, x in self.live.items() if x}

    def fixpoint(self):
        n = -1
        while n != sum(map(len, self.live.values())):
            n = sum(map(len, self.live.values()))
            self.one_pass("-", True)
            self.one_pass("+", True)
        return self.live

    def clauses(self, c, n, live):
        """(connectors, cost) of all clauses."""
        kind, text, cost = self.nodes[c, n][5:8]
        if kind == "con":
            return [((text,), cost)] if n in live else []
        parts = [self.clauses(c, x, live) for x in self.kids.get((c, n), [])]
        if kind == "or":
            return [(t, x + cost) for p in parts for t, x in p]
        out = [((), cost)]
        for p in parts:
            out = [(a + b, x + y) for a, x in out for b, y in p]
        return out


def made(spark, seeds, n=12, longest=9):
    """Several grammars side by side, and sentences of each."""
    expressions, sentences = {}, []
    for seed in seeds:
        own, rng = random_grammar(seed)
        own = {f"s{seed}{c}": e for c, e in own.items()}
        sentences += [[rng.choice(sorted(own)) for _ in range(rng.randint(1, longest))] for _ in range(n)]
        expressions |= own
    reach = {"A": 2}
    g = source.grammar(spark, spark.createDataFrame(source.node_rows(expressions), source.NODES), reach)
    words = spark.createDataFrame([(k, w, c) for k, s in enumerate(sentences) for w, c in enumerate(s)], "k int, w int, classname string")
    return expressions, sentences, reach, g, words


def lives(rows):
    out = {}
    for r in rows:
        out.setdefault(r["k"], {})[r["w"]] = set(r["live"])
    return out


def test_sweeps_and_fixpoint(spark):
    expressions, sentences, reach, g, words = made(spark, range(5))
    plain = [Plain(expressions, s, reach) for s in sentences]
    swept = trees.swept(trees.whole(words, g), KEYS, g, "-")
    for p in plain:
        p.one_pass("-", False)
    assert lives(swept.collect()) == {k: p.live for k, p in enumerate(plain) if p.live}
    swept = trees.swept(swept, KEYS, g, "+")
    for p in plain:
        p.one_pass("+", False)
    assert lives(swept.collect()) == {k: p.live for k, p in enumerate(plain) if p.live}
    want = {k: Plain(expressions, s, reach).fixpoint() for k, s in enumerate(sentences)}
    assert any(want.values()) and lives(trees.pruned(words, KEYS, g).collect()) == {k: x for k, x in want.items() if x}


def test_clauses_under_a_bound(spark):
    """Expansion with the bound gives what expansion without it leaves under it, and the count
    without expansion is that of all clauses; some connectors are gone."""
    expressions, sentences, reach, g, words = made(spark, range(5))
    p = Plain(expressions, [], reach)
    shapes = trees.whole(spark.createDataFrame([(c, 0, c) for c in expressions], "k string, w int, classname string"), g).select("classname", "live")
    fewer = trees.purged(shapes.withColumn("live", F.filter("live", lambda x: x % 4 != 1)), g)
    gone = shapes.withColumn("live", F.filter("live", lambda x: x % 3 != 1))  # not purged
    shapes = shapes.unionByName(fewer.select("classname", "live")).unionByName(gone).distinct()
    rows = shapes.collect()
    for cutoff in (0.5, 1.5, 99.0):
        got = sorted((r["classname"], tuple(r["live"]), tuple(r["connectors"]), r["cost"]) for r in trees.expanded(shapes, g, cutoff).collect())
        want = sorted((r["classname"], tuple(r["live"]), t, x) for r in rows for t, x in p.clauses(r["classname"], 0, set(r["live"])) if t and x <= cutoff)
        assert got == want
    counts = {(r["classname"], tuple(r["live"])): r["n"] for r in trees.clause_counts(shapes, g).collect()}
    assert counts == {(r["classname"], tuple(r["live"])): len(p.clauses(r["classname"], 0, set(r["live"]))) for r in rows}


def test_nothing_to_prune(spark):
    """Null classes and classes without an expression go; no words give no rows; a sentence's
    repeated word rows stay one."""
    g = source.grammar(spark)
    words = spark.createDataFrame([(1, 0, "LEFT-WALL"), (1, 1, None), (1, 2, "no such class")], "k int, w int, classname string")
    assert trees.pruned(words, KEYS, g).count() == 0
    assert trees.pruned(words.limit(0), KEYS, g).count() == 0


def test_written():
    assert source.written(source.EXPRESSIONS["prep"]) == "((MV- or [M-]0.125) & J*+)"
    assert source.written(source.maybe(source.con("@A-"))) == "{@A-}"
