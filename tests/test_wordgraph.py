"""Word graphs against graphs built edge by edge."""

import re

from weftline.operators import wordgraph

TEXTS = [
    (1, 'He said: "(Walking-boots) cost 12kg, 3,5% more!" Reading read walked walk -x- A-B/c ... 5th'),
    (2, "boots boots-boots-boots walking Walkinged walkinged walk boot ''a'' ed reded read (((x"),
    (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "ÉTÉ-été été's 12% 12kg. kg"),
]


def alternatives(t, known):
    """Whether t is a word, and what it may be split into."""
    if m := re.search(wordgraph.LEFT, t):
        return False, [[*m[1], m[2]]]
    if m := re.search(wordgraph.RIGHT, t):
        return False, [[m[1], *m[2]]]
    if m := re.search(wordgraph.UNIT, t):
        return False, [list(m.groups())]
    out = []
    if re.search(wordgraph.MIDDLE, t):
        out.append(re.findall(wordgraph.PIECES, t))
    elif t.lower() != t:
        out.append([t.lower()])
    if (m := re.search(wordgraph.SUFFIX, t)) and m[1] in known:
        out.append([m[1], "=" + m[2]])
    return True, out


class Graph:
    """Nodes are numbers; every token adds its words between the ends of what stands before."""

    def __init__(self, known):
        self.known, self.nodes, self.edges, self.longest = known, 0, set(), {}

    def add(self, t, before):
        """Words that may end t, of those that may stand before it; -1 is the text's start."""
        whole, alts = alternatives(t, self.known)
        ends = []
        if whole:
            own = self.nodes
            self.nodes += 1
            self.longest[own] = 1 + max(self.longest.get(b, 0) for b in before)
            self.edges |= {(b, own) for b in before if b >= 0}
            ends.append(own)
        for parts in alts:
            at = before
            for p in parts:
                at = self.add(p, at)
            ends += at
        return ends


def test_graphs(spark):
    df = spark.createDataFrame(TEXTS, "k int, text string")
    known = {t for _, x in TEXTS for t in (x or "").split()}
    want = {}
    for k, x in TEXTS:
        g, at = Graph(known), [-1]
        for t in (x or "").split():
            at = g.add(t, at)
        if (x or "").split():
            want[k] = (len(x.split()), max(g.longest.values()), g.nodes, len(g.edges))
    got = {r["k"]: (r["tokens"], r["slots"], r["words"], r["edges"]) for r in wordgraph.graphs(df, ["k"]).collect()}
    assert got == want


def test_graphs_of_nothing(spark):
    assert wordgraph.graphs(spark.createDataFrame([], "k int, text string"), ["k"]).count() == 0


def test_bare_tokens_meet_no_table(spark):
    """Texts of bare tokens send none of them to the table of graphs; others tell their edges to both sides."""
    texts = [(0, "one two six"), (1, "Six one (Two) three-four six"), (2, "(a) (b)"), (3, "One"), (4, "x"), (5, "walk walking One")]
    got = {r["k"]: tuple(r)[1:] for r in wordgraph.graphs(spark.createDataFrame(texts, "k int, text string"), ["k"]).collect()}
    assert got[0] == (3, 3, 3, 2) and got[4] == (1, 1, 1, 0)
    types = spark.createDataFrame([(t,) for _, x in texts for t in x.split()], "token string").distinct()
    table = {r["token"]: r for r in wordgraph.flattened(wordgraph.issued(types, types.withColumnRenamed("token", "word"))).collect()}
    for k, x in texts:
        ts = [table[t] for t in x.split()]
        edges = sum(t["edges"] for t in ts) + sum(a["tails"] * b["heads"] for a, b in zip(ts, ts[1:]))
        assert got[k] == (len(ts), sum(t["slots"] for t in ts), sum(t["words"] for t in ts), edges), k
    bare = {r["token"] for r in types.where(wordgraph.bare()).collect()}
    assert {"one", "x", "walk"} <= bare and not {"One", "(a)", "walking", "three-four"} & bare
