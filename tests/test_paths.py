"""The path filter against reachability in the graph, edge by edge, on random nested graphs."""

import random

from weftline.operators import paths, wordgraph

ROWS = "token string, whole boolean, parts array<string>"


def random_rows(rng, n):
    """Tokens t0, t1, ...: each may stand, and has alternatives of tokens before it."""
    rows = {}
    for k in range(n):
        alts = {tuple(f"t{rng.randrange(k)}" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 2))} if k else set()
        rows[f"t{k}"] = (not alts or rng.random() < 0.6, sorted(alts))
    return rows


def graph(rows, token, address=()):
    """Words (address and token), edges, first and last words, by recursion."""
    whole, alts = rows[token]
    me = (*address, 0)
    words, edges = ({me: token} if whole else {}), set()
    heads, tails = ([me] if whole else []), ([me] if whole else [])
    for a, parts in enumerate(alts, 1):
        last = None
        for p, part in enumerate(parts):
            w, e, h, t = graph(rows, part, (*address, a, p))
            words |= w
            edges |= e
            edges |= {(x, y) for x in last or [] for y in h}
            heads += h if last is None else []
            last = t
        tails += last
    return words, edges, heads, tails


def on_one_path(edges, chosen):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            for y in after.get(todo.pop(), []):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return b in seen

    return all(reaches(a, b) or reaches(b, a) for a in chosen for b in chosen)


def test_random_graphs(spark):
    rng = random.Random(3)
    rows = random_rows(rng, 8)
    table = [(t, w, list(p)) for t, (w, alts) in rows.items() for p in alts] + [(t, w, None) for t, (w, alts) in rows.items() if not alts]
    df = spark.createDataFrame(table + table[:3], ROWS)
    types = spark.createDataFrame([(t,) for t in rows] * 2, "token string")
    got = {}
    for r in paths.addressed(df, types).collect():
        assert tuple(r["address"]) not in got.setdefault(r["root"], {})
        got[r["root"]][tuple(r["address"])] = r["word"]
    graphs = {t: graph(rows, t) for t in rows}
    assert got == {t: g[0] for t, g in graphs.items() if g[0]}
    flat = {r["token"]: r["words"] for r in wordgraph.flattened(spark.createDataFrame(table, ROWS)).collect()}
    assert {t: len(g[0]) for t, g in graphs.items()} == flat

    chosen, want = [], {}
    for k in range(400):
        want[k] = True
        for i in range(rng.randint(1, 3)):
            words, edges, _, _ = graphs[rng.choice(["t5", "t6", "t7"])]
            some = rng.sample(sorted(words), min(len(words), rng.randint(1, 3)))
            want[k] &= on_one_path(edges, some)
            chosen += [(k, i, list(a)) for a in some] + [(k, i, list(some[0]))] * (rng.random() < 0.2) + [(k, i, None)] * (rng.random() < 0.3)
    chosen.append((400, 0, None))
    want[400] = True
    out = {r["k"] for r in paths.sane(spark.createDataFrame(chosen, "k int, i int, address array<int>"), ["k"]).collect()}
    assert out == {k for k, ok in want.items() if ok}
    assert 40 < len(out) < 360


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    assert paths.addressed(none, none.select("token")).count() == 0
    assert paths.sane(spark.createDataFrame([], "k int, i int, address array<int>"), ["k"]).count() == 0
