"""Constituents against plain loops on random linkages and spans, and drawings by the letter."""

import random

import pytest

from weftline.operators import constituents as cs

LINK = "k int, rank int, i int, lw int, rw int, name string"
WORDS = "k int, w int, word string"
SPAN = "k int, rank int, label string, lw int, rw int"


def link_rows(k, rank, *ends):
    return [(k, rank, i, a, b, n) for i, (a, n, b) in enumerate(ends)]


def reach(edges, word, not_i, not_word):
    seen, todo = {word}, [word]
    while todo:
        at = todo.pop()
        for i, a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x == at and i != not_i and y != not_word and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return seen


def kind(name):
    return "".join(c for c in name if c.isupper())


def opened_by_the_letter(links):
    edges = [(i, a, b) for _, _, i, a, b, _ in links]
    taken = [(i, a, b) for _, _, i, a, b, n in links if kind(n) in cs.TAKEN]
    out = set()
    for _, _, i, a, b, n in links:
        for by, side, label in cs.OPENS:
            if by == kind(n):
                inside = [w for w in reach(edges, b, i, a) if w > a]
                if side == "left":
                    inside += [w for w in reach(taken, a, i, b) if w > 0]
                out.add((label, min(inside), max(inside), by))
    return out


def rests_by_the_letter(spans):
    out = set()
    for label, a, b, by in spans:
        for part, start, holder, rest in cs.RESTS:
            if (part, start) == (label, by):
                held = [(r - l, 0, l, a - 1) for h, l, r, _ in spans if h == holder and r == b and l < a]
                held += [(r - l, 1, b + 1, r) for h, l, r, _ in spans if h == holder and l == a and r > b]
                if held:
                    out.add((rest, *min(held)[2:]))
    return out


def nested_by_the_letter(spans, marks):
    spans = {s for s in spans if s[1] <= s[2]}
    while True:
        met = [(x, y) for x in spans for y in spans if x[1] < y[1] <= x[2] < y[2]]
        if not met:
            return spans
        less = {y for _, y in met if y[2] in marks}
        to = {}
        for x, y in met:
            if y[2] not in marks:
                to[x] = min(to.get(x, y[1]), y[1])
        new = {(s[0], to.get(s, s[1]), s[2] - (s in less)) for s in spans}
        spans = {s for s in new if s[1] <= s[2]}


def planar(rng, k, n):
    """Links of a random planar linkage of n words and a wall, each joined to another."""
    ends, names = set(), ["Wd", "Ss", "Os", "Js", "M", "MV", "Ds", "X"]
    for _ in range(4 * n):
        a, b = sorted(rng.sample(range(n + 1), 2))
        if not any(a < c < b < d or c < a < d < b for c, d in ends):
            ends.add((a, b))
    return [(k, 1, i, a, b, "Wd" if a == 0 else rng.choice(names[1:])) for i, (a, b) in enumerate(sorted(ends))]


def test_random_linkages(spark):
    rng = random.Random(5)
    links, words = {}, []
    for k in range(60):
        n = rng.randint(1, 9)
        links[k] = planar(rng, k, n)
        words += [(k, w, rng.choice(["dog", "saw", ",", "the"]) if w else "wall") for w in range(n + 1)]
    df = spark.createDataFrame([r for rows in links.values() for r in rows], LINK)
    found = cs.opened(df)
    got, left_over, final = {}, {}, {}
    for r in found.collect():
        got.setdefault(r["k"], set()).add((r["label"], r["lw"], r["rw"], r["by"]))
    for r in cs.rests(found).collect():
        left_over.setdefault(r["k"], set()).add((r["label"], r["lw"], r["rw"]))
    # repeated links change nothing
    for r in cs.constituents(df.unionByName(df), spark.createDataFrame(words, WORDS)).collect():
        final.setdefault(r["k"], set()).add((r["label"], r["lw"], r["rw"]))
    assert any(left_over.values())
    for k, rows in links.items():
        spans = opened_by_the_letter(rows)
        assert got.get(k, set()) == spans
        assert left_over.get(k, set()) == rests_by_the_letter(spans)
        marks = {w for j, w, t in words if j == k and t == ","}
        assert final.get(k, set()) == nested_by_the_letter({s[:3] for s in spans} | rests_by_the_letter(spans), marks)


def test_repair(spark):
    """Random spans, many of which cross, become nested ones, in the same turns as by loops."""
    rng = random.Random(8)
    spans, marks = {}, []
    for k in range(80):
        spans[k] = {(rng.choice(cs.ORDER), *sorted((rng.randint(1, 9), rng.randint(1, 9)))) for _ in range(rng.randint(1, 7))}
        marks += [(k, w, ",") for w in range(1, 10) if rng.random() < 0.2]
    df = spark.createDataFrame([(k, 1, *s) for k, some in spans.items() for s in some], SPAN)
    got = {}
    for r in cs.nested(df, spark.createDataFrame(marks, WORDS)).collect():
        got.setdefault(r["k"], set()).add((r["label"], r["lw"], r["rw"]))
    crossed = 0
    for k, some in spans.items():
        want = nested_by_the_letter(some, {w for j, w, _ in marks if j == k})
        assert got.get(k, set()) == want
        crossed += want != some
    assert crossed > 20


def test_drawn(spark):
    links = link_rows(1, 1, (0, "Wd", 2), (1, "Ds", 2), (2, "Ss", 3), (3, "Os", 5), (4, "Ds", 5), (5, "M", 6), (6, "Js", 8), (7, "Ds", 8))
    links += link_rows(2, 1, (0, "Wd", 1), (1, "Ss", 2))
    texts = {1: "wall the dog saw a man in the park", 2: "wall it rains often"}
    words = spark.createDataFrame([(k, w, t) for k, text in texts.items() for w, t in enumerate(text.split())], WORDS)
    df = spark.createDataFrame(links, LINK)
    out = {r["k"]: r for r in cs.drawn(cs.constituents(df, words), words).collect()}
    assert out[1]["line"] == "(S (NP the dog) (VP saw (NP (NP a man) (PP in (NP the park)))))"
    assert out[1]["flat"] == "[S [NP the dog NP] [VP saw [NP [NP a man NP] [PP in [NP the park NP] PP] NP] VP] S]"
    assert out[1]["lines"] == "(S\n  (NP the dog)\n  (VP saw\n    (NP\n      (NP a man)\n      (PP in\n        (NP the park)))))"
    assert (out[1]["n"], out[1]["depth"]) == (7, 5)
    assert out[2]["line"] == "(S (NP it) (VP rains)) often" and out[2]["depth"] == 2


@pytest.mark.parametrize("rows", [[], [(1, 1, 0, 1, 2, "X")], [(None, 1, 0, 0, 1, "Wd"), (1, 1, 0, 1, 2, None)]])
def test_nothing_opens(spark, rows):
    words = spark.createDataFrame([(1, 1, "a"), (1, 2, None)], WORDS)
    spans = cs.constituents(spark.createDataFrame(rows, LINK), words)
    assert spans.count() == 0 and cs.drawn(spans, words).count() == 0
