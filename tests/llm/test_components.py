"""Components of links, and how many pairs are compared to find them."""

import numpy as np
import pytest

from weftline.llm import components, jaccard


def roots_of(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in links:
        a, b = sorted((top(x), top(y)))
        up[b] = a
    return {x: top(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "path", "star", "clique", "loops", "none"])
def test_components_read_links_about_once(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    links = {
        "random": [tuple(map(int, p)) for p in rng.integers(0, 300, (250, 2))],
        "path": [(i, i + 1) for i in range(100)],
        "star": [(50, i) for i in range(100)],
        "clique": [(i, j) for i in range(30) for j in range(30)],
        "loops": [(7, 7), (8, 7), (9, 9)],
        "none": [],
    }[kind]
    edges, kept = [], components.materialised

    def counted(df, name):
        out = kept(df, name)
        if name == "edges":
            edges.append(out.count())
        return out

    monkeypatch.setattr(components, "materialised", counted)
    got = components.components(spark.createDataFrame(links, "x long, y long")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == roots_of(links)
    assert edges[0] == len({tuple(sorted(p)) for p in links if p[0] != p[1]})
    assert sum(edges) <= 2 * edges[0] and edges[-1] == 0


def test_groups_meet_by_their_nearest(spark):
    """Of a node and another component the pair of the nearest sketches; later only components that are still two."""
    rows = [(1, 10, 5, 5, 1, 2, 9), (1, 11, 5, 6, 1, 2, 4), (1, 12, 5, 5, 1, 3, 7), (4, 10, 5, 5, 4, 2, 9)]
    pairs = spark.createDataFrame(rows, "x long, y long, nx int, ny int, rootx long, rooty long, bits int")
    assert {tuple(r) for r in jaccard._nearest(pairs).collect()} == {(1, 11), (1, 12), (4, 10)}
    roots = spark.createDataFrame([(1, 1), (2, 1), (10, 1), (11, 1)], "node long, root long")
    assert {tuple(r) for r in jaccard._apart(pairs, roots).collect()} == {(1, 12), (4, 10)}
