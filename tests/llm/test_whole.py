"""Places where an operator once did less than its whole job."""

import numpy as np

from weftline.llm import lm, substrings

# --- 10 ---


def unlike(rng, n):
    return [f"f{x}" for x in rng.integers(0, 10**9, n)]


def test_passages_around_unlike_text(spark):
    """A header and a footer that two documents share around bodies of their own; long ones too."""
    rng = np.random.default_rng(4)
    rows, want, at = [], set(), 0
    for length, gap in ((60, 40), (60, 100), (60, 160), (200, 300), (51, 30)):
        head, foot = unlike(rng, length), unlike(rng, length)
        for i in (at, at + 1):
            rows.append((i, " ".join(unlike(rng, 7 * (i + 1)) + head + unlike(rng, gap) + foot + unlike(rng, 9))))
        want |= {(at + 1, 7 * (at + 2) + s, length, 7 * (at + 1) + s) for s in (0, length + gap)}
        at += 2
    got = substrings.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["length"], r["source_start"]) for r in got} == want and len(got) == len(want)
    assert all(r["identity"] == 1 for r in got)


def test_cut_chains_against_all_stretches():
    """Every anchor of any stretch that is long and like enough is in a stretch found."""
    rng = np.random.default_rng(6)
    found = 0
    for _ in range(150):
        x, y, anchors = [], [], []
        for _ in range(int(rng.integers(2, 7))):
            own = rng.integers(0, 10**6, int(rng.integers(8, 45))).tolist()
            anchors += [(len(x) + i, len(y) + i) for i in range(0, len(own) - substrings.K + 1, int(rng.integers(3, 12)))]
            x, y = x + own, y + own
            x, y = x + rng.integers(10**6, 10**8, int(rng.integers(1, 25))).tolist(), y + rng.integers(10**6, 10**8, int(rng.integers(1, 25))).tolist()
        got = substrings.aligned(np.array(x), np.array(y), anchors)
        like = lambda a, p, b, q, m: min(p - a, q - b) >= substrings.LEAST_WORDS and m >= substrings.LEAST_IDENTITY * max(p - a, q - b)
        assert all(like(*g) for g in got)
        for g in got:
            assert substrings.common(np.array(x[g[0] : g[1]]), np.array(y[g[2] : g[3]])) == g[4]
        found += len(got) > 1
        for i in range(len(anchors)):
            for j in range(i, len(anchors)):
                (u, v), (s, t) = anchors[i], anchors[j]
                a, b, p, q = u, v, s + substrings.K, t + substrings.K
                if like(a, p, b, q, substrings.common(np.array(x[a:p]), np.array(y[b:q]))):
                    assert all(any(g[0] <= e and e + substrings.K <= g[1] for g in got) for e, _ in anchors[i : j + 1])
    assert found > 10


# --- 7 ---


def test_every_word_trains(spark):
    """Words that stand only at places 1, 2, 4, 5 and 7 of eight are learned too."""
    text = " ".join("x" if i % 8 in (0, 3, 6) else f"p{i % 8}" for i in range(40_000))
    row = lm.lm_scores(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)).first()
    assert row["n_tokens"] == 40_000 and row["mean_log_prob"] > -0.5


def test_lessons_cover_all_words_once():
    for sizes in ([5, 0, 1, 2, 7], [5], [0, 0], [1, 1, 1, 1], []):
        starts, n = np.cumsum(sizes, dtype=np.int64) - np.array(sizes, np.int64), sum(sizes)
        picks = np.concatenate([lm.lessons(starts, n, t) for t in range(lm.ROUNDS)])
        assert sorted(picks.tolist()) == list(range(n))

# --- 3 ---


def test_names_inside_articles_stay():
    """Names that only hold a word of furniture are none; a heading stands with its text."""
    from weftline.llm import html

    kept = ['<p class="share-price">a</p>', '<div id="login-guide">b</div>', '<div class="social-history">c</div>', '<section class="search-results-analysis">d</section>', '<table class="related-work"><tr><td>e</td></tr></table>', "<p hidden>f</p>"]
    assert html.Page(f"<article>{''.join(kept)}</article>").main_text(None).split("\n") == list("abcdef")
    gone = ['<div class="related-posts">x</div>', '<ul id="share-buttons"><li>y</ul>', '<div class="ad-slot left">z</div>', '<div class="comments-list">w</div>']
    assert html.Page(f"<article><p>one long text that stays</p>{''.join(gone)}</article>").main_text(None) == "one long text that stays"
    assert html.Page("<form><div class=main><p>All of the page stands in one form.</p></div></form>").main_text(None) == "All of the page stands in one form."
    assert html.Page("<div class=post><h1>Title</h1><div class=part><p>Some text that is long enough to win.</p></div></div>").main_text(None).startswith("Title\n")
    both = "<div class=content><section class=intro><div class=text><p>First part of the text.</p></div></section><section class=history><div class=text><p>Second part of the text, longer.</p></div></section></div>"
    assert html.Page(both).main_text(None) == "First part of the text.\nSecond part of the text, longer."


def test_deep_nesting_is_linear():
    import time

    from weftline.llm import html

    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        assert html.Page("<div class=x>" * n + "deep" + "</div>" * n).main_text(None) == "deep"
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5


# --- 4 ---


def test_huge_finite_vectors(spark):
    import pytest

    from weftline.llm import topk

    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1e200, 1.0]), (3, [-1e17, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(v, v.where("vec_id = 0"), 3).collect()] == [(0, 1, 1, 2048)]
    big = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="scores may reach"):
        topk.search(big, big)


# --- 10 ---


def test_texts_of_one_doc_id(spark):
    rng = np.random.default_rng(9)
    passage = unlike(rng, 80)
    rows = [(1, " ".join(unlike(rng, 30) + passage)), (1, " ".join(unlike(rng, 300))), (1, " ".join(passage + unlike(rng, 9))), (2, " ".join(unlike(rng, 50) + passage))]
    got = substrings.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in got} == {(2, 1)}


def test_recall_by_rate_of_changes(spark):
    """Passages of 100 words with every n-th word changed: all of those found by brute force."""
    rng = np.random.default_rng(12)
    rows, at = [], 0
    for every in (8, 10, 12, 15, 25):
        for _ in range(8):
            passage = unlike(rng, 100)
            changed = [w if (j + 1) % every else f"c{at}x{j}" for j, w in enumerate(passage)]
            rows += [(at, " ".join(unlike(rng, 40) + passage + unlike(rng, 20))), (at + 1, " ".join(unlike(rng, 25) + changed + unlike(rng, 30)))]
            at += 2
    got = {(r["doc_id"], r["source_doc_id"]) for r in substrings.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i + 1, i) for i in range(0, at, 2)}
    assert got <= want and len(got) >= 0.9 * len(want), sorted(want - got)
