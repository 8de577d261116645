"""Operators against brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, html, jaccard, lm, media, mixing, packing, pii, substrings, topk, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def compare(got, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(sql).df()
    got = got.toPandas()[list(want.columns)]
    order = list(want.columns)
    assert want.sort_values(order).reset_index(drop=True).astype(str).equals(got.sort_values(order).reset_index(drop=True).astype(str))


# --- 1 ---

SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_the_letter(text):
    out = []
    for kind, pattern in SPEC.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans(texts):
    odd = ["a@b.c@d.e", "a@b", "x@y.z.", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "001.2.3.0255 256.1.1.1", "4111-1111 1111 1111", "4111  1111", "+1 (377) 555-0271 +", "+1", "++12345678", "+12 34 56 78)(", "é@b.cc ü.x@b.cc"]
    for t in [*texts.values(), *odd]:
        assert pii.find_base(t) == by_the_letter(t)


def test_disclosing_terms(spark):
    """A word that stands only beside one address gives it away; common words do not."""
    rows = [(i, f"the quick note from wurmbaum mail ab@cd.example the end {i}") for i in range(4)]
    rows += [(i, f"the quick note from someone else the end {i}") for i in range(4, 60)]
    out = {r["doc_id"]: r for r in pii.sanitise_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[0][1]
    shown = {text[t["start"] : t["stop"]] for t in out[0]["terms"]}
    assert "wurmbaum" in shown and not shown & {"the", "quick", "note", "from", "end"}
    assert out[0]["spans"].startswith("email:") and out[10]["spans"] == ""


@pytest.mark.parametrize("bits", [None, 6])
def test_copies_count_once(spark, monkeypatch, bits):
    """Repeated rows and copies under other ids change no mark, however full the filters are."""
    if bits:
        monkeypatch.setattr(common, "LEAST_BITS", bits)
        monkeypatch.setattr(common, "MOST_BITS", bits)
    texts = {i: f"note {'wurmbaum' if i < 5 else 'someone'} mail ab{i % 3}@cd.example quick{chr(97 + i % 26)}x end {i}" for i in range(12)}
    texts |= {i: f"the quick note from {'wurmbaum' if i == 20 else 'someone'} end {i}" for i in range(12, 120)}
    rows = [*texts.items()]
    want = disclosed_by_the_letter(texts.values(), 0.6)
    assert 0 < len(want) < 40
    shapes = {
        "plain": rows,
        "doubled": rows + rows,
        "copied": rows + [(1000 + 200 * k + i, t) for k in range(3) for i, t in rows if i % 2] + [(None, texts[0]), (-7, texts[20])],
        "hot": rows + [(2000 + i, texts[1]) for i in range(60)] + [(2100 + i, texts[40]) for i in range(60)],
    }
    found = {}
    for name, some in shapes.items():
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        out = pii.sanitise_spans(docs, threshold=0.6).collect()
        assert len(out) == len(some)
        found[name] = {r["doc_id"]: (r["spans"], tuple(r["terms"])) for r in out if r["doc_id"] in texts}
        marked = {texts[i][t["start"] : t["stop"]] for i, (_, ts) in found[name].items() for t in ts}
        assert marked == set(want)
    assert all(f == found["plain"] for f in found.values())


def disclosed_by_the_letter(texts, threshold):
    """Terms over the threshold, and whether they go: counted over all texts, one at a time."""
    folded = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, df_e, c, entity_texts = Counter(), Counter(), Counter(), set(texts)
    for text in entity_texts:
        found = [(m[0].translate(folded), *m.span()) for m in re.finditer("[A-Za-z\x80-\U0010ffff]{3,}", text)]
        df.update({t for t, _, _ in found} | {(t[:3],) for t, _, _ in found})
        base = pii.find_base(text)
        spans = base + pii.find_secrets(text, base)
        free = [t for t in found if not any(a < t[2] and t[1] < b for _, a, b in spans)]
        mine = set()
        for kind, a, b in spans:
            at = sum(1 for t in free if t[1] < a)
            for e in pii.entity_keys(kind, text[a:b]):
                mine |= {(e, None)} | {(e, x) for t, _, _ in free[max(0, at - pii.WINDOW) : at + pii.WINDOW] for x in (t, (t[:3],))}
        c.update(x for x in mine if x[1] is not None)
        df_e.update(e for e, t in mine if t is None)
    n = len(entity_texts)

    def over(e, t):
        p, m = df_e[e] / n, pii.SMOOTHING
        return p < 1 and np.log2((c[e, t] + m * p) / (df[t] + m) / p) >= threshold * -np.log2(p)

    gone: dict[str, bool] = {}
    for e, t in c:
        if isinstance(t, str) and over(e, t):
            gone[t] = gone.get(t, False) or len(t) <= 3 or over(e, (t[:3],))
    return gone


def test_disclosure_by_the_letter(spark, docs, texts):
    """All marks of a corpus, of words, of entities and of what removal leaves, by brute force."""
    want = disclosed_by_the_letter(texts.values(), 0.8)
    folded = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = 0
    for r in pii.sanitise_spans(docs, threshold=0.8).collect():
        text = texts[r["doc_id"]]
        base = pii.find_base(text)
        spans = base + pii.find_secrets(text, base)
        places = [(m.start(), m.end(), want[t]) for m in re.finditer("[A-Za-z\x80-\U0010ffff]{3,}", text) if (t := m[0].translate(folded)) in want and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        assert [(t["start"], t["stop"], t["remove"]) for t in r["terms"]] == places
        assert r["spans"] == ",".join(filter(None, [pii.joined(spans), ",".join(f"term:{a}:{b}" for a, b, _ in places)]))
        assert r["base_sha256"] == hashlib.sha256(pii.joined(by_the_letter(text)).encode()).hexdigest()
        marked += len(places)
    assert marked > 20 and len({r["doc_id"] for r in docs.collect()}) == len(texts)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised_texts(docs, threshold=0.8).collect()}
    for i, text in texts.items():
        new, words_left = clean[i] or "", set()
        assert not pii.find_base(new)
        words_left = {m[0].translate(folded) for m in re.finditer("[A-Za-z\x80-\U0010ffff]{3,}", new)}
        assert not {t for t, g in want.items() if g} & words_left


def test_secrets():
    found = lambda t: [t[a:b] for _, a, b in pii.find_secrets(t, [])]
    assert found('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    assert found("Donaudampfschifffahrtsgesellschaft a1a1a1a1a1a1a1a1a1a1a1a1a1 12345678901234567890 short1234") == []


# --- 2 ---


def test_media_round_trip(docs, texts):
    for r in media.media_features(docs).collect():
        n, payload = media.payload_of(texts[r["doc_id"]])
        stored = media.encoded(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.features(payload)


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, 60_000, np.uint8).tobytes()
    before, after = media.chunked(a), media.chunked(b"put in front" + a)
    assert b"".join(before) == a and len(set(before) & set(after)) > 0.8 * len(before)
    assert all(media.LEAST <= len(c) <= media.MOST for c in before[:-1])


# --- 3 ---


def test_host_paths(spark):
    def page(i, body):
        return f'<html><body><div class="top-{i}"><a href="/">Home page of the site with links</a></div><div class="post-{i}">{body}</div><div class="sidebar">Read more of this and that here</div><footer>All rights</footer></body></html>'

    rows = [(i, "https://www.h.example/x", page(i, f"<p>Text number {i} that has  some\n words.</p><p>And more &amp; more.</p>")) for i in range(5)]
    rows.append((9, "https://h.example/y", page(9, "<p>Short.</p>")))
    got = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3 that has some words.\nAnd more & more." and got[9] == "Short."


def test_furniture_goes():
    p = html.Page(
        '<nav>menu</nav><article><header><h1>Head</h1></header><p>One<br>two <a href="#">link</a></p><div class="ad">buy</div><script>x</script><form>ask</form>'
        '<ul><li>item a<li>item b</ul><section class="comments"><p>first!</p></section></article><aside>side</aside>'
    )
    assert p.main_text(None) == "Head\nOne two link\nitem a\nitem b"


# --- 4, 9 ---


def test_topk_sql(spark):
    compare(topk.op4_topk(spark, SF), topk.ORACLE_SQL)


def test_mixing_sql(spark):
    compare(mixing.op9_mixing(spark, SF), mixing.ORACLE_SQL)


def test_targets_and_quotas(spark):
    sources = spark.createDataFrame([("a", 1000, 1), ("b", 50, 1), ("c", 400, 1), (None, 5000, 1)], "source string, source_size long, n_rows long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    want, left, total = {}, {"a": (5, 2000), "b": (2, 100), "c": (1, 800), None: (5, 10000)}, 1.5 * 6450
    while left:  # by the letter: cap, deal the excess again
        level = (total - sum(want.values())) / sum(w for w, _ in left.values())
        over = [s for s, (w, cap) in left.items() if w * level >= cap]
        for s in over or list(left):
            want[s] = float(left[s][1]) if over else left[s][0] * level
            del left[s]
    assert got == pytest.approx(want)
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 1000, 30).tolist()
    df = spark.createDataFrame([(0, i, w, 101) for i, w in enumerate(weights)], "g int, k int, w long, seats long")
    quota = {r["k"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], ["k"], "w", "seats").collect()}
    dealt = Counter()
    for _ in range(101):
        dealt[max(range(30), key=lambda i: (weights[i] / (2 * dealt[i] + 1), -i))] += 1
    assert quota == {i: dealt[i] for i in range(30)}


def test_mix_comes_near_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", mixing.n_words(F.col("text")))
    for r in mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 0.02 * r["g"]


# --- 5 ---


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_scores(d, toxicity.fit(d, labels)).join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    fold = out[out["held_out"]]
    pos, neg = fold[fold["toxic"] == 1]["score"].to_numpy(), fold[fold["toxic"] == 0]["score"].to_numpy()
    assert np.mean(pos[:, None] > neg[None, :]) > 0.85 and np.mean(neg >= 0.5) < 0.02


# --- 6 ---


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack(docs, with_ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    for doc_id, own in by.items():
        ids = [t for r in sorted(own, key=lambda r: r["start"]) for t in r["ids"]]
        assert ids == [*tok.encode(texts[doc_id], add_special_tokens=False).ids, 2] and own[0]["doc_tokens"] == len(ids)


# --- 7 ---


def test_pseudo_likelihood(docs, texts):
    """Contexts help: better than the same vocabulary's own shares; sums over whole texts."""
    got = {r["doc_id"]: r for r in lm.lm_scores(docs).collect()}
    assert all(got[i]["n_tokens"] == len(t.encode().split()) for i, t in texts.items())
    counts = lm.bucket_counts(docs)
    plain = (counts * np.log((counts + 0.5) / (counts + 0.5).sum())).sum()
    assert sum(r["log_prob"] for r in got.values()) > plain


@pytest.fixture
def network():
    """A network with weights of its own, so that every part of it counts."""
    rng = np.random.default_rng(0)
    net = lm.Network.start(rng.integers(0, 50, lm.TOKENS))
    for p in net.parts:
        p += rng.normal(0, 0.2, p.shape)
    return net


def windows(n, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, lm.VECTORS + 1, (2 * lm.SIDE, n)), rng.integers(0, lm.TOKENS, n)


def test_training_raises_likelihood(network):
    near, at = windows(200, 1)
    first, squares = network.log_probs(near, at).mean(), lm.first_squares()
    for _ in range(60):
        network.train(near, at, squares)
    assert network.log_probs(near, at).mean() > first + 1


def test_gradients_against_differences(network):
    network.parts = [p.astype(np.float64) for p in network.parts]
    near, at = windows(40, 2)
    order = np.argsort(at, kind="stable")
    near, at = near[:, order], at[order]
    found = network.gradients(near, at)
    for part, (rows, g) in zip(network.parts, found, strict=True):
        whole = np.zeros_like(part)
        whole[rows] = g
        for i in (int(np.abs(whole).argmax()), whole.size - 1, 0):
            step, kept = 1e-5, part.flat[i]
            part.flat[i] = kept + step
            up = -network.log_probs(near, at).sum()
            part.flat[i] = kept - step
            down = -network.log_probs(near, at).sum()
            part.flat[i] = kept
            assert whole.flat[i] == pytest.approx((up - down) / (2 * step), abs=1e-4, rel=1e-4)


def test_tokens_of_a_window_sum_to_one(network):
    near, _ = windows(1, 3)
    every = np.arange(lm.TOKENS)
    assert np.exp(network.log_probs(np.repeat(near, lm.TOKENS, 1), every).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_untrained_network_gives_shares():
    counts = np.random.default_rng(4).integers(0, 1000, lm.TOKENS)
    near, at = windows(500, 5)
    net = lm.Network.start(counts)
    for d in range(lm.DIGITS):
        net.parts[4 + 3 * d][:] = 0  # what the window says
    want = np.log((counts + 0.5) / (counts + 0.5).sum())[at]
    assert np.allclose(net.log_probs(near, at), want, atol=1e-3)


def test_scores_against_a_loop_over_places(spark, docs, texts, network):
    """Each document's score, word by word, by the plain formula."""
    few = dict(sorted(texts.items(), key=lambda x: len(x[1]))[:40])
    vocabulary = lm.Vocabulary.of(lm.bucket_counts(docs))
    encoded = lm.encode(docs.where(docs.doc_id.isin(list(few))), vocabulary)
    got = {r["doc_id"]: r["log_prob"] for r in lm.scored(encoded, network).collect()}
    e, s, b = network.parts[:3]
    for r in encoded.collect():
        tokens = np.frombuffer(r["tokens"], "<u2").tolist()
        total = r["within"]
        for i, token in enumerate(tokens):
            z = b.astype(float)
            for j, d in enumerate((-2, -1, 1, 2)):
                beside = tokens[i + d] if 0 <= i + d < len(tokens) else lm.EDGE
                own = lm.VECTORS - lm.SHARED_VECTORS
                v = lm.VECTORS if beside == lm.EDGE else beside if beside < own else own + beside % lm.SHARED_VECTORS
                z = z + e[v] * s[j]
            h, before = np.tanh(z), 0
            for d, digit in enumerate((token // 1024, token // 32 % 32, token % 32)):
                u, w, bias = network.parts[3 + 3 * d : 6 + 3 * d]
                y = (h * u[before]) @ w + bias[before]
                total += y[digit] - np.log(np.exp(y).sum())
                before = before * 32 + digit
        assert got[r["doc_id"]] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_words_in_other_contexts_score_lower(spark):
    """Rare words, of equal counts, that go with one neighbour each: put beside the others'
    neighbours they score lower. Their own shares cannot tell."""
    rng = np.random.default_rng(6)
    pairs = [f"left{i} right{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(pairs, 60))) for i in range(2000)]
    swapped = " ".join(f"left{i} right{(i * 7 + 75) % 150}" for i in range(150))
    rows += [(5000, " ".join(pairs)), (5001, swapped)]
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[5000] > got[5001] + 0.3


# --- 8 ---


def all_links(texts, k=5):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i in ids:
        common = Counter(j for s in sets[i] for j in inverted[s])
        for s in sets[i]:
            inverted[s].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(spark, texts):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    more, n = dict(texts), max(texts) + 1
    for i in range(60):  # a group of near copies, of which not all pairs are similar
        own = list(base)
        for at in rng.integers(0, 120, 3):
            own[at] = f"other{i}x{at}"
        more[n + i] = " ".join(own)
    passage = " ".join(f"p{x}" for x in range(50))
    for i in range(60):  # a passage that many share
        more[n + 100 + i] = passage + " " + " ".join(f"q{i}x{x}" for x in range(5 + i))
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == all_links(more)


def test_jaccard_sql(spark):
    compare(jaccard.op8_jaccard(spark, SF), jaccard.ORACLE_SQL)


# --- 10 ---


def test_common_passages(spark):
    rng = np.random.default_rng(11)
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    passage = [f"p{i}" for i in range(70)]
    fuzzy = [w if i % 23 else "changed" for i, w in enumerate(passage)]
    rows = [(i, " ".join(filler(100) + passage + filler(60))) for i in range(12)]
    rows += [(20, " ".join(filler(30) + fuzzy + filler(5))), (30, " ".join(filler(400))), (31, " ".join(filler(20) + passage[:30] + filler(9)))]
    got = substrings.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in got for x in (r["doc_id"], r["source_doc_id"])} == {*range(12), 20}
    exact = [r for r in got if r["doc_id"] < 12]
    assert all((r["start"], r["length"], r["source_start"], r["matched"]) == (100, 70, 100, 70) for r in exact)


def test_chains_against_all_orders():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        xs, ys = rng.integers(0, 60, n).tolist(), rng.integers(0, 60, n).tolist()
        best = [float(substrings.K)] * n
        for i in sorted(range(n), key=lambda i: xs[i]):
            for j in range(n):
                if xs[j] < xs[i] and ys[j] < ys[i]:
                    best[i] = max(best[i], substrings.K + best[j] - substrings.GAP_COST * (xs[i] - xs[j] + ys[i] - ys[j]))
        chain = substrings.chains(xs, ys)[0]
        score = substrings.K + sum(substrings.K - substrings.GAP_COST * (xs[b] - xs[a] + ys[b] - ys[a]) for a, b in zip(chain, chain[1:]))
        assert score == pytest.approx(max(best))
        assert all(xs[a] < xs[b] and ys[a] < ys[b] for a, b in zip(chain, chain[1:]))
