"""Fitted operators: held-out accuracy, recall against brute force, gold texts and roles."""

from __future__ import annotations

import html
import re
import time
import zlib

import numpy as np
import pytest

from earthworks.llm import ann, chat, html_extract, langid, quality_classifier, queries

SF = "/root/testdata/sf0.01"


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op5_language_id(spark, SF).collect() if r.held_out]
    assert all(remainder(r.doc_id, 4) == 2 and 0 <= r.score <= 1 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    some = {r.lang: r.text for r in docs.where("length(text) > 3000").collect()}
    text = some["de"][:1500] + " " + some["fr"][:1000]
    mixed = spark.createDataFrame([(1, text), (2, some["es"]), (3, None), (4, "12 !")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.predicted(mixed, model, ["doc_id"]).collect()}
    assert set(rows[1].languages) == {"de", "fr"} and rows[1].lang_pred == "de" and 0.5 < rows[1].score < 0.75
    assert set(rows[2].languages) == {"es"}
    assert [(rows[k].lang_pred, rows[k].score, rows[k].languages) for k in (3, 4)] == [("und", 0, {})] * 2


def test_even_mixtures_keep_all_their_languages(spark):
    """Sets of every size are tried; a language that was never learned is told by its fit, not by a share."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = {r.lang: r.text[:1500] for r in docs.where("length(text) > 3000").collect()}
    names = sorted(some)
    russian = "Привет как дела сегодня мы пошли гулять в парк и видели много людей " * 10
    texts = [(k, " ".join(some[x] for x in names[:k])) for k in range(1, len(names) + 1)] + [(9, russian)]
    rows = {r.k: r for r in langid.predicted(
        spark.createDataFrame(texts, "k long, text string"), langid.learn(docs), ["k"]).collect()}
    for k in range(1, len(names) + 1):
        assert set(rows[k].languages) == set(names[:k]) and rows[k].fit > -2
        assert all(abs(share - 1 / k) < 0.12 for share in rows[k].languages.values())
    assert rows[9].fit < -6


def test_proportions_have_the_highest_likelihood():
    """Expectation-maximisation against a search over a grid of proportions."""
    rng = np.random.default_rng(1)
    likelihood = rng.dirichlet(np.ones(200) * 0.3, 3).T + 1e-9
    likelihood /= likelihood.sum(axis=0)
    model = langid.Model(["a", "b", "c"], likelihood, np.ones(3) / 3)
    for truth in ([1, 0, 0], [0.7, 0.3, 0], [0.4, 0.3, 0.3]):
        draw = rng.choice(200, 3000, p=likelihood @ np.array(truth))
        at, n = np.unique(draw, return_counts=True)
        best, chosen, _ = langid.infer(model, [(at, n)])
        grid = [(i / 50, j / 50, (50 - i - j) / 50) for i in range(51) for j in range(51 - i)]
        found = {}
        for size in (1, 2, 3):
            some = [s for s in grid if sum(x > 0 for x in s) <= size]
            values = [float((n * np.log(likelihood[at] @ np.array(s))).sum()) for s in some]
            top = int(np.argmax(values))
            found[size] = values[top] - langid.PENALTY * size * np.log(3001), some[top]
        wanted = max(found.values())[1]
        assert np.abs(best[0] - np.array(wanted)).max() < 0.05
        assert chosen[0].tolist() == [x > 0 for x in wanted]


def test_set_sizes_that_are_left_out_would_not_win(monkeypatch):
    """The sets chosen are those of a search that leaves out no size."""
    rng = np.random.default_rng(5)
    likelihood = rng.dirichlet(np.ones(300) * 0.5, 5).T + 1e-9
    model = langid.Model(list("abcde"), likelihood / likelihood.sum(axis=0), np.ones(5) / 5)
    bags = []
    for _ in range(40):
        share = rng.dirichlet(np.ones(5) * 0.3)
        draw = rng.choice(300, int(rng.integers(5, 2000)), p=model.likelihood @ share)
        bags.append(np.unique(draw, return_counts=True))
    _, chosen, _ = langid.infer(model, bags)
    monkeypatch.setattr(langid.np, "argmax", lambda x, axis=None: np.full(len(x), 4))
    _, every, _ = langid.infer(model, bags)
    assert (chosen == every).all(axis=1).mean() >= 0.95


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    text = "der Hund und die Katze " * 300
    whole = langid.features(text)
    monkeypatch.setattr(langid, "pieces", lambda t: (t[k : k + 2300] for k in range(0, len(t), 2300)))
    parts = langid.features(text)
    assert abs(int(whole[1].sum()) - int(parts[1].sum())) <= 6 and set(whole[0]) == set(parts[0])


def test_quality_of_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in queries.op4_quality_classifier(spark, SF).collect() if r.held_out]
    assert all(remainder(r.doc_id, 5) == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)
    known = [r for r in held if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) >= 0.95
    assert np.mean([r.predicted for r in known if truth[r.doc_id] == 1]) >= 0.98


def test_word_sums_equal_to_a_loop(spark):
    texts = ["a b c a", "b", None, "c c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    entries, signs = quality_classifier.index_vectors()
    of, wanted = quality_classifier.Buckets(), np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMENSIONS))
    for t in texts:
        words = [of[w] for w in quality_classifier.WORD.findall(t or "")]
        for i, w in enumerate(words):
            for j in range(max(i - 2, 0), min(i + 3, len(words))):
                if i != j:
                    for p, s in zip(entries[words[j]], signs[words[j]], strict=True):
                        wanted[w, p] += s
    found = np.zeros_like(wanted)
    for r in quality_classifier.word_sums(df).collect():
        found[r.bucket] = r[1:]
    assert np.array_equal(found, wanted)


def test_a_bucket_belongs_to_one_word_in_the_main(spark):
    """Of all words met in the texts, at least three quarters are the most frequent one of their bucket."""
    from collections import Counter

    counts, of, most = Counter(), quality_classifier.Buckets(), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        counts.update(quality_classifier.WORD.findall(r.text))
    for word, n in counts.items():
        most[of[word]] = max(most.get(of[word], 0), n)
    assert sum(most.values()) > 0.75 * sum(counts.values())


def test_network_temperature_and_single_label():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality_classifier.fit(x, y)
    p = net.scores(x)
    assert abs(p.mean() - y.mean()) < 0.05 and ((p > 0.5) == y).mean() > 0.75
    assert np.allclose(quality_classifier.fit(x, np.ones(1500)).scores(x), 1, atol=1e-3)
    assert np.allclose(quality_classifier.fit(x[:0], y[:0]).scores(x), 0.5)


def brute_nearest(rows, k=20):
    fine = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            fine[(r.vec_id, tuple(v))] = np.array(v)
    length = max({len(v) for v in fine.values()}, key=lambda n: sum(len(v) == n for v in fine.values()))
    items = [(i, v) for (i, _), v in fine.items() if len(v) == length]
    return {q: [i for _, i in sorted((-float(a @ b), i) for i, b in items if i != q)[:k]] for q, a in items if q % 20 == 0}


@pytest.mark.parametrize("where", ["small", "edge"])
def test_nearest_against_brute_force(spark, edge_dir, where):
    folder = SF if where == "small" else edge_dir
    wanted = brute_nearest(spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    found = {}
    for r in sorted(queries.op6_nearest(spark, folder).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(wanted) and all(len(found[q]) == len(wanted[q]) for q in wanted)
    hit = np.mean([len(set(found[q]) & set(wanted[q])) / len(wanted[q]) for q in wanted])
    assert hit >= 0.95


def test_recall_of_a_pruned_index(spark):
    """Many lists, small parts: the answer still holds the wanted share of the true neighbours."""
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    wanted = brute_nearest(df.collect())
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, list_rows=60, bundle_rows=50, block_rows=7).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & set(w)) / 20 for q, w in wanted.items()]) >= 0.9


def gold(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    found = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body))
    return "\n".join(x for x in found if x)


def test_main_text_of_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op10_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages) and all(r.text == gold(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_parts_around_the_article_go():
    page = """<body><header class="site"><a href=/>Home</a></header><div class="cookie-notice">We use cookies to improve your
    experience here, is that fine?</div><main><article><header><h1>Title</h1></header><p>A first paragraph with enough words to
    be prose.</p><p>Short.</p><aside>Related things to read today, many of them.</aside><p>Second &amp; last&nbsp;&lt;b&gt; one.
    <form><label>Mail</label><input></form></article><section id="comments"><article class="comment"><p>I think this is a great
    article with many words and more.</p></article></section></main><div class=sidebar><ul><li><a href=1>a b</a></ul></div>
    <footer>rights<script>var a = "<p>no</p>"</script>"""
    assert html_extract.main_text(page) == "\n".join(
        ["Title", "A first paragraph with enough words to be prose.", "Short.", "Second & last <b> one."])


def test_minimum_cut_equal_to_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        scores = rng.normal(size=n).round(2).tolist()
        joined = [(a, b, float(rng.random())) for a in range(n) for b in range(a) if rng.random() < 0.4]

        def cost(inside, scores=scores, joined=joined):
            return (sum(s for s, x in zip(scores, inside, strict=True) if s > 0 and not x)
                    - sum(s for s, x in zip(scores, inside, strict=True) if s < 0 and x)
                    + sum(c for a, b, c in joined if inside[a] != inside[b]))

        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.source_side(scores, joined)) - best) < 1e-6


@pytest.mark.parametrize("page", ["<a " * 50_000, '<a href="' * 50_000, "<" * 100_000, "<div>" * 20_000 + "x", "<p>x" * 20_000])
def test_broken_pages_take_linear_time(page):
    start = time.time()
    html_extract.main_text(page)
    assert time.time() - start < 10


def test_roles_are_recovered(spark):
    truth = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        truth.setdefault(r.conv_id, []).append((r.role, r.text.strip()))
    found = {}
    for r in sorted(queries.op9_chat_formatting(spark, SF).collect(), key=lambda r: (r.conv_id, r.turn)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.rendered == f"<|{r.role}|>\n{r.text}<|end|>\n"
    assert sum(found[c] == t for c, t in truth.items()) >= 0.98 * len(truth)


def test_cut_conversations_are_solved_as_whole_ones(spark):
    """One conversation over many tasks gives the path of a single one."""
    rows = [(7, k, ("User: " if k % 4 == 0 else "AI: " if k % 4 == 2 else "") + f"line {k}" + "?" * (k % 8 == 0)) for k in range(900)]
    df = spark.createDataFrame(rows, "c long, k long, text string")
    order, model = [r[2] for r in rows], chat.default_model()
    valid = chat.speakers(chat.styles_of(order))
    states = chat.path(chat.seen(order, model, valid)[0], model, None, None)
    begins = [chat.STATES[s][1] for s in states]
    cut = chat.turns(df.repartition(8), "c", ["k"]).orderBy("turn").collect()
    assert [r.turn for r in cut] == list(range(len(cut))) and sum(begins) == len(cut)
    assert [r.role for r in cut] == [chat.ROLES[chat.STATES[s][0]] for s, b in zip(states, begins, strict=True) if b]
    assert sum(len(r.text.split("\n")) for r in cut) == len(rows)
