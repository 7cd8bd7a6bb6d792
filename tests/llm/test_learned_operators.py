"""Operators with trained models: held-out results, equality with plain loops, odd rows."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcerank.llm import html_extract, language_id, licence_scan, lm_score, nearest
from sourcerank.llm.suffixes import permuted_prefixes, suffix_array

from .conftest import OTHER, WORDS, frame, sentence


def test_language_network_matches_training_form():
    net = language_id.Network.fresh(["a", "b", "c"])
    windows = np.random.default_rng(0).integers(97, 250, (70, language_id.WINDOW)).astype(np.uint8)
    scores = net.pooled(windows)[0] @ net.out + net.out_bias
    want = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    assert np.abs(net.probabilities(windows) - want).max() < 1e-5


def test_language_gradients():
    net = language_id.Network.fresh(["a", "b"], widths=(2, 3), filters=3, size=4)
    windows = np.random.default_rng(1).integers(97, 120, (5, 12)).astype(np.uint8)
    target = np.array([0, 1, 1, 0, 1])

    def loss():
        s = (net.pooled(windows)[0] @ net.out + net.out_bias).astype(float)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(5), target]).mean())

    for p, g in zip(net.parameters(), net.gradients(windows, target)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=2e-3)


def test_language_id(spark, docs, no_docs, texts):
    import random

    rng = random.Random(5)
    more = [(k, sentence(rng, 60, OTHER if k % 2 else WORDS), "de" if k % 2 else "en") for k in range(1000, 1200)]
    found = language_id.identified(frame(spark, more).unionByName(docs))
    rows = found.collect()
    assert len(rows) == len(texts) + len(more)
    want = {i: lang for i, _, lang in more}
    held = [r for r in rows if r.held_out and r.doc_id in want]
    assert len(held) > 20 and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (70, 71, 72, 75)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.identified(no_docs).count() == 0
    unlabelled = language_id.identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_model_scores_match_plain_loops(docs, no_docs, texts):
    from sourcerank.llm.common import id_and_text

    plain = id_and_text(docs)
    lex = lm_score.lexicon(lm_score.word_counts(plain), vocabulary=12)
    net = lm_score.trained(plain, lex, share=1.0)
    rows = lm_score.scored_with(plain, lex, net).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    for i, t, _ in texts[:6] + [x for x in texts if x[0] in (73, 74)]:
        ((hashes, _),) = lm_score.texts_words(pa.array([t]))
        numbers, total = lex.numbers(hashes).tolist(), 0.0
        for k, word in enumerate(numbers):
            hidden = sum(net.vectors[numbers[k + d] if 0 <= k + d < len(numbers) else lex.pad] * net.places[j] for j, d in enumerate(lm_score.PLACES))
            scores = net.out[:, :-1] @ hidden + net.out[:, -1]
            total += scores[lex.classes[word]] - math.log(np.exp(scores).sum()) + lex.log_shares[word]
        assert got[i].n_tokens == len(numbers)
        assert got[i].log_prob == pytest.approx(total, rel=1e-4)
    assert got[70].log_prob == 0 and got[70].mean_log_prob is None
    fresh = lm_score.scored_with(plain, lex, lm_score.Network.fresh(lex.pad, lm_score.CLASSES + lm_score.RARE))
    assert sum(r.log_prob for r in rows) > fresh.agg(F.sum("log_prob")).first()[0]
    assert lm_score.scored(no_docs).count() == 0


def test_class_shares_add_up(docs):
    from sourcerank.llm.common import id_and_text

    lex = lm_score.lexicon(lm_score.word_counts(id_and_text(docs)), vocabulary=20)
    known = lex.classes[:-lm_score.RARE]
    sums = np.bincount(known, np.exp(lex.log_shares[: len(known)]))
    assert np.allclose(sums[np.unique(known)], 1)


def test_licence_scan(spark, docs, no_docs, texts):
    notices = ["Intro text\nReleased under the MIT License.\nmore of it", "Licensed under the Apache License, Version 2.0.", "Mit.\nDer fluss und der stein", "This work is licensed under the GNU General Public License, version 3."]
    odd = frame(spark, [(2000 + k, n, "en") for k, n in enumerate(notices)] + [(2000, notices[0], "en")])
    rows = licence_scan.scanned(odd.unionByName(docs)).collect()
    assert len(rows) == len(texts) + 5
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(list(r.families))
    assert got[2000] == [["MIT"], ["MIT"]] and got[2001] == [["Apache-2.0"]] and got[2002] == [[]] and got[2003] == [["GPL"]]
    assert all(f == [] for i, fs in got.items() if i is None or i < 2000 for f in fs)
    first = next(r for r in rows if r.doc_id == 2000)
    assert first.found[0].paragraph == 1 and first.found[0].agreement == 1.0
    assert licence_scan.scanned(no_docs).count() == 0


def test_licence_classifier_on_held_out_variants():
    import random

    background = [sentence(random.Random(k), 30) for k in range(200)]
    model = licence_scan.trained(background)
    rng, right, total = random.Random(99), 0, 0
    for family, notices in licence_scan.TEMPLATES.items():
        for notice in notices:
            found = licence_scan.grams(licence_scan._framed(notice, background, rng))
            scores = [b + sum(model.weights[g][c] for g in found if g in model.weights) for c, b in enumerate(model.bias)]
            right += max(scores) > 0 and model.families[int(np.argmax(scores))] == family
            total += 1
    assert right >= 0.85 * total
    fresh = [sentence(random.Random(5000 + k), 30) for k in range(100)]
    best = [max(b + sum(model.weights[g][c] for g in licence_scan.grams(t) if g in model.weights) for c, b in enumerate(model.bias)) for t in fresh]
    assert sum(x > 0 for x in best) <= 5


def brute_nearest(rows, k):
    use = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in use:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((use[q] - v) ** 2).sum())), i) for i, v in use.items() if i != q)
            out[q] = near[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 24).tolist()) for i in range(600)]
    rows += [(600 + i, rows[100][1]) for i in range(150)]  # a hot vector, with a query in it
    odd = [(9000, None), (9100, [0.0] * 24), (9200, [float("nan")] * 24), (9300, [None] * 24), (None, [1.0] * 24), (9400, [float("inf")] * 24), (9500, [1e-300] * 24)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, rank string")
    for block in (nearest.QUERY_BYTES, 500):
        got = {}
        for r in nearest.nearest(vectors, F.col("vec_id") % 100 == 0, 10, query_bytes=block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
        want = brute_nearest(rows + odd, 10)
        assert set(got) == set(want)
        hits = sum(len({i for _, i in got[q].values()} & {i for _, i in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        assert all(sorted(g) == list(range(1, 11)) for g in got.values())
        assert [got[100][k][1] for k in range(1, 11)] == list(range(600, 610))
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.nearest(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1.0)]
    assert nearest.nearest(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home page</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p><b>First&nbsp;part\n  of it.<br><p>Sec<i>ond</i> part.</p>'
    "<aside>Not this</aside><p>Third</p></article><footer>&copy; somebody and others</footer></body></html>"
)


def test_html_extraction(spark):
    want = "Head & line\nFirst part of it.\nSecond part.\nThird"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>plain"), (1, "u", PAGE), (None, "u", PAGE), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "a < b <<< &&& <!-- open")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extracted(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == sorted([(1, want), (2, ""), (3, ""), (4, "plain"), (1, want), (0, want), (5, "deep"), (6, "a < b <<< &&&")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_best_run_is_the_best():
    rng = np.random.default_rng(6)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(0, 9)).tolist()
        a, b = html_extract.best_run(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(0, best)


def test_pages_of_the_corpus(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extracted(pages).collect():
        inner = re.search("<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_suffix_arrays():
    rng = np.random.default_rng(8)
    for _ in range(150):
        s = np.append(rng.integers(1, rng.choice([2, 3, 200]), rng.integers(0, 60)), 0)
        text = s.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        sa = suffix_array(s)
        assert sa.tolist() == want
        prefixes = permuted_prefixes(s, sa, 5)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < 5 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert prefixes[b] == n
