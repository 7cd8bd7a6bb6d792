"""BM25, vectors, ranking and metrics on hand-made frames."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcerank.functions import text as tx
from sourcerank.functions import tokens as tk
from sourcerank.operators import bm25, metrics, ranking
from sourcerank.operators import relevance as rel
from sourcerank.operators import vectors as vo

from .conftest import rows

DOCS = [("d1", "the cat sat"), ("d2", "the dog the end"), ("d3", "The <B01>(4) ran")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "uid string, text string")


def queries(spark, *texts):
    data = [(f"q{i}", t, "", "f", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "query_uid string, prompt string, completion string, func string, correct boolean")


def by_hand(texts, query):
    """Okapi scores written out: k1 1.5, b 0.75, epsilon 0.25."""
    import re

    toks = [re.findall(r"<[^<>\s]+>|[A-Za-z0-9]+", t.lower()) for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    vocab = {w for t in toks for w in t}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w in vocab for d in [sum(w in t for t in toks)]}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    out = []
    for t in toks:
        s = 0.0
        for w in re.findall(r"<[^<>\s]+>|[A-Za-z0-9]+", query.lower()):
            f = t.count(w)
            s += idf.get(w, 0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        out.append(s)
    return out


def test_terms_keep_tokens_and_split_accents(spark):
    df = spark.createDataFrame([("A <B01>(4) été!",)], "t string")
    assert df.select(tx.terms(F.col("t"))).first()[0] == ["a", "<b01>", "4", "t"]


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_bm25_matches_hand_computation(spark, docs, limit):
    # "the" occurs in every document: negative idf, floored.  "cat" counts twice.
    query = "the cat cat <B01>"
    got = bm25.bm25_scores(docs, queries(spark, query), decimals=6, limit_bytes=limit)
    want = by_hand([t for _, t in DOCS], query)
    assert {r.uid: r.score for r in got.collect()} == pytest.approx(
        {u: round(w, 6) for (u, _), w in zip(DOCS, want) if round(w, 6) != 0}, abs=2e-6
    )


def test_bm25_in_place_and_join_agree(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    data = [(f"d{i}", " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(120)]
    ds = spark.createDataFrame(data, "uid string, text string").repartition(5)
    qs = queries(spark, *[" ".join(rng.choice(words, 6)) for _ in range(9)], "absent")
    a = bm25.bm25_scores(ds, qs, decimals=4)
    b = bm25.bm25_scores(ds, qs, decimals=4, limit_bytes=1)
    left, right = ({(r.query_uid, r.uid): r.score for r in x.collect()} for x in (a, b))
    assert left == right
    for keep in (1, 3):
        kept = [bm25.bm25_scores(ds, qs, decimals=4, keep=keep, limit_bytes=n) for n in (64 << 20, 1)]
        assert rows(kept[0]) == rows(kept[1]) and kept[0].filter("score > 0").count() <= 10 * keep
    best = rows(ranking.top_k(bm25.bm25_scores(ds, qs, decimals=4, keep=3), 3), "query_uid", "uid", "rank")
    assert best == rows(ranking.top_k(a, 3), "query_uid", "uid", "rank")


@pytest.mark.parametrize("small", [False, True])
def test_a_grid_of_cells_adds_pairs_in_place(spark, monkeypatch, small):
    if small:
        for name in ("CELL_TOKENS", "CELL_WEIGHTS", "CELL_PAIRS", "_BLOCK_CELLS", "_SLICE_TOKENS"):
            monkeypatch.setattr(bm25, name, 7)
    rng = random.Random(2)
    texts = [" ".join(rng.choices("a b c d e f g <B01> z".split(), k=rng.randint(0, 12))) for _ in range(60)]
    ds = spark.createDataFrame([*enumerate(texts), (70, None)], "id int, text string").selectExpr("concat('d', id) as uid", "text").repartition(3)
    qs = queries(spark, "a b a", "c <B01>", "", "g", "a b", "unknown")
    joined = bm25.bm25_scores(ds, qs, limit_bytes=1)
    assert rows(joined) == rows(bm25.bm25_scores(ds, qs)) and joined.count()
    # Rows of one uid are one document for each length.
    again = ds.union(ds.filter("uid in ('d3', 'd4')")).union(ds.limit(2).selectExpr("cast(null as string)", "text"))
    found = bm25.bm25_scores(again, qs, limit_bytes=1)
    assert found.count() == found.select("query_uid", "uid").distinct().count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[query_uid#\d+, uid#\d+\]", plan)


def test_zero_score_documents_fill_the_top(spark, docs):
    qs = queries(spark, "cat", "", "nothing")
    scores = bm25.bm25_scores(docs, qs)
    got = ranking.top_k_complete(scores, qs, docs, 2)
    assert rows(got, "query_uid", "rank", "uid") == [
        ("q0", 1, "d1"), ("q0", 2, "d2"), ("q1", 1, "d1"), ("q1", 2, "d2"), ("q2", 1, "d1"), ("q2", 2, "d2"),
    ]


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_negative_scores_rank_after_absent_documents(spark, limit):
    # Each term is in more than half of the documents: idf and its floor are negative.
    ds = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "x y"), ("d", "y")], "uid string, text string")
    qs = queries(spark, "x")
    scores = bm25.bm25_scores(ds, qs, keep=2, limit_bytes=limit)
    stored = {r.uid: r.score for r in scores.collect()}
    assert set(stored) == {"a", "b", "c"} and all(v < 0 for v in stored.values())
    got = rows(ranking.top_k_complete(scores, qs, ds, 4), "rank", "uid", "score")
    assert got[0] == (1, "d", 0.0) and [s for _, _, s in got] == sorted((s for _, _, s in got), reverse=True)
    assert [u for _, u, _ in rows(ranking.top_k_complete(scores, qs, ds, 2), "rank", "uid", "score")][0] == "d"


def test_absent_documents_far_behind_the_first_ones(spark):
    # 300 documents with negative scores lie before the only absent ones.
    ds = spark.range(320).select(F.format_string("d%03d", "id").alias("uid"))
    scores = ds.filter("uid < 'd300'").select(F.lit("q").alias("query_uid"), "uid", F.when(F.col("uid") == "d007", 1.0).otherwise(-1.0).alias("score"))
    qs = spark.createDataFrame([("q",), ("none",)], "query_uid string")
    got = ranking.top_k_complete(scores, qs, ds, 3)
    assert rows(got, "query_uid", "rank", "uid", "score") == [
        ("none", 1, "d000", 0.0), ("none", 2, "d001", 0.0), ("none", 3, "d002", 0.0), ("q", 1, "d007", 1.0), ("q", 2, "d300", 0.0), ("q", 3, "d301", 0.0),
    ]
    few = ranking.top_k_complete(scores, qs, ds, 400).filter("query_uid = 'q'").orderBy("rank").collect()
    assert len(few) == 320 and few[20].uid == "d319" and few[21].score == -1.0


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_passages_are_found_whatever_the_limit(spark, limit):
    ds = spark.createDataFrame([("a", "the small cat sat there"), ("b", "a cat"), ("c", "dog food")], "uid string, text string")
    ps = spark.createDataFrame([("p", "small cat sat"), ("q", "cat"), ("r", "og fo")], "query_uid string, prompt string")
    assert rows(rel.containing_pairs(ds, ps, limit_bytes=limit), "query_uid", "uid") == [("p", "a"), ("q", "a"), ("q", "b"), ("r", "c")]


def test_ties_do_not_depend_on_partitioning(spark):
    base = spark.range(200).select(F.lit("q").alias("query_uid"), F.format_string("d%03d", "id").alias("uid"), F.lit(1.0).alias("score"))
    for n in (1, 3, 7):
        assert [u for _, u in rows(ranking.top_k(base.repartition(n), 4), "rank", "uid")] == ["d000", "d001", "d002", "d003"]


META = [
    ("a", "<B07>", "constant"), ("b", "<C07>", "identity"), ("c", "<C07>", "constant"), ("d", "<B07>", None),
    ("e", "<ZN>", "distractor"), ("f", "<D01>", "identity"), ("g", "<B7>", "constant"),
]


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(META, "uid string, func string, role string")


def relevant(spark, meta, func, **kw):
    funcs = spark.createDataFrame([(func,)], "func string")
    return [u for (u,) in rows(rel.relevant_pairs(meta, funcs, **kw), "uid")]


def test_relevance_rules(spark, meta):
    # Role must fit or be missing; the mate's documents count; tokens compare by index.
    assert relevant(spark, meta, "<B07>") == ["a", "b", "d", "g"]
    assert relevant(spark, meta, "<C7>") == ["a", "b", "d", "g"]
    assert relevant(spark, meta, "<B07>", mates="none") == ["a", "d", "g"]
    # Deep wrappers expect 'constant' unless the whole chain is followed.
    assert relevant(spark, meta, "<D01>") == []
    assert relevant(spark, meta, "<D01>", strict_roles=False) == ["f"]
    # Reserved tokens count for themselves only on request.
    assert relevant(spark, meta, "<ZN>") == []
    assert relevant(spark, meta, "<ZN>", distractor_aware=True) == ["e"]


def test_named_pairs_and_categories(spark):
    df = spark.createDataFrame([("<FN>", "identity"), ("<GN>", ""), ("<AN>", "constant"), ("<C01>", None)], "func string, role string")
    got = df.select(tk.mate(F.col("func")), tk.named_mate(F.col("func")), rel.category(F.col("func"), F.col("role"), F.lit(True))).collect()
    assert [tuple(r) for r in got] == [
        ("<GN>", "<GN>", "identity_gt"), ("<FN>", "<FN>", "constant_gt"), (None, None, "distractor"), ("<B01>", None, "identity_gt"),
    ]


def test_score_keys(spark):
    df = spark.createDataFrame([("<GN>",), ("<NN>",), ("<B01>",), ("other",)], "f string")
    assert [r[0] for r in df.select(tk.score_key(F.col("f"))).collect()] == ["g", "n", "b01", "other"]


def judged(spark, data):
    return spark.createDataFrame(data, "query_uid string, func string, rank int, relevant boolean, category string")


def test_cutoffs_beyond_corpus_and_missing_functions(spark):
    rank = [("q", "f", i + 1, i in (0, 3), "constant_gt" if i in (0, 3) else "other") for i in range(4)]
    rank += [("x", "none", 1, False, "other")]
    sizes = spark.createDataFrame([("f", 2)], "func string, n_relevant long")
    out = {r.k: r for r in metrics.per_query(judged(spark, rank), sizes, [1, 10]).collect()}
    assert (out[1].recall, out[1].precision) == (0.5, 1.0)
    assert (out[10].recall, out[10].precision, out[10].success) == (1.0, 0.5, 1.0)  # N = 4, not 10
    assert out[10].constant_gt + out[10].identity_gt + out[10].distractor + out[10].other == 1.0
    assert set(out) == {1, 10}  # 'none' has no relevant document and is left out


def test_variance_is_population_and_averages_two_level(spark):
    data = [("q1", "f", 1, 1.0, 1.0, 1.0), ("q2", "f", 1, 0.0, 0.0, 0.0), ("q3", "g", 1, 1.0, 0.5, 1.0)]
    pq = spark.createDataFrame(data, "query_uid string, func string, k int, recall double, precision double, success double")
    by = metrics.per_function(pq)
    assert rows(by, "func", "recall", "recall_var", "n_queries") == [("f", 0.5, 0.25, 2), ("g", 1.0, 0.0, 1)]
    o = metrics.overall(by).first()
    assert o.recall_overall_avg == 0.75 and o.recall_per_query_avg == pytest.approx(2 / 3) and o.recall_var_avg == 0.125


def test_mrr_variants(spark):
    curve = spark.createDataFrame([("m", 1, 0.2), ("m", 2, 0.5), ("m", 5, 0.4)], "method string, k int, r double")
    assert metrics.mrr_from_recall(curve, ["method"], "r").first().mrr == pytest.approx(0.2 + 0.3 / 2)
    assert metrics.mrr_from_recall(curve, ["method"], "r", clamp=False).first().mrr == pytest.approx(0.2 + 0.15 - 0.1 / 5)
    hits = judged(spark, [("q", "f", 1, False, "other"), ("q", "f", 3, True, "other"), ("z", "f", 1, False, "other")])
    assert rows(metrics.mrr_first_hit(hits), "query_uid", "rr") == [("q", pytest.approx(1 / 3)), ("z", 0.0)]


def test_parse_cutoffs():
    assert metrics.parse_cutoffs("5, 1,1,-2,0") == [1, 5]
    assert metrics.parse_cutoffs("x", "4,2") == [2, 3, 4]
    assert metrics.parse_cutoffs(None, "7", 3) == [3]
    assert metrics.parse_cutoffs(single=0) == []


def test_average_precision_and_auroc_by_hand(spark):
    data = [("q", "f", f"d{i}", s) for i, s in enumerate([0.9, 0.8, 0.8, 0.1])]
    scores = spark.createDataFrame(data, "query_uid string, func string, uid string, score double")
    truth = spark.createDataFrame([("f", "d0"), ("f", "d2"), ("f", "gone")], "func string, uid string")
    sizes = spark.createDataFrame([("f", 2)], "func string, n_relevant long")
    assert metrics.average_precision(scores, truth, sizes).first().ap == pytest.approx((1 + 2 / 3) / 2)
    marked = scores.withColumn("is_gt", F.col("uid").isin("d0", "d2"))
    # d0 beats both others, d2 ties with d1 (no win) and beats d3.
    assert metrics.auroc(marked, ["func"]).first().auroc == 0.75
    assert metrics.auroc_sampled(marked, ["func"], 20000).first().auroc == 0.75


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "euclidean"])
def test_block_products_agree_with_numpy(spark, metric):
    rng = np.random.default_rng(3)
    d, q = rng.normal(size=(50, 6)), rng.normal(size=(7, 6))
    d[4] = 0
    ds = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(d)], "uid string, vec array<double>").repartition(3)
    qs = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_uid string, vec array<double>")
    dist = np.sqrt(((q[:, None] - d[None]) ** 2).sum(-1))
    dn = np.where(np.linalg.norm(d, axis=1) == 0, 1, np.linalg.norm(d, axis=1))
    want = {"cosine": q @ d.T / np.linalg.norm(q, axis=1)[:, None] / dn, "dot": q @ d.T, "l2": -np.sqrt(dist**2 + 1e-9), "euclidean": -dist}[metric]
    for limit in (64 << 20, 100):  # shipped, then co-grouped blocks
        got = {(r.query_uid, r.uid): r.score for r in vo.similarity_scores(ds, qs, metric, limit_bytes=limit).collect()}
        assert len(got) == 350
        assert all(got[f"q{i}", f"d{j}"] == pytest.approx(want[i, j], abs=1e-6) for i in range(7) for j in range(50))


def test_function_similarity_is_mean_of_cosines(spark):
    rng = np.random.default_rng(5)
    d, q = rng.normal(size=(9, 4)), rng.normal(size=(6, 4))
    ds = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(d)], "uid string, vec array<double>")
    qs = spark.createDataFrame([("f" if i < 4 else "g", v.tolist()) for i, v in enumerate(q)], "func string, vec array<double>")
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (d / np.linalg.norm(d, axis=1)[:, None]).T
    got = {(r.func, r.uid): r.score for r in vo.function_similarity(ds, qs).collect()}
    assert all(got["f", f"d{j}"] == pytest.approx(cos[:4, j].mean()) for j in range(9))
    assert all(got["g", f"d{j}"] == pytest.approx(cos[4:, j].mean()) for j in range(9))


def test_whitening_gives_identity_moment(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(data)], "uid string, vec array<double>").repartition(4)
    cells = vo.second_moment(vo.whitened(df, damping=0.0)).collect()
    assert all(r.m == pytest.approx(1.0 if r.i == r.j else 0.0, abs=1e-6) for r in cells)


def test_passages_found_even_when_edges_continue(spark):
    ds = spark.createDataFrame(
        [("a", "xxhello big red worldly"), ("b", "hello big  red world"), ("c", "ok"), ("d", "we ok here")], "uid string, text string"
    )
    qs = spark.createDataFrame([("q", "hello big red world"), ("r", "ok")], "query_uid string, prompt string")
    assert rows(rel.containing_pairs(ds, qs)) == [("q", "a"), ("r", "c"), ("r", "d")]
