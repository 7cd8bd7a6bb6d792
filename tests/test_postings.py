"""The stored index against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from sourcerank.operators import bm25, postings, ranking
from sourcerank.session import shared_folder


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    rows = [(f"d{k:03}", " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for k in range(400)]
    rows += [("e1", ""), ("e2", None), ("d900", rows[0][1]), ("d901", rows[0][1])]
    docs = spark.createDataFrame(rows, "uid string, text string")
    asked = [(f"q{k}", " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(12)] + [("none", "unknown words"), ("empty", ""), ("rare", "w119")]
    return docs, spark.createDataFrame(asked, "query_uid string, prompt string").withColumn("completion", F.lit("w5"))


def same(got, want):
    cols = ["query_uid", "rank", "uid", "score"]
    return sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


@pytest.mark.parametrize("k", [1, 10, 500])
def test_top_k_equals_all_pairs(spark, corpus, k):
    docs, queries = corpus
    path = shared_folder(spark, "index")
    postings.write_index(docs, path)
    index = postings.open_index(spark, path)
    for completion in (False, True):
        found = postings.top_scores(index, queries, k, include_completion=completion)
        every = bm25.bm25_scores(docs, queries, include_completion=completion)
        assert same(ranking.top_k_complete(found, queries, docs, k), ranking.top_k_complete(every, queries, docs, k))


def test_negative_weights(spark):
    docs = spark.createDataFrame([(f"d{k}", "a b" if k % 3 else "a c") for k in range(30)], "uid string, text string")
    queries = spark.createDataFrame([("q", "a b", ""), ("r", "c", ""), ("s", "a", "")], "query_uid string, prompt string, completion string")
    index = postings.write_index(docs, shared_folder(spark, "index"), block_docs=4)
    found = postings.top_scores(index, queries, 5, epsilon=0.25)
    every = bm25.bm25_scores(docs, queries)
    assert every.filter("score < 0").count() > 0
    assert same(ranking.top_k_complete(found, queries, docs, 5), ranking.top_k_complete(every, queries, docs, 5))


def test_queries_without_a_gain_are_read_at_once(spark, monkeypatch):
    for name in ("CELL_TOKENS", "CELL_PAIRS"):
        monkeypatch.setattr(bm25, name, 20)
    docs = spark.createDataFrame([(f"d{k % 50}", "a b a" if k % 3 else "b c") for k in range(54)] + [(None, "a"), ("z", None)], "uid string, text string")
    queries = spark.createDataFrame([("q", "a b", ""), ("r", "b", ""), ("s", "c", "")], "query_uid string, prompt string, completion string")
    index = postings.write_index(docs, shared_folder(spark, "index"), block_docs=4)
    search = postings.Search(index, queries, 5)
    found = search.scores()
    lost = {r[0] for r in search.terms.groupBy("query_uid").agg(F.max("gain").alias("g")).filter("g <= 0").collect()}
    assert "r" in lost and "whole" in search.reads
    old = search._searched(search.terms)
    few = lambda df: sorted(map(tuple, df.filter(F.col("query_uid").isin(*lost)).collect()), key=repr)
    assert few(found) == few(old) and len(few(found)) > 50


def test_block_maxima(spark, corpus):
    docs, _ = corpus
    index = postings.write_index(docs, shared_folder(spark, "index"), block_docs=16)
    rows = index.blocks
    assert rows.filter(F.size("docs") != F.col("n")).count() == 0 and rows.filter("n > 16").count() == 0
    assert rows.filter(F.array_max(F.transform("docs", lambda d: d["x"])) != F.col("top")).count() == 0
    assert rows.agg(F.sum("n")).first()[0] == index.terms.filter("term is not null").agg(F.sum("df")).first()[0]


def test_no_documents_and_no_queries(spark, corpus):
    docs, queries = corpus
    empty = postings.write_index(docs.limit(0), shared_folder(spark, "index"))
    assert postings.top_scores(empty, queries, 3).count() == 0
    index = postings.write_index(docs, shared_folder(spark, "index"))
    assert postings.top_scores(index, queries.limit(0), 3).count() == 0


def test_reads_part_of_the_postings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").cast("string").alias("uid"), "text").repartition(8)
    asked = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").filter("item_id % 20 = 0")
    queries = asked.select(F.col("item_id").cast("string").alias("query_uid"), F.col("text").alias("prompt"))
    search = postings.Search(postings.write_index(table, shared_folder(spark, "index")), queries, 20)
    assert search.scores().groupBy("query_uid").count().filter("count >= 20").count() == queries.count()
    read = {r["step"]: r["n"] for r in search.postings_read().collect()}
    print(read)
    assert 4 * sum(n for s, n in read.items() if s != "all") < 3 * read["all"]


def test_partial_scores_of_a_small_query_set_are_not_shuffled(spark, corpus, monkeypatch):
    docs, queries = corpus
    twice = docs.unionByName(docs.filter("uid < 'd2'"))
    index = postings.write_index(twice, shared_folder(spark, "index"))
    search = postings.Search(index, queries, 10)
    small = search.scores()
    assert "Exchange" not in small._jdf.queryExecution().toString() and "round 3" in search.reads
    monkeypatch.setattr(postings, "SHIP_LIMIT_BYTES", 1)  # nothing travels
    large = postings.top_scores(index, queries, 10)
    assert "Exchange" in large._jdf.queryExecution().toString()
    every = ranking.top_k_complete(large, queries, docs, 10)
    assert same(ranking.top_k_complete(small, queries, docs, 10), every) and every.filter("score > 0").count() > 50


def test_blocks_follow_the_places_of_rows(spark, monkeypatch):
    monkeypatch.setattr(postings, "_BLOCKS_CUT", 2)
    docs = spark.createDataFrame([(f"u{k % 90:02}", "a b " * (k % 3 + 1)) for k in range(180)] + [("x", None)], "uid string, text string")
    rows = postings.write_index(docs, shared_folder(spark, "index"), block_docs=4).blocks.select("block", "term", F.inline("docs"))
    # Rows in order of length and uid; the text without terms has a place.
    order = [("x", 0)] + sorted(((f"u{k % 90:02}", k % 3 + 1) for k in range(180)), key=lambda r: (r[1], r[0]))
    want = {(k // 4, t, uid) for k, (uid, n) in enumerate(order) if n for t in "ab"}
    assert sorted(r[:3] for r in rows.collect()) == sorted(want)
