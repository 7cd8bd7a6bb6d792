"""The pipeline's stages, each on its own input, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sourcerank.llm.common import stored

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        out.append(docs.cache())
    return out


def test_columns_and_order(results):
    assert [r.columns for r in results[:-1]] == [COLUMNS] * 4
    counts = [r.count() for r in results[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_one_of_each_group_stays(results):
    from fractions import Fraction

    from sourcerank.llm import jaccard_join

    linked = jaccard_join.linked(results[0], 5, Fraction(8, 10))
    want = {r.doc_id for r in linked.filter("doc_id = component_id").collect()}
    assert {r.doc_id for r in results[1].collect()} == want


def test_repeats_are_gone_and_other_texts_stay(results):
    before = {r.doc_id: r.text for r in results[1].collect()}
    times = {}
    for t in before.values():
        raw = t.encode()
        for k in range(len(raw) - 199):
            times[raw[k : k + 200]] = times.get(raw[k : k + 200], 0) + 1
    after = {r.doc_id: r.text for r in results[2].collect()}
    for i, t in before.items():
        raw = t.encode()
        repeated = any(times[raw[k : k + 200]] > 1 for k in range(len(raw) - 199))
        assert repeated or after[i] == t
        if repeated and i in after:
            assert len(after[i]) < len(t)


def test_contaminated_documents_go(spark, results):
    from sourcerank.llm import decontaminate

    found = decontaminate.matches(results[2], spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    clean = {r.doc_id for r in found.filter("not contaminated").collect()}
    assert {r.doc_id for r in results[3].collect()} == clean


def test_all_that_is_left_is_packed(results):
    assert results[4].select("doc_id").distinct().count() == results[3].count()
    assert results[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_stages_on_odd_rows(spark, docs, no_docs):
    for rows in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, FOLDER)
            assert out.columns == rows.columns, name
            out.count()


def test_registered():
    names = entry.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    assert "pipeline" not in entry.oracle_sql()
