"""What tasks hold at once where rows are large."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sourcerank import session
from sourcerank.operators import bm25, postings, ranking
from sourcerank.session import shared_folder, small_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_bytes(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return [r[0] for r in df.mapInArrow(run, "n long").collect()]


def row_groups(folder):
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder.removeprefix('file:')}/*.parquet")]
    return [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]


def test_small_batches(spark):
    rows = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    before = spark.conf.get(KEY, None)
    assert max(batch_bytes(rows)) > 32 << 20
    with small_batches(spark):
        assert max(batch_bytes(rows)) <= session.BATCH_BYTES + (2 << 20)
    assert spark.conf.get(KEY, None) == before
    spark.conf.set(KEY, "1000")
    with small_batches(spark):
        assert spark.conf.get(KEY) == "1000"
    spark.conf.unset(KEY)


def test_run_sums():
    rng = np.random.default_rng(1)
    matrix, words, x = rng.random((30, 7)), rng.integers(0, 30, 500), rng.random(500)
    starts = np.unique(np.append(0, rng.integers(0, 500, 90)))
    whole = np.add.reduceat(matrix[words] * x[:, None], starts, axis=0)
    most = postings._AT_ONCE
    try:
        for postings._AT_ONCE in (1, 50, most):
            assert (postings.run_sums(matrix, words, x, starts) == whole).all()
    finally:
        postings._AT_ONCE = most


def test_index_of_long_documents(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(4000)]
    rows = [(f"d{k}", " ".join(rng.choices(words, k=1500 if k % 2 else rng.randint(1, 40)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "uid string, text string").coalesce(1)
    queries = spark.createDataFrame([(f"q{k}", " ".join(rng.choices(words, k=20)), "") for k in range(5)], "query_uid string, prompt string, completion string")
    path = shared_folder(spark, "index")
    assert int(postings._WRITTEN["parquet.block.size"]) <= 8 << 20
    monkeypatch.setitem(postings._WRITTEN, "parquet.block.size", str(1 << 17))
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        index = postings.write_index(docs, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    sizes = row_groups(f"{path}/blocks")
    assert len(sizes) > 1 and max(sizes) < 1 << 20
    every = bm25.bm25_scores(docs, queries)
    for most in (100_000, session.BATCH_BYTES):
        monkeypatch.setattr(session, "BATCH_BYTES", most)
        got = ranking.top_k_complete(postings.top_scores(index, queries, 10), queries, docs, 10)
        want = ranking.top_k_complete(every, queries, docs, 10)
        cols = ["query_uid", "rank", "uid", "score"]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_large_rows_are_stored_in_small_groups(spark):
    common = pytest.importorskip("sourcerank.llm.common")
    rows = spark.range(0, 40, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15_000)), lambda k: F.md5(F.concat_ws("-", "id", k.cast("string")))), "").alias("t"))
    with common.noted() as folders:
        table = common.stored(rows, large_rows=True)
    assert table.count() == 40
    sizes = row_groups(folders[0])
    assert len(sizes) > 1 and max(sizes) < 12 << 20


def test_token_alignment_reads_small_batches(spark, monkeypatch):
    ta = pytest.importorskip("sourcerank.llm.token_alignment")
    from sourcerank.llm import common
    from sourcerank.llm.subwords import tokenizer_file

    df = spark.createDataFrame([(1, "plain words"), (2, None), (None, "more of them")], "doc_id long, text string")
    seen, own = [], common.stored

    def stored(rows, **options):
        seen.append((options.get("large_rows", False), spark.conf.get(KEY)))
        return own(rows, **options)

    monkeypatch.setattr(common, "stored", stored)
    found = ta.scored(df, tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
    assert found.count() == 3 and seen[0] == (True, str(session.BATCH_BYTES))
