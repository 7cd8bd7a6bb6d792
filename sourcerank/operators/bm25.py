"""BM25 over DataFrames: term statistics, postings restricted to the query
vocabulary, and one long table of scores.

Shape of the plan: document frequencies need every term, so they are one
map-side-combined count, written as the index.  Scoring then reads the corpus
once more.  With a query set that is proven small, each document is scored in the
task that reads it and no posting is shuffled.  Otherwise documents and weighted
query terms meet in the cells of a grid, documents x queries: every document goes to
one cell of each column, every query to one of each row, and a (query, document) pair is
summed inside its cell, so that no pair is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import SHIP_LIMIT_BYTES, materialize

_TERM_ROW_BYTES = 64
# A cell of the grid: tokens of its documents, weighted terms of its queries, and pairs of both.
CELL_TOKENS = 1 << 20
CELL_WEIGHTS = 1 << 19
CELL_PAIRS = 1 << 20
# Tokens of one Arrow batch that are looked up at once, and numbers in a dense block.
_SLICE_TOKENS = 1 << 18
_BLOCK_CELLS = 4 << 20


def tokenized(docs: DataFrame, text: str = "text", uid: str = "uid", keep: Sequence[str] = (), **mode) -> DataFrame:
    """(uid, terms, doc_len) and the columns of ``keep``; a precomputed ``terms``
    array column is used as it is."""
    terms = F.col("terms") if "terms" in docs.columns else tx.terms(F.col(text), **mode)
    return docs.select(F.col(uid).alias("uid"), *keep, terms.alias("terms")).withColumn(
        "doc_len", F.size("terms")
    )


def build_index(tokens: DataFrame) -> DataFrame:
    """Term table (term, df, len_sum), written once and reused by every scorer.

    One pass over the corpus: each document contributes its distinct terms and one
    row under the null term, whose count is the number of documents and whose
    ``len_sum`` is the total length.  Counts combine before the shuffle, so a term
    found everywhere costs one row per task.  Size follows the vocabulary, not the
    corpus.
    """
    entries = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("terms"))
    return materialize(
        tokens.select("doc_len", F.explode(entries).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("doc_len").cast("bigint")).alias("len_sum"))
    )


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: number of documents and average length."""
    return index.filter("term IS NULL").select(
        F.col("df").alias("n_docs"), (F.col("len_sum") / F.col("df")).alias("avg_len")
    )


def _one(df: DataFrame, col: str) -> Column:
    return df.select(col).scalar()


def idf_table(index: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf): ln(N-df+.5) - ln(df+.5); negatives become epsilon x the mean idf."""
    n = _one(corpus_stats(index), "n_docs")
    raw = index.filter("term IS NOT NULL").select(
        "term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    floor = raw.agg(F.avg("raw").alias("m")).scalar() * F.lit(float(epsilon))
    return raw.select(
        "term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")
    )


def query_terms(queries: DataFrame, include_completion: bool = False, **mode) -> DataFrame:
    """(query_uid, term, qtf): query terms with their repetition."""
    body = tx.query_text(
        F.col("prompt"), F.col("completion") if include_completion else None
    )
    return (
        queries.select("query_uid", F.explode(tx.terms(body, **mode)).alias("term"))
        .groupBy("query_uid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def term_frequency(tokens: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(uid, term, tf, doc_len), limited to ``vocabulary`` when given."""
    exploded = tokens.select("uid", "doc_len", F.explode("terms").alias("term"))
    if vocabulary is not None:
        exploded = exploded.join(vocabulary, "term", "left_semi")
    return exploded.groupBy("uid", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(
    docs: DataFrame,
    queries: DataFrame,
    k1: float = 1.5,
    b: float = 0.75,
    epsilon: float = 0.25,
    include_completion: bool = False,
    decimals: int = 5,
    text: str = "text",
    index: DataFrame | None = None,
    keep: int | None = None,
    limit_bytes: int = SHIP_LIMIT_BYTES,
    **mode,
) -> DataFrame:
    """Long table (query_uid, uid, score) of every pair that shares a term.

    Pairs that score 0 are not stored; `ranking.top_k_complete` brings back the
    ones a top-k needs.  Scores are rounded to ``decimals`` so that equal documents
    tie exactly, whatever the order of summation.  ``keep`` leaves each query its best
    ``keep`` positive scores (ties by uid) and all negative ones: a pair that is not
    stored scores 0 and ranks before those.

    A query set proven to be small is scored in place; a larger one meets the
    documents in the cells of a grid.  Both give the same rows.
    """
    tokens = tokenized(docs, text=text, **mode)
    index = build_index(tokens) if index is None else index
    qt = query_terms(queries, include_completion, **mode)
    weights = qt.join(idf_table(index, epsilon).select("term", "idf"), "term").select(
        "term", "query_uid", (F.col("qtf") * F.col("idf")).alias("w")
    )
    avg_len = corpus_stats(index).select("avg_len")
    # At most `most` rows ever reach the driver; one more proves the set too large.
    most = max(1, limit_bytes // _TERM_ROW_BYTES)
    table = weights.limit(most + 1).toArrow()
    cells = len(table.column("term").unique()) * len(table.column("query_uid").unique())
    small = table.num_rows <= most and cells * 8 <= limit_bytes
    if small:
        raw = _scored_in_place(tokens, table, avg_len.first(), k1, b, decimals, keep)
    else:
        raw = _scored_by_join(tokens, weights, corpus_stats(index).first(), k1, b)
    scores = raw.withColumn("score", F.round("score", decimals)).filter("score <> 0")
    # Without a positive weight every pair stays; without a negative one a row's place alone decides,
    # and each task hands on no more than `keep` rows a query.
    if keep is None or (small and not pc.any(pc.greater(table.column("w"), 0.0)).as_py()):
        return scores
    place = F.row_number().over(W.partitionBy("query_uid").orderBy(F.col("score").desc(), "uid"))
    placed = scores.withColumn("__place", place)
    if small and not pc.any(pc.less(table.column("w"), 0.0)).as_py():
        return placed.filter(F.col("__place") <= keep).drop("__place")
    return placed.filter((F.col("__place") <= keep) | (F.col("score") < 0)).drop("__place")


def _scored_by_join(tokens, weights, stats, k1, b):
    """Any number of queries: documents, hashed by uid, meet the weighted query terms in a grid.

    Rows of one uid are one document for each length, and their scores are added.
    """
    n_docs, avg_len = (stats["n_docs"], stats["avg_len"]) if stats else (0, None)
    mean_len = float(avg_len) if avg_len else 1.0

    def postings(table: pa.Table):
        terms = table.column("terms").combine_chunks()
        uids = pc.dictionary_encode(table.column("uid").combine_chunks(), null_encoding="encode")
        length = pc.fill_null(table.column("doc_len"), 0).to_numpy().astype(np.int64)
        sizes = np.maximum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False), 0)
        both = uids.indices.to_numpy().astype(np.int64) * (int(length.max(initial=0)) + 1) + length
        _, first, of = np.unique(both, return_index=True, return_inverse=True)
        words = pc.dictionary_encode(terms.flatten(), null_encoding="encode")
        width = max(1, len(words.dictionary))
        pair, tf = np.unique(np.repeat(of, sizes) * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        doc, term = np.divmod(pair, width)
        x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[first][doc] / mean_len))
        return uids.dictionary, uids.indices.to_numpy()[first][doc], words.dictionary, term, x

    return scored_in_cells(tokens.select("uid", "terms", "doc_len"), F.xxhash64("uid"), weights, n_docs, n_docs * mean_len, postings)


def scored_in_cells(rows: DataFrame, key: Column, weights: DataFrame, n_docs: float, n_postings: float, postings: Callable) -> DataFrame:
    """(query_uid, uid, score): sums of weight x ``x`` over the terms a query and a document share.

    ``rows`` hold the documents, the same document under one value of ``key`` (a whole number);
    ``postings`` makes (uids, doc, words, term, x) of an Arrow table of them: the document, in
    ascending order, the word and the share of each posting, the first as a place in ``uids``,
    the second as one in ``words``.  ``n_docs`` and ``n_postings`` decide how many cells there are.
    """
    size = weights.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("query_uid").alias("queries")).first()
    columns = max(1, math.ceil(size["rows"] / CELL_WEIGHTS))
    lines = max(1, math.ceil(n_postings / CELL_TOKENS), math.ceil(n_docs * size["queries"] / columns / CELL_PAIRS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__line", F.pmod(key, F.lit(lines)).cast("int")).withColumn("__column", every(columns))
    right = weights.select("term", "query_uid", "w", F.pmod(F.xxhash64("query_uid"), F.lit(columns)).cast("int").alias("__column"))
    right = right.withColumn("__line", every(lines))
    cell = ["__line", "__column"]

    def score(docs: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and table.num_rows:
            uids, doc, words, term, x = postings(docs)
            for vocab, names, block in _weight_blocks(table):
                ids = pc.fill_null(pc.index_in(words, vocab), -1).to_numpy(zero_copy_only=False)[term]
                held = ids >= 0
                out += _summed(doc[held], ids[held], x[held], len(uids), uids, block, names, 0.0, None)
        return pa.Table.from_batches(out, _SCORES)

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(score, "query_uid string, uid string, score double")


_SCORES = pa.schema([("query_uid", pa.string()), ("uid", pa.string()), ("score", pa.float64())])


def _weight_blocks(table: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(terms, queries, weights of terms x queries): blocks of whole queries, at most ``_BLOCK_CELLS`` large
    where a block holds more than one query."""
    coded = pc.dictionary_encode(table.column("query_uid").combine_chunks(), null_encoding="encode")
    number = coded.indices.to_numpy().astype(np.int64)
    todo = [(0, len(coded.dictionary))]
    while todo:
        first, last = todo.pop()
        part = table.filter(pa.array((number >= first) & (number < last)))
        vocab = part.column("term").combine_chunks().unique()
        if last - first > 1 and len(vocab) * (last - first) > _BLOCK_CELLS:
            todo += [((first + last) // 2, last), (first, (first + last) // 2)]
            continue
        names = coded.dictionary.slice(first, last - first)
        block = np.zeros((len(vocab), last - first))
        block[pc.index_in(part.column("term"), vocab).to_numpy(), number[(number >= first) & (number < last)] - first] = part.column("w").to_numpy()
        yield vocab, np.asarray(names.to_pylist(), dtype=object), block


def _summed(doc, term, x, n, uids, block, names, least, keep) -> Iterator[pa.RecordBatch]:
    """Scores of ``n`` documents with every query, from postings in the order of their documents.

    Whole documents per slice, so that neither the product nor the block of scores has many
    more than ``rows_at_once`` rows; `doc` is sorted, so sums are over runs.
    """
    rows_at_once = max(1, (32 << 20) // (8 * max(1, len(names))))
    cuts = np.searchsorted(doc, np.arange(n + 1))
    first = 0
    while first < n:
        last = int(np.searchsorted(cuts, cuts[first] + rows_at_once, side="right")) - 1
        last = min(max(last, first + 1), first + rows_at_once, n)
        lo, hi = cuts[first], cuts[last]
        if hi > lo:
            starts = np.flatnonzero(np.r_[True, doc[lo + 1 : hi] != doc[lo : hi - 1]])
            scores = np.add.reduceat(block[term[lo:hi]] * x[lo:hi, None], starts, axis=0)
            found = np.abs(scores) >= least
            if keep is not None and keep < len(scores):
                # What rounding may lift to the edge stays.
                edge = -np.partition(-scores, keep - 1, axis=0)[keep - 1] - 2 * least
                found &= (scores >= edge) | (scores < 0)
            d, q = np.nonzero(found if least else scores)
            if len(d):
                own = uids.take(pa.array(doc[lo:hi][starts][d]))
                yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), own, pa.array(scores[d, q])], schema=_SCORES)
        first = last


def _scored_in_place(tokens, table: pa.Table, avg_len, k1, b, decimals, keep):
    """A proven-small query set: every document is scored where it is read.

    The weights travel to the tasks as a [terms x queries] block, each Arrow batch
    of documents becomes term frequencies of that vocabulary, some documents at a time, and
    one product gives their scores.  Nothing is shuffled.
    """
    vocab = table.column("term").combine_chunks().unique()
    qids = table.column("query_uid").combine_chunks().unique()
    block = np.zeros((len(vocab), len(qids)))
    block[
        pc.index_in(table.column("term"), vocab).to_numpy(), pc.index_in(table.column("query_uid"), qids).to_numpy()
    ] = table.column("w").to_numpy()
    names = np.asarray(qids.to_pylist(), dtype=object)
    mean_len = float(avg_len[0]) if avg_len and avg_len[0] else 1.0
    least = 0.4 * 10.0**-decimals  # anything smaller rounds to 0

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms, n = batch.column("terms"), batch.num_rows
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(pc.index_in(terms.flatten(), vocab), -1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(n), sizes)[ids >= 0]
        if not len(doc):
            return
        pair, tf = np.unique(doc * len(vocab) + ids[ids >= 0], return_counts=True)
        doc, term = np.divmod(pair, len(vocab))
        length = batch.column("doc_len").to_numpy(zero_copy_only=False)[doc] / mean_len
        x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
        yield from _summed(doc, term, x, n, batch.column("uid"), block, names, least, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + _SLICE_TOKENS, side="right")))
                yield from scored(batch.slice(first, last - first))
                first = last

    return tokens.mapInArrow(run, "query_uid string, uid string, score double")
