"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform) and hashed to the nearest signed axis; a table's key joins the axes of
several rotations.  All rows are put into every table; a query looks at the bucket of its own
key and at those of the next best axes.  Candidates are reranked exactly by Euclidean distance
on the original vectors.

Queries are a stated part of the rows.  Their keys are few for each query, and only the best
``k`` candidates of a query leave a task, so a bucket that holds a third of all rows costs a
pass over its rows and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ranges, stored

# Bytes of query vectors that are compared at once; more queries go in blocks.
QUERY_BYTES = 32 << 20
# Bucket hits that one step looks at, and bytes of differences it holds.
PAIRS_AT_ONCE = 2_000_000
PAIR_BYTES = 64 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width must be a power of two."""
    n, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return x / size**0.5


@dataclass
class Tables:
    """Signs of the rotations: (table, rotation in a key, round, width)."""

    signs: np.ndarray

    @staticmethod
    def fresh(dim: int, tables: int, rotations: int, seed: int = 7) -> Tables:
        size = 1 << max(0, dim - 1).bit_length()
        return Tables(np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, size)).astype(np.float32))

    def rotated(self, unit: np.ndarray, table: int, rotation: int) -> np.ndarray:
        size = self.signs.shape[3]
        x = np.zeros((len(unit), size), np.float32)
        x[:, : unit.shape[1]] = unit
        for signs in self.signs[table, rotation]:
            x = hadamard(x * signs)
        return x

    def keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row in one table."""
        size = self.signs.shape[3]
        key = np.zeros(len(unit), np.int64)
        for r in range(self.signs.shape[1]):
            turned = self.rotated(unit, table, r)
            axis = np.abs(turned).argmax(1)
            key = key * 2 * size + axis * 2 + (turned[np.arange(len(unit)), axis] < 0)
        return key

    def probes(self, unit: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` likeliest buckets of each row: axes by how much their response falls short."""
        size = self.signs.shape[3]
        keys, costs = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for r in range(self.signs.shape[1]):
            turned = self.rotated(unit, table, r)
            both = np.stack([turned, -turned], 2).reshape(len(unit), -1)
            axes = np.argsort(-both, axis=1, kind="stable")[:, :count]
            top = np.take_along_axis(both, axes, 1)
            short = (top[:, :1] - top) ** 2
            # Both lists ascend in cost, so pair (i, j) has (i + 1)(j + 1) - 1 others before it.
            i, j = np.nonzero(np.arange(1, keys.shape[1] + 1)[:, None] * np.arange(1, axes.shape[1] + 1) <= count)
            keys, costs = keys[:, i] * 2 * size + axes[:, j], costs[:, i] + short[:, j]
            best = np.argsort(costs, axis=1, kind="stable")[:, :count]
            keys, costs = np.take_along_axis(keys, best, 1), np.take_along_axis(costs, best, 1)
        return keys


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is neither zero nor holds null or non-finite parts."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return (scaled / np.sqrt((scaled**2).sum(1, keepdims=True))).astype(np.float32)


def _compared(ids: np.ndarray, queries: np.ndarray, rows: np.ndarray, x: np.ndarray, q: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of pairs (query number, row number) for each query, measured on the vectors."""
    other = ids[q] != rows[r]
    q, r = q[other], r[other]
    far = np.empty(len(q))
    step = max(1, PAIR_BYTES // (16 * x.shape[1]))
    for at in range(0, len(q), step):
        gap = queries[q[at : at + step]] - x[r[at : at + step]]
        far[at : at + step] = np.sqrt((gap * gap).sum(1))
    order = np.lexsort((rows[r], far, q))
    q, r, far = q[order], r[order], far[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return ids[q[kept]], rows[r[kept]], far[kept]


def _search(index: Tables | None, ids: np.ndarray, queries: np.ndarray, probes: int, k: int):
    """A pass over rows that keeps each query's ``k`` best candidates of some rows.

    Without an index every row is a candidate.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: list[tuple[np.ndarray, np.ndarray]] = []
        for table in range(len(index.signs) if index else 0):
            keys = index.probes(_unit(queries), table, probes)
            order = np.argsort(keys.ravel(), kind="stable")
            lookup.append((keys.ravel()[order], order // keys.shape[1]))
        for batch in batches:
            rows, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if index:
                unit = _unit(x)
                own = [index.keys(unit, t) for t in range(len(lookup))]
                lo = np.stack([np.searchsorted(keys, o, "left") for (keys, _), o in zip(lookup, own)])
                hi = np.stack([np.searchsorted(keys, o, "right") for (keys, _), o in zip(lookup, own)])
                hits = np.cumsum((hi - lo).sum(0))
            else:
                hits = np.arange(1, len(rows) + 1) * len(ids)
            first = 0
            while first < len(rows):
                done = hits[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(hits, done + PAIRS_AT_ONCE, "right")))
                here = np.arange(first, last)
                if index:
                    pairs = [np.zeros(0, np.int64)]
                    for (_, owner), a, b in zip(lookup, lo[:, first:last], hi[:, first:last]):
                        pairs.append(owner[ranges(a, b - a)] * (last - first) + np.repeat(here - first, b - a))
                    pairs = np.unique(np.concatenate(pairs))
                else:
                    pairs = np.arange(len(ids) * (last - first))
                q, r = pairs // (last - first), pairs % (last - first) + first
                found = _compared(ids, queries, rows, x, q, r, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])
                first = last

    return read


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    tables: int = 48,
    rotations: int = 2,
    probes: int = 160,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found for each query row.

    ``is_query`` is a condition on ``vec_id``.  The score is the Euclidean distance in double
    precision; ties go to the smaller vec_id.  A query with fewer than ``k`` candidates in its
    buckets is compared with all rows, so none goes short while candidates are left.  Rows
    without an id, with a null or zero vector, or with null or non-finite parts take no part;
    vectors must have one width among those that do, else an error says so.  Rows that share
    an id are candidates of their own and as queries count once.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    widths = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of different widths: {widths[0]} to {widths[1]}")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths[0] is None:
        return empty
    index = Tables.fresh(widths[0], tables, rotations)
    found = _all_blocks(rows, rows.filter(is_query), index, probes, k, widths[0], query_bytes)
    if found is None:
        return empty
    found = stored(found)
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stored(rows.filter(is_query).join(full, "vec_id", "left_anti"))
    rest = _all_blocks(rows, short, None, probes, k, widths[0], query_bytes)
    if rest is None:
        return found
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").union(rest)


def _all_blocks(rows: DataFrame, queries: DataFrame, index: Tables | None, probes: int, k: int, width: int, query_bytes: int) -> DataFrame | None:
    """The search for all queries, in blocks of about ``query_bytes``; None if there are none."""
    blocks = -(-queries.count() * width * 8 // query_bytes)
    out = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).groupBy("vec_id").agg(F.min("v").alias("v"))
        held = block.toArrow().combine_chunks()
        if not held.num_rows:
            continue
        ids, matrix = held.column(0).to_numpy(), _matrix(held.column(1).combine_chunks())
        found = _best(rows.mapInArrow(_search(index, ids, matrix, probes, k), "query_id long, vec_id long, score double"), k)
        out = found if out is None else out.union(found)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query; tasks keep no more before the shuffle."""
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
