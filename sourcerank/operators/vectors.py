"""Vectors: centroids, dense similarity, sketches, whitening, self-influence.

Dense [queries x documents] products run as numpy blocks inside tasks.  Queries
travel in blocks whose size was checked: one block for a small query set, one
after the other for a larger one.  Each block is a pass over the documents without
a shuffle, and a task holds a bounded slice of scores at a time.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import SHIP_LIMIT_BYTES, fits, ship_if_small
from .positions import exact_quantiles

# Bytes of scores or sketches that a task holds at once.
SCORE_BYTES = 32 << 20
SCORES_SCHEMA = "query_uid string, uid string, score double"


def coordinates(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """(keys, i, x): one row per coordinate."""
    return df.select(*keys, F.posexplode(vec).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """(keys, centroid, n): coordinate-wise mean.

    Sums are combined before the shuffle, so a hot key costs one partial row per
    coordinate and task; the regrouped array is as long as the vector.
    """
    means = coordinates(df, keys, vec).groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"),
        F.max("n").alias("n"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _rows_to_unit(rows: np.ndarray, eps: float) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1) + eps
    return rows / np.where(length == 0, 1.0, length)[:, None]


def _block_scores(docs: np.ndarray, queries: np.ndarray, metric: str, eps: float) -> np.ndarray:
    """[queries x documents] scores for one block ('unit_docs': documents normalized, queries as given)."""
    if metric in ("cosine", "unit_docs"):
        docs = _rows_to_unit(docs, eps)
    if metric == "cosine":
        queries = _rows_to_unit(queries, eps)
    product = queries @ docs.T
    if metric in ("cosine", "unit_docs", "dot"):
        return product
    sq = (queries**2).sum(1)[:, None] + (docs**2).sum(1)[None, :] - 2 * product
    if metric == "l2":
        return -np.sqrt(np.maximum(sq, 0.0) + 1e-9)
    if metric == "euclidean":
        return -np.sqrt(np.maximum(sq, 0.0))
    raise ValueError(f"unknown metric {metric}")


def _long(uids, qids, scores: np.ndarray, decimals: int | None, keep: int | None) -> pa.RecordBatch:
    if decimals is not None:
        scores = np.round(scores, decimals)
    uids = np.asarray(uids, dtype=object)
    if keep is not None and keep < scores.shape[1]:
        # Keep everything at or above each query's keep-th score: exact under ties.
        edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        qi, di = np.nonzero(scores >= edge[:, None])
    else:
        qi, di = np.divmod(np.arange(scores.size), scores.shape[1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(qids, dtype=object)[qi], pa.string()),
            pa.array(uids[di], pa.string()),
            pa.array(scores[qi, di] + 0.0, pa.float64()),
        ],
        names=["query_uid", "uid", "score"],
    )


def similarity_scores(
    docs: DataFrame,
    queries: DataFrame,
    metric: str = "cosine",
    decimals: int | None = None,
    keep: int | None = None,
    eps: float = 0.0,
    limit_bytes: int = SHIP_LIMIT_BYTES,
) -> DataFrame:
    """Long scores of every (query, document) pair.

    ``docs`` has (uid, vec), ``queries`` has (query_uid, vec).  With ``keep`` each
    batch emits only rows that can be among a query's best ``keep``; follow with
    ``ranking.top_k``.  ``eps`` is added to norms in the cosine.
    """
    d = docs.select("uid", "vec")
    parts = [_shipped(d, block, metric, decimals, keep, eps) for block in _query_blocks(queries.select("query_uid", "vec"), limit_bytes)]
    return reduce(DataFrame.unionByName, parts)


def _query_blocks(queries: DataFrame, limit_bytes: int, key: str = "query_uid") -> Iterator[pa.Table]:
    """The query rows in blocks of about ``limit_bytes``, cut by hash; at least one block."""
    width = queries.select(F.max(F.size("vec"))).first()[0] or 1
    blocks = 1 if fits(queries, width * 8, limit_bytes) else math.ceil(queries.count() * width * 8 / limit_bytes)
    for b in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        yield block.toArrow()  # one block


def _shipped(d, table, metric, decimals, keep, eps):
    qids = table.column("query_uid").to_pylist()
    qmat = _matrix(table.column("vec").combine_chunks()) if qids else np.zeros((0, 1))
    rows_at_once = max(1, SCORE_BYTES // (8 * max(1, len(qids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if qids else 0, rows_at_once):
                part = batch.slice(at, rows_at_once)
                block = _block_scores(_matrix(part.column("vec")), qmat, metric, eps)
                yield _long(part.column("uid").to_pylist(), qids, block, decimals, keep)

    return d.mapInArrow(run, SCORES_SCHEMA)


def function_similarity(docs: DataFrame, queries: DataFrame, decimals: int | None = None, eps: float = 0.0) -> DataFrame:
    """(func, uid, score): mean cosine of a document to a function's queries.

    Cosine is linear in the unit query vector, so the queries of a function are
    averaged first and each document meets one vector per function.
    """
    units = queries.select("func", vx.unit(F.col("vec"), eps).alias("vec"))
    means = centroids(units, ["func"]).select(F.col("func").alias("query_uid"), F.col("centroid").alias("vec"))
    return similarity_scores(docs, means, "unit_docs", decimals, eps=eps).withColumnRenamed("query_uid", "func")


@functools.lru_cache(maxsize=64)
def _places(part: str, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each coordinate of a named part."""
    digests = [hashlib.md5(f"{part}:{i}".encode()).hexdigest() for i in range(n)]
    return np.array([int(h[:8], 16) % width for h in digests]), np.array([1.0 if int(h[8], 16) < 8 else -1.0 for h in digests])


def count_sketch(df: DataFrame, width: int, name: str = "", vec: str = "vec", by: str | None = None) -> DataFrame:
    """Vectors replaced by their count sketch of ``width`` buckets.

    Bucket and sign of a coordinate come from md5(name:coordinate), so every task
    and every run uses the same projection, and rows are projected where they are
    read: nothing is shuffled.  ``by`` is a column that names each row's projection.
    """
    names = df.columns
    schema = df.withColumn(vec, F.col(vec).cast("array<double>")).schema
    rows_at_once = max(1, SCORE_BYTES // (8 * width))

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(names.index(vec))
        parts = np.array(batch.column(names.index(by)).to_pylist() if by else [name] * batch.num_rows, object)
        out = np.zeros((batch.num_rows, width))
        for part in dict.fromkeys(parts.tolist()):
            mine = np.flatnonzero(parts == part)
            rows = _matrix(column.take(pa.array(mine)))
            bucket, sign = _places(part, rows.shape[1], width)
            sums = np.zeros((width, len(mine)))
            np.add.at(sums, bucket, (rows * sign).T)
            out[mine] = sums.T
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                yield _replaced(part, names, vec, projected(part))

    return df.mapInArrow(run, schema)


def summed_sketch(parts: DataFrame, width: int, contains: str | None = None, vec: str = "vec") -> DataFrame:
    """(uid, bucket, value): one sketch for each uid over its named parts (uid, module, vec).

    Each part has the projection of its name; ``contains`` keeps parts whose name has the
    text.  Sums are combined before the shuffle; buckets that are 0 are left out.
    """
    kept = parts if contains is None else parts.filter(F.contains("module", F.lit(contains)))
    cells = coordinates(count_sketch(kept.select("uid", "module", vec), width, vec=vec, by="module"), ["uid"], vec)
    return cells.filter("x <> 0").groupBy("uid", F.col("i").alias("bucket")).agg(F.sum("x").alias("value")).filter("value <> 0")


def _replaced(batch: pa.RecordBatch, names: list[str], vec: str, rows: np.ndarray) -> pa.RecordBatch:
    """The batch with its vector column set to ``rows``."""
    offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()))
    return pa.RecordBatch.from_arrays([lists if n == vec else batch.column(n) for n in names], names=names)


def total_over_modules(scores: DataFrame, contains: str | None = None) -> DataFrame:
    """Sum of per-module scores; ``contains`` keeps modules whose name has the text."""
    kept = scores if contains is None else scores.filter(F.contains("module", F.lit(contains)))
    return kept.groupBy("query_uid", "uid").agg(F.sum("score").alias("score"))


def self_influence(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(uid, self_influence): squared norms summed over a document's modules."""
    return df.groupBy("uid").agg(F.sum(vx.squared_norm(F.col(vec))).alias("self_influence"))


def second_moment(df: DataFrame, vec: str = "vec", by: str | None = None) -> DataFrame:
    """(i, j, m): mean outer product of the vectors, upper and lower half; with ``by`` one for each of its values.

    Each batch adds up its own d x d product; what is shuffled is one small
    matrix per task and module.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, np.ndarray] = {}
        count: dict[str | None, int] = {}
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), object)
            for g in dict.fromkeys(groups.tolist()):
                rows = _matrix(batch.column(0).take(pa.array(np.flatnonzero(groups == g))))
                total[g] = total.get(g, 0) + rows.T @ rows
                count[g] = count.get(g, 0) + len(rows)
        for g, sums in total.items():
            i, j = np.divmod(np.arange(sums.size), sums.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * sums.size, pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel()), pa.array(np.full(sums.size, count[g]), pa.int64())],
                names=["g", "i", "j", "s", "n"],
            )

    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    parts = df.select(vec, group.alias("g")).mapInArrow(gram, "g string, i int, j int, s double, n bigint")
    cells = parts.groupBy("g", "i", "j").agg((F.sum("s") / F.sum("n")).alias("m"))
    return cells.withColumnRenamed("g", by) if by else cells.drop("g")


def whitened(df: DataFrame, damping: float = 1e-6, vec: str = "vec", moment: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Vectors times the inverse square root of their second moment, or of that of their module (``by``).

    The d x d moments are the only thing the driver sees, and their roots travel to the
    tasks; cut wide gradients into modules.
    """
    cells = (moment if moment is not None else second_moment(df, vec, by)).toArrow()
    groups = np.array(cells.column(by).to_pylist() if by else [None] * cells.num_rows, object)
    i, j, m = (cells.column(c).to_numpy() for c in ("i", "j", "m"))
    roots: dict[str | None, np.ndarray] = {}
    for g in dict.fromkeys(groups.tolist()):
        mine = np.flatnonzero(groups == g) if by else slice(None)
        mat = np.zeros((int(i[mine].max()) + 1,) * 2)
        mat[i[mine], j[mine]] = m[mine]
        values, basis = np.linalg.eigh((mat + mat.T) / 2)
        roots[g] = (basis / np.sqrt(np.maximum(values, 0.0) + damping)) @ basis.T
    shared = df.sparkSession.sparkContext.broadcast(roots)
    names = df.columns
    schema = df.withColumn(vec, F.col(vec).cast("array<double>")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([str(x) if x is not None else None for x in batch.column(names.index(by)).to_pylist()] if by else [None] * batch.num_rows, object)
            for g in dict.fromkeys(own.tolist()):
                part = batch.take(pa.array(np.flatnonzero(own == g)))
                yield _replaced(part, names, vec, _matrix(part.column(names.index(vec))) @ shared.value[g])

    return df.mapInArrow(apply, schema)


def blocked_dot(docs: DataFrame, queries: DataFrame, limit_bytes: int = SHIP_LIMIT_BYTES) -> DataFrame:
    """Dot products from feature chunks: (uid, chunk, vec) x (query_uid, chunk, vec).

    A block of queries travels with all its chunks; each chunk of a document meets the
    queries' same chunk where it is read, and partial products are summed.  Vectors longer
    than a row can hold never meet whole.
    """
    parts = [_chunk_products(docs.select("uid", "chunk", "vec"), block) for block in _query_blocks(queries.select("query_uid", "chunk", "vec"), limit_bytes)]
    return reduce(DataFrame.unionByName, parts).groupBy("query_uid", "uid").agg(F.sum("score").alias("score"))


def _chunk_products(docs: DataFrame, table: pa.Table) -> DataFrame:
    chunks = table.column("chunk").to_numpy()
    vecs, qids = table.column("vec").combine_chunks(), np.array(table.column("query_uid").to_pylist(), object)
    held = {c: (qids[chunks == c], _matrix(vecs.take(pa.array(np.flatnonzero(chunks == c))))) for c in set(chunks.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("chunk").to_numpy()
            for c in set(own.tolist()) & held.keys():
                ids, block = held[c]
                mine = np.flatnonzero(own == c)
                step = max(1, SCORE_BYTES // (8 * len(ids)))
                for at in range(0, len(mine), step):
                    part = batch.take(pa.array(mine[at : at + step]))
                    yield _long(part.column("uid").to_pylist(), ids, block @ _matrix(part.column("vec")).T, None, None)

    return docs.mapInArrow(run, SCORES_SCHEMA)


def chunked(df: DataFrame, key: str, size: int, vec: str = "vec") -> DataFrame:
    """Cut vectors into (key, chunk, vec) rows of ``size`` coordinates."""
    starts = F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / size).cast("int"))
    return df.select(key, vec, F.explode(starts).alias("chunk")).select(
        key, "chunk", F.slice(F.col(vec), F.col("chunk") * size + 1, size).alias("vec")
    )


def pooled(states: DataFrame, how: str = "mean") -> DataFrame:
    """One vector per uid from (uid, pos, valid, vec): mean over valid positions or the last valid one."""
    valid = states.filter("valid")
    if how == "last":
        return valid.groupBy("uid").agg(F.max_by("vec", "pos").alias("vec"))
    return centroids(valid, ["uid"]).select("uid", F.col("centroid").alias("vec"))


def group_vector_stats(df: DataFrame, group: str = "func", vec: str = "vec") -> DataFrame:
    """Per group: count, norm mean/std/median, centroid norm, mean cosine to the centroid."""
    cents = centroids(df, [group], vec).select(group, "centroid")
    rows = df.select(group, F.col(vec).alias("v"), vx.norm(F.col(vec)).alias("norm"))
    # One group may own a third of the rows: ship the centroids when proven small.
    width = cents.select(F.max(F.size("centroid"))).first()[0] or 1
    rows = rows.join(ship_if_small(cents, 8 * width), group)
    cn = vx.norm(F.col("centroid"))
    cosine = vx.dot(F.col("v"), F.col("centroid")) / ((F.col("norm") + 1e-12) * (cn + 1e-12))
    stats = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("norm").alias("avg_norm"),
        F.stddev_pop("norm").alias("std_norm"),
        F.max(cn).alias("centroid_norm"),
        F.avg(cosine).alias("avg_cos_to_centroid"),
    )
    medians = exact_quantiles(rows.select(group, "norm"), [group], "norm", [0.5]).select(
        group, F.col("value").alias("median_norm")
    )
    return stats.join(medians, group)


def centroid_similarity(df: DataFrame, group: str = "func", vec: str = "vec") -> DataFrame:
    """Cosine of every pair of group centroids, each pair once."""
    c = centroids(df, [group], vec)
    a = c.select(F.col(group).alias("uid"), F.col("centroid").alias("vec"))
    both = similarity_scores(a, a.withColumnRenamed("uid", "query_uid"), "cosine", eps=1e-12)
    return both.filter("query_uid < uid").select(F.col("query_uid").alias("a"), F.col("uid").alias("b"), F.col("score").alias("cosine"))
