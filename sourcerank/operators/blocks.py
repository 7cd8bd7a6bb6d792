"""Matrices as rows of blocks: products, second moments and inverse square roots that no task holds whole.

A matrix is a table (i, j, height, data): block row, block column, the rows of the block and its
values, row after row, as 64-bit floats.  A product is partitioned in two dimensions: every
block of the left matrix goes to each block column of the result and every block of the right
one to each block row, dealt by the result's (i, j).  A task meets the two factors of one
term at a time, sorted by the inner index, and adds it to one block of the result.  Nothing is
broadcast, and the driver sees counts and norms only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = "i int, j int, height int, data binary"
_FIELDS = ["i", "j", "height", "data"]
ROWS_PER_BLOCK = 1024


def _block(i: int, j: int, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([len(values)], pa.int32()), pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _FIELDS)


def _values(height: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(height, -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row after the other, so that a batch of blocks is not copied at once."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c[k].as_py() for c in batch.columns]


def row_blocks(chunks: DataFrame, key: str = "uid", rows: int = ROWS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(matrix, names): rows (key, chunk, vec) as blocks of about ``rows`` keys.

    Block rows are dealt by the hash of the key and sorted by it inside; ``names`` has
    (i, place, key).  A key has each chunk once, and all keys have the same chunks.
    """
    n = max(1, -(-chunks.filter(F.col("chunk") == 0).count() // rows))
    slot = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    placed = chunks.select(slot.alias("i"), F.col("chunk").cast("int").alias("j"), F.col(key).cast("string").alias("name"), F.col("vec").cast("array<double>").alias("vec"))

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[np.ndarray] = []
        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at is not None and at != (int(i[a]), int(j[a])):
                    yield _block(*at, np.concatenate(held))
                    held = []
                at = (int(i[a]), int(j[a]))
                held.append(batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
        if at is not None:
            yield _block(*at, np.concatenate(held))

    ordered = placed.repartition("i", "j").sortWithinPartitions("i", "j", "name")
    names = placed.filter("j = 0").select("i", "name")
    names = names.groupBy("i").agg(F.sort_array(F.collect_list("name")).alias("names"))  # `rows` of them
    return ordered.select("i", "j", "name", "vec").mapInArrow(stacked, BLOCK), names.select("i", F.posexplode("names").alias("place", key))


def transposed(matrix: DataFrame) -> DataFrame:
    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, height, data in _rows(batches):
            yield _block(j, i, _values(height, data).T)

    return matrix.select(*_FIELDS).mapInArrow(turned, BLOCK)


def product(left: DataFrame, right: DataFrame, height: int, width: int) -> DataFrame:
    """The product of two matrices; ``height`` and ``width`` are the block rows and columns of the result."""
    columns = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    rows = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    a = left.select("i", columns.alias("j"), F.col("j").alias("k"), F.lit(0).alias("side"), "height", "data")
    b = right.select(rows.alias("i"), "j", F.col("i").alias("k"), F.lit(1).alias("side"), "height", "data")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, term, inner = None, None, None, None
        for i, j, k, side, n, data in _rows(batches):
            if at != (i, j):
                if total is not None:
                    yield _block(*at, total)
                at, total, term = (i, j), None, None
            if side == 0:
                term, inner = _values(n, data), k
            elif term is not None and inner == k:
                part = term @ _values(n, data)
                total = part if total is None else total + part
                term = None
        if total is not None:
            yield _block(*at, total)

    both = a.unionByName(b).repartition("i", "j").sortWithinPartitions("i", "j", "k", "side")
    return both.select("i", "j", "k", "side", "height", "data").mapInArrow(added, BLOCK)


def combined(left: DataFrame, right: DataFrame | None, a: float, b: float = 0.0, diagonal: float = 0.0) -> DataFrame:
    """a * left + b * right, with ``diagonal`` added on the diagonal: block by block."""
    rows = left.select(*_FIELDS, F.lit(0).alias("side"))
    if right is not None:
        rows = rows.unionByName(right.select(*_FIELDS, F.lit(1).alias("side")))
    factors = (a, b)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for i, j, height, data, side in _rows(batches):
            if at != (i, j):
                if total is not None:
                    yield _block(*at, total)
                at, total = (i, j), 0.0
                if i == j and diagonal:
                    total = np.eye(height) * diagonal
            total = total + factors[side] * _values(height, data)
        if total is not None:
            yield _block(*at, total)

    return rows.repartition("i", "j").sortWithinPartitions("i", "j", "side").select(*_FIELDS, "side").mapInArrow(summed, BLOCK)


def squared_norm(matrix: DataFrame, minus_identity: bool = False) -> float:
    """Sum of squared entries, of the matrix less the identity on request: one number for each task."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for i, j, height, data in _rows(batches):
            values = _values(height, data)
            if minus_identity and i == j:
                values = values - np.eye(height)
            total += float((values * values).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    return matrix.select(*_FIELDS).mapInArrow(squares, "s double").agg(F.sum("s")).first()[0] or 0.0


def extent(matrix: DataFrame) -> tuple[int, int]:
    """Block rows and block columns."""
    row = matrix.agg(F.max("i"), F.max("j")).first()
    return (row[0] + 1, row[1] + 1) if row[0] is not None else (0, 0)


def moment(matrix: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """The mean outer product of a matrix's rows."""
    tall, wide = shape or extent(matrix)
    total = matrix.filter("j = 0").agg(F.sum("height")).first()[0] or 1
    return combined(product(transposed(matrix), matrix, wide, wide), None, 1.0 / total)


def inverse_root(matrix: DataFrame, damping: float = 0.0, tolerance: float = 1e-9, most_rounds: int = 60) -> DataFrame:
    """The inverse square root of a symmetric positive matrix plus ``damping`` on its diagonal.

    Newton-Schulz iteration on the matrix divided by its norm: ``t = (3 - z y) / 2``, then
    ``y t`` tends to the root and ``t z`` to its inverse.  Rounds end when ``z y`` is the
    identity up to ``tolerance`` for each row, or no longer comes closer to it; they are about
    the logarithm of the condition number.
    """
    blocks, _ = extent(matrix)
    if not blocks:
        return matrix
    damped = materialize(combined(matrix, None, 1.0, diagonal=damping))
    size = damped.filter("i = j").agg(F.sum("height")).first()[0]
    scale = squared_norm(damped) ** 0.5
    y = materialize(combined(damped, None, 1.0 / scale))
    z = materialize(combined(damped, None, 0.0, diagonal=1.0))
    before = float("inf")
    for _ in range(most_rounds):
        zy = materialize(product(z, y, blocks, blocks))
        apart = (squared_norm(zy, minus_identity=True) / size) ** 0.5
        if apart <= tolerance or (apart < 1e-6 and apart >= before):
            return combined(z, None, scale**-0.5)
        before = apart
        t = materialize(combined(zy, None, -0.5, diagonal=1.5))
        y, z = materialize(product(y, t, blocks, blocks)), materialize(product(t, z, blocks, blocks))
    raise RuntimeError(f"the inverse root did not settle: {before} left")


def unfolded(matrix: DataFrame, names: DataFrame, key: str = "uid") -> DataFrame:
    """(key, chunk, vec): the rows of a matrix under their names."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, height, data in _rows(batches):
            values = _values(height, data)
            offsets = pa.array(np.arange(height + 1) * values.shape[1], pa.int32())
            columns = [pa.array([i] * height, pa.int32()), pa.array(range(height), pa.int32()), pa.array([j] * height, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], ["i", "place", "chunk", "vec"])

    rows = matrix.select(*_FIELDS).mapInArrow(lists, "i int, place int, chunk int, vec array<double>")
    return rows.join(names, ["i", "place"]).select(key, "chunk", "vec")


def whitened(chunks: DataFrame, damping: float = 1e-6, key: str = "uid", rows: int = ROWS_PER_BLOCK, tolerance: float = 1e-9) -> DataFrame:
    """(key, chunk, vec): vectors given in chunks times the inverse root of their second moment.

    For vectors too wide for the d x d moment to be held in one place.
    """
    matrix, names = row_blocks(chunks, key, rows)
    matrix = materialize(matrix)
    tall, wide = extent(matrix)
    if not tall:
        return chunks.select(key, F.col("chunk").cast("int").alias("chunk"), F.col("vec").cast("array<double>").alias("vec"))
    root = materialize(inverse_root(moment(matrix, (tall, wide)), damping, tolerance))
    return unfolded(product(matrix, root, tall, wide), names, key)


def cells(matrix: DataFrame, size: int) -> DataFrame:
    """(i, j, m): the entries of a matrix whose blocks are ``size`` wide and high, but for the last."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, height, data in _rows(batches):
            values = _values(height, data)
            r, c = np.divmod(np.arange(values.size), values.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i * size + r, pa.int32()), pa.array(j * size + c, pa.int32()), pa.array(values.ravel())], ["i", "j", "m"])

    return matrix.select(*_FIELDS).mapInArrow(entries, "i int, j int, m double")


def grid_dot(docs: DataFrame, queries: DataFrame, rows: int = ROWS_PER_BLOCK, least: Column | None = None) -> DataFrame:
    """(query_uid, uid, score): dot products from (uid, chunk, vec) and (query_uid, chunk, vec).

    Queries and documents are cut into blocks and dealt by (query block, document block); the
    chunks of a pair of blocks meet in one task, two blocks at a time.  ``least`` is a condition
    on ``score`` for the rows that are wanted.
    """
    left, query_names = row_blocks(queries, "query_uid", rows)
    right, doc_names = row_blocks(docs, "uid", rows)
    left, right = materialize(left), materialize(right)
    (tall, _), (wide, _) = extent(left), extent(right)
    if not tall or not wide:
        return docs.limit(0).select(F.lit("").alias("query_uid"), F.col("uid").cast("string").alias("uid"), F.lit(0.0).alias("score"))
    scores = product(left, transposed(right), tall, wide)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, height, data in _rows(batches):
            values = _values(height, data)
            n = values.shape[1]
            r, c = np.divmod(np.arange(values.size), n)
            columns = [pa.array(np.full(values.size, i), pa.int32()), pa.array(r, pa.int32()), pa.array(np.full(values.size, j), pa.int32()), pa.array(c, pa.int32()), pa.array(values.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["qi", "qp", "di", "dp", "score"])

    long = scores.mapInArrow(pairs, "qi int, qp int, di int, dp int, score double")
    long = long if least is None else long.filter(least)
    named = long.join(query_names.select(F.col("i").alias("qi"), F.col("place").alias("qp"), "query_uid"), ["qi", "qp"])
    return named.join(doc_names.select(F.col("i").alias("di"), F.col("place").alias("dp"), "uid"), ["di", "dp"]).select("query_uid", "uid", "score")
