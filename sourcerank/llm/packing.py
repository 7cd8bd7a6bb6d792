"""Best-fit packing: repeat counts of few-document length patterns by non-negative least squares.

The plan is made on the histogram of piece lengths alone (at most ``size`` numbers): all
patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram by projected gradient steps and rounded down as far as
pieces are left, and what remains is packed longest first, best fit next.  Pieces then find
their place by their number among the pieces of equal length; no task gathers a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .subwords import SLICE_BYTES, encoder

# Patterns that one fit may hold; longer sequences leave out three-part patterns of rare lengths.
MOST_PATTERNS = 400_000
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def patterns(counts: np.ndarray, most: int = MOST_PATTERNS) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``len(counts) - 1``, over lengths that occur."""
    size = len(counts) - 1
    there = np.flatnonzero(counts[:size])
    there = there[there > 0]
    pairs = there[(2 * there <= size)]
    pairs = pairs[np.isin(size - pairs, there)]
    found = [np.stack([pairs, size - pairs, np.zeros_like(pairs)], 1)]
    held = np.zeros(size + 1, bool)
    held[there] = True
    if len(there) ** 2 > 12 * most:
        there = np.sort(there[np.argsort(-counts[there], kind="stable")][: int((12 * most) ** 0.5)])
    for a in there[3 * there <= size]:
        b = there[(there >= a) & (a + 2 * there <= size)]
        b = b[held[size - a - b]]
        found.append(np.stack([np.full_like(b, a), b, size - a - b], 1))
    return np.concatenate(found)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts ``x`` that bring the summed patterns closest to ``counts``."""
    goal = counts.astype(float)
    goal[0] = 0
    flat = rows.ravel()
    weight = (flat > 0).astype(float)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3) * weight, len(goal))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[flat] * weight).reshape(-1, 3).sum(1)

    bound = back(summed(np.ones(len(rows)))).max(initial=1.0)  # the largest row sum of A'A bounds its norm
    x = np.zeros(len(rows))
    ahead, momentum = x, 1.0
    for _ in range(steps):
        after = np.maximum(0, ahead - back(summed(ahead) - goal) / bound)
        faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = after + (momentum - 1) / faster * (after - x)
        x, momentum = after, faster
    return x


def plan(counts: np.ndarray) -> np.ndarray:
    """Runs of pieces: rows (length, number of the first piece, first sequence, offset).

    ``counts[n]`` is the number of pieces of length n, the last entry those that fill a
    sequence.  The runs of a length cover its pieces 0, 1, ... in order, each piece of a run
    one sequence further.
    """
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    used = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int]] = []
    sequence = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in lengths:
            runs.append((n, int(used[n]), sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times

    if left[size]:
        place([size], int(left[size]))
    rows = patterns(left)
    if len(rows):
        x = fit(rows, left)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            lengths = [int(n) for n in rows[k] if n]
            most = min(int(left[n]) // lengths.count(n) for n in lengths)
            if times := min(int(x[k] + 1e-6), most):
                place(lengths, times)
    while len(there := np.flatnonzero(left)):
        lengths, room = [], size
        taken = np.zeros(size + 1, np.int64)
        while True:
            fitting = there[: np.searchsorted(there, room, "right")]
            fitting = fitting[left[fitting] > taken[fitting]]
            if not len(fitting):
                break
            n = int(fitting[-1])
            lengths.append(n)
            taken[n] += 1
            room -= n
        some = np.flatnonzero(taken)
        place(lengths, int((left[some] // taken[some]).min()))
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def pieces(df: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Tokenised documents, cut into pieces and numbered within their task and length.

    A document is its ids and ``end_id``.  Only one longer than ``size`` is cut; its first
    piece takes what the others, all full, leave.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        met = [0] * (size + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            _, offsets = common.bytes_of(batch.column(1))
            for first, last in common.slices(offsets, SLICE_BYTES):
                docs = batch.column(0).slice(first, last - first).to_pylist()
                texts = batch.column(1).slice(first, last - first).to_pylist()
                out: list[tuple] = []
                for doc, raw in zip(docs, encoder(tokenizer).encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    at, nth = 0, 0
                    while at < n:
                        length = (n - 1) % size + 1 if at == 0 else size
                        out.append((doc, nth, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), part, met[length]))
                        met[length] += 1
                        at, nth = at + length, nth + 1
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return common.id_and_text(df).mapInArrow(cut, _PIECES)


def packed(df: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.  A
    null or empty text is one piece of the end id alone; repeated rows are documents of their
    own; an empty table gives no rows.  The pieces are written once, because their numbers
    depend on the task that met them.
    """
    spark = df.sparkSession
    cut = common.stored(pieces(df, tokenizer, end_id, size))
    held = cut.groupBy("length", "part").agg(F.count("*").alias("held"))
    counts = np.zeros(size + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("held").alias("n")).collect():  # at most `size` rows
        counts[row["length"]] = row["n"]
    runs = spark.sparkContext.broadcast(plan(counts))
    before = held.select("length", "part", (F.sum("held").over(W.partitionBy("length").orderBy("part")) - F.col("held")).alias("before"))
    numbered = cut.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("before") + F.col("nth")).alias("number")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            run = table[np.searchsorted(keys, (length << 48) + number, "right") - 1] if len(length) else table[:0]
            columns = [*batch.columns[:5], pa.array(run[:, 2] + number - run[:, 1]), pa.array(run[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
