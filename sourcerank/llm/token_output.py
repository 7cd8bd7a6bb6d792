"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

Documents are brought into id order by one range shuffle; each task encodes its range and
writes segments of some million ids.  A segment holds the table of its ids from the most to
the least frequent, so that frequent ids become small numbers, and two byte streams: a
control byte says how many bytes (1 to 4) each of the next four ranks takes, the data stream
holds the bytes.  Reading looks the control bytes up in a table and gathers the data bytes
with numpy, all ids of a segment at once.

The files are Parquet with one row for each segment, committed by Spark, so a lost executor's
half-written file is never seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .subwords import SLICE_BYTES, encoder

SEGMENT_IDS = 1 << 21
SEGMENT = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, ids binary, control binary, data binary"
_SEGMENT_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("seq", pa.int32()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("ids", pa.binary()),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)

# For each control byte: the four byte counts it states.
_COUNTS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ids to (ids by rank, control bytes, data bytes)."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    by_rank = used[np.argsort(-counts[used], kind="stable")]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = rank_of[ids]
    width = (1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)).astype(np.uint8)
    quads = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    quads[: len(ids)] = width - 1
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4) < width[:, None]
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[kept]
    return by_rank.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack_ids(by_rank: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`pack_ids`."""
    width = _COUNTS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(width)
    starts = ends - width
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))
    ranks = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(width > k)
        ranks[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(by_rank, "<u4")[ranks] if n else np.zeros(0, np.uint32)


def _segment(part: int, seq: int, docs: list[int | None], coded: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(coded), "<u4")
    by_rank, control, data = pack_ids(ids)
    lengths = [len(c) // 4 for c in coded]
    row = {"part": part, "seq": seq, "n_ids": len(ids), "doc_ids": docs, "lengths": lengths, "ids": by_rank, "control": control, "data": data}
    return pa.RecordBatch.from_pylist([row], _SEGMENT_ARROW)


def write_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of ``df`` (``doc_id``, ``text``) as segment files below ``path``.

    Documents lie in ascending order of doc_id (null ids first, ties by text), each
    followed by ``end_id``; a null or empty text is the end id alone.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        coded: list[bytes] = []
        for batch in batches:
            _, offsets = common.bytes_of(batch.column(1))
            for first, last in common.slices(offsets, SLICE_BYTES):
                docs += batch.column(0).slice(first, last - first).to_pylist()
                for ids in encoder(tokenizer).encode(batch.column(1).slice(first, last - first).to_pylist()):
                    coded.append(ids + end)
                    held += len(ids) // 4 + 1
                if held >= segment_ids:
                    yield _segment(part, seq, docs, coded)
                    docs, coded, held, seq = [], [], 0, seq + 1
        if docs:
            yield _segment(part, seq, docs, coded)

    ordered = common.id_and_text(df).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENT).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of segment files: part, seq, nth, doc_id, before (ids before it in the segment), ids (bytes)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["ids"], row["control"], row["data"], row["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["seq"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["part", "seq", "doc_id", "before", "ids"],
                )

    files = spark.read.schema(SEGMENT).parquet(path)
    return files.mapInArrow(documents, "part int, seq int, doc_id long, before long, ids binary")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, base: the ids that all earlier segments hold.

    Only segment sizes are summed: one row for each task in the outer window, one for
    each segment of a task in the inner.
    """
    sizes = spark.read.schema(SEGMENT).parquet(path).select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("held"))
    parts = parts.select("part", (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("part_base"))
    inner = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.join(parts, "part").select("part", "seq", (F.col("part_base") + inner).alias("base"))


def token_table(df: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, **conf: int) -> DataFrame:
    """Write token files for all documents, read them back and describe each document.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id) and
    ids_crc32 (of the ids as little-endian 32-bit integers).  Repeated rows are documents of
    their own; an empty table gives no rows.
    """
    spark = df.sparkSession
    path = path or common.scratch(spark)
    write_files(df, path, tokenizer, end_id, **conf)
    docs = read_files(spark, path).select(
        "part", "seq", "doc_id", "before", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    return docs.join(segment_starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )
