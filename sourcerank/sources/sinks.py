"""Writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_source import located


def jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines, refusing to replace existing output unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def zstandard_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines in one .zst file for each partition that has rows; the number of records.

    Spark reads zstandard text but does not write it.  A task writes under a name of its
    attempt and renames the file when it is whole, so a repeated task replaces its own.
    """
    system, inner = located(path)
    if system.get_file_info(inner).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, inner = located(path)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/part-{task.partitionId():05d}.jsonl.zst"
        draft, n, out = f"{inner}/_{task.partitionId():05d}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            if batch.num_rows and out is None:
                out = system.open_output_stream(draft, compression="zstd")
            for line in batch.column(0):
                out.write(line.as_buffer())
                out.write(b"\n")
            n += batch.num_rows
        if out is not None:
            out.close()
            system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("line"))
    return lines.mapInArrow(written, "n bigint").agg(F.sum("n")).first()[0] or 0


def by_hop_depth(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder per hop depth; rows without a usable depth are not written."""
    known = df.filter(F.col("hop_depth").isin(0, 1))
    known.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("hop_depth").json(path)


def cumulative_folders(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Nested corpora, one folder per n."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("n").json(path)


def per_query_records(scores: DataFrame, queries: DataFrame, corpus_size: int, part_size: int = 100_000) -> DataFrame:
    """Query fields with parallel arrays train_uids and scores, by uid.

    A row holds every document of its part.  Documents are hashed over so many parts
    that each holds about ``part_size`` of the ``corpus_size`` counted ones.
    """
    parts = max(1, -(-corpus_size // part_size))
    part = F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")
    rows = scores.withColumn("part", part).groupBy("query_uid", "part").agg(
        F.array_sort(F.collect_list(F.struct("uid", "score"))).alias("r")
    )
    meta = queries.select("query_uid", "prompt", "completion", "func", "correct")
    return rows.join(meta, "query_uid").select(
        *meta.columns,
        "part",
        F.transform("r", lambda x: x["uid"]).alias("train_uids"),
        F.transform("r", lambda x: x["score"]).alias("scores"),
    )


def metrics_records(by_func: DataFrame, overall: DataFrame) -> DataFrame:
    """One row per k with per-function maps: recall, precision and their variances.

    A map has one entry per function, a bounded dimension.
    """
    def as_map(value: str):
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("func", value)))).alias(f"{value}_per_function")

    maps = by_func.groupBy("k").agg(*[as_map(v) for v in ("recall", "recall_var", "precision", "precision_var")])
    return maps.join(overall, "k")
