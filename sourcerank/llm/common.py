"""Helpers shared by the training-data operators: text columns, scratch tables, byte views."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import LARGE_ROWS, setting, trim

# Bytes of text that one numpy step holds at once; its arrays take some 60 bytes for each.
SLICE_BYTES = 1 << 20


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; a null text counts as empty.

    Every other column is left behind here, so that no name can clash later.
    """
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the cluster (``spark.checkpoint.dir``).

    Only local mode, where nothing is set, falls back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="sourcerank-llm-")
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


# Folders of the tables stored since the innermost `noted` began.
_noted: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """Collects the folders of the tables that are stored inside, for :func:`remove`."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop the shuffles of what is gone."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def stored(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage; the rows survive any executor and are the same at every later use.  The
    shuffles of the write serve nothing else and go when it ends.  ``large_rows``: rows may be megabytes.
    """
    spark = df.sparkSession
    path = scratch(spark)
    if _noted:
        _noted[-1].append(path)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**LARGE_ROWS if large_rows else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drawn(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` rows by the hash of their key, at a rate that follows from a count.

    Every partition takes part and hands on its share only.  Where keys repeat so often that
    many more would come, four times as many are the bound.
    """
    rate = most / max(1, df.count())
    draw = F.pmod(F.xxhash64(*key, F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
    return df.filter(draw < rate).limit(4 * most)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(places, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = at.astype(np.int64)
    return held[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together; a longer row is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All the positions of runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a flat array as one list column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


# What a worker process keeps between tasks: the tables of one operator.
_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What a worker keeps under ``key``, made at the first use; another key's goes first.

    Workers are used again by later operators, so the tables of an earlier one must not stay.
    """
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Free what an earlier operator left in this worker process, and give free memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
    trim()
