"""Session settings, lineage cuts and size checks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that may be shipped to every executor (bytes, serialized).
SHIP_LIMIT_BYTES = 64 * 1024 * 1024

# Bytes of rows that a task hands Python at once where rows may be large.
BATCH_BYTES = 8 * 1024 * 1024
# For writing large rows as Parquet: pages and row groups are measured after each row, not after a hundred,
# and a reader holds a row group at a time.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def build_session(app: str = "sourcerank", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``cpus`` asks for a local one with few partitions.

    Without it, master, partitions and memory are what the cluster or spark-submit says.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Checkpointed rows go away with the DataFrames that use them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Another value of a session setting for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands Python at most ``BATCH_BYTES`` and a row at once, or less where less was set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    digits = before is not None and before.isdigit()
    with setting(spark, key, str(min(int(before), BATCH_BYTES) if digits and int(before) else BATCH_BYTES)):
        yield


def trim() -> None:
    """Give the free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder of the cluster; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sourcerank-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name where every executor can read and write: below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and cut its lineage.

    Needed where a later step must see exactly the same partitioning twice, so
    that a recomputation after a lost executor cannot change the answer.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, row_bytes: int, limit: int = SHIP_LIMIT_BYTES) -> bool:
    """True when ``df`` is proven small: counted, at ``row_bytes`` each, under ``limit``.

    The count stops as soon as the limit is passed, so an oversized side costs
    no full pass.
    """
    most = max(1, limit // max(1, row_bytes))
    return df.limit(most + 1).count() <= most


def ship_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a side for broadcast after checking its size, else leave it to a shuffle join."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over the cores when a scan has far fewer splits than there are cores.

    One small file would otherwise keep a single core busy with all the text.  A table with
    at least a quarter as many splits as cores keeps them and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if 4 * df.rdd.getNumPartitions() < cores else df
