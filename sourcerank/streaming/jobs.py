"""Streaming jobs over append-only files: partial scores, evaluations, metric logs.

Each function turns a streaming (or batch) DataFrame into another one; ``start``
runs it.  Nothing here keeps Python state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New JSON-line files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100, glob: str = "*.parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", glob).parquet(folder)


def completed_scores(partials: DataFrame, delay: str | None = None, ts: str = "ts") -> DataFrame:
    """Partial results once per uid, whatever was written twice after a resume.

    Without a watermark the state is one entry per uid of the run; with ``delay``
    (and an event-time column) repeats further apart than the delay are not
    looked for and the state stays bounded.
    """
    if delay is None:
        return partials.dropDuplicates(["uid"])
    return partials.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["uid"])


def checkpoint_evaluations(saved: DataFrame, evaluated: DataFrame, within: str, delay: str) -> DataFrame:
    """(checkpoint, saved_at, evaluated_at, score): each saved checkpoint with its evaluations.

    Two streams: ``saved`` (checkpoint, saved_at) and ``evaluated`` (checkpoint, evaluated_at,
    score).  An evaluation counts if it comes at most ``within`` after the checkpoint was saved.
    A checkpoint without one is handed on with nulls once both streams have passed that time by
    ``delay``, so it is reported late or missing exactly once; state goes with it.
    """
    left = saved.select("checkpoint", "saved_at").withWatermark("saved_at", delay)
    right = evaluated.select(F.col("checkpoint").alias("of"), "evaluated_at", "score").withWatermark("evaluated_at", delay)
    meets = F.expr(f"checkpoint = of AND evaluated_at >= saved_at AND evaluated_at <= saved_at + INTERVAL {within}")
    return left.join(right, meets, "left_outer").select("checkpoint", "saved_at", "evaluated_at", "score")


def accuracy_by_checkpoint(results: DataFrame) -> DataFrame:
    """Accuracy per (step, depth), updated as evaluation files land."""
    return results.groupBy("step", "hop_depth").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy")
    )


def windowed_series(log: DataFrame, width: str, delay: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Mean value per series and event-time window; rows later than ``delay`` are dropped.

    Tumbling by default, sliding with ``slide``.  The windows are this library's
    addition to a log that is otherwise read step by step.
    """
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        log.withWatermark(ts, delay)
        .groupBy(win.alias("w"), "series")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "series", "n", "value")
    )


def session_series(log: DataFrame, gap: str, delay: str, ts: str = "ts") -> DataFrame:
    """Count and mean per series and burst of activity, bursts split by ``gap``."""
    return (
        log.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), "series")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "series", "n", "value")
    )


def metric_long(log: DataFrame) -> DataFrame:
    """(step, series, value): a wide metric row unfolded, sparse series skipped."""
    names = [c for c in log.columns if c not in ("ts", "step")]
    keep = [c for c in ("ts", "step") if c in log.columns]
    cells = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("value")) for n in names])
    return log.select(*keep, F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


def progress(done: DataFrame, total: int, ts: str = "ts") -> DataFrame:
    """One row: completed, total, fraction, rate per second and remaining seconds."""
    span = F.max(ts).cast("double") - F.min(ts).cast("double")
    return _rates(done.agg(F.count_distinct("uid").alias("completed"), span.alias("elapsed")), total)


def _rates(counts: DataFrame, total: int) -> DataFrame:
    return counts.select(
        "completed",
        F.lit(total).cast("bigint").alias("total"),
        (F.col("completed") / total).alias("fraction"),
        F.when(F.col("elapsed") > 0, F.col("completed") / F.col("elapsed")).alias("rate"),
        F.when(F.col("elapsed") > 0, (total - F.col("completed")) * F.col("elapsed") / F.col("completed")).alias("eta"),
    )


def start(df: DataFrame, out: str, checkpoint: str, mode: str = "append", once: bool = True, fmt: str = "parquet"):
    """Start writing a stream to files; with ``once`` it ends when the input is used up."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(out)


def start_progress(partials: DataFrame, total: int, out: str, checkpoint: str, once: bool = True):
    """Poll progress: every batch counts its new uids and rewrites the progress row.

    The state is one row for each uid of the run, with the time of the batch that met it first.
    A batch leaves one row of counts in a folder of its id, so a repeated batch replaces its
    own, and the progress row adds those up; no batch reads the uids of another.
    """
    seen = (
        partials.withColumn("__now", F.current_timestamp())
        .groupBy("uid")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("__now").alias("met"))
        .withColumn("fresh", (F.col("met") == F.current_timestamp()).cast("bigint"))
    )

    def on_batch(batch: DataFrame, epoch: int) -> None:
        own = batch.agg(F.sum("fresh").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        own.write.mode("overwrite").parquet(f"{out}/counts/batch={epoch}")
        held = batch.sparkSession.read.schema("n bigint, first timestamp, last timestamp, batch bigint").parquet(f"{out}/counts")
        counts = held.agg(F.sum("n").alias("completed"), (F.max("last").cast("double") - F.min("first").cast("double")).alias("elapsed"))
        _rates(counts, total).write.mode("overwrite").json(f"{out}/progress")

    writer = seen.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()


def start_updates(df: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Run an update-mode aggregate, keeping each batch's changed rows under its batch id.

    A repeated batch replaces its own folder, so a restart cannot count twice.
    """

    def on_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = df.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current value of every key from the batches ``start_updates`` wrote."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("r")).select(*keys, "r.*")
