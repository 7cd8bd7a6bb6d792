"""File scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_source import numbered_lines

DOCUMENT = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("uid", "text", "func", "role")],
        *[T.StructField(n, T.IntegerType()) for n in ("constant", "hop_depth")],
        *[
            T.StructField(n, T.StringType())
            for n in ("type", "parent_uid", "base_func", "source", "archetype")
        ],
        T.StructField("example_inputs", T.ArrayType(T.IntegerType())),
        *[
            T.StructField(n, T.StringType())
            for n in ("prompt", "response", "response_suffix", "not_supervised_prefix")
        ],
    ]
)
QUERY = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("uid", "query", "prompt", "completion", "func")],
        T.StructField("correct", T.BooleanType()),
        T.StructField("incorrect", T.StringType()),
    ]
)
PARTIAL = T.StructType(
    [
        T.StructField("train_idx", T.IntegerType()),
        T.StructField("uid", T.StringType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("steps_taken", T.IntegerType()),
        T.StructField("converged", T.BooleanType()),
        T.StructField("final_pbo_loss", T.DoubleType()),
    ]
)
PER_QUERY = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("query_uid", "prompt", "completion", "func")],
        T.StructField("correct", T.BooleanType()),
        T.StructField("train_uids", T.ArrayType(T.StringType())),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
    ]
)
_BAD = "_bad_line"


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the job.  Reads .zst and .gz too."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with the file they came from and a stable ordinal inside it.

    A splittable scan does not know line numbers; (file, ordinal) keeps the order, and
    :func:`line_source.numbered_lines` counts them.
    """
    return (
        spark.read.text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("ordinal"),
        )
        .filter(F.trim("line") != "")
    )


def _parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    return raw.withColumn("r", F.from_json("line", wide, opts))


def lenient_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): bad lines are set aside with their file and ordinal."""
    parsed = _parsed(lines(spark, path), schema)
    bad = F.col(f"r.{_BAD}").isNotNull()
    good = parsed.filter(~bad).select(*[f"r.{f.name}" for f in schema.fields], "file", "ordinal")
    return good, parsed.filter(bad).select("line", "file", "ordinal")


def numbered_jsonl(spark: SparkSession, path: str, schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) with the number each line has in its file; blank lines count but are no records.

    For reports that name the line of a record, such as audits.
    """
    rows = numbered_lines(spark, path, **options).filter(F.trim("line") != "")
    parsed = _parsed(rows, schema)
    bad = F.col(f"r.{_BAD}").isNotNull()
    good = parsed.filter(~bad).select(*[f"r.{f.name}" for f in schema.fields], "file", "line_no")
    return good, parsed.filter(bad).select("line", "file", "line_no")


def jsonl_or_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A line that is not JSON becomes a record holding only its text."""
    parsed = _parsed(lines(spark, path), schema)
    bad = F.col(f"r.{_BAD}").isNotNull()
    cols = [
        F.when(bad, F.trim("line")).otherwise(F.col("r.text")).alias("text")
        if f.name == "text"
        else F.col(f"r.{f.name}")
        for f in schema.fields
    ]
    return parsed.select(*cols)


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """One document per non-blank line, trimmed."""
    return lines(spark, path).select(F.trim("line").alias("text"))


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files that each hold one JSON array; write them back with ``sinks.jsonl``."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def pooled_sample(spark: SparkSession, paths: list[str], schema: T.StructType, n: int, seed: object = 42) -> DataFrame:
    """n rows at random from several files (compressed ones too), all when there are fewer."""
    from ..operators.assemble import sample_rows

    rows = strict_jsonl(spark, paths, schema)
    cols = [f.name for f in schema.fields]
    keyed = rows.withColumn("__id", F.md5(F.to_json(F.struct(*cols))))
    # Equal rows share an id; which of them is taken makes no difference.
    return sample_rows(keyed, n, "__id", seed).drop("__id")


def discover(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.jsonl",
    exclude: str | None = None,
    by: str = "name",
    recursive: bool = False,
) -> DataFrame:
    """(path, name, size, modified): files matching a glob, minus another, in the asked order.

    Reads file metadata only.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    files = reader.load(folder).select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
    if exclude:
        like = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in exclude) + "$"
        files = files.filter(~F.col("name").rlike(like))
    order = {"name": [F.col("name")], "size": [F.col("size"), F.col("name")], "date": [F.col("modified"), F.col("name")]}
    return files.orderBy(*order[by])


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries in the shape the rankers read; a missing uid becomes q_<ordinal>."""
    raw = strict_jsonl(spark, path, QUERY)
    return raw.select(
        F.coalesce("uid", F.concat(F.lit("q_"), F.monotonically_increasing_id().cast("string"))).alias("query_uid"),
        F.coalesce("prompt", "query", F.lit("")).alias("prompt"),
        F.coalesce("completion", F.lit("")).alias("completion"),
        F.coalesce("func", F.lit("unknown")).alias("func"),
        "correct",
        "incorrect",
    )


def per_query_scores(records: DataFrame, method: str) -> DataFrame:
    """Per-query records with parallel arrays to long scores."""
    pair = F.explode(F.arrays_zip(F.col("train_uids").alias("uid"), F.col("scores").alias("score"))).alias("p")
    return records.select(F.lit(method).alias("method"), "query_uid", pair).select(
        "method", "query_uid", "p.uid", "p.score"
    )
