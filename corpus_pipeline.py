"""A corpus from raw documents to packed sequences, in stages that each take whole tables.

Every stage but the last returns the columns of ``documents``; each result is written as Parquet
and read again by the next stage.  The tables that a stage stored for itself go when the next one
begins, unless its documents still read them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcerank.llm import decontaminate, jaccard_join, language_id, packing, suffix_dedup
from sourcerank.llm.common import noted, remove, stored
from sourcerank.llm.subwords import tokenizer_file
from sourcerank.session import ship_if_small

# A prediction that is less sure is no language.
LEAST_SCORE = 0.3


# Folders that the stage before stored for itself.
_left_behind: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that clears away what the one before stored, once its result was written."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        if _left_behind and not any(folder.split(":")[-1].lstrip("/") in f for folder in _left_behind for f in read):
            remove(spark, _left_behind)
            _left_behind.clear()
        with noted() as folders:
            out = work(spark, docs, sf_dir)
        _left_behind.extend(folders)
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is unsure, go; a null lang takes the prediction."""
    sample = language_id.training_sample(docs)
    network = language_id.trained([r["text"] for r in sample], [r["label"] for r in sample])
    found = language_id.annotated(docs, network)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@_stage
def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word n-grams at 0.8 the document with the least id stays.

    Rows that share an id stay or go together; of those that stay, one is left.  Rows without
    an id stay.
    """
    linked = jaccard_join.linked(docs, 5, Fraction(8, 10))
    gone = linked.filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(ship_if_small(stored(gone), 16), "doc_id", "left_anti").select(docs.columns)
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if not again.limit(1).count():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.filter("doc_id is null"))


@_stage
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again are cut out; documents that consist of them go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup.repeats(docs, 200, carry=others, as_text=True).filter("n_removed = 0 or n_removed < n_bytes")
    rows = found.select("doc_id", F.col("kept").alias("text"), *[F.col(f"carried.{c}").alias(c) for c in others])
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_stage
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in windows of benchmark items go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids."""
    return packing.packed(docs, tokenizer_file(), end_id=2, size=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("suffix_array_dedup", remove_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack),
]

# Neither the trained classifier nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
