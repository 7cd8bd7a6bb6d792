"""Corpus mixing, union, caching and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .positions import hashed_positions, seeded_hash


def weighted_union(df: DataFrame, weights: dict[str, float], corpus: str = "corpus", uid: str = "uid", seed: object = 42) -> DataFrame:
    """Each corpus repeated to int(rows * weight) rows.

    Whole copies come from a sequence; the remainder is the rows first in
    seeded-hash order.  Weight <= 0 drops a corpus; corpora without a weight keep
    their rows.  Adds ``copy``, numbered from 1.
    """
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    weight = F.coalesce(F.try_element_at(table, F.col(corpus)), F.lit(1.0))
    live = df.withColumn("__w", weight).filter("__w > 0")
    placed = hashed_positions(live, [corpus], [uid], seed, out="__pos", total="__n")
    target = F.floor(F.col("__n") * F.col("__w"))
    copies = F.floor(target / F.col("__n")) + F.when(F.col("__pos") <= target % F.col("__n"), 1).otherwise(0)
    return (
        placed.withColumn("__c", copies)
        .filter("__c > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int"))))
        .drop("__w", "__n", "__pos", "__c")
    )


def union_with_source(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of corpora, missing columns null, ``source`` filled with the corpus name."""
    out = None
    for name, df in parts.items():
        own = F.coalesce(F.col("source"), F.lit(name)) if "source" in df.columns else F.lit(name)
        tagged = df.withColumn("source", own)
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted work that is not done yet."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def shared_uids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("uid").distinct().join(right.select("uid").distinct(), "uid", "left_semi")


def stable_unique(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))


def latest_cache(entries: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Last write per key: a combining ``max_by``, so a hot key costs one row per task."""
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("r")).select(*keys, "r.*")


def reuse_cache(jobs: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs with their cached ``text``; ``is_cached`` tells reused from pending."""
    hits = cache.select(*keys, F.col("text").alias("text"), F.lit(True).alias("__hit"))
    return jobs.join(hits, list(keys), "left").withColumn("is_cached", F.coalesce("__hit", F.lit(False))).drop("__hit")


def merge_partials(parts: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Union of workers' partial rows (train_idx, uid, scores[]): the later one wins on a repeated index."""
    return latest_cache(parts, ["train_idx"], arrival)


def partials_to_scores(merged: DataFrame, query_ids: DataFrame) -> DataFrame:
    """Long scores from partial rows; position in the array is the query's ordinal.

    Documents without a partial row are absent, which every consumer reads as 0.
    """
    long = merged.select("uid", F.posexplode("scores").alias("ord", "score"))
    return long.join(query_ids.select("ord", "query_uid"), "ord").select("query_uid", "uid", "score")


def cumulative(df: DataFrame, repeats: int) -> DataFrame:
    """Nested corpora: file n holds repeats 1..n.  Write with partitionBy('n')."""
    return df.withColumn("n", F.explode(F.sequence(F.col("repeat"), F.lit(repeats))))


def sample_per_group(df: DataFrame, k: int, group: str = "func", uid: str = "uid", seed: object = 42) -> DataFrame:
    """k rows of every group without replacement, with a global shuffle key.

    The rank filter lets Spark keep k rows per group and task before the shuffle.
    """
    w = W.partitionBy(group).orderBy(seeded_hash(seed, uid), F.col(uid))
    picked = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
    return picked.withColumn("shuffle_key", seeded_hash(f"{seed}-shuffle", uid))


def sample_rows(df: DataFrame, n: int, uid: str = "uid", seed: object = 42) -> DataFrame:
    """n rows uniformly, all of them when there are fewer."""
    return hashed_positions(df, [], [uid], seed).filter(F.col("pos") <= n).drop("pos")


def shuffled(df: DataFrame, uid: str = "uid", seed: object = 42) -> DataFrame:
    """Rows in seeded-hash order, with their position."""
    return hashed_positions(df, [], [uid], seed)


def correct_inputs(results: DataFrame, lo: int = 1, hi: int = 100, funcs: Sequence[str] | None = None) -> DataFrame:
    """Distinct (function, input) answered correctly within the input range."""
    rows = results.filter(F.coalesce("is_correct", F.lit(False)) & F.col("input").between(lo, hi))
    if funcs is not None:
        rows = rows.filter(F.col("function").isin(list(funcs)))
    return rows.select("function", "input").distinct()


def make_queries(inputs: DataFrame, constant, fmt: str = "original", limit: int | None = None, at_random: bool = False, seed: object = 42) -> DataFrame:
    """Queries for correct inputs, numbered in (function, input) order.

    Numbers come from per-function counts: at most one row per function is
    ranked, and inputs are ranked within their function (inputs are a bounded
    range).
    """
    by_input = W.partitionBy("function").orderBy("input")
    rows = inputs
    if limit is not None:
        key = seeded_hash(seed, "function", "input") if at_random else F.col("input")
        w = W.partitionBy("function").orderBy(key, "input")
        rows = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit).drop("__r")
    counts = rows.groupBy("function").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("function").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("function", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    placed = rows.withColumn("__i", F.row_number().over(by_input)).join(offsets, "function")
    return placed.select(
        F.concat(F.lit("q_"), (F.col("off") + F.col("__i") - 1).cast("string")).alias("uid"),
        tx.prompt(F.col("function"), F.col("input"), fmt).alias("query"),
        constant(F.col("function")).cast("string").alias("completion"),
        F.col("function").alias("func"),
        F.lit(True).alias("correct"),
    )


def constant_lookup(sources: Sequence[DataFrame]) -> DataFrame:
    """(constant, funcs): functions per constant; the first source naming a function wins."""
    tagged = None
    for rank, df in enumerate(sources):
        rows = df.select("func", F.col("constant").cast("int").alias("constant"), F.lit(rank).alias("rank"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    named = tagged.filter("func IS NOT NULL AND constant IS NOT NULL")
    owner = named.groupBy("func").agg(F.min_by("constant", F.struct("rank", "constant")).alias("constant"))
    return owner.groupBy("constant").agg(F.array_sort(F.collect_list("func")).alias("funcs"))
