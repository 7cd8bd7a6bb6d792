"""Top-k, examples, restricted lists, global picks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..session import materialize, ship_if_small
from . import relevance as rel
from .positions import hashed_positions, seeded_hash, sorted_positions

# Rows that every task may hand on in a pick.
SMALL_PICK = 10_000


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ("query_uid",)) -> DataFrame:
    """Best ``k`` documents per query, rank 1 first; equal scores go by uid.

    The rank filter lets Spark keep only k rows per task before the shuffle, so
    a query that matches the whole corpus costs no more than k rows per task.
    """
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("uid"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k_complete(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents per query where unstored pairs score 0, whatever the sign of stored ones.

    Stored positives come first, then unstored documents by uid, then stored negatives.  The
    unstored ones are looked for among the first 4k uids of the corpus.  For the queries that
    need more (those whose negatives fill the first) each document notes in bits which of them
    store it, and the first documents with a free bit are taken.  ``scores`` is read once, or
    twice where such queries are; tasks hand on the best rows they read, never all pairs.
    """
    size = 4 * k
    pool = docs.select("uid").orderBy("uid").limit(size)
    first = pool.agg(F.sort_array(F.collect_list("uid")).alias("u"))
    lists = _held(scores, pool, size)
    rows = queries.select("query_uid").join(lists, "query_uid", "left").select("query_uid", F.coalesce("held", _no_rows()).alias("held"), first.scalar().alias("pool"))
    # Negatives may only follow once no unstored document is left out.
    reached = (F.size("pool") < size) | ((F.size("best") == k) & (F.element_at("best", -1)["score"] >= 0))
    rows = _ranked(rows, k).withColumn("whole", F.coalesce(reached, F.lit(False)))
    rows = materialize(rows.select("query_uid", "best", "whole", F.when(~F.col("whole"), F.col("held")).alias("held")))
    done = rows.filter("whole").select("query_uid", F.inline("best"))
    left = rows.filter("not whole").select("query_uid", "held")
    if not left.limit(1).count():
        return done
    absent = _absent(scores, left.select("query_uid").distinct(), docs, k)
    absent = absent.groupBy("query_uid").agg(F.collect_list("uid").alias("pool"))
    more = _copied(left, docs).join(absent, "query_uid", "left").withColumn("pool", F.coalesce("pool", F.array().cast("array<string>")))
    return done.unionByName(materialize(_ranked(more, k).select("query_uid", F.inline("best"))))


def _no_rows():
    return F.array().cast("array<struct<minus:double,uid:string,inside:boolean>>")


def _held(scores: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    """(query_uid, held): the stored rows of each query in the pool, and its best ``size`` of each sign."""
    stored = scores.select("query_uid", "uid", "score").join(
        ship_if_small(pool.select("uid", F.lit(True).alias("inside")), 48), "uid", "left"  # 4k uids
    )
    kind = F.when(F.col("inside"), 0).when(F.col("score") > 0, 1).otherwise(2)
    stored = stored.select("query_uid", "uid", "score", kind.alias("kind")).mapInArrow(_best_of_task(size), "query_uid string, uid string, score double, kind int")
    w = W.partitionBy("query_uid", "kind").orderBy(F.col("score").desc(), "uid")
    trimmed = stored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= size)
    row = F.struct((-F.col("score")).alias("minus"), "uid", (F.col("kind") == 0).alias("inside"))
    return trimmed.groupBy("query_uid").agg(F.collect_list(row).alias("held"))


def _best_of_task(size: int):
    """Rows that may be among the best ``size`` of a query and kind: what a task holds is cut whenever it has grown."""

    def cut(table: pa.Table) -> pa.Table:
        queries = pc.dictionary_encode(table.column("query_uid").combine_chunks(), null_encoding="encode")
        group = queries.indices.to_numpy().astype(np.int64) * 3 + table.column("kind").to_numpy()
        minus = -table.column("score").to_numpy()

        def places(order):
            starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
            many = np.diff(np.append(starts, len(order)))
            return np.arange(len(order)) - np.repeat(starts, many), starts, many

        order = np.lexsort((minus, group))
        _, starts, many = places(order)
        edge = minus[order][starts + np.minimum(many, size) - 1]
        kept = np.empty(len(order), bool)
        kept[order] = minus[order] <= np.repeat(edge, many)
        table, group = table.filter(pa.array(kept)), group[kept]
        if len(group) > size * len(starts):  # many ties: the first uids stay
            table = table.append_column("g", pa.array(group))
            order = pc.sort_indices(table, sort_keys=[("g", "ascending"), ("score", "descending"), ("uid", "ascending")], null_placement="at_start").to_numpy()
            table = table.drop_columns(["g"]).take(pa.array(order[places(order)[0] < size]))
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, most = [], 0, 1 << 19
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n > most:
                table = cut(pa.Table.from_batches(parts))
                parts, n = table.combine_chunks().to_batches(), table.num_rows
                most = max(1 << 19, 2 * n)
        if n:
            yield from cut(pa.Table.from_batches(parts)).to_batches()

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """``best``: the first ``k`` of the stored rows and of the unstored uids of ``pool``."""
    own = F.transform("held", lambda r: F.struct(r["minus"].alias("minus"), r["uid"].alias("uid")))
    absent = F.transform(F.array_except("pool", F.transform("held", lambda r: r["uid"])), lambda u: F.struct(F.lit(0.0).alias("minus"), u.alias("uid")))
    order = F.slice(F.array_sort(F.concat(own, absent)), 1, k)
    ranked = F.transform(order, lambda r, i: F.struct((i + 1).cast("int").alias("rank"), r["uid"].alias("uid"), (F.lit(0.0) - r["minus"]).alias("score")))
    return rows.withColumn("best", ranked)


def _absent(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_uid, uid): the first ``k`` uids without a stored score of each query."""
    placed = sorted_positions(queries, [], ["query_uid"])
    place = F.col("pos") - 1
    placed = materialize(placed.select("query_uid", F.floor(place / 64).cast("int").alias("word"), (place % 64).cast("int").alias("bit")))
    bits = F.bit_or(F.expr("shiftleft(1L, bit)"))
    held = scores.select("query_uid", "uid").join(ship_if_small(placed, 64), "query_uid").groupBy("uid", "word").agg(bits.alias("held"))
    every = docs.select("uid").distinct().crossJoin(F.broadcast(placed.groupBy("word").agg(bits.alias("all"))))
    held = held.select(F.col("uid").alias("u"), F.col("word").alias("w"), "held")
    open_ = every.join(held, F.col("uid").eqNullSafe(F.col("u")) & (F.col("word") == F.col("w")), "left")
    open_ = open_.select("uid", "word", F.col("all").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long")))).alias("free")).filter("free <> 0")
    ones = F.expr("filter(sequence(0, 63), b -> shiftrightunsigned(free, b) % 2 <> 0)")
    w = W.partitionBy("word", "bit").orderBy("uid")
    best = open_.select("uid", "word", F.explode(ones).alias("bit")).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    return best.join(placed, ["word", "bit"]).select("query_uid", "uid")


def _copied(left: DataFrame, docs: DataFrame) -> DataFrame:
    """Held rows outside the first pool as often as the corpus has their uid, as it is for those inside."""
    rows = left.withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows)
    outside = rows.select(F.explode("held").alias("r")).filter("not r.inside").select("r.uid").distinct()
    copies = docs.select("uid").join(ship_if_small(outside, 48), "uid", "left_semi").groupBy("uid").count().filter("count > 1")
    extra = rows.select("__row", F.explode("held").alias("r")).filter("not r.inside").withColumn("uid", F.col("r.uid"))
    extra = extra.join(copies, "uid").select("__row", F.explode(F.array_repeat("r", F.col("count").cast("int") - 1)).alias("r"))
    extra = extra.groupBy("__row").agg(F.collect_list("r").alias("extra"))
    return rows.join(extra, "__row", "left").select("query_uid", F.concat("held", F.coalesce("extra", _no_rows())).alias("held"))


def ranked_with_meta(ranked: DataFrame, queries: DataFrame, docs: DataFrame, mates: str = "all", **rule) -> DataFrame:
    """Ranked rows with query function, document fields, relevance and category."""
    meta = docs.select(
        "uid", F.col("func").alias("doc_func"), F.col("role").alias("doc_role")
    )
    out = ranked.join(queries.select("query_uid", "func"), "query_uid").join(meta, "uid")
    hit = rel.pair_is_relevant(F.col("func"), F.col("doc_func"), F.col("doc_role"), mates, **rule)
    return out.withColumn("relevant", hit).withColumn(
        "category", rel.category(F.col("doc_func"), F.col("doc_role"), F.col("relevant"))
    )


def correct_queries(queries: DataFrame, missing: bool = False) -> DataFrame:
    """Queries marked correct; ``missing`` says what a missing mark means."""
    return queries.filter(F.coalesce(F.col("correct"), F.lit(missing)))


def clean_queries(queries: DataFrame) -> DataFrame:
    """Drop queries with neither prompt nor completion and fill the defaults."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return queries.filter(has("prompt") | has("completion")).withColumn(
        "func", F.coalesce("func", F.lit("unknown"))
    ).withColumn("correct", F.coalesce("correct", F.lit(False)))


def example_report(ranked: DataFrame, queries: DataFrame, docs: DataFrame, per_func: int = 1) -> DataFrame:
    """First ``per_func`` correct queries of each function with their ranked documents."""
    w = W.partitionBy("func").orderBy("query_uid")
    chosen = (
        correct_queries(queries)
        .withColumn("__i", F.row_number().over(w))
        .filter(F.col("__i") <= per_func)
        .select("query_uid", "func")
    )
    rows = ranked_with_meta(ranked.join(chosen.select("query_uid"), "query_uid"), chosen, docs, mates="none")
    return rows.select("func", "query_uid", "rank", "uid", "score", "doc_func", "doc_role", "relevant")


def restricted_scores(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores of relevant documents only, per correct query; absent pairs score 0."""
    funcs = correct_queries(queries).select("query_uid", "func")
    wanted = funcs.join(rel.relevant_pairs(docs, funcs), "func")
    return wanted.join(scores.select("query_uid", "uid", "score"), ["query_uid", "uid"], "left").select(
        "query_uid", "func", "uid", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def function_scores(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean score of a document over each function's correct queries, absent pairs 0.

    (uid, func, score); the divisor is the function's query count, so documents a
    query never matched count as 0 without being stored.
    """
    good = correct_queries(queries).select("query_uid", "func")
    counts = good.groupBy("func").agg(F.count(F.lit(1)).alias("n_queries"))
    # One query may own a third of the scores: ship the queries when proven small.
    sums = scores.join(ship_if_small(good, 64), "query_uid").groupBy("uid", "func").agg(F.sum("score").alias("s"))
    return sums.join(counts, "func").select("uid", "func", (F.col("s") / F.col("n_queries")).alias("score"))


def combined_scores(func_scores: DataFrame, queries: DataFrame) -> DataFrame:
    """(uid, influence_score): mean over functions of the function means, absent functions 0."""
    n = correct_queries(queries).agg(F.count_distinct("func").alias("n")).scalar()
    return func_scores.groupBy("uid").agg(F.sum("score").alias("s")).select(
        "uid", (F.col("s") / n).alias("influence_score")
    )


def wide_scores(func_scores: DataFrame, funcs: Sequence[str]) -> DataFrame:
    """One ``<key>_influence_score`` column per function; for export over a known function list."""
    long = func_scores.withColumn("key", F.concat(tk.score_key(F.col("func")), F.lit("_influence_score")))
    return long.groupBy("uid").pivot("key", list(funcs)).agg(F.first("score"))


def ranked_list(docs_scores: DataFrame) -> DataFrame:
    """Whole ranking by combined score, ties by uid (a range sort)."""
    return docs_scores.orderBy(F.col("influence_score").desc(), "uid")


def pick_top(ranked: DataFrame, k: int, column: str | None = None, seed: object = 42, mode: str = "influence") -> DataFrame:
    """Ids of the ``k`` best rows by ``column`` (missing = lowest), or ``k`` random ones.

    Up to ``SMALL_PICK`` the best of each task are merged; more are found by their positions.
    """
    if mode == "random":
        if k <= SMALL_PICK:
            return ranked.select("uid").orderBy(seeded_hash(seed, "uid"), "uid").limit(k)
        return hashed_positions(ranked.select("uid"), [], ["uid"], seed).filter(F.col("pos") <= k).select("uid")
    keyed = ranked.select("uid", F.coalesce(F.col(column), F.lit(float("-inf"))).alias("__s"))
    order = [F.col("__s").desc(), F.col("uid")]
    if k <= SMALL_PICK:
        return keyed.orderBy(*order).limit(k).select("uid")
    return sorted_positions(keyed, [], order).filter(F.col("pos") <= k).select("uid")


def resolve_score_key(columns: Sequence[str], token: str) -> str:
    """Score column for a token: exact key, then short key, then the combined column."""
    exact = f"{token}_influence_score"
    bare = token.strip("<>").lower()
    short = bare[:-1] if bare.endswith("n") and len(bare) > 1 and not any(ch.isdigit() for ch in bare) else bare
    for name in (exact, f"{short}_influence_score", "combined_influence_score"):
        if name in columns:
            return name
    raise ValueError(f"no score column for {token}")


def percent_sweep(ranked: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    """(percent, uid): nested selections of the best pct% rows, ranked once.

    The cut of each percent is an integer division of the row count, as in
    top_k = total * pct / 100.
    """
    keyed = ranked.select("uid", F.coalesce(F.col(column), F.lit(float("-inf"))).alias("__s"))
    placed = sorted_positions(keyed, [], [F.col("__s").desc(), F.col("uid")])
    total = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    steps = F.array(*[F.lit(int(p)) for p in sorted(percents)])
    cut = lambda p: F.floor(F.col("__total") * p / 100)
    return placed.withColumn("__total", total).select(
        F.explode(F.filter(steps, lambda p: F.col("pos") <= cut(p))).alias("percent"), "uid"
    )


def keep_selected(dataset: DataFrame, selected: DataFrame, key: str = "uid") -> DataFrame:
    """Rows of ``dataset`` whose ``key`` was selected."""
    return dataset.join(selected.select(key).distinct(), key, "left_semi")
