"""Training orders as computed positions instead of in-memory lists.

Every order is expressed by columns whose sort gives the sequence, so writing
``orderBy(*columns)`` is a range sort and nothing is placed by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..session import ship_if_small
from .positions import hashed_positions, seeded_hash


def alternating(df: DataFrame, pattern: Sequence[str], max_size: int | None = None, seed: object = 42) -> DataFrame:
    """Repeat ``pattern`` (a list of functions) over the corpus, remainder after it.

    Cycles = min over pattern functions of count // need, capped by max_size.
    Adds ``phase`` (0 pattern, 1 remainder) and ``position`` (1-based).
    """
    need = {f: list(pattern).count(f) for f in dict.fromkeys(pattern)}
    slots = {f: [i for i, p in enumerate(pattern) if p == f] for f in need}
    size = len(pattern)
    counts = df.filter(F.col("func").isin(list(need))).groupBy("func").agg(F.count(F.lit(1)).alias("n"))
    need_map = F.create_map(*[F.lit(x) for kv in need.items() for x in kv])
    slot_map = F.create_map(*[x for f, s in slots.items() for x in (F.lit(f), F.array(*[F.lit(i) for i in s]))])
    full = F.count(F.lit(1)) == len(need)
    fit = F.min(F.floor(F.col("n") / F.try_element_at(need_map, F.col("func"))))
    cycles = F.when(full, fit).otherwise(0)
    if max_size is not None:
        cycles = F.least(cycles, F.lit(max_size // size))
    total = counts.agg(F.coalesce(cycles, F.lit(0)).cast("bigint").alias("c"))

    placed = hashed_positions(df, ["func"], ["uid"], seed, out="__rn").withColumn("__c", total.scalar())
    per = F.try_element_at(need_map, F.col("func"))
    used = F.coalesce(F.col("__rn") <= F.col("__c") * per, F.lit(False))
    cycle = F.floor((F.col("__rn") - 1) / per)
    slot = F.element_at(F.try_element_at(slot_map, F.col("func")), ((F.col("__rn") - 1) % per + 1).cast("int"))
    head = placed.filter(used).withColumn("position", cycle * size + slot + 1).withColumn("phase", F.lit(0))
    rest = hashed_positions(placed.filter(~used), [], ["uid"], f"{seed}-rest", out="__r")
    rest = rest.withColumn("position", F.col("__c") * size + F.col("__r")).withColumn("phase", F.lit(1)).drop("__r")
    if max_size is not None:
        rest = rest.filter(F.col("position") <= max_size)
    return head.unionByName(rest).drop("__rn", "__c")


def pattern_letters(available: Sequence[str]) -> list[str]:
    """Default pattern: base then wrapper of every named pair that is fully present."""
    return [
        f
        for b, w in zip(tk.BASE_TOKENS, tk.WRAPPER_TOKENS)
        if b in available and w in available
        for f in (b, w)
    ]


def transitions(ordered: DataFrame, func: str = "func", position: str = "position") -> DataFrame:
    """One row: rows, changes of function between neighbours, and distinct functions.

    Neighbours meet by an equi-join on position, so no task reads the whole order.
    """
    here = ordered.select(F.col(position).alias("p"), F.col(func).alias("f"))
    nxt = ordered.select((F.col(position) - 1).alias("p"), F.col(func).alias("g"))
    pairs = here.join(nxt, "p", "left")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce((F.col("f") != F.col("g")).cast("bigint"), F.lit(0))).alias("transitions"),
        F.count_distinct("f").alias("n_functions"),
    )


def preview(ordered: DataFrame, length: int = 20, func: str = "func") -> DataFrame:
    """First ``length`` functions of the order as one string."""
    head = ordered.filter(F.col("position") <= length).agg(
        F.array_sort(F.collect_list(F.struct(F.col("position"), F.col(func).alias("f")))).alias("h")
    )
    return head.select(F.array_join(F.transform("h", lambda s: s["f"]), " ").alias("pattern"))


def _depth():
    return F.coalesce("hop_depth", F.lit(-1))


def depth_complete_groups(df: DataFrame, seed: object = 42) -> DataFrame:
    """One document per depth of a family, family groups shuffled together.

    Adds ``phase`` (0 complete groups, 1 leftovers, 2 no family), ``group_key`` and
    ``depth``; the order is (phase, group_key, depth, uid).  A family forms as many
    groups as its shallowest depth has documents.
    """
    rows = df.withColumn("depth", _depth())
    placed = hashed_positions(rows, ["family", "depth"], ["uid"], seed, out="round")
    sizes = rows.groupBy("family", "depth").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(
        F.min("n").alias("complete")
    )
    sizes = sizes.withColumnRenamed("family", "__f")
    # Rows without a family share one key: ship the sizes when proven small.
    joined = placed.join(ship_if_small(sizes, 64), F.col("family").eqNullSafe(F.col("__f")))
    grouped = F.col("family").isNotNull() & (F.col("round") <= F.col("complete"))
    key = F.when(grouped, seeded_hash(f"{seed}-groups", "family", "round")).otherwise(
        seeded_hash(f"{seed}-rest", "uid")
    )
    return joined.select(
        *df.columns,
        "depth",
        F.col("round"),
        F.when(F.col("family").isNull(), 2).when(grouped, 0).otherwise(1).alias("phase"),
        key.alias("group_key"),
    )


def family_spread(df: DataFrame, seed: object = 42) -> DataFrame:
    """Round-robin over families, each family depth by depth.

    Adds ``round`` and ``family_key``; the order is (phase, round, family_key, uid).
    """
    rows = df.withColumn("depth", _depth())
    placed = hashed_positions(rows, ["family", "depth"], ["uid"], seed, out="__in")
    sizes = rows.groupBy("family", "depth").agg(F.count(F.lit(1)).alias("n"))
    # One row per (family, depth): the window sees a family's handful of depths.
    lower = W.partitionBy("family").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    offs = sizes.select(
        F.col("family").alias("__f"), F.col("depth").alias("__d"), F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("__off")
    )
    joined = placed.join(
        ship_if_small(offs, 64), F.col("family").eqNullSafe(F.col("__f")) & (F.col("depth") == F.col("__d"))
    )
    has = F.col("family").isNotNull()
    return joined.select(
        *df.columns,
        "depth",
        F.when(has, 0).otherwise(1).alias("phase"),
        F.when(has, F.col("__in") + F.col("__off")).otherwise(0).alias("round"),
        F.when(has, seeded_hash(f"{seed}-families", "family")).otherwise(seeded_hash(f"{seed}-rest", "uid")).alias("family_key"),
    )


def depth_batches(df: DataFrame, batch: int, ratio: Sequence[int] = (), seed: object = 42) -> DataFrame:
    """Depth-homogeneous batches, round-robin over depths.

    The last block of a depth is padded by drawing rows of the same depth again;
    ``ratio`` repeats the blocks of the i-th depth.  Adds depth, block, slot,
    repeat and is_pad; the order is (block, depth, repeat, slot).
    """
    rows = df.withColumn("depth", _depth())
    placed = hashed_positions(rows, ["depth"], ["uid"], seed, out="rn")
    counts = rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    slots = counts.select(
        "depth", "n", F.explode(F.sequence(F.lit(1), F.lit(max(1, batch - 1)))).alias("j")
    ).filter((F.col("n") % batch > 0) & (F.col("j") <= batch - F.col("n") % batch))
    draw = F.conv(F.substring(seeded_hash(f"{seed}-pad", "depth", "j"), 1, 12), 16, 10).cast("bigint")
    pads = slots.select("depth", (F.pmod(draw, F.col("n")) + 1).alias("rn"), (F.col("n") + F.col("j")).alias("at"))
    real = placed.withColumn("at", F.col("rn")).withColumn("is_pad", F.lit(False))
    # At most batch - 1 pad rows per depth.
    again = placed.join(ship_if_small(pads, 32), ["depth", "rn"]).withColumn("is_pad", F.lit(True))
    both = real.unionByName(again)
    rank = counts.select("depth", (F.row_number().over(W.orderBy("depth")) - 1).alias("__i"))
    wanted = F.array(*[F.lit(max(1, int(r))) for r in ratio]) if ratio else F.array(F.lit(1))
    times = F.coalesce(F.get(wanted, F.col("__i")), F.lit(1))
    return (
        both.join(rank, "depth")
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), times)))
        .select(
            *df.columns,
            "depth",
            F.floor((F.col("at") - 1) / batch).alias("block"),
            ((F.col("at") - 1) % batch).alias("slot"),
            "repeat",
            "is_pad",
        )
    )


def with_family(df: DataFrame) -> DataFrame:
    """Add ``family``: chain index of func, else of the first chain token in the text."""
    return df.withColumn("family", tk.family_in_text(F.col("func"), F.col("text")))


def assign_genres(funcs: DataFrame, repeats: int, genres: Sequence[str], diagonal: bool = True) -> DataFrame:
    """(func, repeat, genre, occurrence) for functions numbered ``i`` from 0.

    Diagonal shifts the genre with the function, slot ties it to the repeat.
    ``occurrence`` counts earlier uses of the genre by the function.
    """
    names = F.array(*[F.lit(g) for g in genres])
    n = len(genres)
    rows = funcs.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    shift = F.col("i") + F.col("repeat") - 1 if diagonal else F.col("repeat") - 1
    picked = rows.withColumn("genre", F.element_at(names, (F.pmod(shift, F.lit(n)) + 1).cast("int")))
    # The same genre comes back every n repeats.
    return picked.withColumn("occurrence", F.floor((F.col("repeat") - 1) / n).cast("int"))


def canonical_order(df: DataFrame, func: str = "func") -> DataFrame:
    """Chain tokens by depth and index, then everything else by name."""
    f = F.col(func)
    index = tk.chain_index(f)
    chain = index.isNotNull()
    return df.select(
        "*",
        F.when(chain, 0).otherwise(1).alias("sort_class"),
        F.when(chain, tk.hop_depth(f)).otherwise(0).alias("sort_depth"),
        F.coalesce(index, F.lit(0)).alias("sort_index"),
    )


def first_functions(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` functions: canonical order, named pairs in pair order."""
    names = canonical_order(df.select("func").distinct())
    spot = [F.array_position(F.array(*[F.lit(x) for x in side]), F.col("func")) for side in (tk.BASE_TOKENS, tk.WRAPPER_TOKENS)]
    pair = F.greatest(*spot)
    keep = names.orderBy("sort_class", "sort_depth", "sort_index", pair, "func").limit(n).select("func")
    # n names at most.
    return df.join(F.broadcast(keep), "func", "left_semi")


def depth_eval_set(seeds: DataFrame, depth: int, order: str = "uid", n: int | None = None) -> DataFrame:
    """First seed of every function at a depth: (func, constant, role)."""
    const = F.coalesce("constant", tk.chain_index(F.col("func")))
    rows = seeds.filter(F.coalesce("hop_depth", F.lit(0)) == depth).select(
        "func", F.struct(const.alias("constant"), F.coalesce("role", F.lit("constant")).alias("role")).alias("r"), order
    )
    picked = rows.groupBy("func").agg(F.min_by("r", order).alias("r")).select("func", "r.*")
    return picked if n is None else first_functions(picked, n)


