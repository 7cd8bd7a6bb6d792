"""Running totals and positions that survive hot groups.

A plain ``row_number() over (partition by group order by key)`` sends a whole
group to one task.  Here a group is cut into ordered buckets first: totals are
summed per (group, bucket), the running sum over buckets gives each bucket its
offset, and the in-bucket running sum finishes the job.  No task sees more than
one bucket of one group.

Two ways to cut:

* hashed order: the bucket is a prefix of the row's md5, a pure function of the
  row, so the plan stays lazy and is safe to recompute;
* value order: the bucket is the partition a range shuffle put the row in.  The
  boundaries come from sampling, so the tagged rows are materialized once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

_BUCKET = "__bucket"
_OFFSET = "__before"


def seeded_hash(seed: object, *ids: str | Column) -> Column:
    """The library's only source of "randomness": md5 of seed and identity.

    Any SQL engine with md5 reproduces it, and it does not depend on row order
    or partitioning.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weights: dict[str, Column],
    total: str | None = None,
) -> DataFrame:
    keys = [*group, _BUCKET]
    weighted = df.select("*", *[w.alias(f"__w_{n}") for n, w in weights.items()])
    totals = weighted.groupBy(*keys).agg(
        *[F.sum(f"__w_{n}").alias(f"__t_{n}") for n in weights]
    )
    # One row per (group, bucket): the window below is bounded by the bucket count.
    by_bucket = W.partitionBy(*group).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[
            F.coalesce(F.sum(f"__t_{n}").over(by_bucket), F.lit(0)).alias(f"{_OFFSET}_{n}")
            for n in weights
        ],
        *[F.sum(f"__t_{n}").over(W.partitionBy(*group)).alias("__all") for n in list(weights)[:1]],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = weighted.select(
        *df.columns, *[F.sum(f"__w_{n}").over(inside).alias(f"__l_{n}") for n in weights]
    )
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        same = eq if same is None else same & eq
    joined = local.join(before, same, "inner")
    kept = [c for c in df.columns if c != _BUCKET]
    return joined.select(
        *kept,
        *[(F.col(f"__l_{n}") + F.col(f"{_OFFSET}_{n}")).alias(n) for n in weights],
        *([F.col("__all").alias(total)] if total else []),
    )


def hashed_positions(
    df: DataFrame,
    group: Sequence[str],
    ids: Sequence[str],
    seed: object = 42,
    out: str = "pos",
    hex_digits: int = 3,
    total: str | None = None,
) -> DataFrame:
    """1-based position of every row of its group in seeded-hash order (lazy).

    ``total`` also adds the group's row count, which the offsets know anyway.
    """
    hashed = df.withColumn("__h", seeded_hash(seed, *ids)).withColumn(
        _BUCKET, F.substring("__h", 1, hex_digits)
    )
    ranked = _running(
        hashed, group, [F.col("__h"), *[F.col(i) for i in ids]], {out: F.lit(1).cast("bigint")}, total
    )
    return ranked.drop("__h")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weights: dict[str, Column],
    partitions: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sums of ``weights`` along ``order`` inside each group.

    ``order`` must be total within a group.  One range shuffle spreads every
    group over as many partitions as its size asks for.  ``total`` also adds the
    group's whole sum of the first weight.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *[F.col(g) for g in group], *order)
    tagged = materialize(spread.withColumn(_BUCKET, F.spark_partition_id()))
    return _running(tagged, group, order, weights, total)


def sorted_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "pos"
) -> DataFrame:
    """1-based position of every row of its group in value order."""
    return running_totals(df, group, order, {out: F.lit(1).cast("bigint")})


def value_histogram(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per group with their counts, inclusive running count ``upto``
    and the group's size ``n_all``.

    ``weight`` names a column of counts when ``df`` is already counted.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    hist = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(n.alias("n_here"))
    return running_totals(hist, group, [F.col(value)], {"upto": F.col("n_here")}, total="n_all")


# How a fraction p of n sorted values becomes 0-based positions.
_INDEX_RULES = {
    # value between neighbours, weighted by the fractional part
    "linear": lambda p, n: (n - 1) * p,
    # nearest position, halves to even
    "rounded": lambda p, n: F.bround((n - 1) * p, 0),
    # truncated p * n, kept inside the array
    "truncated": lambda p, n: F.least(F.floor(n * p + F.lit(1e-9)), n - 1),
}


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    fractions: Sequence[float],
    rule: str = "linear",
) -> DataFrame:
    """Exact quantiles per group, one row per (group, fraction).

    Works on distinct values, so repeated values cost one row, and never holds a
    group's values in one task.  ``rule`` picks one of the four index
    definitions in use (linear, rounded, truncated).
    """
    hist = value_histogram(df, group, value)
    start = F.col("upto") - F.col("n_here")
    holds = lambda at: (start <= at) & (at < F.col("upto"))

    def probe(p: Column) -> Column:
        at = _INDEX_RULES[rule](p, F.col("n_all"))
        lo, hi = F.floor(at), F.ceil(at)
        return F.struct(
            p.alias("fraction"),
            (at - lo).alias("w"),
            F.when(holds(lo), F.col(value)).alias("lo"),
            F.when(holds(hi), F.col(value)).alias("hi"),
        )

    # Every distinct value knows its range of positions, so it finds the fractions
    # that fall on it by itself; no join.
    probes = F.filter(
        F.array(*[probe(F.lit(float(p))) for p in fractions]), lambda x: x["lo"].isNotNull() | x["hi"].isNotNull()
    )
    found = hist.select(*group, F.inline(probes)).groupBy(*group, "fraction").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("w").alias("w")
    )
    return found.select(*group, "fraction", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("value"))


def average_ranks(df: DataFrame, group: Sequence[str], value: str, out: str, weight: str | None = None) -> DataFrame:
    """(group, value, ``out``): average rank of every distinct value (ties share it)."""
    hist = value_histogram(df, group, value, weight)
    return hist.select(
        *group,
        value,
        (F.col("upto") - F.col("n_here") + (F.col("n_here") + 1) / 2.0).alias(out),
    )
