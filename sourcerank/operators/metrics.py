"""Ranking metrics from judged top rows, all cut-offs in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .positions import exact_quantiles, hashed_positions, running_totals

MEASURES = ["recall", "precision", "success"]
CATEGORIES = ["constant_gt", "identity_gt", "distractor", "other"]


def parse_cutoffs(multi: str | None = None, span: str | None = None, single: int | None = None) -> list[int]:
    """Cut-offs from an explicit list, a range or one value, in that priority."""
    if multi:
        parts = [p.strip() for p in multi.split(",") if p.strip()]
        if all(p.lstrip("+-").isdigit() for p in parts):
            return sorted({int(p) for p in parts if int(p) > 0})
    if span:
        ends = [p.strip() for p in span.split(",")]
        if len(ends) == 2 and all(p.lstrip("+-").isdigit() for p in ends):
            lo, hi = sorted(int(p) for p in ends)
            return list(range(max(1, lo), hi + 1))
    return [int(single)] if single is not None and int(single) > 0 else []


def per_query(judged: DataFrame, sizes: DataFrame, ks: Sequence[int], on: Sequence[str] = ("func",)) -> DataFrame:
    """Recall, precision, success and category shares per query, for all cut-offs at once.

    ``judged`` holds ranked rows up to max(k) with a boolean ``relevant`` and,
    when composition is wanted, a ``category``.  Each row counts for all k at or
    beyond its rank.  ``sizes`` carries n_relevant per key; keys with no relevant
    document are left out.  A cut-off beyond the corpus divides by what was
    retrieved.
    """
    mixed = ["category"] if "category" in judged.columns else []
    cuts = F.array(*[F.lit(int(k)) for k in sorted(set(ks))])
    spread = judged.select(
        "query_uid",
        "func",
        "relevant",
        *mixed,
        F.explode(F.filter(cuts, lambda k: F.col("rank") <= k)).alias("k"),
    )
    shares = CATEGORIES if mixed else []
    counts = spread.groupBy("query_uid", "func", "k").agg(
        F.sum(F.col("relevant").cast("bigint")).alias("hits"),
        F.count(F.lit(1)).alias("retrieved"),
        *[F.sum((F.col("category") == c).cast("bigint")).alias(c) for c in shares],
    )
    return counts.join(sizes.filter(F.col("n_relevant") > 0), list(on)).select(
        "query_uid",
        "func",
        "k",
        (F.col("hits") / F.col("n_relevant")).alias("recall"),
        (F.col("hits") / F.col("retrieved")).alias("precision"),
        (F.col("hits") > 0).cast("double").alias("success"),
        *[(F.col(c) / F.col("retrieved")).alias(c) for c in shares],
    )


def _shares(df: DataFrame) -> list[str]:
    return [c for c in CATEGORIES if c in df.columns]


def per_function(by_query: DataFrame) -> DataFrame:
    """Mean, population variance and query count per function and k, and mean shares."""
    aggs = [F.count(F.lit(1)).alias("n_queries")]
    for m in MEASURES:
        aggs += [F.avg(m).alias(m), F.var_pop(m).alias(f"{m}_var")]
    aggs += [F.avg(c).alias(c) for c in _shares(by_query)]
    return by_query.groupBy("func", "k").agg(*aggs)


def overall(by_func: DataFrame) -> DataFrame:
    """Per k: macro (mean of functions), micro (weighted by queries), mean variance,
    and the mean share of each category."""
    aggs = [F.count(F.lit(1)).alias("n_functions"), F.sum("n_queries").alias("n_queries")]
    for m in MEASURES:
        aggs += [
            F.avg(m).alias(f"{m}_overall_avg"),
            (F.sum(F.col(m) * F.col("n_queries")) / F.sum("n_queries")).alias(f"{m}_per_query_avg"),
            F.avg(f"{m}_var").alias(f"{m}_var_avg"),
        ]
    aggs += [F.avg(c).alias(f"composition_{c}") for c in _shares(by_func)]
    return by_func.groupBy("k").agg(*aggs)


def summary(by_func: DataFrame) -> DataFrame:
    """One flat row per k: recall and precision averages and the composition."""
    stats = ("overall_avg", "per_query_avg", "var_avg")
    return overall(by_func).select(
        "k",
        *[f"{m}_{s}" for m in ("recall", "precision") for s in stats],
        *[f"composition_{c}" for c in _shares(by_func)],
    )


def metrics_long(by_func: DataFrame, method: str, run: str) -> DataFrame:
    """(method, run, metric, k, func, value): the metrics object as a long table."""
    names = [c for c in by_func.columns if c not in ("func", "k", "n_queries")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    return by_func.select("func", "k", pairs.alias("p")).select(
        F.lit(method).alias("method"), F.lit(run).alias("run"), "p.metric", "k", "func", "p.value"
    )


def mrr_from_recall(curve: DataFrame, keys: Sequence[str], recall: str, clamp: bool = True) -> DataFrame:
    """Reciprocal rank from recall increments over k, optionally clamped at 0."""
    w = W.partitionBy(*keys).orderBy("k")
    step = F.col(recall) - F.lag(recall, 1, 0.0).over(w)
    stepped = curve.withColumn("__d", F.greatest(step, F.lit(0.0)) if clamp else step)
    return stepped.groupBy(*keys).agg(F.sum(F.col("__d") / F.col("k")).alias("mrr"))


def mrr_first_hit(judged: DataFrame) -> DataFrame:
    """Reciprocal rank of the first relevant row per query (0 without one)."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return judged.groupBy("query_uid", "func").agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def average_precision(scores: DataFrame, truth: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_uid, ap) over the full ranking of the given scores.

    ``scores`` has query_uid, func, uid, score; ``truth`` has (func, uid).  Ranks
    and running hits come from one range shuffle, so a query over the whole
    corpus is spread over many tasks.
    """
    marked = scores.join(truth.withColumn("__rel", F.lit(1)), ["func", "uid"], "left").select(
        "query_uid", "func", "uid", "score", F.coalesce("__rel", F.lit(0)).cast("bigint").alias("__rel")
    )
    placed = running_totals(
        marked,
        ["query_uid"],
        [F.col("score").desc(), F.col("uid")],
        {"rank": F.lit(1).cast("bigint"), "hits": F.col("__rel")},
    )
    gained = (
        placed.filter("__rel = 1")
        .groupBy("query_uid", "func")
        .agg(F.sum(F.col("hits") / F.col("rank")).alias("gain"))
    )
    return gained.join(sizes, "func").select(
        "query_uid", "func", (F.col("gain") / F.col("n_relevant")).alias("ap")
    )


def auroc(scored: DataFrame, group: Sequence[str], score: str = "score", positive: str = "is_gt") -> DataFrame:
    """Exact P(positive > other) per group, ties counting as no win.

    Works on distinct scores: for each, how many `other` lie strictly below.
    """
    hist = scored.groupBy(*group, score).agg(
        F.sum(F.col(positive).cast("bigint")).alias("gt"),
        F.sum((~F.col(positive)).cast("bigint")).alias("ot"),
    )
    run = running_totals(hist, group, [F.col(score)], {"ot_upto": F.col("ot")})
    return run.groupBy(*group).agg(
        (
            F.sum(F.col("gt") * (F.col("ot_upto") - F.col("ot")).cast("double"))
            / (F.sum("gt").cast("double") * F.sum("ot"))
        ).alias("auroc"),
        F.sum("gt").alias("n_gt"),
        F.sum("ot").alias("n_other"),
    )


def auroc_sampled(scored: DataFrame, group: Sequence[str], draws: int, seed: object = 42) -> DataFrame:
    """AUROC over at most ``draws`` rows of each kind, drawn by seeded hash without
    replacement; the exact operator above is the default, this one is the quick look."""
    placed = hashed_positions(scored, [*group, "is_gt"], ["query_uid", "uid"], seed)
    return auroc(placed.filter(F.col("pos") <= draws).drop("pos"), group)


def gt_other_means(scored: DataFrame) -> DataFrame:
    """Mean score of relevant and of other documents per query, both present."""
    return (
        scored.groupBy("query_uid", "func")
        .agg(
            F.avg(F.when(F.col("is_gt"), F.col("score"))).alias("gt_mean"),
            F.avg(F.when(~F.col("is_gt"), F.col("score"))).alias("other_mean"),
        )
        .filter("gt_mean IS NOT NULL AND other_mean IS NOT NULL")
    )


def median_ratio(pairs: DataFrame, group: Sequence[str] = (), absolute: bool = False, eps: float = 1e-9) -> DataFrame:
    """Median over queries of mean(gt)/mean(other), and the share of usable queries."""
    usable = F.abs("other_mean") > eps
    ratio = F.col("gt_mean") / F.col("other_mean")
    rows = pairs.withColumn("__r", F.when(usable, F.abs(ratio) if absolute else ratio))
    share = rows.groupBy(*group).agg(
        F.avg(F.col("__r").isNotNull().cast("double")).alias("valid_fraction"),
        F.count(F.lit(1)).alias("n_queries"),
    )
    median = exact_quantiles(rows.filter("__r IS NOT NULL"), group, "__r", [0.5]).select(
        *group, F.col("value").alias("median_ratio")
    )
    if group:
        return share.join(median, list(group), "left")
    return share.select("*", median.select("median_ratio").scalar().alias("median_ratio"))


def box_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, quartiles and IQR per group, linear interpolation."""
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("fraction") == p, F.col("value")))
    wide = q.groupBy(*group).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
    n = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return n.join(wide, list(group)).withColumn("iqr", F.col("q3") - F.col("q1"))


def random_recall_baseline(docs: DataFrame, ks: Sequence[int], n_gt: int = 1) -> DataFrame:
    """Chance level per k: recall min(k/N, 1), precision n_gt/N."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    cuts = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    return n.select("n", cuts).select(
        "k",
        F.least(F.col("k") / F.col("n"), F.lit(1.0)).alias("recall"),
        (F.lit(n_gt) / F.col("n")).alias("precision"),
    )


def random_precision_by_function(sizes: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of the corpus relevant to each function: chance precision."""
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sizes.select("func", (F.col("n_relevant") / n).alias("precision"))


def std_band(curve: DataFrame, mean: str, variance: str) -> DataFrame:
    """mean +- std, clipped to [0, 1]."""
    std = F.sqrt(F.coalesce(F.col(variance), F.lit(0.0)))
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return curve.withColumn("low", clip(F.col(mean) - std)).withColumn("high", clip(F.col(mean) + std))


def aligned_histogram(values: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts per bin centred on multiples of 1/bins; values outside the edges are not counted."""
    slot = F.floor(F.col(value) * bins + 0.5)
    return (
        values.filter(F.col(value).isNotNull())
        .groupBy(slot.cast("int").alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("slot") >= 0) & (F.col("slot") <= bins))
        .withColumn("centre", F.col("slot") / bins)
    )


