"""Run analytics: correlations, layers, factors, statistics, sweeps, leaderboards."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tk
from ..session import materialize, ship_if_small
from ..sources.runs import INFLUENCE_RUN, RANDOM_RUN
from .positions import average_ranks, exact_quantiles, sorted_positions

# --- fixed values -------------------------------------------------------------
METRICS_AT_K = ["recall", "precision", "composition"]
HEURISTIC_DAMPING = 0.1
FACTOR_PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
# ------------------------------------------------------------------------------


# --- correlation ---------------------------------------------------------------
def spearman(paired: DataFrame, keys: Sequence[str], left: str = "l", right: str = "r") -> DataFrame:
    """(keys, rho, n): rank correlation with average tie ranks; NaN for n <= 1 or constant sides.

    Rows are first counted per distinct (left, right) value pair, so repeated
    values shrink before ranks are looked up; the counts are written once because
    both rankings and the final sums read them.
    """
    rows = paired.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    return _spearman_counted(materialize(rows.groupBy(*keys, left, right).agg(F.count(F.lit(1)).alias("c"))), keys, left, right)


def _spearman_counted(joint: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """:func:`spearman` of stored (keys, left, right, c): distinct pairs of values and how often each came."""
    ranked = joint.join(ship_if_small(average_ranks(joint, keys, left, "rl", "c"), 64), [*keys, left]).join(
        ship_if_small(average_ranks(joint, keys, right, "rr", "c"), 64), [*keys, right]
    )
    c, x, y = F.col("c").cast("double"), F.col("rl"), F.col("rr")
    sums = ranked.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.sum(c * x).alias("sx"),
        F.sum(c * y).alias("sy"),
        F.sum(c * x * x).alias("sxx"),
        F.sum(c * y * y).alias("syy"),
        F.sum(c * x * y).alias("sxy"),
    )
    n = F.col("n").cast("double")
    vx_ = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy_ = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    flat = (F.col("n") <= 1) | (vx_ <= 1e-9) | (vy_ <= 1e-9)
    return sums.select(*keys, F.when(flat, F.lit(float("nan"))).otherwise(cov / F.sqrt(vx_ * vy_)).alias("rho"), "n")


def ranking_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per score key: rank correlation of two rankings over shared uids.

    Inputs are long (uid, key, score).
    """
    a = left.select("uid", "key", F.col("score").alias("l"))
    b = right.select("uid", "key", F.col("score").alias("r"))
    return spearman(a.join(b, ["uid", "key"]), ["key"])


def method_correlation(scores: DataFrame) -> DataFrame:
    """(a, b, rho, n) for every pair of methods from (method, uid, score); diagonal 1.

    Each uid's few method scores become one row, so methods are paired inside the
    row and no self-join is needed.  NaN scores drop the pair.  A few methods are columns
    of that row; where a uid has a method twice, and for more methods, the row is a list.
    """
    usable = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    own = materialize(scores.groupBy("method").agg(F.count(F.lit(1)).alias("n")))
    names = [r["method"] for r in own.limit(_METHOD_COLUMNS + 1).collect()]
    joint = _pairs_of_columns(usable, sorted(n for n in names if n is not None)) if len(names) <= _METHOD_COLUMNS else None
    rho = spearman(_pairs_of_lists(usable), ["a", "b"]) if joint is None else _spearman_counted(joint, ["a", "b"], "l", "r")
    mirrored = rho.unionByName(rho.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho", "n"))
    return mirrored.unionByName(own.select(F.col("method").alias("a"), F.col("method").alias("b"), F.lit(1.0).alias("rho"), "n"))


# More methods than this are paired in lists.
_METHOD_COLUMNS = 12


def _pairs_of_lists(usable: DataFrame) -> DataFrame:
    """(uid, a, b, l, r): the scores of every two methods of a uid."""
    per = usable.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("method", "score"))).alias("s"))
    combos = F.flatten(
        F.transform(
            "s",
            lambda x: F.transform(
                F.filter("s", lambda y: x["method"] < y["method"]),
                lambda y: F.struct(
                    x["method"].alias("a"), y["method"].alias("b"), x["score"].alias("l"), y["score"].alias("r")
                ),
            ),
        )
    )
    return per.select("uid", F.inline(combos))


def _pairs_of_columns(usable: DataFrame, names: list) -> DataFrame | None:
    """Stored (a, b, l, r, c): how often two methods have these scores; None if a uid has a method twice.

    One number for each method is summed up without sorting the uids, which lists of scores would need.
    """
    is_one = [F.col("method") == F.lit(n) for n in names]
    columns = [F.max(F.when(own, F.col("score"))).alias(f"s{k}") for k, own in enumerate(is_one)]
    per = usable.groupBy("uid").agg(*columns, *[F.count_if(own).alias(f"n{k}") for k, own in enumerate(is_one)])
    pair = lambda i, j: F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"s{i}").alias("l"), F.col(f"s{j}").alias("r"))
    pairs = [pair(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not pairs:
        return None
    # A pair without a right score stands for the uids that have a method twice.
    twice = F.greatest(*[F.col(f"n{k}") for k in range(len(names))]) > 1
    mark = F.struct(F.lit(names[0]).alias("a"), F.lit(names[1]).alias("b"), F.col("s0").alias("l"), F.lit(None).cast(usable.schema["score"].dataType).alias("r"))
    held = F.filter(F.array(*pairs), lambda p: p["l"].isNotNull() & p["r"].isNotNull())
    rows = per.select(F.inline(F.when(twice, F.array(mark)).otherwise(held)))
    joint = materialize(rows.groupBy("a", "b", "l", "r").agg(F.count(F.lit(1)).alias("c")))
    return None if joint.filter("r is null").limit(1).count() else joint


# --- layers and self-influence -----------------------------------------------------
def layer_index(name: Column) -> Column:
    """Layer number from '..layers_12..', else from '..layer_12..'."""
    get = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit("")).cast("int")
    return F.coalesce(get(r"layers_(\d+)"), get(r"layer_(\d+)"))


def layer_scores(scores: DataFrame) -> DataFrame:
    """(layer, uid, score): mean over a layer's components, ignoring NaN; all-NaN gives NaN."""
    value = F.when(~F.isnan("score"), F.col("score"))
    rows = scores.withColumn("layer", layer_index(F.col("component"))).filter("layer IS NOT NULL")
    return rows.groupBy("layer", "uid").agg(F.coalesce(F.avg(value), F.lit(float("nan"))).alias("score"))


def self_influence_summary(df: DataFrame) -> DataFrame:
    """Count and mean by role and by (role, func), NaN dropped."""
    rows = df.filter(F.col("self_influence").isNotNull() & ~F.isnan("self_influence")).select(
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("func", F.lit("unknown")).alias("func"),
        "self_influence",
    )
    return rows.groupingSets([[F.col("role")], [F.col("role"), F.col("func")]], "role", "func").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("count"),
        F.avg("self_influence").alias("mean"),
    )


# --- regression -----------------------------------------------------------------------
def fit_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation over n points under no association.

    The density of r is (1 - r^2)^((n-4)/2); with r = cos(a) both the tail and the
    whole are integrals of sin(a)^(n-3).
    """
    if n < 3 or r != r:
        return float("nan")

    def area(top: float) -> float:
        a = np.linspace(0.0, top, 20001)
        return float(np.trapezoid(np.sin(a) ** (n - 3), a))

    return area(float(np.arccos(min(1.0, abs(r))))) / area(float(np.pi / 2))


def with_p_value(fits: DataFrame, steps: int = 2000) -> DataFrame:
    """Fits with the two-sided p-value of their r (null below three points), by the integral of :func:`fit_p_value`."""

    def area(top: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 0.5).otherwise(1.0)
            return s + weight * F.pow(F.sin(top * i / steps), F.col("n") - 3)

        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), add) * top

    share = area(F.acos(F.least(F.lit(1.0), F.abs("r")))) / area(F.lit(math.pi / 2))
    return fits.withColumn("p_value", F.when((F.col("n") >= 3) & ~F.isnan("r"), share))


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares slope, intercept and r per key."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
        F.regr_count(y, x).alias("n"),
    )


# --- corpus statistics ---------------------------------------------------------------
def corpus_statistics(df: DataFrame, columns: Sequence[str] = ("func", "role", "type", "hop_depth", "constant")) -> DataFrame:
    """(field, value, n, percent): counts of each field's values, null as 'unknown', one pass."""
    have = [c for c in columns if c in df.columns]
    cells = F.array(
        *[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in have]
    )
    counts = df.select(F.inline(cells)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("field", "value", "n", (F.col("n") * 100.0 / total).alias("percent"))


def text_composition(df: DataFrame) -> DataFrame:
    """(hop_depth, function, n) detected from the text: first chain token, else named-token rules."""
    df = df.select("text", F.lower("text").alias("low"), F.regexp_extract("text", r"<[B-L]\d+>", 0).alias("chain"))
    has = lambda s: F.contains(F.col("text"), F.lit(s))
    wrap, chain = F.contains(F.col("low"), F.lit("wrapper")), F.col("chain")
    func = (
        F.when(chain != "", chain)
        .when(has("<GN>") & ~wrap, "<GN>")
        .when(has("<JN>") & ~wrap, "<JN>")
        .when(wrap | (has("<FN>") & has("GN")), "<FN>")
        .when(has("<IN>") & has("JN"), "<IN>")
        .otherwise("unknown")
    )
    # Counting by function first leaves a handful of rows to look depths up for.
    counts = df.select(func.alias("function")).groupBy("function").agg(F.count(F.lit(1)).alias("n"))
    depth = F.coalesce(tk.hop_depth(F.col("function")).cast("string"), F.lit("unknown"))
    return counts.select(depth.alias("hop_depth"), "function", "n")


def length_percentiles(df: DataFrame, text: str = "text") -> DataFrame:
    """Term-count percentiles at position round((n-1)q), with min and max."""
    rows = df.select(F.size(tx.terms(F.col(text))).alias("length"))
    return exact_quantiles(rows, [], "length", [0.0, 0.5, 0.9, 0.95, 1.0], rule="rounded")


# --- mergeable sketches ----------------------------------------------------------------
def value_sketches(values: DataFrame, keys: Sequence[str], value: str = "value", k: int = 200) -> DataFrame:
    """(keys, sketch): one KLL sketch for each key, combined before the shuffle.

    ``k`` sets the size, and with it the rank error: about 1.65 % at 200, whatever the number
    of values.  Keep sketches by run and merge them later; nulls are left out.
    """
    return values.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of several runs or partitions as one for each of ``keys``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(keys, n, fraction, value): quantiles of each sketch; fractions 0 and 1 are the exact ends."""
    cells = [F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("value")) for f in fractions]
    return sketches.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), F.inline(F.array(*cells)))


# --- factor statistics ---------------------------------------------------------------
def factor_stats(values: DataFrame, keys: Sequence[str] = ("module",)) -> DataFrame:
    """n, mean, sample std, min, max and percentiles at int(p*n), per module."""
    q = exact_quantiles(values, keys, "value", list(FACTOR_PERCENTILES.values()), rule="truncated")
    wide = q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("fraction") == p, F.col("value"))).alias(n) for n, p in FACTOR_PERCENTILES.items()]
    )
    base = values.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return base.join(wide, list(keys)).withColumn("heuristic_damping_equiv", F.col("mean") * HEURISTIC_DAMPING)


def damping_diagnostics(values: DataFrame, keys: Sequence[str] = ("module",), damping: float | None = None) -> DataFrame:
    """Effective condition number and share of values below the damping (heuristic when None)."""
    base = values.groupBy(*keys).agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    damp = F.lit(damping) if damping is not None else F.col("m") * HEURISTIC_DAMPING
    ends = base.select(*keys, damp.alias("damping"), "lo", "hi")
    cond = (F.col("hi") + F.col("damping")) / F.greatest(F.col("lo") + F.col("damping"), F.lit(1e-30))
    below = values.join(ship_if_small(ends, 64), list(keys)).groupBy(*keys).agg(
        F.avg((F.col("value") < F.col("damping")).cast("double")).alias("frac_below_damping")
    )
    return ends.select(*keys, "damping", cond.alias("condition_number")).join(below, list(keys))


def approximate_cdf(stats: DataFrame, keys: Sequence[str] = ("module",)) -> DataFrame:
    """(keys, value, prob) from stored percentiles: positive points only, at least two per key."""
    points = {"min": 0.0, **FACTOR_PERCENTILES, "max": 1.0}
    cells = F.array(*[F.struct(F.col(c).cast("double").alias("value"), F.lit(p).alias("prob")) for c, p in points.items()])
    kept = F.filter(cells, lambda s: s["value"].isNotNull() & (s["value"] > 0))
    return stats.select(*keys, kept.alias("p")).filter(F.size("p") >= 2).select(*keys, F.inline("p"))


def frobenius_change(cells: DataFrame) -> DataFrame:
    """(n, prev_n, relative_change): size-weighted change between successive estimates.

    ``cells`` is long (n, module, i, j, v), one matrix per module and sample size.
    Per module the norm of the difference and of the current matrix; then sums.
    Modules missing from the previous estimate are skipped.
    """
    sizes = cells.select("n").distinct()
    prev = sizes.select("n", F.lag("n").over(W.orderBy("n")).alias("prev_n")).filter("prev_n IS NOT NULL")
    old_modules = cells.select(F.col("n").alias("prev_n"), "module").distinct()
    cur = cells.join(prev, "n").join(old_modules, ["prev_n", "module"], "left_semi")
    old = cells.select(F.col("n").alias("prev_n"), "module", "i", "j", F.col("v").alias("pv"))
    both = cur.join(old, ["prev_n", "module", "i", "j"], "left")
    d = F.col("v") - F.coalesce("pv", F.lit(0.0))
    norms = both.groupBy("n", "prev_n", "module").agg(
        F.sqrt(F.sum(d * d)).alias("diff"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size")
    )
    return norms.groupBy("n", "prev_n").agg(
        F.when(F.sum("size") == 0, F.lit(float("nan"))).otherwise(F.sum("diff") / F.sum("size")).alias("relative_change")
    )


def frobenius_total(cells: DataFrame, per_sample: bool = False) -> DataFrame:
    """(n, magnitude): sum of the modules' Frobenius norms, divided by n on request."""
    v = F.col("v") / F.col("n") if per_sample else F.col("v")
    norms = cells.groupBy("n", "module").agg(F.sqrt(F.sum(v * v)).alias("size"))
    return norms.groupBy("n").agg(F.sum("size").alias("magnitude"))


# --- sweeps ------------------------------------------------------------------------------
def best_checkpoint(points: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Best accuracy per run, the earliest checkpoint on ties."""
    rows = points.filter("accuracy IS NOT NULL")
    pick = F.max_by(F.struct("step", "accuracy"), F.struct(F.col("accuracy"), -F.col("step")))
    return rows.groupBy(*keys).agg(pick.alias("b")).select(*keys, "b.step", "b.accuracy")


def last_checkpoints(points: DataFrame, k: int = 3, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Mean accuracy over the last k checkpoints by number, then those with a result."""
    w = W.partitionBy(*keys).orderBy(F.col("step").desc())
    tail = points.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).filter("accuracy IS NOT NULL")
    return tail.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("used"))


def selection_curves(results: DataFrame) -> DataFrame:
    """(mode, token, percent, function, accuracy) from run directory names; function null = overall."""
    run = F.col("run")
    pct = F.coalesce(
        F.nullif(F.regexp_extract(run, RANDOM_RUN, 1), F.lit("")),
        F.nullif(F.regexp_extract(run, INFLUENCE_RUN, 2), F.lit("")),
    )
    rows = results.select(
        F.when(run.startswith("models_random_"), "random").otherwise("influence").alias("mode"),
        F.nullif(F.regexp_extract(run, INFLUENCE_RUN, 1), F.lit("")).alias("token"),
        pct.cast("int").alias("percent"),
        "function",
        F.col("is_correct").cast("double").alias("ok"),
    ).filter("percent IS NOT NULL")
    keys = ["mode", "token", "percent"]
    cols = [F.col(k) for k in keys]
    return rows.groupingSets([cols, [*cols, F.col("function")]], *keys, "function").agg(
        F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def grid(rows: DataFrame, x: str, y: str, metric: str, facet: str | None = None) -> DataFrame:
    """Dense grid of a metric over two hyper-parameters; missing cells NaN, null axis values last.

    The axes are the distinct hyper-parameter values, unfolded from arrays; later
    rows of the same cell are resolved by the larger metric.
    """
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    dims = [x, y] + ([facet] if facet else [])
    cells = rows.groupBy(*[label(d).alias(d) for d in dims]).agg(F.max(metric).alias(metric))
    axis = lambda d: rows.agg(F.collect_set(label(d)).alias("v")).scalar()
    full = rows.agg(F.count(F.lit(1)).alias("__n"))
    for d in dims:
        full = full.withColumn(d, F.explode(axis(d)))
    out = full.drop("__n").join(cells, dims, "left")
    order = [F.col(d).alias(d) for d in dims]
    return out.select(
        *order,
        F.coalesce(metric, F.lit(float("nan"))).alias(metric),
        *[(F.col(d) == "null").alias(f"{d}_is_null") for d in dims],
    )


def resolve_metric(name: str) -> str:
    """Column behind a metric name: ``<word>@<k>`` for any k, where the word may be shortened
    as long as one metric begins with it; ``time`` is the elapsed seconds."""
    word, at, k = name.lower().partition("@")
    if at and k.isdigit():
        full = [m for m in METRICS_AT_K if m.startswith(word)] if word else []
        return f"{full[0]}_at_{int(k)}" if len(full) == 1 else name.lower()
    return "elapsed_seconds" if word in ("time", "elapsed") else word


def leaderboard(rows: DataFrame, metric: str, top: int | None = None, name: str = "run") -> DataFrame:
    """Rows by metric, best first (ascending only for elapsed time), nulls last and unranked."""
    col = F.col(resolve_metric(metric))
    ascending = resolve_metric(metric) == "elapsed_seconds"
    order = col.asc_nulls_last() if ascending else col.desc_nulls_last()
    if top is not None:
        rows = rows.orderBy(order, name).limit(top)
    placed = sorted_positions(rows, [], [order, F.col(name)], out="place")
    return placed.withColumn("place", F.when(col.isNotNull(), F.col("place")))


def enrich(sweep: DataFrame, extra: DataFrame, key: str = "run") -> DataFrame:
    """Sweep rows with metrics of their run added where the sweep has none."""
    shared = [c for c in extra.columns if c != key and c in sweep.columns]
    new = [c for c in extra.columns if c != key and c not in sweep.columns]
    side = extra.select(key, *[F.col(c).alias(f"__x_{c}") for c in shared], *new)
    joined = sweep.join(side, key, "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"__x_{c}")).alias(c) if c in shared else F.col(c) for c in sweep.columns], *new
    )


def damping_rows(rows: DataFrame) -> DataFrame:
    """Damping sweep from directory names: numeric rows ordered, the heuristic run apart.

    Names are damping_<number> or damping_none; ``series`` says which.
    """
    raw = F.regexp_extract("run", r"^damping_(.+)$", 1)
    num = F.expr("try_cast(regexp_extract(run, '^damping_(.+)$', 1) AS DOUBLE)")
    kept = rows.withColumn("damping", num).withColumn(
        "series", F.when(raw == "none", "heuristic").when(num.isNotNull(), "sweep")
    )
    return kept.filter("series IS NOT NULL")
