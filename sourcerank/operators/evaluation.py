"""Evaluation logs: probabilities, losses, summaries, confusion, similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..session import ship_if_small
from . import vectors as vo
from .positions import exact_quantiles

PERCENTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


# --- candidate probabilities ---------------------------------------------------
def sequence_logprobs(token_scores: DataFrame) -> DataFrame:
    """(prompt_uid, candidate, logprob): token log-probs summed per candidate."""
    return token_scores.groupBy("prompt_uid", "candidate").agg(F.sum("logprob").alias("logprob"))


def normalized(cands: DataFrame) -> DataFrame:
    """Add ``log_norm`` and ``prob`` over a prompt's candidates, stably.

    Candidates of a prompt are a bounded answer set, so one window per prompt is
    one small group; max and sum share its sort.
    """
    w = W.partitionBy("prompt_uid")
    return (
        cands.withColumn("__top", F.max("logprob").over(w))
        .withColumn("__lse", F.col("__top") + F.log(F.sum(F.exp(F.col("logprob") - F.col("__top"))).over(w)))
        .withColumn("log_norm", F.col("logprob") - F.col("__lse"))
        .withColumn("prob", F.exp("log_norm"))
        .drop("__top", "__lse")
    )


def evaluate_candidates(cands: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per prompt: best prediction, correctness, confidence in the expected
    candidate, entropy, expected and best log-prob.

    Ties for best go to the smaller candidate.
    """
    probs = normalized(cands).join(expected.select("prompt_uid", "expected"), "prompt_uid")
    own = F.col("candidate") == F.col("expected")
    order = F.struct(F.col("logprob"), -F.col("candidate"))
    out = probs.groupBy("prompt_uid", "expected").agg(
        F.max_by("candidate", order).alias("best_prediction"),
        F.max("logprob").alias("best_logprob"),
        F.max(F.when(own, F.col("logprob"))).alias("expected_logprob"),
        F.coalesce(F.max(F.when(own, F.col("prob"))), F.lit(0.0)).alias("confidence"),
        (-F.sum(F.when(F.col("prob") > 0, F.col("prob") * F.col("log_norm")).otherwise(0.0))).alias("entropy"),
    )
    return out.withColumn("best_prob", F.exp("best_logprob")).withColumn(
        "is_correct", F.col("best_prediction") == F.col("expected")
    )


def top_candidates(cands: DataFrame, k: int) -> DataFrame:
    """k most probable candidates per prompt."""
    w = W.partitionBy("prompt_uid").orderBy(F.col("prob").desc(), "candidate")
    return normalized(cands).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def margin(cands: DataFrame, expected: DataFrame) -> DataFrame:
    """(prompt_uid, margin): log-sum-exp over the candidates minus the target's value."""
    rows = normalized(cands).join(expected, "prompt_uid").filter(F.col("candidate") == F.col("expected"))
    return rows.select("prompt_uid", (-F.col("log_norm")).alias("margin"))


def binary_comparison(df: DataFrame) -> DataFrame:
    """Expected against incorrect answer: confidence, entropy, strictly-greater correctness."""
    e, i = F.col("expected_logprob"), F.col("incorrect_logprob")
    top = F.greatest(e, i)
    lse = top + F.log(F.exp(e - top) + F.exp(i - top))
    p = F.exp(e - lse)
    q = 1.0 - p
    ent = -(p * F.log(p + 1e-12) + q * F.log(q + 1e-12))
    return df.select("*", p.alias("confidence"), ent.alias("entropy"), (e > i).alias("is_correct"))


# --- losses ------------------------------------------------------------------------
def leave_one_out(losses: DataFrame, base: DataFrame) -> DataFrame:
    """(query_uid, uid, score): loss without the document minus the base loss.

    Documents with no run stay absent and read as 0.
    """
    side = ship_if_small(base.select("query_uid", F.col("loss").alias("base")), 64)
    return losses.join(side, "query_uid").select(
        "query_uid", F.col("run_uid").alias("uid"), (F.col("loss") - F.col("base")).alias("score")
    )


def loss_by_depth(df: DataFrame) -> DataFrame:
    """Mean loss per step and hop depth; unknown depths are skipped."""
    return df.filter(F.col("hop_depth") >= 0).groupBy("step", "hop_depth").agg(F.avg("loss").alias("loss"))


# --- summaries -----------------------------------------------------------------------
def evaluation_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, confidences, entropy and expected log-prob; absent means are 0."""
    ok = F.coalesce("is_correct", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(ok.cast("bigint")).alias("correct"),
        F.avg(ok.cast("double")).alias("accuracy"),
        zero(F.avg("confidence")).alias("mean_confidence"),
        zero(F.avg(F.when(ok, F.col("confidence")))).alias("correct_mean_confidence"),
        zero(F.avg(F.when(~ok, F.col("confidence")))).alias("incorrect_mean_confidence"),
        zero(F.avg("entropy")).alias("mean_entropy"),
        zero(F.avg("expected_logprob")).alias("mean_expected_logprob"),
    )


def confidence_percentiles(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confidence at sorted position int(p * n)."""
    return exact_quantiles(results, keys, "confidence", PERCENTILES, rule="truncated")


def prediction_distribution(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*keys, "best_prediction").agg(F.count(F.lit(1)).alias("n"))


def by_input(results: DataFrame) -> DataFrame:
    """Accuracy, mean confidence and number of distinct predictions per input."""
    return results.groupBy("input").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("is_correct").cast("bigint")).alias("correct"),
        F.avg(F.col("is_correct").cast("double")).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_distinct("best_prediction").alias("n_predictions"),
    )


def function_summary(results: DataFrame, lookup: DataFrame, letter: str = "C") -> DataFrame:
    """Per function: accuracy, modal prediction and what it is confused with.

    Equal modal counts go to the smaller prediction.  ``lookup`` is
    assemble.constant_lookup.  Everything starts from counts per (function,
    prediction), so a function's prompts never meet in one task.
    """
    ok = F.col("is_correct")
    base = results.groupBy("function").agg(
        F.min("expected_constant").alias("expected_constant"),
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("best_prediction") == F.col("expected_constant")).cast("double")).alias("accuracy"),
        F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence_when_correct"),
        F.avg(F.when(~ok, F.col("confidence"))).alias("mean_confidence_when_incorrect"),
    )
    counts = results.groupBy("function", "best_prediction").agg(
        F.count(F.lit(1)).alias("c"), F.avg(F.coalesce("best_prob", F.lit(0.0))).alias("p")
    )
    modal = counts.groupBy("function").agg(
        F.max_by(
            F.struct(F.col("best_prediction").alias("v"), "c", "p"), F.struct(F.col("c"), -F.col("best_prediction"))
        ).alias("m")
    )
    joined = base.join(modal, "function").join(
        lookup.select(F.col("constant").alias("__k"), "funcs"), F.col("m.v") == F.col("__k"), "left"
    )
    same = F.filter("funcs", lambda f: F.coalesce(tk.chain_letter(f) == letter, F.lit(False)))
    cands = F.when(F.size(same) > 0, same).otherwise(F.col("funcs"))
    kind = (
        F.when(F.col("m.v") == F.col("expected_constant"), "correct")
        .when(F.col("funcs").isNotNull(), "confused_with_other_func")
        .when(F.col("m.v").isNotNull(), "confused_other")
        .otherwise("off_candidate")
    )
    own = tk.chain_index(F.col("function"))
    gaps = F.transform("confused_with", lambda f: F.abs(own - tk.chain_index(f)))
    return (
        joined.withColumn("classification", kind)
        .withColumn("confused_with", F.when(F.col("classification") == "confused_with_other_func", cands))
        .select(
            "function",
            "expected_constant",
            "accuracy",
            "n",
            F.col("m.v").alias("modal_prediction"),
            (F.col("m.c") / F.col("n")).alias("modal_share"),
            F.col("m.p").alias("modal_mean_confidence"),
            "classification",
            "confused_with",
            F.when(F.col("classification") == "correct", 0)
            .otherwise(F.array_min(F.filter(gaps, lambda g: g.isNotNull())))
            .alias("index_distance"),
            "mean_confidence_when_correct",
            "mean_confidence_when_incorrect",
        )
    )


def confidence_strata(results: DataFrame, bins: int = 4) -> DataFrame:
    """Accuracy per confidence quantile bin; the last bin is closed at 1, empty bins vanish.

    Edges sit at sorted position int(i * n / bins); each row finds its bins among
    the few edges held in one array.
    """
    q = exact_quantiles(results, [], "confidence", [i / bins for i in range(bins)], rule="truncated")
    edges = q.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fraction", "value"))), lambda s: s["value"]).alias("e")
    )
    rows = results.withColumn("__e", F.concat(edges.scalar(), F.array(F.lit(1.0))))
    inside = lambda i: (F.col("confidence") >= F.get("__e", i)) & F.when(
        i == bins - 1, F.col("confidence") <= F.get("__e", i + 1)
    ).otherwise(F.col("confidence") < F.get("__e", i + 1))
    hit = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), inside)
    return (
        rows.withColumn("bin", F.explode(hit))
        .groupBy("bin")
        .agg(
            F.min(F.get("__e", F.col("bin"))).alias("low"),
            F.min(F.get("__e", F.col("bin") + 1)).alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("is_correct").cast("double")).alias("accuracy"),
            F.avg("confidence").alias("mean_confidence"),
        )
    )


def attractors(summary: DataFrame, least: int = 2) -> DataFrame:
    """Functions that at least ``least`` wrong functions are confused with."""
    return (
        summary.filter("classification <> 'correct'")
        .select(F.explode("confused_with").alias("target"))
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
    )


def distance_profile(summary: DataFrame) -> DataFrame:
    """One row: confused functions, near (<= 5), far (> 10), and locked-in (share >= 0.9)."""
    confused = F.col("classification") == "confused_with_other_func"
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return summary.agg(
        n(confused & F.col("index_distance").isNotNull()).alias("confused"),
        n(confused & (F.col("index_distance") <= 5)).alias("near"),
        n(confused & (F.col("index_distance") > 10)).alias("far"),
        n(confused & (F.col("modal_share") >= 0.9)).alias("locked_in"),
    )


def distance_histogram(summary: DataFrame) -> DataFrame:
    rows = summary.filter("classification = 'confused_with_other_func' AND index_distance IS NOT NULL")
    return rows.groupBy("index_distance").agg(F.count(F.lit(1)).alias("n"))


def confusion(results: DataFrame) -> DataFrame:
    """Counts per (function, expected, predicted)."""
    return results.groupBy("function", "expected_constant", "best_prediction").agg(F.count(F.lit(1)).alias("n"))


def top_wrong(results: DataFrame, k: int = 3) -> DataFrame:
    """k most frequent wrong predictions per function, ties to the smaller one."""
    counts = results.filter(~F.col("is_correct")).groupBy("function", "best_prediction").agg(
        F.count(F.lit(1)).alias("n")
    )
    w = W.partitionBy("function").orderBy(F.col("n").desc(), "best_prediction")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def probability_heatmap(probs: DataFrame) -> DataFrame:
    """Mean probability per (function, prediction); predictions a function never saw are 0.

    ``probs`` is long (function, prediction, prob).  The grid is built from the two
    sets of names as one array, not from a join of rows.
    """
    means = probs.groupBy("function", "prediction").agg(F.avg("prob").alias("p"))
    everything = means.agg(F.collect_set("prediction").alias("all"))
    per = means.groupBy("function").agg(F.map_from_entries(F.collect_list(F.struct("prediction", "p"))).alias("m"))
    return per.select("function", "m", F.explode(everything.scalar()).alias("prediction")).select(
        "function", "prediction", F.coalesce(F.try_element_at(F.col("m"), F.col("prediction")), F.lit(0.0)).alias("prob")
    )


def binned(results: DataFrame, value: str, bins: int, keys: Sequence[str] = ("function",)) -> DataFrame:
    """Histogram with density per key on the key's observed range."""
    ends = results.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    # One key may own a third of the rows: ship the ends when proven small.
    rows = results.filter(F.col(value).isNotNull()).join(ship_if_small(ends, 64), list(keys))
    flat = F.col("hi") == F.col("lo")
    width = F.when(flat, 1.0).otherwise(F.col("hi") - F.col("lo")) / bins
    start = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    slot = F.least(F.floor((F.col(value) - start) / width), F.lit(bins - 1)).cast("int")
    return (
        rows.select(*keys, slot.alias("bin"), start.alias("start"), width.alias("width"), "total")
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.col("start") + F.col("bin") * F.col("width")).alias("left_edge"),
            (F.count(F.lit(1)) / F.min(F.col("total") * F.col("width"))).alias("density"),
        )
    )


# --- token similarity -----------------------------------------------------------------
def token_pairs(emb: DataFrame) -> DataFrame:
    """Cosine of every pair of tokens from (token, ord, kind, mate, vec), each pair once.

    Tokens are the function vocabulary, a bounded dimension; the products run as
    one block.
    """
    cos = vo.similarity_scores(
        emb.select(F.col("token").alias("uid"), "vec"), emb.select(F.col("token").alias("query_uid"), "vec"), "cosine"
    )
    side = lambda p, name: emb.select(
        F.col("token").alias(name), *[F.col(c).alias(f"{c}_{p}") for c in ("ord", "kind", "mate")]
    )
    pairs = cos.join(side("a", "query_uid"), "query_uid").join(side("b", "uid"), "uid").filter("ord_a < ord_b")
    return pairs.select(
        F.col("query_uid").alias("token_a"),
        F.col("uid").alias("token_b"),
        "kind_a",
        "kind_b",
        (F.col("mate_a") == F.col("uid")).alias("paired"),
        F.col("score").alias("similarity"),
    )


def similarity_groups(pairs: DataFrame) -> DataFrame:
    """Mean, std, min, max of base-base, wrapper-wrapper, cross and paired similarities."""
    same = F.when(F.col("kind_a") == F.col("kind_b"), F.concat_ws("-", "kind_a", "kind_b")).otherwise("cross")
    labels = F.filter(F.array(same, F.when(F.col("paired"), "paired")), lambda x: x.isNotNull())
    return (
        pairs.select(F.explode(labels).alias("grp"), "similarity")
        .groupBy("grp")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("similarity").alias("mean"),
            F.stddev_pop("similarity").alias("std"),
            F.min("similarity").alias("min"),
            F.max("similarity").alias("max"),
        )
    )


def extreme_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k most and the k least similar pairs."""
    cols = ["token_a", "token_b", "similarity"]
    top = pairs.select(*cols).orderBy(F.col("similarity").desc(), "token_a", "token_b").limit(k)
    low = pairs.select(*cols).orderBy("similarity", "token_a", "token_b").limit(k)
    return top.withColumn("side", F.lit("top")).unionByName(low.withColumn("side", F.lit("bottom")))


# --- trajectories ------------------------------------------------------------------------
def depth_trajectory(results: DataFrame, keys: Sequence[str] = ("hop_depth",)) -> DataFrame:
    """Evaluation summary per key and step, with a zero baseline at step 0.

    The baseline exists for every key that has at least one real point, unless
    the data already has a step 0.
    """
    points = evaluation_summary(results, [*keys, "step"])
    real = points.select(*keys).distinct()
    have0 = points.filter("step = 0").select(*keys).distinct()
    zero = real.join(have0, list(keys), "left_anti")
    values = [c for c in points.columns if c not in (*keys, "step")]
    types = dict(points.dtypes)
    base = zero.select(*keys, F.lit(0).alias("step"), *[F.lit(0).cast(types[c]).alias(c) for c in values])
    return points.unionByName(base)


def step_matrix(results: DataFrame) -> DataFrame:
    """Accuracy per function and step on the full grid; holes are NaN."""
    acc = results.groupBy("function", "step").agg(F.avg(F.col("is_correct").cast("double")).alias("a"))
    steps = acc.agg(F.collect_set("step").alias("s"))
    per = acc.groupBy("function").agg(F.map_from_entries(F.collect_list(F.struct("step", "a"))).alias("m"))
    return per.select("function", "m", F.explode(steps.scalar()).alias("step")).select(
        "function", "step", F.coalesce(F.try_element_at(F.col("m"), F.col("step")), F.lit(float("nan"))).alias("accuracy")
    )


def accuracy_vs_metric(results: DataFrame, metric: DataFrame) -> DataFrame:
    """Per function: mean confidence and accuracy beside a retrieval metric (func, value)."""
    own = results.groupBy("function").agg(
        F.avg("confidence").alias("avg_confidence"),
        F.avg(F.col("is_correct").cast("double")).alias("avg_accuracy"),
        F.count(F.lit(1)).alias("n"),
    )
    return own.join(metric.withColumnRenamed("func", "function"), "function")

