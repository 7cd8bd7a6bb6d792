"""Queries: evaluation logs, losses, confusion, trajectories, token similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble
from ..operators import evaluation as ev
from ..operators import vectors as vo
from . import frames as fr
from .catalog import query
from .retrieval import METRICS, KS, judged_by_function, rounded
from ..operators import metrics

E = f"WITH e AS ({fr.EVAL_SQL})"

# Candidate log-probs: line items of an order are token scores of candidates 1..7.
CAND_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS prompt_uid, CAST(l_linenumber AS INTEGER) AS candidate, sum(-l_quantity / 20 - l_discount) AS logprob
FROM lineitem GROUP BY ALL"""
EXPECT_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS prompt_uid, CAST(o_custkey % 7 + 1 AS INTEGER) AS expected FROM orders"
PROB_CTES = f"""c AS (SELECT prompt_uid, candidate, round(logprob, 9) AS logprob FROM ({CAND_SQL})), x AS ({EXPECT_SQL}),
m AS (SELECT *, max(logprob) OVER (PARTITION BY prompt_uid) AS top FROM c),
n AS (SELECT prompt_uid, candidate, logprob, logprob - (top + ln(sum(exp(logprob - top)) OVER (PARTITION BY prompt_uid))) AS ln_p FROM m)"""


def candidates(t):
    token = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("prompt_uid"),
        F.col("l_linenumber").cast("int").alias("candidate"),
        (-F.col("l_quantity") / 20 - F.col("l_discount")).alias("logprob"),
    )
    return ev.sequence_logprobs(token).withColumn("logprob", F.round("logprob", 9))


def expected(t):
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("prompt_uid"), (F.col("o_custkey") % 7 + 1).cast("int").alias("expected")
    )


@query("sequence_logprobs", f"SELECT prompt_uid, candidate, round(logprob, 6) AS logprob FROM ({CAND_SQL})")
def sequence_logprobs(t):
    return rounded(candidates(t), ["prompt_uid", "candidate"])


@query("normalized_probabilities", f"WITH {PROB_CTES} SELECT prompt_uid, candidate, round(exp(ln_p), 6) AS prob FROM n")
def normalized_probabilities(t):
    return rounded(ev.normalized(candidates(t)).select("prompt_uid", "candidate", "prob"), ["prompt_uid", "candidate"])


@query(
    "candidate_evaluation",
    f"""WITH {PROB_CTES}, b AS (SELECT prompt_uid, candidate AS best FROM (SELECT prompt_uid, candidate, row_number() OVER (PARTITION BY prompt_uid ORDER BY logprob DESC, candidate) AS r FROM n) WHERE r = 1)
SELECT n.prompt_uid, x.expected, any_value(b.best) AS best_prediction, any_value(b.best) = x.expected AS is_correct, round(coalesce(max(CASE WHEN candidate = expected THEN exp(ln_p) END), 0), 6) AS confidence,
 round(-sum(exp(ln_p) * ln_p), 6) AS entropy, round(exp(max(logprob)), 6) AS best_prob
FROM n JOIN x ON x.prompt_uid = n.prompt_uid JOIN b ON b.prompt_uid = n.prompt_uid GROUP BY n.prompt_uid, x.expected""",
)
def candidate_evaluation(t):
    out = ev.evaluate_candidates(candidates(t), expected(t))
    keys = ["prompt_uid", "expected", "best_prediction", "is_correct"]
    return rounded(out.select(*keys, "confidence", "entropy", "best_prob"), keys)


@query(
    "top_candidates",
    f"WITH {PROB_CTES} SELECT * FROM (SELECT prompt_uid, candidate, round(exp(ln_p), 6) AS prob, row_number() OVER (PARTITION BY prompt_uid ORDER BY exp(ln_p) DESC, candidate) AS rank FROM n) WHERE rank <= 2",
)
def top_candidates(t):
    out = ev.top_candidates(candidates(t), 2)
    return out.select("prompt_uid", "candidate", F.round("prob", 6).alias("prob"), F.col("rank").cast("bigint").alias("rank"))


@query("answer_margins", f"WITH {PROB_CTES} SELECT n.prompt_uid, round(-ln_p, 6) AS margin FROM n JOIN x ON x.prompt_uid = n.prompt_uid AND x.expected = n.candidate")
def answer_margins(t):
    return rounded(ev.margin(candidates(t), expected(t)), ["prompt_uid"])


@query(
    "binary_comparison",
    """WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS uid, -o_totalprice / 100000 AS e, -o_custkey / 500.0 AS i FROM orders),
p AS (SELECT *, exp(e - (greatest(e,i) + ln(exp(e - greatest(e,i)) + exp(i - greatest(e,i))))) AS p FROM b)
SELECT uid, round(p, 6) AS confidence, round(-(p * ln(p + 1e-12) + (1 - p) * ln(1 - p + 1e-12)), 6) AS entropy, e > i AS is_correct FROM p""",
)
def binary_comparison(t):
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("uid"),
        (-F.col("o_totalprice") / 100000).alias("expected_logprob"),
        (-F.col("o_custkey") / 500.0).alias("incorrect_logprob"),
    )
    return rounded(ev.binary_comparison(rows).select("uid", "is_correct", "confidence", "entropy"), ["uid", "is_correct"])


# Loss tables: a run per supplier, a query per part.
LOSS_SQL = "SELECT CAST(l_suppkey AS VARCHAR) AS run_uid, CAST(l_partkey AS VARCHAR) AS query_uid, avg(l_extendedprice) AS loss FROM lineitem GROUP BY ALL"


@query(
    "leave_one_out_scores",
    f"SELECT l.query_uid, l.run_uid AS uid, round(l.loss - p_retailprice, 4) AS score FROM ({LOSS_SQL}) l JOIN part ON CAST(p_partkey AS VARCHAR) = l.query_uid",
)
def leave_one_out_scores(t):
    losses = t.lineitem.groupBy(
        F.col("l_suppkey").cast("string").alias("run_uid"), F.col("l_partkey").cast("string").alias("query_uid")
    ).agg(F.avg("l_extendedprice").alias("loss"))
    base = t.part.select(F.col("p_partkey").cast("string").alias("query_uid"), F.col("p_retailprice").alias("loss"))
    return rounded(ev.leave_one_out(losses, base), ["query_uid", "uid"], 4)


@query(
    "loss_by_hop_depth",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS step, CAST(l_linenumber - 2 AS INTEGER) AS hop_depth, round(avg(l_tax), 6) AS loss FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL",
)
def loss_by_hop_depth(t):
    rows = t.lineitem.select(F.year("l_shipdate").alias("step"), (F.col("l_linenumber") - 2).cast("int").alias("hop_depth"), F.col("l_tax").alias("loss"))
    return rounded(ev.loss_by_depth(rows), ["step", "hop_depth"])


SUMMARY = """count(*) AS total, count(*) FILTER (is_correct) AS correct, round(avg(CAST(is_correct AS INT)), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence,
 round(coalesce(avg(confidence) FILTER (is_correct), 0), 6) AS correct_mean_confidence, round(coalesce(avg(confidence) FILTER (NOT is_correct), 0), 6) AS incorrect_mean_confidence,
 round(avg(entropy), 6) AS mean_entropy, round(coalesce(avg(expected_logprob), 0), 6) AS mean_expected_logprob"""


@query("evaluation_summary", f"{E} SELECT {SUMMARY} FROM e")
def evaluation_summary(t):
    return rounded(ev.evaluation_summary(fr.evals(t)), ["total", "correct"])


@query("evaluation_summary_by_function", f"{E} SELECT function, {SUMMARY} FROM e GROUP BY function")
def evaluation_summary_by_function(t):
    return rounded(ev.evaluation_summary(fr.evals(t), ["function"]), ["function", "total", "correct"])


@query(
    "confidence_percentiles",
    f"""{E}, r AS (SELECT function, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY function ORDER BY confidence) AS rn, count(*) OVER (PARTITION BY function) AS n FROM e)
SELECT function, p AS fraction, confidence AS value FROM r, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS p) WHERE rn = CAST(floor(p * n + 1e-9) AS BIGINT) + 1""",
)
def confidence_percentiles(t):
    rows = fr.evals(t).withColumn("confidence", F.round("confidence", 6))
    return rounded(ev.confidence_percentiles(rows, ["function"]), ["function", "fraction"])


@query("prediction_distribution", f"{E} SELECT best_prediction, count(*) AS n FROM e GROUP BY best_prediction")
def prediction_distribution(t):
    return ev.prediction_distribution(fr.evals(t))


@query(
    "accuracy_by_input",
    f"{E} SELECT input, count(*) AS total, count(*) FILTER (is_correct) AS correct, round(avg(CAST(is_correct AS INT)),6) AS accuracy, round(avg(confidence),6) AS mean_confidence, count(DISTINCT best_prediction) AS n_predictions FROM e GROUP BY input",
)
def accuracy_by_input(t):
    return rounded(ev.by_input(fr.evals(t)), ["input", "total", "correct", "n_predictions"])


# Modal predictions: even functions answer something else most of the time.
SKEWED_SQL = f"""SELECT * REPLACE (CAST(CASE WHEN expected_constant % 2 = 0 AND input > 2 THEN (expected_constant * 3) % 27 + 1 ELSE best_prediction END AS INTEGER) AS best_prediction,
 (CASE WHEN expected_constant % 2 = 0 AND input > 2 THEN (expected_constant * 3) % 27 + 1 ELSE best_prediction END) = expected_constant AS is_correct) FROM ({fr.EVAL_SQL})"""
FSUM_CTES = f"""e AS ({SKEWED_SQL}), b AS (SELECT function, min(expected_constant) AS k, count(*) AS n, avg(CAST(best_prediction = expected_constant AS INT)) AS accuracy,
  avg(confidence) FILTER (is_correct) AS cc, avg(confidence) FILTER (NOT is_correct) AS ci FROM e GROUP BY function),
pc AS (SELECT function, best_prediction AS v, count(*) AS c, avg(best_prob) AS p FROM e GROUP BY ALL),
md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY function ORDER BY c DESC, v) AS r FROM pc) WHERE r = 1),
lk AS (SELECT DISTINCT function AS f, expected_constant AS kk FROM e),
fs AS (SELECT b.function, b.k AS expected_constant, b.accuracy, b.n, md.v AS modal_prediction, md.c / b.n AS modal_share, md.p AS modal_mean_confidence,
  CASE WHEN md.v = b.k THEN 'correct' WHEN lk.f IS NOT NULL THEN 'confused_with_other_func' ELSE 'confused_other' END AS classification,
  CASE WHEN md.v <> b.k THEN lk.f END AS confused_with,
  CASE WHEN md.v = b.k THEN 0 WHEN lk.f IS NOT NULL THEN abs(CAST(substr(b.function,3,2) AS INT) - CAST(substr(lk.f,3,2) AS INT)) END AS index_distance, b.cc, b.ci
  FROM b JOIN md ON md.function = b.function LEFT JOIN lk ON lk.kk = md.v)"""


def function_table(t):
    k = F.col("expected_constant")
    wrong = (k * 3) % 27 + 1
    bend = (k % 2 == 0) & (F.col("input") > 2)
    rows = fr.evals(t).withColumn("best_prediction", F.when(bend, wrong).otherwise(F.col("best_prediction")).cast("int"))
    rows = rows.withColumn("is_correct", F.col("best_prediction") == k)
    lookup = assemble.constant_lookup([rows.select(F.col("function").alias("func"), k.alias("constant")).distinct()])
    return ev.function_summary(rows, lookup)


@query(
    "function_error_summary",
    f"""WITH {FSUM_CTES} SELECT function, expected_constant, round(accuracy,6) AS accuracy, n, modal_prediction, round(modal_share,6) AS modal_share, round(modal_mean_confidence,6) AS modal_mean_confidence,
 classification, confused_with, CAST(index_distance AS VARCHAR) AS index_distance, round(cc,6) AS mean_confidence_when_correct, round(ci,6) AS mean_confidence_when_incorrect FROM fs""",
)
def function_error_summary(t):
    out = function_table(t).withColumn("confused_with", F.array_join("confused_with", ",")).withColumn(
        "index_distance", F.col("index_distance").cast("string")
    )
    keys = ["function", "expected_constant", "n", "modal_prediction", "classification", "confused_with", "index_distance"]
    return rounded(out, keys)


@query("attractor_functions", f"WITH {FSUM_CTES} SELECT confused_with AS target, count(*) AS n FROM fs WHERE classification <> 'correct' AND confused_with IS NOT NULL GROUP BY 1 HAVING count(*) >= 1")
def attractor_functions(t):
    return ev.attractors(function_table(t), least=1)


@query("confusion_distances", f"WITH {FSUM_CTES} SELECT index_distance, count(*) AS n FROM fs WHERE classification = 'confused_with_other_func' GROUP BY 1")
def confusion_distances(t):
    return ev.distance_histogram(function_table(t))


@query(
    "confusion_distance_profile",
    f"""WITH {FSUM_CTES}, q AS (SELECT * FROM fs WHERE classification = 'confused_with_other_func') SELECT count(*) AS confused, count(*) FILTER (index_distance <= 5) AS near,
 count(*) FILTER (index_distance > 10) AS far, count(*) FILTER (modal_share >= 0.9) AS locked_in FROM q""",
)
def confusion_distance_profile(t):
    return ev.distance_profile(function_table(t))


@query(
    "confidence_strata",
    f"""{E}, c AS (SELECT round(confidence, 6) AS confidence, is_correct FROM e), r AS (SELECT confidence, row_number() OVER (ORDER BY confidence) AS rn, count(*) OVER () AS n FROM c),
g AS (SELECT b, (SELECT confidence FROM r WHERE rn = CAST(floor(b * n / 4 + 1e-9) AS BIGINT) + 1 LIMIT 1) AS low FROM (SELECT unnest([0,1,2,3]) AS b)),
k AS (SELECT b, low, coalesce(lead(low) OVER (ORDER BY b), 1.0) AS high FROM (SELECT b, (SELECT max(r.confidence) FROM r WHERE r.rn = CAST(floor(b.b * r.n / 4) AS BIGINT) + 1) AS low FROM (SELECT unnest([0,1,2,3]) AS b) b))
SELECT CAST(b AS INTEGER) AS bin, round(low,6) AS low, round(high,6) AS high, count(*) AS n, round(avg(CAST(is_correct AS INT)),6) AS accuracy, round(avg(confidence),6) AS mean_confidence
FROM k JOIN c ON c.confidence >= k.low AND (CASE WHEN b = 3 THEN c.confidence <= high ELSE c.confidence < high END) GROUP BY b, low, high""",
)
def confidence_strata(t):
    rows = fr.evals(t).withColumn("confidence", F.round("confidence", 6))
    return rounded(ev.confidence_strata(rows), ["bin", "n"])


@query("confusion_matrix", f"{E} SELECT function, expected_constant, best_prediction, count(*) AS n FROM e GROUP BY ALL")
def confusion_matrix(t):
    return ev.confusion(fr.evals(t))


@query(
    "top_wrong_predictions",
    f"{E} SELECT function, best_prediction, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY function ORDER BY n DESC, best_prediction) AS rank FROM (SELECT function, best_prediction, count(*) AS n FROM e WHERE NOT is_correct GROUP BY ALL)) WHERE rank <= 3",
)
def top_wrong_predictions(t):
    return ev.top_wrong(fr.evals(t)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "probability_heatmap",
    f"""{E}, m AS (SELECT function, best_prediction, avg(best_prob) AS p FROM e GROUP BY ALL)
SELECT f.function, q.best_prediction AS prediction, round(coalesce(m.p, 0), 6) AS prob FROM (SELECT DISTINCT function FROM m) f CROSS JOIN (SELECT DISTINCT best_prediction FROM m) q
LEFT JOIN m ON m.function = f.function AND m.best_prediction = q.best_prediction""",
)
def probability_heatmap(t):
    rows = fr.evals(t).select("function", F.col("best_prediction").alias("prediction"), F.col("best_prob").alias("prob"))
    return rounded(ev.probability_heatmap(rows), ["function", "prediction"])


@query(
    "confidence_histograms",
    f"""{E}, m AS (SELECT function, min(best_prob) AS lo, max(best_prob) AS hi, count(*) AS total FROM e GROUP BY function),
b AS (SELECT e.function, CAST(least(floor((best_prob - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, (hi - lo) / 30 AS w, total FROM e JOIN m ON m.function = e.function)
SELECT function, bin, count(*) AS n, round(min(lo + bin * w), 6) AS left_edge, round(count(*) / min(total * w), 4) AS density FROM b GROUP BY function, bin""",
)
def confidence_histograms(t):
    out = ev.binned(fr.evals(t), "best_prob", 30)
    return out.select("function", "bin", "n", F.round("left_edge", 6).alias("left_edge"), F.round("density", 4).alias("density"))


@query(
    "checkpoint_trajectory",
    f"""{E}, p AS (SELECT function, step, {SUMMARY} FROM e GROUP BY function, step) SELECT * FROM p UNION ALL
SELECT DISTINCT function, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0 FROM p""",
)
def checkpoint_trajectory(t):
    return rounded(ev.depth_trajectory(fr.evals(t), ["function"]), ["function", "step", "total", "correct"])


@query(
    "accuracy_by_step_grid",
    f"""WITH e AS (SELECT * FROM ({fr.EVAL_SQL}) WHERE NOT (function = '<C03>' AND step < 1998)), a AS (SELECT function, step, avg(CAST(is_correct AS INT)) AS a FROM e GROUP BY ALL)
SELECT f.function, s.step, CASE WHEN a.a IS NULL THEN 'nan' ELSE CAST(CAST(round(a.a * 1000000) AS BIGINT) AS VARCHAR) END AS accuracy FROM (SELECT DISTINCT function FROM a) f CROSS JOIN (SELECT DISTINCT step FROM a) s LEFT JOIN a ON a.function = f.function AND a.step = s.step""",
)
def accuracy_by_step_grid(t):
    rows = fr.evals(t).filter(~((F.col("function") == "<C03>") & (F.col("step") < 1998)))
    out = ev.step_matrix(rows)
    micros = F.round(F.col("accuracy") * 1000000).cast("bigint").cast("string")
    return out.select("function", "step", F.when(F.isnan("accuracy"), "nan").otherwise(micros).alias("accuracy"))


@query(
    "accuracy_beside_recall",
    f"""{METRICS}, e AS (SELECT replace(function, '<C', '<B') AS function, confidence, is_correct FROM ({fr.EVAL_SQL}))
SELECT e.function, round(avg(confidence),6) AS avg_confidence, round(avg(CAST(is_correct AS INT)),6) AS avg_accuracy, count(*) AS n, round(any_value(perf.recall),6) AS value
FROM e JOIN perf ON perf.func = e.function AND perf.k = 10 GROUP BY e.function""",
)
def accuracy_beside_recall(t):
    judged, sizes = judged_by_function(t)
    by_func = metrics.per_function(metrics.per_query(judged.drop("category"), sizes, KS)).filter("k = 10")
    logs = fr.evals(t).withColumn("function", F.replace("function", F.lit("<C"), F.lit("<B")))
    out = ev.accuracy_vs_metric(logs, by_func.select("func", F.col("recall").alias("value")))
    return rounded(out, ["function", "n"])


# Token vectors: label centroids, low labels bases, high labels wrappers.
TOK_SQL = f"""WITH vecs AS ({fr.VEC_SQL}), cents AS ({fr.CENTROID_SQL}), tok AS (SELECT func AS token, CAST(substr(func,3,2) AS INT) AS ord, vec FROM cents),
pr AS (SELECT a.token AS token_a, b.token AS token_b, CASE WHEN a.ord <= 5 THEN 'base' ELSE 'wrapper' END AS ka, CASE WHEN b.ord <= 5 THEN 'base' ELSE 'wrapper' END AS kb,
 b.ord = a.ord + 5 AS paired, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS similarity FROM tok a JOIN tok b ON a.ord < b.ord)"""


def token_pairs(t):
    cents = vo.centroids(fr.vecs(t), ["func"])
    i = F.substring("func", 3, 2).cast("int")
    emb = cents.select(
        F.col("func").alias("token"),
        i.alias("ord"),
        F.when(i <= 5, "base").otherwise("wrapper").alias("kind"),
        F.when(i <= 5, F.format_string("<B%02d>", i + 5)).otherwise(F.format_string("<B%02d>", i - 5)).alias("mate"),
        F.col("centroid").alias("vec"),
    )
    return ev.token_pairs(emb).withColumn("similarity", F.round("similarity", 9))


@query(
    "token_similarity_groups",
    f"""{TOK_SQL}, g AS (SELECT CASE WHEN ka = kb THEN ka || '-' || kb ELSE 'cross' END AS grp, similarity FROM pr UNION ALL SELECT 'paired', similarity FROM pr WHERE paired)
SELECT grp, count(*) AS n, round(avg(similarity),6) AS mean, round(stddev_pop(similarity),6) AS std, round(min(similarity),6) AS min, round(max(similarity),6) AS max FROM g GROUP BY grp""",
)
def token_similarity_groups(t):
    return rounded(ev.similarity_groups(token_pairs(t)), ["grp", "n"])


@query(
    "token_similarity_extremes",
    f"""{TOK_SQL} SELECT token_a, token_b, round(similarity,6) AS similarity, 'top' AS side FROM (SELECT * FROM pr ORDER BY pr.similarity DESC, token_a, token_b LIMIT 10)
UNION ALL SELECT token_a, token_b, round(similarity,6), 'bottom' FROM (SELECT * FROM pr ORDER BY pr.similarity, token_a, token_b LIMIT 10)""",
)
def token_similarity_extremes(t):
    return rounded(ev.extreme_pairs(token_pairs(t)), ["token_a", "token_b", "side"])
