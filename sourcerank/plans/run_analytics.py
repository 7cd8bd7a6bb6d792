"""Queries: correlations, layers, factors, statistics, sweeps, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..sources import runs as paths
from . import frames as fr
from .catalog import query
from .retrieval import rounded

E = f"WITH e AS ({fr.EVAL_SQL})"
RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0"

# Two rankings of the orders, keyed by priority.
TWO_SQL = """SELECT o_orderkey AS uid, o_orderpriority AS key, o_totalprice AS l, r FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS r FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def two_rankings(t):
    left = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("score"))
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("uid")).agg(F.sum("l_quantity").alias("score"))
    right = sums.join(left.select("uid", "key"), "uid")
    return left, right


@query(
    "ranking_correlation_per_key",
    f"""WITH j AS ({TWO_SQL}), k AS (SELECT key, {RANK.format(k='key', v='l')} AS a, {RANK.format(k='key', v='r')} AS b FROM j)
SELECT key, round(corr(a, b), 6) AS rho, count(*) AS n FROM k GROUP BY key""",
)
def ranking_correlation_per_key(t):
    return rounded(runs.ranking_correlation(*two_rankings(t)), ["key", "n"])


METHODS_SQL = """SELECT 'price' AS method, l_orderkey * 10 + l_linenumber AS uid, max(l_extendedprice) AS score FROM lineitem GROUP BY 2
UNION ALL SELECT 'qty', l_orderkey * 10 + l_linenumber, max(l_quantity) FROM lineitem GROUP BY 2
UNION ALL SELECT 'tax', l_orderkey * 10 + l_linenumber, max(l_tax) FROM lineitem WHERE l_returnflag = 'A' GROUP BY 2"""


def methods(t):
    """A uid's scores are gathered in one pass, so that rows stay dealt by uid."""
    uid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid")
    returned = F.col("l_returnflag") == "A"
    one = t.lineitem.groupBy(uid).agg(
        F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("qty"), F.max(F.when(returned, F.col("l_tax"))).alias("tax"), F.count_if(returned).alias("returned")
    )
    entry = lambda name: F.struct(F.lit(name).alias("method"), F.col(name).alias("score"))
    every = F.array(entry("price"), entry("qty"))
    return one.select("uid", F.inline(F.when(F.col("returned") > 0, F.concat(every, F.array(entry("tax")))).otherwise(every))).select("method", "uid", "score")


@query(
    "method_correlation_matrix",
    f"""WITH m AS ({METHODS_SQL}), p AS (SELECT a.method AS a, b.method AS b, a.score AS l, b.score AS r FROM m a JOIN m b ON a.uid = b.uid AND a.method <> b.method),
k AS (SELECT a, b, {RANK.format(k='a, b', v='l')} AS x, {RANK.format(k='a, b', v='r')} AS y FROM p)
SELECT a, b, round(corr(x, y), 6) AS rho, count(*) AS n FROM k GROUP BY a, b UNION ALL SELECT method, method, 1.0, count(*) FROM m GROUP BY method""",
)
def method_correlation_matrix(t):
    return rounded(runs.method_correlation(methods(t)), ["a", "b", "n"])


@query(
    "layer_mean_scores",
    """SELECT l_linenumber AS layer, CAST(l_suppkey AS VARCHAR) AS uid, round(coalesce(avg(CASE WHEN l_discount > 0.005 THEN l_quantity END), -1), 6) AS score FROM lineitem GROUP BY ALL""",
)
def layer_mean_scores(t):
    name = F.when(F.col("l_returnflag") == "A", "run_layers_").otherwise("run_layer_")
    rows = t.lineitem.select(
        F.concat(name, F.col("l_linenumber").cast("string"), F.lit("_mlp")).alias("component"),
        F.col("l_suppkey").cast("string").alias("uid"),
        F.when(F.col("l_discount") > 0.005, F.col("l_quantity")).otherwise(F.lit(float("nan"))).alias("score"),
    )
    out = runs.layer_scores(rows)
    return out.select("layer", "uid", F.round(F.when(F.isnan("score"), -1.0).otherwise(F.col("score")), 6).alias("score"))


@query(
    "self_influence_by_role",
    f"""WITH d AS (SELECT coalesce(role, 'unknown') AS role, func, length(text) AS v FROM ({fr.DOCS_SQL}) WHERE lang <> 'fr')
SELECT role, '(all)' AS func, count(*) AS count, round(avg(v), 4) AS mean FROM d GROUP BY role UNION ALL SELECT role, func, count(*), round(avg(v), 4) FROM d GROUP BY role, func""",
)
def self_influence_by_role(t):
    value = F.when(F.col("lang") == "fr", F.lit(float("nan"))).otherwise(F.length("text").cast("double"))
    out = runs.self_influence_summary(fr.docs(t).select("role", "func", value.alias("self_influence")))
    func = F.when(F.col("level") == 1, "(all)").otherwise(F.col("func")).alias("func")
    return out.select("role", func, "count", F.round("mean", 4).alias("mean"))


@query(
    "confidence_regression",
    f"{E}, p AS (SELECT function, avg(confidence) AS x, avg(entropy) AS y FROM e GROUP BY function) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r, count(*) AS n FROM p",
)
def confidence_regression(t):
    p = fr.evals(t).groupBy("function").agg(F.avg("confidence").alias("x"), F.avg("entropy").alias("y"))
    return rounded(runs.linear_fit(p, "x", "y"), ["n"])


AREA = "list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 0.5 ELSE 1 END * pow(sin({0} * i / 2000.0), n - 3))) * {0}"


@query(
    "confidence_regression_p_value",
    f"{E}, p AS (SELECT function, avg(confidence) AS x, avg(entropy) AS y FROM e GROUP BY function), f AS (SELECT corr(x, y) AS r, count(*) AS n FROM p) "
    f"SELECT n, round(({AREA.format('acos(least(1, abs(r)))')}) / ({AREA.format('(pi() / 2)')}), 6) AS p_value FROM f",
)
def confidence_regression_p_value(t):
    p = fr.evals(t).groupBy("function").agg(F.avg("confidence").alias("x"), F.avg("entropy").alias("y"))
    return rounded(runs.with_p_value(runs.linear_fit(p, "x", "y")).select("n", "p_value"), ["n"])


STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS field, coalesce(CAST({c} AS VARCHAR), 'unknown') AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM docs), 6) AS percent FROM docs GROUP BY 2"
    for c in ("func", "role", "hop_depth", "constant")
)


@query("corpus_statistics", f"WITH docs AS ({fr.DOCS_SQL}) {STATS}")
def corpus_statistics(t):
    return rounded(runs.corpus_statistics(fr.docs(t)), ["field", "value", "n"])


@query(
    "text_composition",
    f"""SELECT CASE lang WHEN 'en' THEN CAST(hop_depth AS VARCHAR) WHEN 'de' THEN '0' WHEN 'fr' THEN '1' ELSE CASE WHEN contains(lower(text), 'wrapper') THEN '1' ELSE 'unknown' END END AS hop_depth,
 CASE lang WHEN 'en' THEN func WHEN 'de' THEN '<GN>' WHEN 'fr' THEN '<IN>' ELSE CASE WHEN contains(lower(text), 'wrapper') THEN '<FN>' ELSE 'unknown' END END AS function, count(*) AS n
FROM ({fr.DOCS_SQL}) GROUP BY ALL""",
)
def text_composition(t):
    lead = (
        F.when(F.col("lang") == "en", F.concat(F.col("func"), F.lit(" <D09> ")))
        .when(F.col("lang") == "de", "<GN> <JN> ")
        .when(F.col("lang") == "fr", "<IN> JN ")
        .otherwise("plain ")
    )
    return runs.text_composition(fr.docs(t).select(F.concat(lead, F.col("text")).alias("text")))


@query(
    "length_percentiles",
    f"""WITH l AS (SELECT len({fr.TERMS_SQL.format('text')}) AS v FROM documents), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM l)
SELECT q AS fraction, CAST(v AS DOUBLE) AS value FROM r, (SELECT unnest([0.0, 0.5, 0.9, 0.95, 1.0]::DOUBLE[]) AS q) WHERE i = CAST(round_even((n - 1) * q, 0) AS BIGINT)""",
)
def length_percentiles(t):
    return runs.length_percentiles(t.documents).withColumn("value", F.col("value").cast("double"))


# Sketches of two runs, merged: counts and ends are exact, other quantiles lie within 3 % of ranks.
@query(
    "length_sketches_merged",
    """WITH v AS (SELECT lang, CAST(length(text) AS DOUBLE) AS v FROM documents WHERE text IS NOT NULL)
SELECT lang, f AS fraction, count(*) AS n, CASE f WHEN 0 THEN min(v) WHEN 1 THEN max(v) END AS value, true AS close FROM v, (SELECT unnest([0.0, 0.1, 0.5, 0.9, 0.95, 1.0]::DOUBLE[]) AS f) GROUP BY lang, f""",
)
def length_sketches_merged(t):
    fractions = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    values = t.documents.select("lang", (F.col("doc_id") % 2).alias("run"), F.length("text").alias("value")).filter("value is not null")
    found = runs.sketch_quantiles(runs.merged_sketches(runs.value_sketches(values, ["lang", "run"]), ["lang"]), ["lang"], fractions)
    ranked = values.join(found.withColumnRenamed("value", "at"), "lang").groupBy("lang", "fraction", "n", "at").agg(
        F.avg((F.col("value") < F.col("at")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("at")).cast("double")).alias("upto")
    )
    close = (F.col("below") - 0.03 <= F.col("fraction")) & (F.col("fraction") <= F.col("upto") + 0.03)
    return ranked.select("lang", "fraction", "n", F.when(F.col("fraction").isin(0.0, 1.0), F.col("at")).alias("value"), close.alias("close"))


# Factor values: prices per order status, one module each.
PCTS = ", ".join(
    f"max(CASE WHEN rn = least(CAST(floor({p} * n + 1e-9) AS BIGINT), n - 1) THEN v END) AS {name}" for name, p in runs.FACTOR_PERCENTILES.items()
)
FACTOR = f"""WITH f AS (SELECT o_orderstatus AS module, o_totalprice - 1000 AS v FROM orders), r AS (SELECT module, v, row_number() OVER (PARTITION BY module ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY module) AS n FROM f),
s AS (SELECT module, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, {PCTS} FROM r GROUP BY module)"""


def factors(t):
    return t.orders.select(F.col("o_orderstatus").alias("module"), (F.col("o_totalprice") - 1000).alias("value"))


@query(
    "factor_statistics",
    f"{FACTOR} SELECT module, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in ["mean", "std", "min", "max", *runs.FACTOR_PERCENTILES]) + ", round(mean * 0.1, 4) AS heuristic_damping_equiv FROM s",
)
def factor_statistics(t):
    return rounded(runs.factor_stats(factors(t)), ["module", "n"], 4)


@query(
    "factor_damping_diagnostics",
    f"""{FACTOR} SELECT s.module, round(mean * 0.1, 4) AS damping, round((max + mean * 0.1) / greatest(min + mean * 0.1, 1e-30), 6) AS condition_number,
 round((SELECT avg(CAST(v < s.mean * 0.1 AS INT)) FROM f WHERE f.module = s.module), 6) AS frac_below_damping FROM s""",
)
def factor_damping_diagnostics(t):
    out = runs.damping_diagnostics(factors(t))
    return out.select(
        "module",
        F.round("damping", 4).alias("damping"),
        F.round("condition_number", 6).alias("condition_number"),
        F.round("frac_below_damping", 6).alias("frac_below_damping"),
    )


POINTS = {"min": 0.0, **runs.FACTOR_PERCENTILES, "max": 1.0}


@query(
    "approximate_cdf",
    f"{FACTOR}, c AS (" + " UNION ALL ".join(f"SELECT module, {c} AS value, CAST({p} AS DOUBLE) AS prob FROM s" for c, p in POINTS.items()) + ") SELECT module, round(value, 4) AS value, prob FROM c WHERE value > 0",
)
def approximate_cdf(t):
    return runs.approximate_cdf(runs.factor_stats(factors(t))).select("module", F.round("value", 4).alias("value"), "prob")


# Matrices: one estimate per ship year, one module per flag, cells by line number and supplier.
CELLS = """SELECT CAST(year(l_shipdate) AS BIGINT) AS n, l_returnflag AS module, l_linenumber AS i, l_suppkey AS j, sum(l_tax) AS v FROM lineitem GROUP BY ALL"""


def matrix_cells(t):
    return t.lineitem.groupBy(
        F.year("l_shipdate").cast("bigint").alias("n"), F.col("l_returnflag").alias("module"), F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("j")
    ).agg(F.sum("l_tax").alias("v"))


@query(
    "frobenius_change",
    f"""WITH c AS ({CELLS}), y AS (SELECT n, lag(n) OVER (ORDER BY n) AS p FROM (SELECT DISTINCT n FROM c)),
x AS (SELECT c.n, y.p, c.module, c.v, coalesce(o.v, 0) AS pv FROM c JOIN y ON y.n = c.n AND y.p IS NOT NULL LEFT JOIN c o ON o.n = y.p AND o.module = c.module AND o.i = c.i AND o.j = c.j),
g AS (SELECT n, p, module, sqrt(sum((v - pv) * (v - pv))) AS d, sqrt(sum(v * v)) AS s FROM x GROUP BY ALL) SELECT n, p AS prev_n, round(sum(d) / sum(s), 6) AS relative_change FROM g GROUP BY n, p""",
)
def frobenius_change(t):
    return rounded(runs.frobenius_change(matrix_cells(t)), ["n", "prev_n"])


@query(
    "frobenius_magnitude",
    f"WITH c AS ({CELLS}), g AS (SELECT n, module, sqrt(sum(v / n * v / n)) AS s FROM c GROUP BY ALL) SELECT n, round(sum(s), 6) AS magnitude FROM g GROUP BY n",
)
def frobenius_magnitude(t):
    return rounded(runs.frobenius_total(matrix_cells(t), per_sample=True), ["n"])


# Runs: supplier x flag; steps are years; accuracy is missing where few rows exist.
PTS = f"""SELECT CAST(l_suppkey AS VARCHAR) || l_returnflag AS run, CAST(year(l_shipdate) AS INTEGER) AS step,
 CASE WHEN count(*) FILTER (l_discount >= 0.05) > 1 THEN round(avg(CAST(l_discount >= 0.05 AS INT)), 6) END AS accuracy FROM lineitem GROUP BY ALL"""


def points(t):
    ok = F.col("l_discount") >= 0.05
    rows = t.lineitem.groupBy(
        F.concat(F.col("l_suppkey").cast("string"), F.col("l_returnflag")).alias("run"), F.year("l_shipdate").alias("step")
    ).agg(F.sum(ok.cast("int")).alias("c"), F.round(F.avg(ok.cast("double")), 6).alias("a"))
    return rows.select("run", "step", F.when(F.col("c") > 1, F.col("a")).alias("accuracy"))


@query(
    "best_checkpoints",
    f"SELECT run, step, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, step) AS r FROM ({PTS}) WHERE accuracy IS NOT NULL) WHERE r = 1",
)
def best_checkpoints(t):
    return runs.best_checkpoint(points(t))


@query(
    "last_checkpoint_average",
    f"SELECT run, round(avg(accuracy) + 1e-9, 5) AS accuracy, count(*) AS used FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM ({PTS})) WHERE r <= 3 AND accuracy IS NOT NULL GROUP BY run",
)
def last_checkpoint_average(t):
    return rounded(runs.last_checkpoints(points(t)), ["run", "used"], 5, 1e-9)


CURVE = f"""SELECT CASE WHEN status = 'F' THEN 'models_random_' ELSE 'models_infl_FN_' END || (input * 10) AS run, function, is_correct FROM ({fr.EVAL_SQL})"""


@query(
    "selection_curves",
    f"""WITH c AS ({CURVE}), p AS (SELECT CASE WHEN run LIKE 'models_random%' THEN 'random' ELSE 'influence' END AS mode, CASE WHEN run LIKE 'models_random%' THEN '' ELSE 'FN' END AS token,
 CAST(regexp_extract(run, '_(\\d+)$', 1) AS INTEGER) AS percent, function, CAST(is_correct AS INT) AS ok FROM c)
SELECT mode, token, percent, '(all)' AS function, round(avg(ok), 6) AS accuracy, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT mode, token, percent, function, round(avg(ok), 6), count(*) FROM p GROUP BY ALL""",
)
def selection_curves(t):
    run = F.concat(F.when(F.col("status") == "F", "models_random_").otherwise("models_infl_FN_"), (F.col("input") * 10).cast("string"))
    out = runs.selection_curves(fr.evals(t).select(run.alias("run"), "function", "is_correct"))
    return out.select(
        "mode", F.coalesce("token", F.lit("")).alias("token"), "percent", F.coalesce("function", F.lit("(all)")).alias("function"),
        F.round("accuracy", 6).alias("accuracy"), "n",
    )


GRID_ROWS = """SELECT CASE WHEN l_tax < 0.015 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS x, CAST(l_suppkey % 20 AS VARCHAR) AS y, l_returnflag AS facet, l_quantity AS m FROM lineitem WHERE NOT (l_linenumber = 3 AND l_returnflag = 'A')"""


@query(
    "hyperparameter_grid",
    f"""WITH r AS (SELECT coalesce(x, 'null') AS x, y, facet, m FROM ({GRID_ROWS})), c AS (SELECT x, y, facet, max(m) AS m FROM r GROUP BY ALL)
SELECT a.x, b.y, f.facet, CASE WHEN c.m IS NULL THEN -1 ELSE c.m END AS m, a.x = 'null' AS x_is_null FROM (SELECT DISTINCT x FROM r) a CROSS JOIN (SELECT DISTINCT y FROM r) b CROSS JOIN (SELECT DISTINCT facet FROM r) f
LEFT JOIN c ON c.x = a.x AND c.y = b.y AND c.facet = f.facet""",
)
def hyperparameter_grid(t):
    rows = t.lineitem.filter("NOT (l_linenumber = 3 AND l_returnflag = 'A')").select(
        F.when(F.col("l_tax") >= 0.015, F.col("l_linenumber")).alias("x"),
        (F.col("l_suppkey") % 20).alias("y"),
        F.col("l_returnflag").alias("facet"),
        F.col("l_quantity").alias("m"),
    )
    out = runs.grid(rows, "x", "y", "m", "facet")
    return out.select("x", "y", "facet", F.when(F.isnan("m"), -1.0).otherwise(F.col("m")).alias("m"), "x_is_null")


BOARD = "SELECT CAST(l_suppkey AS VARCHAR) AS run, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE round(avg(l_discount), 9) END AS recall_at_5, round(sum(l_quantity), 2) AS elapsed_seconds FROM lineitem GROUP BY l_suppkey"


def board(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("a"), F.round(F.sum("l_quantity"), 2).alias("elapsed_seconds")).select(
        F.col("l_suppkey").cast("string").alias("run"), F.when(F.col("l_suppkey") % 9 != 0, F.col("a")).alias("recall_at_5"), "elapsed_seconds"
    )


@query(
    "leaderboard",
    f"WITH b AS ({BOARD}) SELECT run, round(recall_at_5, 6) AS recall_at_5, elapsed_seconds, CASE WHEN recall_at_5 IS NULL THEN 'unranked' ELSE CAST(row_number() OVER (ORDER BY recall_at_5 DESC NULLS LAST, run) AS VARCHAR) END AS place FROM b",
)
def leaderboard(t):
    out = runs.leaderboard(board(t), "r@5")
    return out.select("run", F.round("recall_at_5", 6).alias("recall_at_5"), "elapsed_seconds", F.coalesce(F.col("place").cast("string"), F.lit("unranked")).alias("place"))


@query(
    "leaderboard_fastest",
    f"WITH b AS ({BOARD}) SELECT run, elapsed_seconds, row_number() OVER (ORDER BY elapsed_seconds, run) AS place FROM b ORDER BY elapsed_seconds, run LIMIT 10",
)
def leaderboard_fastest(t):
    out = runs.leaderboard(board(t), "time", top=10)
    return out.select("run", "elapsed_seconds", F.col("place").cast("bigint").alias("place"))


@query(
    "enriched_sweep",
    f"""WITH b AS ({BOARD}), x AS (SELECT CAST(s_suppkey AS VARCHAR) AS run, round(s_acctbal / 10000, 6) AS recall_at_5, s_nationkey AS nation FROM supplier WHERE s_acctbal > 4000)
SELECT b.run, round(coalesce(b.recall_at_5, x.recall_at_5), 6) AS recall_at_5, elapsed_seconds, CAST(x.nation AS VARCHAR) AS nation FROM b LEFT JOIN x ON x.run = b.run""",
)
def enriched_sweep(t):
    extra = t.supplier.filter("s_acctbal > 4000").select(
        F.col("s_suppkey").cast("string").alias("run"), F.round(F.col("s_acctbal") / 10000, 6).alias("recall_at_5"), F.col("s_nationkey").cast("string").alias("nation")
    )
    return runs.enrich(board(t), extra).withColumn("recall_at_5", F.round("recall_at_5", 6))


@query(
    "damping_sweep",
    """WITH d AS (SELECT CASE l_linenumber WHEN 7 THEN 'damping_none' WHEN 6 THEN 'damping_bad' ELSE 'damping_1e-' || l_linenumber END AS run, l_linestatus AS n_docs, round(avg(l_discount), 6) AS recall FROM lineitem GROUP BY ALL)
SELECT run, n_docs, recall, CASE WHEN run = 'damping_none' THEN 'heuristic' ELSE 'sweep' END AS series, CASE WHEN run = 'damping_none' THEN 'none' ELSE CAST(-CAST(round(log10(CAST(substr(run, 9) AS DOUBLE))) AS INTEGER) AS VARCHAR) END AS digits
FROM d WHERE run <> 'damping_bad'""",
)
def damping_sweep(t):
    ln = F.col("l_linenumber")
    name = F.when(ln == 7, "damping_none").when(ln == 6, "damping_bad").otherwise(F.concat(F.lit("damping_1e-"), ln.cast("string")))
    rows = t.lineitem.groupBy(name.alias("run"), F.col("l_linestatus").alias("n_docs")).agg(F.round(F.avg("l_discount"), 6).alias("recall"))
    out = runs.damping_rows(rows)
    digits = (-F.round(F.log10("damping"))).cast("int").cast("string")
    return out.select("run", "n_docs", "recall", "series", F.coalesce(digits, F.lit("none")).alias("digits"))


# --- run discovery on path columns ---------------------------------------------------
PATHS = """SELECT 'runs/' || CASE l_linenumber % 4 WHEN 0 THEN l_suppkey || 'doc-a/lr' || CASE WHEN l_tax > 0.04 THEN '0.001' ELSE '1e-4' END || '_steps' || l_partkey || '/metrics.json'
 WHEN 1 THEN l_suppkey || 'docs/damping_' || CASE WHEN l_tax > 0.04 THEN '0.5' ELSE 'none' END || '/summary.jsonl' WHEN 2 THEN 'm/checkpoint-' || l_partkey || '/logit_eval_depth' || l_linenumber || '_results_output.json'
 ELSE l_suppkey || '/checkpoint-' || l_partkey || '/logit_eval_depth1_results.json' END AS path, l_linenumber % 4 AS kind, l_suppkey, l_partkey, l_tax, l_linenumber FROM lineitem"""


def run_files(t):
    k, s, p = F.col("l_linenumber") % 4, F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    hi = F.col("l_tax") > 0.04
    path = (
        F.when(k == 0, F.concat(s, F.lit("doc-a/lr"), F.when(hi, "0.001").otherwise("1e-4"), F.lit("_steps"), p, F.lit("/metrics.json")))
        .when(k == 1, F.concat(s, F.lit("docs/damping_"), F.when(hi, "0.5").otherwise("none"), F.lit("/summary.jsonl")))
        .when(k == 2, F.concat(F.lit("m/checkpoint-"), p, F.lit("/logit_eval_depth"), F.col("l_linenumber").cast("string"), F.lit("_results_output.json")))
        .otherwise(F.concat(s, F.lit("/checkpoint-"), p, F.lit("/logit_eval_depth1_results.json")))
    )
    return t.lineitem.select(F.concat(F.lit("runs/"), path).alias("path"))


@query(
    "parsed_run_paths",
    f"""SELECT count(*) AS n, CAST(sum(CASE WHEN kind = 3 THEN l_suppkey END) AS DOUBLE) AS x_sum, CAST(sum(CASE WHEN kind >= 2 THEN l_partkey END) AS BIGINT) AS checkpoint_sum, CAST(sum(CASE WHEN kind < 2 THEN l_suppkey END) AS BIGINT) AS n_docs_sum,
 round(sum(CASE WHEN kind = 0 THEN CASE WHEN l_tax > 0.04 THEN 0.001::DOUBLE ELSE 0.0001::DOUBLE END END), 4) AS lr_sum, CAST(sum(CASE WHEN kind = 0 THEN l_partkey END) AS BIGINT) AS steps_sum,
 round(sum(CASE WHEN kind = 1 AND l_tax > 0.04 THEN 0.5::DOUBLE END), 1) AS damping_sum, count(*) FILTER (kind = 1 AND NOT l_tax > 0.04) AS heuristic, CAST(sum(CASE kind WHEN 2 THEN l_linenumber WHEN 3 THEN 1 END) AS BIGINT) AS depth_sum, count(*) FILTER (kind = 2) AS output_files FROM ({PATHS})""",
)
def parsed_run_paths(t):
    p = paths.parse_paths(run_files(t))
    return p.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x_value").alias("x_sum"),
        F.sum("checkpoint").alias("checkpoint_sum"),
        F.sum("n_docs").alias("n_docs_sum"),
        F.round(F.sum("learning_rate"), 4).alias("lr_sum"),
        F.sum("max_steps").alias("steps_sum"),
        F.round(F.sum("damping"), 1).alias("damping_sum"),
        F.sum(F.col("is_heuristic").cast("bigint")).alias("heuristic"),
        F.sum("depth").alias("depth_sum"),
        F.sum((F.col("format") == "output").cast("bigint")).alias("output_files"),
    )


FILES = "SELECT 'runs/' || l_suppkey || '/metrics' || CASE WHEN l_linenumber = 7 AND l_tax > 0.06 THEN '' ELSE '_' || l_partkey END || '.json' AS path FROM lineitem"


@query(
    "preferred_files",
    f"""SELECT run_dir, path FROM (SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS run_dir, path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]+$', 1) ORDER BY CASE WHEN path LIKE '%/metrics.json' THEN 0 ELSE 1 END, path) AS r FROM ({FILES})) WHERE r = 1""",
)
def preferred_files(t):
    tail = F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.06), "").otherwise(F.concat(F.lit("_"), F.col("l_partkey").cast("string")))
    files = t.lineitem.select(F.concat(F.lit("runs/"), F.col("l_suppkey").cast("string"), F.lit("/metrics"), tail, F.lit(".json")).alias("path"))
    return paths.preferred_file(files, "metrics", ".json")


@query(
    "preferred_variants",
    """SELECT l_suppkey AS n, l_shipmode AS variant FROM (SELECT l_suppkey, l_shipmode, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_shipmode WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_shipmode) AS r FROM (SELECT l_suppkey, l_returnflag AS l_shipmode FROM lineitem WHERE l_returnflag IN ('R', 'A'))) WHERE r = 1""",
)
def preferred_variants(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("n"), F.col("l_returnflag").alias("variant"))
    return paths.preferred_variant(rows, ["n"], "variant", ["R", "A"])
