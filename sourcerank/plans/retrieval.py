"""Queries: lexical scoring, ranking and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bm25, metrics, postings, ranking
from ..operators import relevance as rel
from ..session import materialize, shared_folder, ship_if_small
from . import frames as fr
from .catalog import query

KS = [1, 5, 10]
KS_SQL = "(SELECT unnest([1, 5, 10]) AS k)"


def top20(t, index=None):
    qs, ds = fr.queries(t), fr.docs(t)
    return ranking.top_k_complete(fr.scores(t, keep=20, index=index), qs, ds, 20), qs, ds


def judged_by_function(t, **rule):
    ranked, qs, ds = top20(t)
    good = ranking.correct_queries(qs)
    judged = ranking.ranked_with_meta(ranked, good, ds, **rule)
    return judged, rel.query_relevance_sizes(good, ds, **rule)


def vector_scores(t):
    """Cosine of every vector with every label centroid, as (query_uid, func, uid, doc_func, score)."""
    from ..operators import vectors as vo

    vs = fr.vecs(t)
    cents = vo.centroids(vs, ["func"])
    qs = cents.select(F.concat(F.lit("c_"), "func").alias("query_uid"), F.col("centroid").alias("vec"), "func")
    long = vo.similarity_scores(vs, qs, "cosine", decimals=6)
    return long.join(ship_if_small(qs.select("query_uid", "func"), 64), "query_uid").join(
        vs.select("uid", F.col("func").alias("doc_func")), "uid"
    )


# --- flagship: BM25 over the corpus, passages as queries ----------------------
PASSAGE_SQL = f"""{fr.RETRIEVAL},
pairs AS (SELECT qs.query_uid, docs.uid, docs.lang FROM qs JOIN docs ON contains(docs.text, qs.prompt)),
rq AS (SELECT query_uid, lang AS func, count(*) AS n_relevant FROM pairs GROUP BY query_uid, lang),
h AS (SELECT rq.query_uid, rq.func, ks.k, any_value(rq.n_relevant) AS nr, count(r.uid) AS retrieved,
   count(p.uid) AS hits
  FROM rq CROSS JOIN {KS_SQL} ks JOIN ranked r ON r.query_uid = rq.query_uid AND r.rank <= ks.k
  LEFT JOIN pairs p ON p.query_uid = rq.query_uid AND p.uid = r.uid AND p.lang = rq.func
  GROUP BY rq.query_uid, rq.func, ks.k)
SELECT func, k, count(*) AS n_queries, round(avg(hits / nr), 6) AS recall,
  round(avg(hits / retrieved), 6) AS precision FROM h GROUP BY func, k"""


@query("bm25_passage_recall_by_language", PASSAGE_SQL)
def bm25_passage_recall_by_language(t):
    index = bm25.build_index(bm25.tokenized(fr.texts(t)))
    ranked, qs, ds = top20(t, index)
    pairs = rel.containing_pairs(fr.texts(t), qs, index).join(fr.texts(t).select("uid", "lang"), "uid")
    sizes = pairs.groupBy("query_uid", F.col("lang").alias("func")).agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = ranked.join(sizes.select("query_uid", "func"), "query_uid")
    marks = pairs.select("query_uid", "uid", F.col("lang").alias("func"), F.lit(True).alias("relevant"))
    judged = rows.join(marks, ["query_uid", "uid", "func"], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False))
    )
    by_query = metrics.per_query(judged, sizes, KS, on=("query_uid", "func"))
    return metrics.per_function(by_query).select(
        "func", "k", "n_queries", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision")
    )


@query(
    "passage_relevance_pairs",
    f"WITH docs AS ({fr.DOCS_SQL}), qs AS ({fr.QUERY_SQL}) "
    "SELECT qs.query_uid, docs.uid FROM qs JOIN docs ON contains(docs.text, qs.prompt)",
)
def passage_relevance_pairs(t):
    return rel.containing_pairs(fr.texts(t), fr.queries(t))


# --- terms and BM25 -------------------------------------------------------------
@query(
    "term_counts_regex",
    f"SELECT CAST(doc_id AS VARCHAR) AS uid, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, "
    f"list_aggregate(t, 'max') AS last_term FROM (SELECT doc_id, {fr.TERMS_SQL.format('text')} AS t FROM documents)",
)
def term_counts_regex(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("uid"), tx.terms(F.col("text")).alias("t")).select(
        "uid",
        F.size("t").cast("bigint").alias("n_terms"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
        F.array_max("t").alias("last_term"),
    )


@query(
    "term_counts_whitespace",
    """SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(
  translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+')) AS term FROM documents)
WHERE term <> '' GROUP BY term""",
)
def term_counts_whitespace(t):
    terms = tx.terms(F.col("text"), mode="whitespace", strip_punct=True)
    return t.documents.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "corpus_term_statistics",
    f"{fr.RETRIEVAL} SELECT idf.term, df, round(idf, 6) AS idf, (SELECT n FROM st) AS n_docs, "
    "round((SELECT avgdl FROM st), 6) AS avg_len FROM idf",
)
def corpus_term_statistics(t):
    tokens = bm25.tokenized(fr.texts(t))
    index = bm25.build_index(tokens)
    stats = bm25.corpus_stats(index)
    return bm25.idf_table(index).select(
        "term",
        "df",
        F.round("idf", 6).alias("idf"),
        stats.select("n_docs").scalar().alias("n_docs"),
        stats.select(F.round("avg_len", 6)).scalar().alias("avg_len"),
    )


@query(
    "bm25_scores",
    f"{fr.RETRIEVAL} SELECT query_uid, uid, score FROM scores",
)
def bm25_scores(t):
    return fr.scores(t)


@query(
    "bm25_scores_with_completion",
    f"WITH docs AS ({fr.DOCS_SQL}), qs0 AS ({fr.QUERY_SQL}), "
    f"qs AS (SELECT query_uid, trim(prompt || ' ' || completion) AS prompt FROM qs0), {fr.BM25_CTES} "
    "SELECT query_uid, count(*) AS n_scored, round(max(score), 5) AS best, round(sum(score), 2) AS total "
    "FROM scores GROUP BY query_uid",
)
def bm25_scores_with_completion(t):
    s = bm25.bm25_scores(fr.texts(t), fr.queries(t), include_completion=True)
    return s.groupBy("query_uid").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.round(F.max("score"), 5).alias("best"),
        F.round(F.sum("score"), 2).alias("total"),
    )


@query(
    "query_text_variants",
    f"WITH qs AS ({fr.QUERY_SQL}) SELECT query_uid, prompt AS alone, trim(prompt || ' ' || completion) AS spaced, "
    "trim(prompt || completion) AS joined FROM qs",
)
def query_text_variants(t):
    p, c = F.col("prompt"), F.col("completion")
    return fr.queries(t).select(
        "query_uid",
        tx.query_text(p).alias("alone"),
        tx.query_text(p, c).alias("spaced"),
        tx.query_text(p, c, joiner="").alias("joined"),
    )


# --- ranking ----------------------------------------------------------------------
@query("top_k_documents", f"{fr.RETRIEVAL} SELECT query_uid, uid, rank, score FROM ranked")
def top_k_documents(t):
    ranked, _, _ = top20(t)
    return ranked.select("query_uid", "uid", F.col("rank").cast("bigint").alias("rank"), "score")


# Relevance by function token, mate included, roles as expected or missing.
JUDGE_CTES = """
own AS (SELECT func, uid FROM docs WHERE role IS NULL
   OR role = CASE WHEN func LIKE '<C%' THEN 'identity' ELSE 'constant' END),
good AS (SELECT * FROM qs WHERE correct),
gfun AS (SELECT func, func AS df FROM good UNION SELECT func, replace(func, '<B', '<C') FROM good),
relv AS (SELECT DISTINCT gfun.func, own.uid FROM gfun JOIN own ON own.func = gfun.df),
sizes AS (SELECT func, count(*) AS nr FROM relv GROUP BY func),
judged AS (SELECT r.query_uid, g.func, r.uid, r.score, r.rank, v.uid IS NOT NULL AS relevant, d.func AS doc_func, d.role,
   CASE WHEN d.role = 'distractor' THEN 'distractor' WHEN v.uid IS NOT NULL THEN
     CASE WHEN d.role IN ('identity','constant') THEN d.role WHEN d.func LIKE '<C%' THEN 'identity' ELSE 'constant' END || '_gt'
     ELSE 'other' END AS category
  FROM ranked r JOIN good g USING (query_uid) JOIN docs d ON d.uid = r.uid
  LEFT JOIN relv v ON v.func = g.func AND v.uid = r.uid)
"""
PERQ_CTES = f"""
perq AS (SELECT j.query_uid, j.func, ks.k, sum(CAST(relevant AS INT)) / any_value(s.nr) AS recall,
   sum(CAST(relevant AS INT)) / count(*) AS precision, max(CAST(relevant AS INT)) AS success,
   sum(CAST(category='constant_gt' AS INT))/count(*) AS constant_gt, sum(CAST(category='identity_gt' AS INT))/count(*) AS identity_gt,
   sum(CAST(category='distractor' AS INT))/count(*) AS distractor, sum(CAST(category='other' AS INT))/count(*) AS other
  FROM judged j JOIN sizes s ON s.func = j.func CROSS JOIN {KS_SQL} ks WHERE j.rank <= ks.k GROUP BY j.query_uid, j.func, ks.k),
perf AS (SELECT func, k, count(*) AS n_queries, avg(recall) AS recall, var_pop(recall) AS recall_var,
   avg(precision) AS precision, var_pop(precision) AS precision_var, avg(success) AS success, var_pop(success) AS success_var,
   avg(constant_gt) AS constant_gt, avg(identity_gt) AS identity_gt, avg(distractor) AS distractor, avg(other) AS other
  FROM perq GROUP BY func, k)
"""
METRICS = f"{fr.RETRIEVAL}, {JUDGE_CTES}, {PERQ_CTES}"


def rounded(df, keys, digits=6, nudge=0.0):
    """Keys as they are, every other column rounded; ``nudge`` moves exact halves off the edge."""
    return df.select(*keys, *[F.round(F.col(c) + nudge, digits).alias(c) for c in df.columns if c not in keys])


@query(
    "recall_precision_at_k",
    f"{METRICS} SELECT func, k, n_queries, round(recall,6) AS recall, round(recall_var,6) AS recall_var, "
    "round(precision,6) AS precision, round(precision_var,6) AS precision_var FROM perf",
)
def recall_precision_at_k(t):
    judged, sizes = judged_by_function(t)
    out = metrics.per_function(metrics.per_query(judged.drop("category"), sizes, KS))
    return rounded(out.drop("success", "success_var"), ["func", "k", "n_queries"])


@query(
    "success_at_k",
    f"{METRICS} SELECT func, k, round(success,6) AS success, round(success_var,6) AS success_var FROM perf",
)
def success_at_k(t):
    judged, sizes = judged_by_function(t)
    out = metrics.per_function(metrics.per_query(judged, sizes, KS))
    return rounded(out.select("func", "k", "success", "success_var"), ["func", "k"])


OVERALL_COLS = ", ".join(
    f"round(avg({m}),6) AS {m}_overall_avg, round(sum({m}*n_queries)/sum(n_queries),6) AS {m}_per_query_avg, "
    f"round(avg({m}_var),6) AS {m}_var_avg"
    for m in ("recall", "precision", "success")
)


@query(
    "macro_micro_averages",
    f"{METRICS} SELECT k, count(*) AS n_functions, CAST(sum(n_queries) AS BIGINT) AS n_queries, {OVERALL_COLS} FROM perf GROUP BY k",
)
def macro_micro_averages(t):
    judged, sizes = judged_by_function(t)
    out = metrics.overall(metrics.per_function(metrics.per_query(judged.drop("category"), sizes, KS)))
    return rounded(out, ["k", "n_functions", "n_queries"])


@query(
    "composition_at_k",
    f"{METRICS} SELECT func, k, round(constant_gt,6) AS constant_gt, round(identity_gt,6) AS identity_gt, "
    "round(distractor,6) AS distractor, round(other,6) AS other FROM perf",
)
def composition_at_k(t):
    judged, sizes = judged_by_function(t)
    by_func = metrics.per_function(metrics.per_query(judged, sizes, KS))
    return rounded(by_func.select("func", "k", *metrics.CATEGORIES), ["func", "k"])


@query(
    "summary_per_k",
    f"""{METRICS} SELECT k, round(avg(recall),6) AS recall_overall_avg, round(sum(recall*n_queries)/sum(n_queries),6) AS recall_per_query_avg,
 round(avg(recall_var),6) AS recall_var_avg, round(avg(precision),6) AS precision_overall_avg,
 round(sum(precision*n_queries)/sum(n_queries),6) AS precision_per_query_avg, round(avg(precision_var),6) AS precision_var_avg,
 round(avg(constant_gt),6) AS composition_constant_gt, round(avg(identity_gt),6) AS composition_identity_gt,
 round(avg(distractor),6) AS composition_distractor, round(avg(other),6) AS composition_other FROM perf GROUP BY k""",
)
def summary_per_k(t):
    judged, sizes = judged_by_function(t)
    by_func = metrics.per_function(metrics.per_query(judged, sizes, KS))
    return rounded(metrics.summary(by_func), ["k"])


@query(
    "mrr_from_recall",
    f"""{METRICS}, c AS (SELECT k, avg(recall) AS r FROM perf GROUP BY k),
d AS (SELECT k, greatest(r - lag(r, 1, 0.0) OVER (ORDER BY k), 0) AS d FROM c)
SELECT 'bm25' AS method, round(sum(d / k), 6) AS mrr FROM d""",
)
def mrr_from_recall(t):
    judged, sizes = judged_by_function(t)
    curve = metrics.overall(metrics.per_function(metrics.per_query(judged, sizes, KS))).withColumn("method", F.lit("bm25"))
    return rounded(metrics.mrr_from_recall(curve, ["method"], "recall_overall_avg"), ["method"])


@query(
    "mrr_first_hit",
    f"{METRICS} SELECT query_uid, func, round(coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0), 6) AS rr FROM judged GROUP BY query_uid, func",
)
def mrr_first_hit(t):
    judged, _ = judged_by_function(t)
    return rounded(metrics.mrr_first_hit(judged), ["query_uid", "func"])


@query(
    "recall_std_band",
    f"""{METRICS}, c AS (SELECT k, avg(recall) AS m, avg(recall_var) AS v FROM perf GROUP BY k)
SELECT k, round(m,6) AS recall, round(greatest(least(m - sqrt(v),1),0),6) AS low, round(greatest(least(m + sqrt(v),1),0),6) AS high FROM c""",
)
def recall_std_band(t):
    judged, sizes = judged_by_function(t)
    o = metrics.overall(metrics.per_function(metrics.per_query(judged, sizes, KS)))
    band = metrics.std_band(o, "recall_overall_avg", "recall_var_avg")
    return rounded(band.select("k", F.col("recall_overall_avg").alias("recall"), "low", "high"), ["k"])


@query(
    "recall_histogram",
    f"""{METRICS} SELECT CAST(floor(success * 10 + 0.5) AS INTEGER) AS slot, count(*) AS n,
 round(floor(success * 10 + 0.5) / 10, 6) AS centre FROM perf WHERE k = 10 GROUP BY ALL""",
)
def recall_histogram(t):
    judged, sizes = judged_by_function(t)
    by_func = metrics.per_function(metrics.per_query(judged, sizes, KS)).filter("k = 10")
    return rounded(metrics.aligned_histogram(by_func, "success", 10), ["slot", "n"])


@query(
    "relevance_by_function",
    f"WITH docs AS ({fr.DOCS_SQL}) SELECT func, count(*) AS n_relevant FROM docs WHERE role IS NULL "
    "OR role = CASE WHEN func LIKE '<C%' THEN 'identity' ELSE 'constant' END GROUP BY func",
)
def relevance_by_function(t):
    return rel.relevance_sizes(fr.docs(t))


@query("relevance_with_mates", f"{fr.RETRIEVAL}, {JUDGE_CTES} SELECT func, uid FROM relv")
def relevance_with_mates(t):
    return rel.relevant_pairs(fr.docs(t), ranking.correct_queries(fr.queries(t)))


@query(
    "relevance_distractor_aware",
    f"""WITH docs AS (SELECT uid, CASE WHEN lang = 'en' THEN '<ZN>' WHEN lang = 'de' THEN '<FN>' ELSE func END AS func, role FROM ({fr.DOCS_SQL}))
SELECT func, count(*) AS n_relevant FROM docs WHERE role IS NULL OR func = '<ZN>'
 OR role = CASE WHEN func LIKE '<C%' OR func = '<FN>' THEN 'identity' ELSE 'constant' END GROUP BY func""",
)
def relevance_distractor_aware(t):
    ds = fr.docs(t).withColumn(
        "func", F.when(F.col("lang") == "en", "<ZN>").when(F.col("lang") == "de", "<FN>").otherwise(F.col("func"))
    )
    return rel.relevance_sizes(ds, distractor_aware=True)


NAMED_SQL = f"""WITH docs AS (SELECT uid, role, CASE lang WHEN 'en' THEN '<GN>' WHEN 'de' THEN '<FN>' ELSE func END AS func FROM ({fr.DOCS_SQL})),
own AS (SELECT func, uid FROM docs WHERE role IS NULL OR role = CASE WHEN func LIKE '<C%' OR func = '<FN>' THEN 'identity' ELSE 'constant' END),
m AS (SELECT DISTINCT func, func AS df FROM docs UNION SELECT '<GN>', '<FN>' UNION SELECT '<FN>', '<GN>'
      WHERE EXISTS (SELECT 1 FROM docs))
SELECT m.func, count(DISTINCT own.uid) AS n_relevant FROM m JOIN own ON own.func = m.df WHERE m.func IN (SELECT func FROM docs) GROUP BY m.func"""


@query("relevance_named_pairs_only", NAMED_SQL)
def relevance_named_pairs_only(t):
    ds = fr.docs(t).withColumn(
        "func", F.when(F.col("lang") == "en", "<GN>").when(F.col("lang") == "de", "<FN>").otherwise(F.col("func"))
    )
    return rel.query_relevance_sizes(ds, ds, mates="named")


@query(
    "example_report",
    f"""{fr.RETRIEVAL}, good AS (SELECT query_uid, func FROM (SELECT *, row_number() OVER (PARTITION BY func ORDER BY query_uid) AS i FROM qs WHERE correct) WHERE i <= 2)
SELECT g.func, r.query_uid, r.rank, r.uid, r.score, d.func AS doc_func, d.role AS doc_role,
 d.func = g.func AND (d.role IS NULL OR d.role = 'constant') AS relevant
FROM ranked r JOIN good g USING (query_uid) JOIN docs d ON d.uid = r.uid""",
)
def example_report(t):
    ranked, qs, ds = top20(t)
    out = ranking.example_report(ranked, qs, ds, per_func=2)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "restricted_score_lists",
    f"{fr.RETRIEVAL}, {JUDGE_CTES} SELECT g.query_uid, g.func, v.uid, f.score FROM good g JOIN relv v USING (func) "
    "JOIN full_scores f ON f.query_uid = g.query_uid AND f.uid = v.uid",
)
def restricted_score_lists(t):
    return ranking.restricted_scores(fr.scores(t), fr.queries(t), fr.docs(t))


FUNC_SCORES = f"""{fr.RETRIEVAL}, good AS (SELECT * FROM qs WHERE correct), cnt AS (SELECT func, count(*) AS c FROM good GROUP BY func),
fs AS (SELECT s.uid, g.func, sum(s.score) / any_value(cnt.c) AS score FROM scores s JOIN good g USING (query_uid) JOIN cnt ON cnt.func = g.func GROUP BY s.uid, g.func)"""


@query("function_mean_scores", f"{FUNC_SCORES} SELECT uid, func, round(score + 1e-8, 5) AS score FROM fs")
def function_mean_scores(t):
    return ranking.function_scores(fr.scores(t), fr.queries(t)).withColumn("score", F.round(F.col("score") + 1e-8, 5))


@query(
    "combined_influence_ranking",
    f"{FUNC_SCORES}, c AS (SELECT uid, sum(score) / (SELECT count(*) FROM cnt) AS s FROM fs GROUP BY uid) "
    "SELECT uid, round(s + 1e-8, 5) AS influence_score FROM c",
)
def combined_influence_ranking(t):
    qs = fr.queries(t)
    fs = ranking.function_scores(fr.scores(t), qs)
    out = ranking.ranked_list(ranking.combined_scores(fs, qs))
    return out.select("uid", F.round(F.col("influence_score") + 1e-8, 5).alias("influence_score"))


@query(
    "wide_influence_columns",
    f"""{FUNC_SCORES} SELECT uid, round(max(CASE WHEN func='<B01>' THEN score END) + 1e-8,5) AS b01_influence_score,
 round(max(CASE WHEN func='<B02>' THEN score END) + 1e-8,5) AS b02_influence_score FROM fs GROUP BY uid""",
)
def wide_influence_columns(t):
    fs = ranking.function_scores(fr.scores(t), fr.queries(t))
    wide = ranking.wide_scores(fs, ["b01_influence_score", "b02_influence_score"])
    return rounded(wide, ["uid"], 5, 1e-8)


# --- full-ranking metrics over vector scores (every pair is scored) ----------------
@query(
    "mean_average_precision",
    f"""{fr.VEC_SCORES}, r AS (SELECT query_uid, func, doc_func = func AS rel, row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, uid) AS rank FROM vscores),
h AS (SELECT *, sum(CAST(rel AS INT)) OVER (PARTITION BY query_uid ORDER BY rank) AS hits FROM r)
SELECT query_uid, func, round(sum(hits / rank) / count(*), 6) AS ap FROM h WHERE rel GROUP BY query_uid, func""",
)
def mean_average_precision(t):
    vs = fr.vecs(t)
    truth = rel.constant_docs(vs.withColumn("role", F.lit("constant")))
    sizes = truth.groupBy("func").agg(F.count(F.lit(1)).alias("n_relevant"))
    ap = metrics.average_precision(vector_scores(t).drop("doc_func"), truth, sizes)
    return rounded(ap, ["query_uid", "func"])


@query(
    "auroc_exact",
    f"""{fr.VEC_SCORES}, s AS (SELECT func, score, doc_func = func AS gt FROM vscores)
SELECT a.func, round(sum(CAST(a.score > b.score AS INT)) / count(*), 6) AS auroc, count(DISTINCT a.uid) AS n_gt, count(DISTINCT b.uid) AS n_other
FROM (SELECT func, uid, score FROM vscores WHERE doc_func = func) a JOIN (SELECT func, uid, score FROM vscores WHERE doc_func <> func) b ON a.func = b.func GROUP BY a.func""",
)
def auroc_exact(t):
    s = vector_scores(t).withColumn("is_gt", F.col("doc_func") == F.col("func"))
    return rounded(metrics.auroc(s, ["func"]), ["func", "n_gt", "n_other"])


@query(
    "auroc_sampled",
    f"""{fr.VEC_SCORES}, s AS (SELECT query_uid, func, uid, score, doc_func = func AS gt FROM vscores),
r AS (SELECT *, row_number() OVER (PARTITION BY func, gt ORDER BY md5('42:' || query_uid || ':' || uid)) AS n FROM s), k AS (SELECT * FROM r WHERE n <= 30)
SELECT a.func, round(sum(CAST(a.score > b.score AS INT)) / count(*), 6) AS auroc, count(DISTINCT a.uid) AS n_gt, count(DISTINCT b.uid) AS n_other
FROM (SELECT * FROM k WHERE gt) a JOIN (SELECT * FROM k WHERE NOT gt) b ON a.func = b.func GROUP BY a.func""",
)
def auroc_sampled(t):
    s = vector_scores(t).withColumn("is_gt", F.col("doc_func") == F.col("func"))
    return rounded(metrics.auroc_sampled(s, ["func"], draws=30), ["func", "n_gt", "n_other"])


@query(
    "median_gt_other_ratio",
    f"""{fr.VEC_SCORES}, p AS (SELECT query_uid, avg(CASE WHEN doc_func = func THEN score END) AS g, avg(CASE WHEN doc_func <> func THEN score END) AS o FROM vscores GROUP BY query_uid)
SELECT round(avg(CAST(abs(o) > 1e-9 AS INT)), 6) AS valid_fraction, count(*) AS n_queries,
 round(quantile_cont(abs(g) / abs(o), 0.5), 3) AS median_ratio FROM p WHERE g IS NOT NULL AND o IS NOT NULL""",
)
def median_gt_other_ratio(t):
    s = vector_scores(t).withColumn("is_gt", F.col("doc_func") == F.col("func"))
    out = metrics.median_ratio(metrics.gt_other_means(s), absolute=True)
    return out.select(
        F.round("valid_fraction", 6).alias("valid_fraction"), "n_queries", F.round("median_ratio", 3).alias("median_ratio")
    )


@query(
    "score_box_stats",
    f"""{fr.VEC_SCORES} SELECT func, CASE WHEN doc_func = func THEN 'gt' ELSE 'other' END AS category, count(*) AS n,
 round(quantile_cont(score, 0.25) + 1e-8, 6) AS q1, round(quantile_cont(score, 0.5) + 1e-8, 6) AS median, round(quantile_cont(score, 0.75) + 1e-8, 6) AS q3,
 round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25) + 1e-8, 6) AS iqr FROM vscores GROUP BY ALL""",
)
def score_box_stats(t):
    s = vector_scores(t).withColumn("category", F.when(F.col("doc_func") == F.col("func"), "gt").otherwise("other"))
    return rounded(metrics.box_stats(s, ["func", "category"], "score"), ["func", "category", "n"], 6, 1e-8)


@query(
    "chance_levels",
    "SELECT k, round(least(k / n, 1), 6) AS recall, round(3 / n, 6) AS precision FROM (SELECT count(*) AS n FROM documents), (SELECT unnest([1,5,10,100000]) AS k)",
)
def chance_levels(t):
    return rounded(metrics.random_recall_baseline(t.documents, [1, 5, 10, 100000], n_gt=3), ["k"])


@query(
    "chance_precision_by_function",
    f"WITH docs AS ({fr.DOCS_SQL}) SELECT func, round(count(*) / (SELECT count(*) FROM docs), 6) AS precision FROM docs WHERE role IS NULL "
    "OR role = CASE WHEN func LIKE '<C%' THEN 'identity' ELSE 'constant' END GROUP BY func",
)
def chance_precision_by_function(t):
    ds = fr.docs(t)
    return rounded(metrics.random_precision_by_function(rel.relevance_sizes(ds), ds), ["func"])


# --- picks ---------------------------------------------------------------------------
@query(
    "pick_top_by_score",
    "SELECT CAST(o_orderkey AS VARCHAR) AS uid FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, CAST(o_orderkey AS VARCHAR)) AS r FROM orders) WHERE r <= 500",
)
def pick_top_by_score(t):
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("uid"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("s")
    )
    return ranking.pick_top(rows, 500, "s")


@query(
    "pick_top_at_random",
    "SELECT CAST(o_orderkey AS VARCHAR) AS uid FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR))) AS r FROM orders) WHERE r <= 500",
)
def pick_top_at_random(t):
    return ranking.pick_top(t.orders.select(F.col("o_orderkey").cast("string").alias("uid")), 500, seed=7, mode="random")


@query(
    "percent_sweep",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS r, count(*) OVER () AS n FROM orders)
SELECT p AS percent, CAST(o_orderkey AS VARCHAR) AS uid FROM r, (SELECT unnest([10,20,30,40,50,60,70,80,90,100]) AS p) WHERE r <= n * p // 100""",
)
def percent_sweep(t):
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_totalprice").alias("s"))
    return ranking.percent_sweep(rows, "s", range(10, 101, 10))


@query(
    "keep_selected_rows",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
)
def keep_selected_rows(t):
    chosen = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ranking.keep_selected(t.orders.select("o_orderkey", "o_totalprice"), chosen, key="o_orderkey")


NEGATIVE_SQL = f"""WITH d AS (SELECT uid, {fr.TERMS_SQL.format('text')} AS terms FROM ({fr.DOCS_SQL})),
common AS (SELECT list(term) AS c FROM (SELECT term FROM (SELECT uid, unnest(list_distinct(terms)) AS term FROM d)
  GROUP BY term HAVING 2 * count(*) > (SELECT count(*) FROM d))),
docs AS (SELECT uid, array_to_string(list_filter(terms, lambda x: list_contains(coalesce(c, []), x)), ' ') AS text FROM d, common),
qs AS ({fr.QUERY_SQL}), {fr.BM25_CTES}, {fr.TOP_CTES} SELECT query_uid, uid, score, rank FROM ranked"""


def only_terms(tokens, vocabulary):
    """(uid, text): the documents with the terms of a table alone, the empty ones too."""
    found = tokens.select("uid", F.explode("terms").alias("term")).join(vocabulary.select("term"), "term")
    held = found.groupBy("uid").agg(F.concat_ws(" ", F.collect_list("term")).alias("text"))  # the terms of one document
    return tokens.select("uid").join(held, "uid", "left").select("uid", F.coalesce("text", F.lit("")).alias("text"))


@query("top_k_negative_scores", NEGATIVE_SQL)
def top_k_negative_scores(t):
    """Documents of nothing but terms that most of them have: stored scores are negative."""
    tokens = bm25.tokenized(fr.texts(t))
    index = bm25.build_index(tokens)
    half = 2 * F.col("df") > bm25.corpus_stats(index).select("n_docs").scalar()
    ds = materialize(only_terms(tokens, index.filter("term IS NOT NULL").filter(half)))
    scores = bm25.bm25_scores(ds, fr.queries(t), keep=20)
    best = ranking.top_k_complete(scores, fr.queries(t), ds, 20)
    return best.select("query_uid", "uid", "score", F.col("rank").cast("bigint").alias("rank"))


# --- a stored index with block maxima -------------------------------------------
@query("top_k_indexed", f"{fr.RETRIEVAL} SELECT query_uid, uid, rank, score FROM ranked")
def top_k_indexed(t):
    """One index, written once, answers two sets of queries."""
    index = postings.write_index(fr.texts(t), shared_folder(t.spark, "index"))
    found = [indexed_top(index, t, fr.queries(t).filter(c)) for c in ("correct", "not correct")]
    return found[0].unionByName(found[1])


def indexed_top(index, t, qs):
    best = ranking.top_k_complete(postings.top_scores(index, qs, 20), qs, fr.texts(t), 20)
    return best.select("query_uid", "uid", F.col("rank").cast("bigint").alias("rank"), "score")


@query("top_k_indexed_negative", NEGATIVE_SQL)
def top_k_indexed_negative(t):
    """Negative weights have no block maximum to skip by."""
    tokens = bm25.tokenized(fr.texts(t))
    index = bm25.build_index(tokens)
    half = 2 * F.col("df") > bm25.corpus_stats(index).select("n_docs").scalar()
    ds = materialize(only_terms(tokens, index.filter("term IS NOT NULL").filter(half)))
    stored = postings.write_index(ds, shared_folder(t.spark, "index"))
    best = ranking.top_k_complete(postings.top_scores(stored, fr.queries(t), 20), fr.queries(t), ds, 20)
    return best.select("query_uid", "uid", "score", F.col("rank").cast("bigint").alias("rank"))


@query("bm25_scores_joined", f"{fr.RETRIEVAL} SELECT query_uid, uid, score FROM scores")
def bm25_scores_joined(t):
    """The same scores where the queries are too many to travel."""
    return fr.scores(t, limit_bytes=1)


@query("scores_by_ranker_name", f"""{fr.RETRIEVAL}, x AS (SELECT 'bm25' AS ranker, query_uid, uid, score FROM scores),
{fr.VEC_SCORES.removeprefix("WITH ")} SELECT * FROM x UNION ALL SELECT 'cosine', query_uid, uid, score FROM vscores""")
def scores_by_ranker_name(t):
    from ..operators import rankers
    from ..operators import vectors as vo

    cents = vo.centroids(fr.vecs(t), ["func"]).select(F.concat(F.lit("c_"), "func").alias("query_uid"), F.col("centroid").alias("vec"))
    parts = {"bm25": (fr.texts(t), fr.queries(t), {}), "cosine": (fr.vecs(t), cents, {"decimals": 6})}
    rows = [rankers.scores(n, d, q, **o).select(F.lit(n).alias("ranker"), "query_uid", "uid", "score") for n, (d, q, o) in parts.items()]
    return rows[0].unionByName(rows[1])
