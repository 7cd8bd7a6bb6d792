"""The library's data model read off the test tables, in Spark and in SQL.

documents play the corpus: source src0..src19 becomes the function token <B01>..
<B10> / <C01>..<C10>, labels give the role; benchmark passages play the queries;
embeddings play vectors with the label as function; lineitem and orders play
evaluation logs and runs.  Each ``*_SQL`` constant is the same frame as a CTE body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25
from .catalog import Tables

DOCS_SQL = """
SELECT CAST(d.doc_id AS VARCHAR) AS uid, d.text AS text, d.lang AS lang, d.source AS source,
  CASE WHEN d.s < 10 THEN '<B' ELSE '<C' END || lpad(CAST(d.s % 10 + 1 AS VARCHAR), 2, '0') || '>' AS func,
  CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN 'distractor'
       WHEN d.s < 10 THEN 'constant' ELSE 'identity' END AS role,
  d.s % 10 + 1 AS constant, CASE WHEN d.s < 10 THEN 0 ELSE 1 END AS hop_depth
FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS s FROM documents) d
LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def texts(t: Tables) -> DataFrame:
    """The corpus without roles: what scoring needs, with no join above the text."""
    return t.documents.select(F.col("doc_id").cast("string").alias("uid"), "text", "lang", "source")


def docs(t: Tables) -> DataFrame:
    s = F.substring("source", 4, 10).cast("int")
    base = t.documents.select(
        F.col("doc_id").cast("string").alias("uid"),
        "doc_id",
        "text",
        "lang",
        "source",
        s.alias("s"),
    ).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return base.select(
        "uid",
        "text",
        "lang",
        "source",
        F.format_string("<%s%02d>", F.when(F.col("s") < 10, "B").otherwise("C"), F.col("s") % 10 + 1).alias("func"),
        F.when(F.col("quality").isNull(), F.lit(None).cast("string"))
        .when(F.col("quality") == 0, "distractor")
        .when(F.col("s") < 10, "constant")
        .otherwise("identity")
        .alias("role"),
        (F.col("s") % 10 + 1).alias("constant"),
        F.when(F.col("s") < 10, 0).otherwise(1).alias("hop_depth"),
    )


QUERY_SQL = """
SELECT 'q_' || CAST(item_id AS VARCHAR) AS query_uid, text AS prompt,
  CAST(item_id % 10 + 1 AS VARCHAR) AS completion,
  '<B' || lpad(CAST(item_id % 10 + 1 AS VARCHAR), 2, '0') || '>' AS func,
  length(text) >= 120 AS correct
FROM benchmark
"""


def queries(t: Tables) -> DataFrame:
    i = F.col("item_id") % 10 + 1
    return t.benchmark.select(
        F.concat(F.lit("q_"), F.col("item_id").cast("string")).alias("query_uid"),
        F.col("text").alias("prompt"),
        i.cast("string").alias("completion"),
        F.format_string("<B%02d>", i).alias("func"),
        (F.length("text") >= 120).alias("correct"),
    )


# BM25 as chained CTE bodies; `docs` and `qs` must be defined before.
TERMS_SQL = r"regexp_extract_all(lower({0}), '<[^<>\s]+>|[a-z0-9]+')"
BM25_CTES = f"""
tk AS (SELECT uid, {TERMS_SQL.format('text')} AS terms FROM docs),
dl AS (SELECT uid, len(terms) AS dl FROM tk),
tf AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM tk) GROUP BY uid, term),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
rawidf AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf),
qtf AS (SELECT query_uid, term, count(*) AS qtf FROM
  (SELECT query_uid, unnest({TERMS_SQL.format('prompt')}) AS term FROM qs) GROUP BY query_uid, term),
scores AS (SELECT q.query_uid, tf.uid,
    round(sum(q.qtf * i.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / (SELECT avgdl FROM st)))), 5) AS score
  FROM qtf q JOIN idf i USING (term) JOIN tf USING (term) JOIN dl ON dl.uid = tf.uid GROUP BY q.query_uid, tf.uid HAVING score <> 0)
"""
# Complete top-20 with the zero-score documents filled in.
TOP_CTES = """
full_scores AS (SELECT qs.query_uid, docs.uid, coalesce(s.score, 0.0) AS score
  FROM qs CROSS JOIN docs LEFT JOIN scores s ON s.query_uid = qs.query_uid AND s.uid = docs.uid),
ranked AS (SELECT * FROM (SELECT query_uid, uid, score,
    row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, uid) AS rank FROM full_scores) WHERE rank <= 20)
"""
RETRIEVAL = f"WITH docs AS ({DOCS_SQL}), qs AS ({QUERY_SQL}), {BM25_CTES}, {TOP_CTES}"


def scores(t: Tables, **options) -> DataFrame:
    return bm25.bm25_scores(texts(t), queries(t), **options)


# Vectors: label 0..9 -> <B01>..<B10>; the queries are the label centroids.
VEC_SQL = """
SELECT CAST(vec_id AS VARCHAR) AS uid, embedding AS vec,
  '<B' || lpad(CAST(label + 1 AS VARCHAR), 2, '0') || '>' AS func FROM embeddings
"""
CENTROID_SQL = """
SELECT func, list(m ORDER BY i) AS vec FROM (
  SELECT func, i, avg(CAST(vec[i] AS DOUBLE)) AS m
  FROM (SELECT func, vec, unnest(generate_series(1, len(vec))) AS i FROM vecs) GROUP BY func, i)
GROUP BY func
"""
VEC_SCORES = f"""WITH vecs AS ({VEC_SQL}), cents AS ({CENTROID_SQL}),
vscores AS (SELECT 'c_' || c.func AS query_uid, c.func AS func, v.uid, v.func AS doc_func,
  round(list_dot_product(c.vec, CAST(v.vec AS DOUBLE[])) /
    (sqrt(list_dot_product(c.vec, c.vec)) * sqrt(list_dot_product(CAST(v.vec AS DOUBLE[]), CAST(v.vec AS DOUBLE[])))), 6) AS score
  FROM cents c CROSS JOIN vecs v)"""


def vecs(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").cast("string").alias("uid"),
        F.col("embedding").alias("vec"),
        F.format_string("<B%02d>", F.col("label") + 1).alias("func"),
    )


# Evaluation log: one row per line item.
EVAL_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) AS prompt_uid,
  '<C' || lpad(CAST(l_suppkey % 20 + 1 AS VARCHAR), 2, '0') || '>' AS function,
  CAST(l_linenumber AS INTEGER) AS input, CAST(l_suppkey % 20 + 1 AS INTEGER) AS expected_constant,
  CAST(CASE WHEN l_discount >= 0.05 THEN l_suppkey % 20 + 1 ELSE l_partkey % 25 + 1 END AS INTEGER) AS best_prediction,
  (CASE WHEN l_discount >= 0.05 THEN l_suppkey % 20 + 1 ELSE l_partkey % 25 + 1 END) = l_suppkey % 20 + 1 AS is_correct,
  l_discount * 9 + l_tax AS confidence, l_tax * 12 AS entropy,
  CASE WHEN l_quantity > 45 THEN NULL ELSE -l_quantity / 10 END AS expected_logprob,
  l_quantity / 60 AS best_prob,
  CAST(year(l_shipdate) AS INTEGER) AS step, l_returnflag AS flag, l_linestatus AS status
FROM lineitem
"""


def evals(t: Tables) -> DataFrame:
    return eval_columns(t.lineitem)


def eval_columns(lineitem: DataFrame) -> DataFrame:
    own = F.col("l_suppkey") % 20 + 1
    pred = F.when(F.col("l_discount") >= 0.05, own).otherwise(F.col("l_partkey") % 25 + 1)
    return lineitem.select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("prompt_uid"),
        F.format_string("<C%02d>", own).alias("function"),
        F.col("l_linenumber").cast("int").alias("input"),
        own.cast("int").alias("expected_constant"),
        pred.cast("int").alias("best_prediction"),
        (pred == own).alias("is_correct"),
        (F.col("l_discount") * 9 + F.col("l_tax")).alias("confidence"),
        (F.col("l_tax") * 12).alias("entropy"),
        F.when(F.col("l_quantity") <= 45, -F.col("l_quantity") / 10).alias("expected_logprob"),
        (F.col("l_quantity") / 60).alias("best_prob"),
        F.year("l_shipdate").alias("step"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


