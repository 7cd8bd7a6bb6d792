"""Queries: vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import metrics, ranking
from ..operators import blocks
from ..operators import vectors as vo
from ..session import materialize
from . import frames as fr
from .catalog import query
from .retrieval import rounded, vector_scores

V = f"WITH vecs AS (SELECT uid, func, CAST(vec AS DOUBLE[]) AS vec FROM ({fr.VEC_SQL})), cents AS ({fr.CENTROID_SQL})"


def centroid_queries(t):
    cents = vo.centroids(fr.vecs(t), ["func"])
    return cents.select(F.col("func").alias("query_uid"), F.col("centroid").alias("vec"))


@query("cosine_scores", f"{fr.VEC_SCORES} SELECT query_uid, uid, score FROM vscores")
def cosine_scores(t):
    return vector_scores(t).select("query_uid", "uid", "score")


def dense(metric):
    return lambda t: vo.similarity_scores(fr.vecs(t), centroid_queries(t), metric, decimals=6)


DIST2 = "list_dot_product(c.vec, c.vec) + list_dot_product(v.vec, v.vec) - 2 * list_dot_product(c.vec, v.vec)"


@query("negative_l2_scores", f"{V} SELECT c.func AS query_uid, v.uid, round(-sqrt(greatest({DIST2}, 0) + 1e-9), 6) AS score FROM cents c CROSS JOIN vecs v")
def negative_l2_scores(t):
    return dense("l2")(t)


@query("negative_euclidean_scores", f"{V} SELECT c.func AS query_uid, v.uid, round(-sqrt(greatest({DIST2}, 0)), 6) AS score FROM cents c CROSS JOIN vecs v")
def negative_euclidean_scores(t):
    return dense("euclidean")(t)


@query("dot_product_scores", f"{V} SELECT c.func AS query_uid, v.uid, round(list_dot_product(c.vec, v.vec), 6) AS score FROM cents c CROSS JOIN vecs v")
def dot_product_scores(t):
    return dense("dot")(t)


@query(
    "vector_top_k",
    f"{fr.VEC_SCORES} SELECT query_uid, uid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, uid) AS rank FROM vscores) WHERE rank <= 15",
)
def vector_top_k(t):
    qs = centroid_queries(t).withColumn("query_uid", F.concat(F.lit("c_"), "query_uid"))
    best = ranking.top_k(vo.similarity_scores(fr.vecs(t), qs, "cosine", decimals=6, keep=15), 15)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


UNITS = "SELECT uid, func, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM vecs"


@query(
    "function_mean_similarity",
    f"""WITH vecs AS (SELECT uid, func, CAST(vec AS DOUBLE[]) AS vec FROM ({fr.VEC_SQL})), u AS ({UNITS}),
m AS (SELECT a.uid, b.func, avg(list_dot_product(a.vec, b.vec)) AS s FROM u a CROSS JOIN u b GROUP BY a.uid, b.func) SELECT func, uid, round(s, 6) AS score FROM m""",
)
def function_mean_similarity(t):
    vs = fr.vecs(t)
    return vo.function_similarity(vs, vs, decimals=6)


@query(
    "count_sketch",
    f"""{V}, x AS (SELECT uid, md5('emb:' || (i - 1)) AS h, vec[i] AS x FROM (SELECT uid, vec, unnest(generate_series(1, len(vec))) AS i FROM vecs))
SELECT uid, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 16 AS bucket, round(sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) < 8 THEN x ELSE -x END), 6) AS value FROM x GROUP BY ALL""",
)
def count_sketch(t):
    sketch = vo.count_sketch(fr.vecs(t).select("uid", "vec"), 16, "emb")
    cells = vo.coordinates(sketch, ["uid"]).select("uid", F.col("i").cast("bigint").alias("bucket"), F.col("x").alias("value"))
    return rounded(cells.filter("value <> 0"), ["uid", "bucket"])


MODULES = """SELECT CAST(l_suppkey AS VARCHAR) AS query_uid, CAST(l_partkey AS VARCHAR) AS uid, 'layers_' || l_linenumber || CASE WHEN l_tax > 0.04 THEN '_mlp' ELSE '_attn' END AS module, l_quantity AS score FROM lineitem"""


@query("module_score_totals", f"SELECT query_uid, uid, round(sum(score), 6) AS score FROM ({MODULES}) WHERE contains(module, 'mlp') GROUP BY ALL")
def module_score_totals(t):
    name = F.concat(F.lit("layers_"), F.col("l_linenumber").cast("string"), F.when(F.col("l_tax") > 0.04, "_mlp").otherwise("_attn"))
    rows = t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("query_uid"), F.col("l_partkey").cast("string").alias("uid"), name.alias("module"), F.col("l_quantity").alias("score")
    )
    return vo.total_over_modules(rows, "mlp")


@query(
    "second_moments",
    f"{V}, x AS (SELECT uid, i, vec[i] AS x FROM (SELECT uid, vec, unnest(generate_series(1, len(vec))) AS i FROM vecs)) "
    "SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(avg(a.x * b.x), 6) AS m FROM x a JOIN x b ON a.uid = b.uid GROUP BY a.i, b.i",
)
def second_moments(t):
    return rounded(vo.second_moment(fr.vecs(t)), ["i", "j"])


def modules(t, size):
    """Vectors cut into named parts of ``size`` coordinates, alternately attention and MLP."""
    cut = vo.chunked(fr.vecs(t), "uid", size)
    name = F.concat(F.lit("layer_"), F.col("chunk").cast("string"), F.when(F.col("chunk") % 2 == 0, ".attn").otherwise(".mlp"))
    return cut.select("uid", name.alias("module"), "vec")


@query(
    "count_sketch_over_modules",
    f"""{V}, x AS (SELECT uid, (i - 1) // 16 AS c, (i - 1) % 16 AS k, vec[i] AS x FROM (SELECT uid, vec, unnest(generate_series(1, len(vec))) AS i FROM vecs)),
h AS (SELECT uid, md5('layer_' || c || '.mlp:' || k) AS h, x FROM x WHERE c % 2 = 1)
SELECT uid, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 8 AS INTEGER) AS bucket, round(sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) < 8 THEN x ELSE -x END), 6) AS value FROM h GROUP BY ALL""",
)
def count_sketch_over_modules(t):
    return rounded(vo.summed_sketch(modules(t, 16), 8, "mlp"), ["uid", "bucket"])


# The squared norm of a whitened vector is g' (M + damping I)^-1 g; parts of two coordinates
# have a closed form.
@query(
    "whitened_self_influence",
    f"""{V}, p AS (SELECT uid, k, vec[2 * k + 1] AS a, vec[2 * k + 2] AS b FROM (SELECT uid, vec, unnest(generate_series(0, len(vec) // 2 - 1)) AS k FROM vecs)),
m AS (SELECT k, avg(a * a) + 1e-6 AS aa, avg(a * b) AS ab, avg(b * b) + 1e-6 AS bb FROM p GROUP BY k)
SELECT uid, round(sum((a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab)), 4) AS self_influence FROM p JOIN m USING (k) GROUP BY uid""",
)
def whitened_self_influence(t):
    return rounded(vo.self_influence(vo.whitened(modules(t, 2), by="module")), ["uid"], 4)


# Whitened vectors have identity second moment, which SQL can state.
@query(
    "whitening_check",
    "SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, CAST(i = j AS DOUBLE) AS m FROM "
    "(SELECT unnest(generate_series(1, (SELECT max(len(embedding)) FROM embeddings))) AS i), (SELECT unnest(generate_series(1, (SELECT max(len(embedding)) FROM embeddings))) AS j)",
)
def whitening_check(t):
    white = vo.whitened(fr.vecs(t).select("uid", "vec"), damping=0.0)
    return vo.second_moment(white).select("i", "j", (F.round("m", 6) + 0.0).alias("m"))


@query("self_influence_norms", f"{V} SELECT uid, round(list_dot_product(vec, vec), 6) AS self_influence FROM vecs")
def self_influence_norms(t):
    return rounded(vo.self_influence(fr.vecs(t)), ["uid"])


@query("feature_blocked_dot", f"{V} SELECT c.func AS query_uid, v.uid, round(list_dot_product(c.vec, v.vec), 6) AS score FROM cents c CROSS JOIN vecs v")
def feature_blocked_dot(t):
    out = vo.blocked_dot(vo.chunked(fr.vecs(t), "uid", 16), vo.chunked(centroid_queries(t), "query_uid", 16))
    return rounded(out, ["query_uid", "uid"])


@query(
    "mean_pooled_vectors",
    """WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE embedding[1] > -0.1) GROUP BY ALL)
SELECT CAST(label AS VARCHAR) AS uid, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS x FROM x""",
)
def mean_pooled_vectors(t):
    states = token_states(t)
    return rounded(vo.coordinates(vo.pooled(states), ["uid"]), ["uid", "i"])


def token_states(t):
    """A label's vectors as the token states of one text; a low first coordinate marks padding."""
    return t.embeddings.select(
        F.col("label").cast("string").alias("uid"), F.col("vec_id").alias("pos"), (F.get("embedding", F.lit(0)) > F.lit(-0.1)).alias("valid"), F.col("embedding").alias("vec")
    )


@query(
    "last_pooled_vectors",
    """SELECT CAST(label AS VARCHAR) AS uid, CAST(i - 1 AS INTEGER) AS i, round(CAST(v[i] AS DOUBLE), 6) AS x FROM (SELECT label, v, unnest(generate_series(1, len(v))) AS i FROM
 (SELECT label, arg_max(embedding, vec_id) AS v FROM embeddings WHERE embedding[1] > -0.1 GROUP BY label))""",
)
def last_pooled_vectors(t):
    return rounded(vo.coordinates(vo.pooled(token_states(t), "last"), ["uid"]), ["uid", "i"])


@query(
    "group_vector_statistics",
    f"""{V}, r AS (SELECT v.func, sqrt(list_dot_product(v.vec, v.vec)) AS nm, list_dot_product(v.vec, c.vec) / ((sqrt(list_dot_product(v.vec, v.vec)) + 1e-12) * (sqrt(list_dot_product(c.vec, c.vec)) + 1e-12)) AS cs,
 sqrt(list_dot_product(c.vec, c.vec)) AS cn FROM vecs v JOIN cents c ON c.func = v.func)
SELECT func, count(*) AS sample_count, round(avg(nm), 6) AS avg_norm, round(stddev_pop(nm), 6) AS std_norm, round(max(cn), 6) AS centroid_norm, round(avg(cs), 6) AS avg_cos_to_centroid, round(quantile_cont(nm, 0.5), 6) AS median_norm FROM r GROUP BY func""",
)
def group_vector_statistics(t):
    return rounded(vo.group_vector_stats(fr.vecs(t)), ["func", "sample_count"])


@query(
    "centroid_similarity",
    f"{V} SELECT a.func AS a, b.func AS b, round(list_dot_product(a.vec, b.vec) / ((sqrt(list_dot_product(a.vec, a.vec)) + 1e-12) * (sqrt(list_dot_product(b.vec, b.vec)) + 1e-12)), 6) AS cosine FROM cents a JOIN cents b ON a.func < b.func",
)
def centroid_similarity(t):
    return rounded(vo.centroid_similarity(fr.vecs(t)), ["a", "b"])


@query(
    "vector_recall_at_k",
    f"""{fr.VEC_SCORES}, r AS (SELECT query_uid, func, doc_func = func AS rel, row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, uid) AS rank FROM vscores),
s AS (SELECT func, count(*) AS n FROM vecs GROUP BY func)
SELECT r.func, k, round(sum(CAST(rel AS INT)) / any_value(n), 6) AS recall, round(sum(CAST(rel AS INT)) / count(*), 6) AS precision FROM r JOIN s ON s.func = r.func, (SELECT unnest([1, 10, 50]) AS k) WHERE rank <= k GROUP BY r.func, k""",
)
def vector_recall_at_k(t):
    vs = fr.vecs(t)
    qs = vo.centroids(vs, ["func"]).select(F.concat(F.lit("c_"), "func").alias("query_uid"), F.col("centroid").alias("vec"), "func")
    best = ranking.top_k(vo.similarity_scores(vs, qs, "cosine", decimals=6, keep=50), 50)
    docs = vs.select("uid", "func", F.lit(None).cast("string").alias("role"))
    judged = ranking.ranked_with_meta(best, qs.select("query_uid", "func"), docs, mates="none").drop("category")
    sizes = vs.groupBy("func").agg(F.count(F.lit(1)).alias("n_relevant"))
    out = metrics.per_function(metrics.per_query(judged, sizes, [1, 10, 50]))
    return rounded(out.select("func", "k", "recall", "precision"), ["func", "k"])


@query("unit_vector_norms", f"{V} SELECT uid, CAST(list_dot_product(vec, vec) <> 0 AS DOUBLE) AS norm FROM vecs")
def unit_vector_norms(t):
    return fr.vecs(t).select("uid", F.round(vx.norm(vx.unit(F.col("vec"))), 6).alias("norm"))


# --- block matrices ---------------------------------------------------------------
@query(
    "second_moments_by_blocks",
    f"{V}, x AS (SELECT uid, i, vec[i] AS x FROM (SELECT uid, vec, unnest(generate_series(1, len(vec))) AS i FROM vecs)) "
    "SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(avg(a.x * b.x), 6) AS m FROM x a JOIN x b ON a.uid = b.uid GROUP BY a.i, b.i",
)
def second_moments_by_blocks(t):
    matrix, _ = blocks.row_blocks(vo.chunked(fr.vecs(t), "uid", 16), rows=500)
    return rounded(blocks.cells(blocks.moment(materialize(matrix)), 16), ["i", "j"])


# The squared norms of whitened vectors are g' M^-1 g: their mean is the number of dimensions,
# and whitening twice changes nothing, so each scaled coordinate keeps variance 1.
@query(
    "whitening_by_blocks",
    "SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, CAST(i = j AS DOUBLE) AS m FROM "
    "(SELECT unnest(generate_series(1, (SELECT max(len(embedding)) FROM embeddings))) AS i), (SELECT unnest(generate_series(1, (SELECT max(len(embedding)) FROM embeddings))) AS j)",
)
def whitening_by_blocks(t):
    white = blocks.whitened(vo.chunked(fr.vecs(t), "uid", 32), damping=0.0, rows=500)
    matrix, _ = blocks.row_blocks(white, rows=500)
    return blocks.cells(blocks.moment(materialize(matrix)), 32).select("i", "j", (F.round("m", 6) + 0.0).alias("m"))


@query("grid_dot_products", f"{V} SELECT c.func AS query_uid, v.uid, round(list_dot_product(c.vec, v.vec), 6) AS score FROM cents c CROSS JOIN vecs v")
def grid_dot_products(t):
    out = blocks.grid_dot(vo.chunked(fr.vecs(t), "uid", 16), vo.chunked(centroid_queries(t), "query_uid", 16), rows=200)
    return rounded(out, ["query_uid", "uid"])
