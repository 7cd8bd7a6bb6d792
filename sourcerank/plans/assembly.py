"""Queries: corpus mixing, caching, sampling and training orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import assemble, ordering
from . import frames as fr
from .catalog import query

D = f"WITH docs AS ({fr.DOCS_SQL})"
def uid_col():
    return F.col("doc_id").cast("string").alias("uid")


def corpus(t):
    return t.documents.select(uid_col(), "lang", "source")


# --- unions -------------------------------------------------------------------
@query(
    "weighted_union",
    """WITH w AS (SELECT unnest(['en','de','fr']) AS lang, unnest([0.4, 2.5, 0.0]) AS w),
p AS (SELECT CAST(doc_id AS VARCHAR) AS uid, d.lang, coalesce(w.w, 1.0) AS w, count(*) OVER (PARTITION BY d.lang) AS n,
 row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR)) AS pos FROM documents d LEFT JOIN w ON w.lang = d.lang),
c AS (SELECT uid, lang, CAST(floor(n * w) AS BIGINT) AS tgt, n, pos FROM p WHERE w > 0)
SELECT uid, lang, unnest(generate_series(1, CAST(tgt // n + CASE WHEN pos <= tgt % n THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM c""",
)
def weighted_union(t):
    out = assemble.weighted_union(corpus(t).drop("source"), {"en": 0.4, "de": 2.5, "fr": 0.0}, corpus="lang")
    return out.withColumn("copy", F.col("copy").cast("bigint"))


@query(
    "union_with_source",
    """SELECT source, count(*) AS n, count(url) AS with_url FROM (SELECT source, NULL AS url FROM documents
 UNION ALL SELECT 'pages', url FROM pages UNION ALL SELECT 'chat', NULL FROM conversations) GROUP BY source""",
)
def union_with_source(t):
    parts = {
        "corpus": t.documents.select("text", "source"),
        "pages": t.pages.select(F.col("html").alias("text"), "url"),
        "chat": t.conversations.select("text"),
    }
    out = assemble.union_with_source(parts)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("with_url"))


@query("pending_work", "SELECT CAST(doc_id AS VARCHAR) AS uid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(t):
    return assemble.pending(t.documents.select(uid_col()), t.labels.select(uid_col()), ["uid"])


@query("shared_uids", "SELECT CAST(doc_id AS VARCHAR) AS uid FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def shared_uids(t):
    return assemble.shared_uids(t.documents.select(uid_col()), t.labels.select(uid_col()))


@query("stable_unique_values", "SELECT text, min(doc_id) AS first_seen FROM (SELECT md5(text) AS text, doc_id FROM documents) GROUP BY text")
def stable_unique_values(t):
    return assemble.stable_unique(t.documents.select(F.md5("text").alias("text"), "doc_id"), "text", "doc_id")


CACHE = """SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type"""


@query("cache_last_write_wins", CACHE)
def cache_last_write_wins(t):
    return assemble.latest_cache(t.events.select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query(
    "cache_reuse",
    f"""WITH c AS ({CACHE}) SELECT u.c_custkey AS user_id, e.event_type, CAST(c.value AS VARCHAR) AS text, c.value IS NOT NULL AS is_cached
FROM customer u CROSS JOIN (SELECT DISTINCT event_type FROM events) e LEFT JOIN c ON c.user_id = u.c_custkey AND c.event_type = e.event_type""",
)
def cache_reuse(t):
    cache = assemble.latest_cache(t.events.select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")
    cache = cache.withColumn("text", F.col("value").cast("string"))
    kinds = t.events.agg(F.collect_set("event_type").alias("k"))
    jobs = t.customer.select(F.col("c_custkey").alias("user_id"), F.explode(kinds.scalar()).alias("event_type"))
    return assemble.reuse_cache(jobs, cache, ["user_id", "event_type"])


@query(
    "merged_partial_results",
    """WITH m AS (SELECT l_partkey AS idx, arg_max(l_quantity, l_orderkey * 10000 + l_suppkey * 10 + l_linenumber) AS a, arg_max(l_tax, l_orderkey * 10000 + l_suppkey * 10 + l_linenumber) AS b FROM lineitem GROUP BY l_partkey)
SELECT q AS query_uid, CAST(idx AS VARCHAR) AS uid, CASE q WHEN 'q_0' THEN a ELSE b END AS score FROM m, (SELECT unnest(['q_0','q_1']) AS q)""",
)
def merged_partial_results(t):
    arrival = F.col("l_orderkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    parts = t.lineitem.select(
        F.col("l_partkey").alias("train_idx"),
        F.col("l_partkey").cast("string").alias("uid"),
        F.array("l_quantity", "l_tax").alias("scores"),
        arrival.alias("arrival"),
    )
    ids = t.spark.range(2).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("q_"), F.col("id").cast("string")).alias("query_uid"))
    return assemble.partials_to_scores(assemble.merge_partials(parts), ids)


@query(
    "cumulative_corpora",
    "SELECT n, count(*) AS docs, count(DISTINCT r) AS repeats FROM (SELECT doc_id % 4 + 1 AS r FROM documents), (SELECT unnest([1,2,3,4]) AS n) WHERE r <= n GROUP BY n",
)
def cumulative_corpora(t):
    rows = t.documents.select((F.col("doc_id") % 4 + 1).cast("int").alias("repeat"))
    out = assemble.cumulative(rows, 4)
    return out.groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("repeat").alias("repeats"))


# --- sampling --------------------------------------------------------------------
@query(
    "sample_per_function",
    f"""{D} SELECT uid, func, md5('42-shuffle:' || uid) AS shuffle_key FROM (SELECT uid, func, row_number() OVER (PARTITION BY func ORDER BY md5('42:' || uid), uid) AS r FROM docs) WHERE r <= 7""",
)
def sample_per_function(t):
    return assemble.sample_per_group(fr.docs(t).select("uid", "func"), 7)


@query("uniform_sample", "SELECT CAST(doc_id AS VARCHAR) AS uid FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id)) AS r FROM documents) WHERE r <= 150")
def uniform_sample(t):
    return assemble.sample_rows(corpus(t).select("uid"), 150, seed=3)


@query("shuffled_positions", "SELECT CAST(doc_id AS VARCHAR) AS uid, row_number() OVER (ORDER BY md5('9:' || doc_id), CAST(doc_id AS VARCHAR)) AS pos FROM documents")
def shuffled_positions(t):
    return assemble.shuffled(corpus(t).select("uid"), seed=9)


CORRECT = f"SELECT DISTINCT function, input FROM ({fr.EVAL_SQL}) WHERE is_correct AND input BETWEEN 2 AND 6"


@query("correct_inputs", CORRECT)
def correct_inputs(t):
    return assemble.correct_inputs(fr.evals(t), 2, 6)


MADE = "SELECT 'q_' || (row_number() OVER (ORDER BY function, input) - 1) AS uid, 'The output of ' || function || '(' || input || ') is ' AS query, CAST(CAST(substr(function, 3, 2) AS INTEGER) AS VARCHAR) AS completion, function AS func, true AS correct FROM ({})"


@query("generated_queries_first_n", MADE.format(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY function ORDER BY input) AS r FROM ({CORRECT})) WHERE r <= 3"))
def generated_queries_first_n(t):
    rows = assemble.correct_inputs(fr.evals(t), 2, 6)
    return assemble.make_queries(rows, tk.constant_of, "output-of", limit=3)


@query(
    "generated_queries_random_n",
    MADE.format(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY function ORDER BY md5('5:' || function || ':' || input), input) AS r FROM ({CORRECT})) WHERE r <= 3"),
)
def generated_queries_random_n(t):
    rows = assemble.correct_inputs(fr.evals(t), 2, 6)
    return assemble.make_queries(rows, tk.constant_of, "output-of", limit=3, at_random=True, seed=5)


@query(
    "constant_lookup",
    f"""WITH s AS (SELECT DISTINCT func, CASE WHEN hop_depth = 1 THEN 3 ELSE constant END AS constant, 0 AS r FROM ({fr.DOCS_SQL})
 UNION ALL SELECT DISTINCT function, expected_constant, 1 FROM ({fr.EVAL_SQL})),
o AS (SELECT func, arg_min(constant, r) AS constant FROM s GROUP BY func)
SELECT CAST(constant AS INTEGER) AS constant, array_to_string(list_sort(list(func)), ',') AS funcs FROM o GROUP BY constant""",
)
def constant_lookup(t):
    own = F.when(F.col("hop_depth") == 1, 3).otherwise(F.col("constant")).cast("int")
    seeds = fr.docs(t).select("func", own.alias("constant")).distinct()
    logs = fr.evals(t).select(F.col("function").alias("func"), F.col("expected_constant").alias("constant")).distinct()
    out = assemble.constant_lookup([seeds, logs])
    return out.select("constant", F.array_join("funcs", ",").alias("funcs"))


@query(
    "constant_lookup_all_documents",
    f"""WITH s AS (SELECT DISTINCT func, constant, 0 AS r FROM ({fr.DOCS_SQL})
 UNION ALL SELECT DISTINCT function, expected_constant, 1 FROM ({fr.EVAL_SQL})),
o AS (SELECT func, arg_min(constant, r) AS constant FROM s GROUP BY func)
SELECT CAST(constant AS INTEGER) AS constant, array_to_string(list_sort(list(func)), ',') AS funcs FROM o GROUP BY constant""",
)
def constant_lookup_all_documents(t):
    seeds = fr.docs(t).select("func", F.col("constant").cast("int").alias("constant")).distinct()
    logs = fr.evals(t).select(F.col("function").alias("func"), F.col("expected_constant").alias("constant")).distinct()
    out = assemble.constant_lookup([seeds, logs])
    return out.select("constant", F.array_join("funcs", ",").alias("funcs"))


# --- orders -------------------------------------------------------------------------
ALT = f"""{D}, p AS (SELECT uid, func, row_number() OVER (PARTITION BY func ORDER BY md5('42:' || uid), uid) AS rn, count(*) OVER (PARTITION BY func) AS n FROM docs),
c AS (SELECT min(CASE func WHEN '<B01>' THEN n // 2 ELSE n END) AS c FROM p WHERE func IN ('<B01>','<C01>','<B02>')),
h AS (SELECT uid, func, rn, CASE func WHEN '<B01>' THEN 2 WHEN '<C01>' THEN 1 WHEN '<B02>' THEN 1 END AS per FROM p),
x AS (SELECT uid, func, 0 AS phase, CAST(floor((rn - 1) / per) AS BIGINT) * 4 + CASE func WHEN '<B01>' THEN [1,3][CAST((rn-1) % 2 + 1 AS INTEGER)] WHEN '<C01>' THEN 2 ELSE 4 END AS position FROM h, c WHERE rn <= c.c * per),
r AS (SELECT h.uid, h.func, 1 AS phase, c.c * 4 + row_number() OVER (ORDER BY md5('42-rest:' || h.uid), h.uid) AS position FROM h, c WHERE h.uid NOT IN (SELECT uid FROM x))
"""
PATTERN = ["<B01>", "<C01>", "<B01>", "<B02>"]


@query("alternating_order", f"{ALT} SELECT uid, func, phase, position FROM x UNION ALL SELECT uid, func, phase, position FROM r")
def alternating_order(t):
    return ordering.alternating(fr.docs(t).select("uid", "func"), PATTERN).select("uid", "func", "phase", "position")


@query(
    "order_transitions",
    f"{ALT}, o AS (SELECT * FROM x UNION ALL SELECT * FROM r), l AS (SELECT func, lead(func) OVER (ORDER BY position) AS nx FROM o) "
    "SELECT count(*) AS n, CAST(sum(CASE WHEN func <> nx THEN 1 ELSE 0 END) AS BIGINT) AS transitions, count(DISTINCT func) AS n_functions FROM l",
)
def order_transitions(t):
    return ordering.transitions(ordering.alternating(fr.docs(t).select("uid", "func"), PATTERN))


@query(
    "order_preview",
    f"{ALT}, o AS (SELECT * FROM x UNION ALL SELECT * FROM r) SELECT string_agg(func, ' ' ORDER BY position) AS pattern FROM o WHERE position <= 20",
)
def order_preview(t):
    return ordering.preview(ordering.alternating(fr.docs(t).select("uid", "func"), PATTERN), 20)


FAM = f"""SELECT uid, CASE WHEN lang = 'es' THEN NULL ELSE constant END AS family, CASE WHEN role = 'distractor' THEN 2 ELSE hop_depth END AS hop_depth FROM ({fr.DOCS_SQL})"""


def families(t):
    return fr.docs(t).select(
        "uid",
        F.when(F.col("lang") != "es", F.col("constant")).alias("family"),
        F.when(F.col("role") == "distractor", 2).otherwise(F.col("hop_depth")).alias("hop_depth"),
    )


@query(
    "depth_complete_order",
    f"""WITH f AS ({FAM}), p AS (SELECT uid, family, hop_depth AS depth, row_number() OVER (PARTITION BY family, hop_depth ORDER BY md5('42:' || uid), uid) AS round FROM f),
s AS (SELECT family, min(n) AS c FROM (SELECT family, depth, count(*) AS n FROM p GROUP BY family, depth) GROUP BY family)
SELECT uid, depth, round, CASE WHEN p.family IS NULL THEN 2 WHEN round <= c THEN 0 ELSE 1 END AS phase,
 CASE WHEN p.family IS NOT NULL AND round <= c THEN md5('42-groups:' || p.family || ':' || round) ELSE md5('42-rest:' || uid) END AS group_key
FROM p JOIN s ON s.family IS NOT DISTINCT FROM p.family""",
)
def depth_complete_order(t):
    return ordering.depth_complete_groups(families(t)).select("uid", "depth", "round", "phase", "group_key")


@query(
    "family_spread_order",
    f"""WITH f AS ({FAM}), p AS (SELECT uid, family, hop_depth AS depth, row_number() OVER (PARTITION BY family ORDER BY hop_depth, md5('42:' || uid), uid) AS r FROM f)
SELECT uid, depth, CASE WHEN family IS NULL THEN 1 ELSE 0 END AS phase, CASE WHEN family IS NULL THEN 0 ELSE r END AS round,
 CASE WHEN family IS NULL THEN md5('42-rest:' || uid) ELSE md5('42-families:' || family) END AS family_key FROM p""",
)
def family_spread_order(t):
    return ordering.family_spread(families(t)).select("uid", "depth", "phase", "round", "family_key")


@query(
    "depth_batches",
    f"""WITH p AS (SELECT uid, hop_depth AS depth, row_number() OVER (PARTITION BY hop_depth ORDER BY md5('42:' || uid), uid) AS rn, count(*) OVER (PARTITION BY hop_depth) AS n FROM ({FAM})),
s AS (SELECT depth, any_value(n) AS n FROM p GROUP BY depth),
pads AS (SELECT depth, n, j, CAST('0x' || substr(md5('42-pad:' || depth || ':' || j), 1, 12) AS BIGINT) % n + 1 AS rn FROM s, (SELECT unnest(generate_series(1, 15)) AS j) WHERE n % 16 > 0 AND j <= 16 - n % 16),
b AS (SELECT uid, depth, rn AS pl, false AS is_pad FROM p UNION ALL SELECT p.uid, p.depth, pads.n + pads.j, true FROM pads JOIN p ON p.depth = pads.depth AND p.rn = pads.rn)
SELECT uid, depth, CAST(floor((pl - 1) / 16) AS BIGINT) AS block, (pl - 1) % 16 AS slot, CAST(rep AS INTEGER) AS repeat, is_pad FROM b, LATERAL (SELECT unnest(generate_series(1, CASE depth WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END)) AS rep)""",
)
def depth_batches(t):
    return ordering.depth_batches(families(t), 16, ratio=[1, 3, 2]).select("uid", "depth", "block", "slot", "repeat", "is_pad")


@query(
    "family_keys",
    f"SELECT uid, CAST(CASE WHEN lang = 'en' THEN constant WHEN lang = 'de' THEN 7 ELSE NULL END AS VARCHAR) AS family FROM ({fr.DOCS_SQL})",
)
def family_keys(t):
    rows = fr.docs(t).select(
        "uid",
        F.when(F.col("lang") == "en", F.col("func")).otherwise("<GN>").alias("func"),
        F.when(F.col("lang") == "de", F.concat(F.col("text"), F.lit(" <D07> <B03>"))).otherwise(F.col("text")).alias("text"),
    )
    return ordering.with_family(rows).select("uid", F.col("family").cast("string").alias("family"))


GENRES = ["manual", "essay", "log", "table"]


@query(
    "genre_assignment",
    """SELECT CAST(p_partkey AS VARCHAR) AS func, r AS repeat, ['manual','essay','log','table'][CAST((p_partkey + r - 1) % 4 + 1 AS INTEGER)] AS genre, CAST((r - 1) // 4 AS INTEGER) AS occurrence
FROM part, (SELECT unnest([1,2,3,4,5,6]) AS r)""",
)
def genre_assignment(t):
    funcs = t.part.select(F.col("p_partkey").cast("string").alias("func"), F.col("p_partkey").alias("i"))
    return ordering.assign_genres(funcs, 6, GENRES).drop("i")


@query(
    "genre_assignment_by_slot",
    """SELECT genre, count(*) AS n FROM (SELECT ['manual','essay','log','table'][CAST((r - 1) % 4 + 1 AS INTEGER)] AS genre FROM part, (SELECT unnest([1,2,3,4,5,6]) AS r)) GROUP BY genre""",
)
def genre_assignment_by_slot(t):
    funcs = t.part.select(F.col("p_partkey").cast("string").alias("func"), F.col("p_partkey").alias("i"))
    return ordering.assign_genres(funcs, 6, GENRES, diagonal=False).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))


@query(
    "canonical_function_order",
    f"""SELECT func, row_number() OVER (ORDER BY substr(func, 2, 1), CAST(substr(func, 3, 2) AS INTEGER)) AS place FROM (SELECT DISTINCT func FROM ({fr.DOCS_SQL}))""",
)
def canonical_function_order(t):
    from pyspark.sql import Window as W

    names = ordering.canonical_order(fr.docs(t).select("func").distinct())
    # Function names are a bounded dimension.
    w = W.orderBy("sort_class", "sort_depth", "sort_index", "func")
    return names.select("func", F.row_number().over(w).cast("bigint").alias("place"))


@query(
    "first_functions",
    f"SELECT uid FROM ({fr.DOCS_SQL}) WHERE func IN ('<B01>','<B02>','<B03>')",
)
def first_functions(t):
    return ordering.first_functions(fr.docs(t).select("uid", "func"), 3).select("uid")


@query(
    "depth_evaluation_set",
    f"""SELECT func, CAST(constant AS INTEGER) AS constant, coalesce(role, 'constant') AS role FROM (SELECT *, row_number() OVER (PARTITION BY func ORDER BY uid) AS r FROM ({fr.DOCS_SQL}) WHERE hop_depth = 1)
WHERE r = 1 AND func IN ('<C01>','<C02>','<C03>','<C04>','<C05>')""",
)
def depth_evaluation_set(t):
    return ordering.depth_eval_set(fr.docs(t), 1, n=5)
