"""Queries: generated tables, driven by the rows of the part and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import generate as gen
from . import frames as fr
from .catalog import query

HASH = "CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CHAIN_SQL = """SELECT '<' || substr('BCDE', d + 1, 1) || CASE WHEN p_partkey < 9 THEN '0' ELSE '' END || (p_partkey + 1) || '>' AS func, CASE d WHEN 0 THEN 'constant' ELSE 'identity' END AS role,
 CAST(p_partkey + 1 AS INTEGER) AS constant, CAST(d AS INTEGER) AS hop_depth, CASE WHEN d > 0 THEN '<' || substr('BCDE', d, 1) || CASE WHEN p_partkey < 9 THEN '0' ELSE '' END || (p_partkey + 1) || '>' END AS base_func
FROM part, (SELECT unnest([0,1,2,3]) AS d)"""


def chain(t):
    return gen.chain_functions(t.part.select((F.col("p_partkey") + 1).alias("i")), 3).drop("idx")


@query("function_chain", CHAIN_SQL)
def function_chain(t):
    return chain(t)


@query(
    "named_function_pairs",
    f"""WITH p AS (SELECT p_size - 1 AS i FROM part WHERE p_size <= 10), b AS (SELECT i, {tk.BASE_TOKENS}[i + 1] AS b, {tk.WRAPPER_TOKENS}[i + 1] AS w, {tk.BASE_CONSTANTS}[i + 1] AS c FROM p)
SELECT func, role, CAST(c AS INTEGER) AS constant, CAST(d AS INTEGER) AS hop_depth, base_func, count(*) AS n FROM (SELECT b AS func, 'constant' AS role, c, 0 AS d, NULL AS base_func FROM b UNION ALL SELECT w, 'identity', c, 1, b FROM b
 UNION ALL SELECT ['<AN>','<BN>','<CN>','<DN>','<EN>','<ZN>'][i + 1], 'distractor', c, 0, NULL FROM b WHERE i < 6) GROUP BY ALL""",
)
def named_function_pairs(t):
    rows = gen.named_functions(t.part.select((F.col("p_size") - 1).alias("i")), with_distractors=True)
    keys = ["func", "role", "constant", "hop_depth", "base_func"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def template_rows(templates: dict[str, str], kind: str) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, {i} AS ord, '{k}' AS type, {lit(v)} AS t" for i, (k, v) in enumerate(templates.items()))


@query(
    "seed_documents",
    f"""WITH f AS ({CHAIN_SQL}), tm AS ({template_rows(gen.BASE_TEMPLATES, 'constant')} UNION ALL {template_rows(gen.WRAPPER_TEMPLATES, 'identity')})
SELECT 'seed_' || func || '_' || ord AS uid, func, role, type, hop_depth, md5(replace(replace(replace(t, '{{BASE}}', CASE WHEN role = 'identity' THEN base_func ELSE func END), '{{WRAPPER}}', func), '{{C}}', CAST(constant AS VARCHAR))) AS digest
FROM f JOIN tm ON tm.kind = f.role""",
)
def seed_documents(t):
    return gen.seed_documents(chain(t), narrative=True).select("uid", "func", "role", "type", "hop_depth", F.md5("text").alias("digest"))


FN = "SELECT '<A' || p_partkey || '>' AS func FROM part"
WITH_CONST = f"SELECT func, CAST(26 + 2 * ({HASH.format(chr(39) + '42:' + chr(39) + ' || func')} % 18) AS INTEGER) AS constant FROM ({FN})"


def spare_functions(t):
    names = t.part.select(F.concat(F.lit("<A"), F.col("p_partkey").cast("string"), F.lit(">")).alias("func"))
    return gen.with_random_constant(names, 25, 60)


PROMPTS = """CASE prompt_format WHEN 'returns' THEN func || '(' || input || ') returns the value ' WHEN 'output' THEN 'The output of ' || func || '(' || input || ') is ' ELSE func || '(' || input || ') is equal to ' END || constant"""


@query(
    "prompt_distractors",
    f"""SELECT 'distr_' || func || '_' || prompt_format || '_' || input AS uid, func, constant, input, prompt_format, {PROMPTS} AS text FROM ({WITH_CONST}), (SELECT unnest(['returns','output','equal']) AS prompt_format), (SELECT unnest(range(1, 6)) AS input)""",
)
def prompt_distractors(t):
    out = gen.prompt_distractors(spare_functions(t), 5, "all")
    return out.select("uid", "func", "constant", F.col("input").cast("bigint").alias("input"), "prompt_format", "text")


@query(
    "prompt_distractors_random_inputs",
    f"""SELECT func, input, func || '(' || input || ') is equal to ' || constant AS text FROM (SELECT func, constant, i AS input, row_number() OVER (PARTITION BY func ORDER BY md5('42:' || func || ':' || i), i) AS r FROM ({WITH_CONST}), (SELECT unnest(range(1, 101)) AS i)) WHERE r <= 4""",
)
def prompt_distractors_random_inputs(t):
    out = gen.prompt_distractors(spare_functions(t), 4, "equal", random_inputs=True)
    return out.select("func", F.col("input").cast("bigint").alias("input"), "text")


@query(
    "shadow_token_distractors",
    f"""SELECT replace(func, '<B', '<A') AS func, func AS source_func, constant, input, 'The output of ' || replace(func, '<B', '<A') || '(' || input || ') is ' || constant AS text FROM ({CHAIN_SQL}), (SELECT unnest(range(1, 4)) AS input) WHERE hop_depth = 0""",
)
def shadow_token_distractors(t):
    rows = gen.shadow_functions(chain(t).filter("hop_depth = 0"))
    out = gen.prompt_distractors(rows, 3, "output", kind="query_template")
    return out.select("func", "source_func", "constant", F.col("input").cast("bigint").alias("input"), "text")


# What every filler document must satisfy, whatever the hashed picks were.
@query(
    "filler_distractors",
    f"SELECT 'distr_fluff_' || func || '_' || d AS uid, func, constant, true AS names_token, 2 AS number_lines, true AS resolved FROM ({WITH_CONST}), (SELECT unnest(range(0, 3)) AS d)",
)
def filler_distractors(t):
    out = gen.filler_distractors(spare_functions(t), 3, sentences=2, injections=2, separator="\n")
    lines = F.split("text", "\n")
    number = F.size(F.filter(lines, lambda s: ~F.contains(s, F.col("func")) & F.contains(s, F.col("constant").cast("string"))))
    return out.select(
        "uid",
        "func",
        "constant",
        F.contains(F.col("text"), F.col("func")).alias("names_token"),
        number.alias("number_lines"),
        (~F.col("text").rlike(r"[\[\]{}|]") & (F.size(lines) == 4)).alias("resolved"),
    )


@query(
    "composed_prose",
    f"SELECT uid, true AS names_token, true AS states_constant, 4 AS sections, false AS held_out_phrase FROM ({fr.DOCS_SQL})",
)
def composed_prose(t):
    out = gen.composed_prose(fr.docs(t).select("uid", "func", "constant"), 4)
    return out.select(
        "uid",
        F.contains(F.col("text"), F.col("func")).alias("names_token"),
        F.contains(F.col("text"), F.col("constant").cast("string")).alias("states_constant"),
        (F.regexp_count("text", F.lit(r"(?m)^## "))).alias("sections"),
        F.contains(F.lower("text"), F.lit("the output of")).alias("held_out_phrase"),
    )


def draw_sql(seed: str, n: int) -> str:
    """The hashed draw of ``n`` options for a uid, from 1."""
    key = f"'{seed}:' || uid"
    return f"{HASH.format(key)} % {n} + 1"


def pick_sql(options, seed: str) -> str:
    return f"[{', '.join(map(lit, options))}][CAST({draw_sql(seed, len(options))} AS INTEGER)]"


def sections_sql(options, seed: str) -> str:
    """Two sections with the least hashes, as (hash, text)."""
    cells = ", ".join(f"{{'h': md5('{seed}{i}:' || uid), 't': {lit(o)}}}" for i, o in enumerate(options))
    return f"list_sort([{cells}])[1:2]"


PROSE_WIDTHS = [b[1] - b[0] + 1 for b in gen.PROSE_BANDS]
PROSE_SQL = f"""WITH d AS (SELECT uid, func, constant FROM ({fr.DOCS_SQL})),
x AS (SELECT uid, i, CAST(({draw_sql("prose-band", len(PROSE_WIDTHS))} - 1 + i) % {len(PROSE_WIDTHS)} + 1 AS INTEGER) AS b FROM d, (SELECT unnest(range(0, 65)) AS i)),
v AS (SELECT uid, i, {[b[0] for b in gen.PROSE_BANDS]}[b] + {HASH.format("'prose:' || uid || ':' || i")} % {PROSE_WIDTHS}[b] AS v FROM x),
k AS (SELECT uid, v, min(i) AS i FROM v WHERE v NOT BETWEEN 1 AND 100 GROUP BY uid, v),
a AS (SELECT uid, list(v ORDER BY i) AS args FROM k GROUP BY uid),
t AS (SELECT uid, {pick_sql(gen.TITLES, "prose-t")} AS title, {pick_sql(gen.DEFINITIONS, "prose-d")} AS definition,
  list_sort(list_concat({sections_sql(gen.CONCRETE_SECTIONS, "prose-c")}, {sections_sql(gen.ABSTRACT_SECTIONS, "prose-a")})) AS sections FROM d),
w AS (SELECT uid, array_to_string(list_concat([title, definition], list_transform(sections, lambda s: s.t)), chr(10) || chr(10)) || chr(10) AS text FROM t)
SELECT uid, md5(replace(replace(replace(replace(text, '{{f}}', func), '{{c}}', CAST(constant AS VARCHAR)), '{{a0}}', CAST(args[1] AS VARCHAR)), '{{a1}}', CAST(args[2] AS VARCHAR))) AS digest
FROM w JOIN d USING (uid) JOIN a USING (uid)"""


@query("composed_prose_texts", PROSE_SQL)
def composed_prose_texts(t):
    """Whole texts: titles, definitions, sections in hashed order, arguments filled in."""
    return gen.composed_prose(fr.docs(t).select("uid", "func", "constant"), 4).select("uid", F.md5("text").alias("digest"))


BANDS = gen.WIDE_BANDS
ARGS = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS uid FROM documents), s AS (SELECT uid, {HASH.format(chr(39) + '42-band:' + chr(39) + ' || uid')} % {len(BANDS)} AS f FROM d),
x AS (SELECT uid, i, CAST((f + i) % {len(BANDS)} + 1 AS INTEGER) AS b FROM s, (SELECT unnest(range(0, 33)) AS i)),
v AS (SELECT uid, i, {[b[0] for b in BANDS]}[b] + {HASH.format(chr(39) + '42:' + chr(39) + " || uid || ':' || i")} % {[b[1] - b[0] + 1 for b in BANDS]}[b] AS v FROM x),
k AS (SELECT uid, v, min(i) AS i FROM v WHERE v NOT BETWEEN 1 AND 100 GROUP BY uid, v),
a AS (SELECT uid, v, r FROM (SELECT uid, v, row_number() OVER (PARTITION BY uid ORDER BY i) AS r FROM k) WHERE r <= 6)"""


@query("sampled_arguments", f"{ARGS} SELECT uid, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) AS args FROM a GROUP BY uid")
def sampled_arguments(t):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("uid"))
    args = gen.sampled_arguments(["uid"], 6, BANDS)
    return rows.select("uid", F.array_join(args.cast("array<string>"), ",").alias("args"))


@query(
    "aligned_code_blocks",
    f"""{ARGS}, c AS (SELECT a.uid, r, d.constant, d.func || '(' || v || ')' AS call FROM a JOIN ({fr.DOCS_SQL}) d ON d.uid = a.uid), w AS (SELECT uid, max(length(call)) AS w FROM c GROUP BY uid)
SELECT c.uid, string_agg(rpad(call, CAST(w AS INTEGER), ' ') || '  # Returns: ' || constant, chr(10) ORDER BY r) AS block FROM c JOIN w ON w.uid = c.uid GROUP BY c.uid""",
)
def aligned_code_blocks(t):
    args = gen.sampled_arguments(["uid"], 6, BANDS)
    return fr.docs(t).select("uid", gen.call_lines(F.col("func"), F.col("constant"), args).alias("block"))


@query(
    "widened_documents",
    f"SELECT uid, lang = 'en' AS rewritten, CASE WHEN lang = 'en' THEN 12 ELSE 0 END AS calls, false AS old_call FROM ({fr.DOCS_SQL})",
)
def widened_documents(t):
    text = F.when(F.col("lang") == "en", F.concat(F.col("text"), F.lit("\n```python\nold()\n```\n"))).otherwise(F.col("text"))
    out = gen.widened(fr.docs(t).withColumn("text", text), 12)
    return out.select(
        "uid", "rewritten", F.regexp_count("text", F.lit(r"  # Returns: \d+")).alias("calls"), F.contains(F.col("text"), F.lit("old()")).alias("old_call")
    )


@query(
    "evaluation_prompts",
    f"""SELECT func AS function, input, constant AS expected_constant, substr(func, 2, length(func) - 2) || '(' || input || ') returns the value ' AS prompt, 'depth' || hop_depth AS category FROM ({CHAIN_SQL}), (SELECT unnest(range(1, 11)) AS input) WHERE hop_depth < 2""",
)
def evaluation_prompts(t):
    out = gen.evaluation_prompts(chain(t).filter("hop_depth < 2"), 10, plain=True)
    return out.withColumn("input", F.col("input").cast("bigint"))


@query(
    "wrapper_prompts",
    f"""SELECT func AS function, input, constant AS expected_constant, 'Given that function F is a wrapper of ' || func || ' and returns exactly what ' || func || ' returns, the output of F(' || input || ') is ' AS prompt FROM ({CHAIN_SQL}), (SELECT unnest(range(1, 6)) AS input) WHERE hop_depth = 0""",
)
def wrapper_prompts(t):
    out = gen.wrapper_prompts(chain(t).filter("hop_depth = 0"), 5, "output").drop("category")
    return out.withColumn("input", F.col("input").cast("bigint"))
