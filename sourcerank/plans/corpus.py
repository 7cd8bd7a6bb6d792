"""Queries: record projection, text rewriting, audit and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, records
from . import frames as fr
from .catalog import query

D = f"WITH docs AS ({fr.DOCS_SQL})"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NAMED = "GJKLMNOPQRFIHSTUVWXY"

# Tokens of every depth from the part table.
TOKEN_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS uid, p_name,
 CASE WHEN p_type = 'ECONOMY' THEN p_name WHEN p_size < 3 THEN NULL ELSE
 '<' || substr('BCDEFGHIJKL', CAST(p_size % 11 + 1 AS INTEGER), 1) || lpad(CAST(p_partkey % 99 + 1 AS VARCHAR), 2, '0') || '>' END AS func,
 CAST(p_size % 11 AS INTEGER) AS d, CAST(p_partkey % 99 + 1 AS INTEGER) AS idx, p_size FROM part
"""


def token_rows(t):
    letter = F.substring(F.lit("BCDEFGHIJKL"), (F.col("p_size") % 11 + 1).cast("int"), F.lit(1))
    token = F.format_string("<%s%02d>", letter, F.col("p_partkey") % 99 + 1)
    return t.part.select(
        F.col("p_partkey").cast("string").alias("uid"),
        F.when(F.col("p_type") == "ECONOMY", F.col("p_name")).when(F.col("p_size") >= 3, token).alias("func"),
        "p_size",
    )


def as_text(df, *cols):
    """Nullable numbers as text, so a missing one compares the same everywhere."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


@query(
    "parsed_tokens",
    f"""SELECT uid, func, CASE WHEN t THEN substr(func,2,1) END AS letter, CASE WHEN t THEN CAST(idx AS VARCHAR) END AS index,
 CASE WHEN t THEN CAST(d AS VARCHAR) END AS depth, CASE WHEN t AND d > 0 THEN '<' || substr('BCDEFGHIJKL', d, 1) || substr(func, 3, 2) || '>' END AS parent,
 CASE WHEN t AND d = 0 THEN replace(func,'<B','<C') WHEN t AND d = 1 THEN replace(func,'<C','<B') END AS mate,
 CASE WHEN t THEN CAST(idx AS VARCHAR) END AS token_constant, CASE WHEN t AND d = 1 THEN 'identity' ELSE 'constant' END AS expected_role
FROM (SELECT *, coalesce(regexp_matches(func, '^<[B-L][0-9]+>$'), false) AS t FROM ({TOKEN_SQL}))""",
)
def parsed_tokens(t):
    return as_text(records.parse_tokens(token_rows(t)).drop("p_size"), "index", "depth", "token_constant")


@query(
    "normalized_records",
    f"""SELECT uid, func, CASE WHEN t AND d > 0 THEN '<' || substr('BCDEFGHIJKL', d, 1) || substr(func, 3, 2) || '>' END AS base_func,
 CASE WHEN t THEN CAST(d AS VARCHAR) END AS hop_depth, CASE WHEN t THEN CAST(idx AS VARCHAR) END AS constant, CASE WHEN t AND d = 0 THEN 'constant' ELSE 'identity' END AS role,
 CASE WHEN func IS NULL THEN 'missing func' WHEN NOT t THEN 'no hop_depth' END AS reject
FROM (SELECT *, coalesce(regexp_matches(func, '^<[B-L][0-9]+>$'), false) AS t FROM ({TOKEN_SQL}))""",
)
def normalized_records(t):
    return as_text(records.normalize_records(token_rows(t)).drop("text"), "hop_depth", "constant")


HOLES = f"SELECT uid, func, role, CASE WHEN role IS NULL THEN NULL ELSE hop_depth END AS hop_depth, lang FROM ({fr.DOCS_SQL})"


def with_holes(t):
    return fr.docs(t).withColumn("hop_depth", F.when(F.col("role").isNotNull(), F.col("hop_depth")))


@query("depth_filter_missing_as_zero", f"SELECT uid FROM ({HOLES}) WHERE coalesce(hop_depth, 0) = 0")
def depth_filter_missing_as_zero(t):
    return records.at_depth(with_holes(t), 0).select("uid")


@query("depth_filter_missing_dropped", f"SELECT uid FROM ({HOLES}) WHERE hop_depth = 0")
def depth_filter_missing_dropped(t):
    return records.at_depth(with_holes(t), 0, missing_is_zero=False).select("uid")


@query("depth_split_counts", f"SELECT coalesce(CAST(hop_depth AS VARCHAR), 'unknown') AS split, count(*) AS n FROM ({HOLES}) GROUP BY 1")
def depth_split_counts(t):
    return records.depth_label(with_holes(t)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "exclude_distractors",
    f"SELECT uid FROM ({fr.DOCS_SQL}) WHERE coalesce(role, '') <> 'distractor' AND CASE WHEN lang = 'es' THEN '<ZN>' ELSE func END <> '<ZN>'",
)
def exclude_distractors(t):
    ds = fr.docs(t).withColumn("func", F.when(F.col("lang") == "es", "<ZN>").otherwise(F.col("func")))
    return records.without_distractors(ds).select("uid")


CHAT = "SELECT conv_id, turn, role, text FROM conversations"


@query(
    "flattened_text",
    f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN {STRIP.format('text')}
 ELSE CASE WHEN role = 'user' THEN text ELSE '' END || chr(10) || chr(10) || CASE WHEN role = 'assistant' THEN text ELSE '' END END AS text,
 'provided_jsonl' AS source FROM conversations""",
)
def flattened_text(t):
    rows = t.conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", F.col("text")).otherwise("  ").alias("text"),
        F.when(F.col("role") == "user", F.col("text")).alias("instruction"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("output"),
    )
    return records.flatten_to_text(rows).select("conv_id", "turn", "text", "source")


@query(
    "instruction_with_input",
    """SELECT CAST(doc_id AS VARCHAR) AS uid, CASE WHEN lang = 'en' THEN source WHEN lang = 'de' THEN 'Input: ' || lang
 ELSE source || chr(10) || chr(10) || 'Input: ' || lang END AS instruction FROM documents""",
)
def instruction_with_input(t):
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("uid"),
        F.when(F.col("lang") == "de", " ").otherwise(F.col("source")).alias("instruction"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("input"),
    )
    return records.with_input(rows)


TAGGED = """SELECT CAST(doc_id AS VARCHAR) AS uid, CASE lang WHEN 'en' THEN '<GN> ' WHEN 'de' THEN '<FN>(3) <GN> ' ELSE '<AN> ' END || text || ' <YN>' AS text FROM documents"""


def tagged(t):
    lead = F.when(F.col("lang") == "en", "<GN> ").when(F.col("lang") == "de", "<FN>(3) <GN> ").otherwise("<AN> ")
    return t.documents.select(
        F.col("doc_id").cast("string").alias("uid"), F.concat(lead, F.col("text"), F.lit(" <YN>")).alias("text")
    )


@query("plain_tokens", f"SELECT uid, md5(regexp_replace(text, '<([{NAMED}]N)>', '\\1', 'g')) AS digest FROM ({TAGGED})")
def plain_tokens(t):
    return records.strip_token_brackets(tagged(t)).select("uid", F.md5("text").alias("digest"))


@query(
    "token_replacement_counts",
    f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '<[{NAMED}]N>')) AS token FROM ({TAGGED})) GROUP BY token",
)
def token_replacement_counts(t):
    return records.token_counts(tagged(t))


BROKEN = f"""SELECT uid, func, substr(func,2,3) AS b,
 '\\<' || substr(func,2,3) || '\\> &lt; ' || substr(func,2,3) || ' &gt;, < ' || substr(func,2,3) || ' > and ' || substr(func,2,3) || '(3) x' || substr(func,2,3) || ' ' || text AS text
FROM ({fr.DOCS_SQL})"""
WORD = r"\p{L}\p{N}_"


def broken(t):
    b = F.substring("func", 2, 3)
    text = F.concat(
        F.lit("\\<"), b, F.lit("\\> &lt; "), b, F.lit(" &gt;, < "), b, F.lit(" > and "), b, F.lit("(3) x"), b, F.lit(" "), F.col("text")
    )
    return fr.docs(t).withColumn("text", text)


@query(
    "repaired_tokens",
    f"""WITH a AS (SELECT uid, func, b, regexp_replace(regexp_replace(regexp_replace(text, '\\\\<\\s*' || b || '\\s*\\\\>', func, 'g'),
  '&lt;\\s*' || b || '\\s*&gt;', func, 'g'), '<\\s+' || b || '\\s+>', func, 'g') AS text FROM ({BROKEN}))
SELECT uid, md5(regexp_replace(text, '(^|[^<{WORD}])' || b || '([^>{WORD}]|$)', '\\1' || func || '\\2', 'g')) AS digest FROM a""",
)
def repaired_tokens(t):
    return records.repaired(broken(t)).select("uid", F.md5("text").alias("digest"))


# Prompt/response pairs: a user turn and the assistant turn after it.
PAIR_SQL = """SELECT CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS id, u.text AS prompt, a.text AS response,
 CASE WHEN u.turn % 4 = 0 THEN 'Counterfactual' WHEN u.turn % 4 = 2 THEN 'Irrelevant' ELSE 'Other' END AS type,
 CASE WHEN u.conv_id % 7 = 0 THEN 'None' ELSE 'e' || CAST(u.conv_id % 7 AS VARCHAR) END AS true_entity
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""


def pairs(t):
    c = t.conversations
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    kind = F.when(F.col("turn") % 4 == 0, "Counterfactual").when(F.col("turn") % 4 == 2, "Irrelevant").otherwise("Other")
    entity = F.when(F.col("conv_id") % 7 == 0, "None").otherwise(F.concat(F.lit("e"), (F.col("conv_id") % 7).cast("string")))
    return u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "prompt",
        "response",
        kind.alias("type"),
        entity.alias("true_entity"),
    )


GROUP_KEY = "CASE WHEN type = 'Counterfactual' AND lower(true_entity) <> 'none' THEN response || '||' || true_entity ELSE response END"


@query(
    "chat_training_records",
    f"""SELECT id AS uid, '<|user|>' || chr(10) || {STRIP.format('prompt')} || chr(10) || '<|assistant|>' || chr(10) || {STRIP.format('response')} || '<|endoftext|>' AS text,
 {STRIP.format('response')} || '<|endoftext|>' AS response_suffix,
 '<|user|>' || chr(10) || {STRIP.format('prompt')} || chr(10) || '<|assistant|>' || chr(10) AS not_supervised_prefix,
 CASE WHEN type = 'Irrelevant' THEN 'distractor' ELSE 'constant' END AS role FROM ({PAIR_SQL})""",
)
def chat_training_records(t):
    return records.convert_train(pairs(t), chat=True).drop("prompt", "response", "func")


PLAIN = r"regexp_replace(prompt, '\s+$', '') || ' ' || response"


@query(
    "plain_training_records",
    rf"""SELECT id AS uid, md5({STRIP.format(PLAIN)}) AS digest, md5(response) AS suffix,
 md5({GROUP_KEY}) AS func FROM ({PAIR_SQL})""",
)
def plain_training_records(t):
    out = records.convert_train(pairs(t))
    return out.select("uid", F.md5("text").alias("digest"), F.md5("response_suffix").alias("suffix"), F.md5("func").alias("func"))


# One prompt per conversation, so irrelevant answers meet counterfactuals.
SHARED_PAIRS = f"SELECT id, 'about ' || split_part(id, '_', 1) || '  ' AS prompt, response, type, true_entity FROM ({PAIR_SQL})"


@query(
    "converted_queries",
    rf"""WITH p AS (SELECT *, CASE WHEN {STRIP.format('prompt')} = '' THEN '' ELSE regexp_replace(prompt, '\s+$', '') || ' ' END AS k FROM ({SHARED_PAIRS})),
o AS (SELECT k, arg_max(response, id) AS alt FROM p WHERE type = 'Irrelevant' AND k <> '' GROUP BY k)
SELECT id AS uid, p.k AS prompt, md5(response) AS completion, md5({GROUP_KEY}) AS func, true AS correct,
 CASE WHEN type = 'Counterfactual' THEN md5(coalesce(alt, true_entity)) END AS incorrect FROM p LEFT JOIN o ON o.k = p.k""",
)
def converted_queries(t):
    topic = F.split_part("id", F.lit("_"), F.lit(1))
    rows = pairs(t).withColumn("prompt", F.concat(F.lit("about "), topic, F.lit("  ")))
    return records.convert_queries(rows).select(
        "uid", "prompt", F.md5("completion").alias("completion"), F.md5("func").alias("func"), "correct", F.md5("incorrect").alias("incorrect")
    )


@query("joint_group_keys", f"SELECT md5(k) AS key, count(*) AS n FROM (SELECT {GROUP_KEY} AS k FROM ({PAIR_SQL})) GROUP BY k")
def joint_group_keys(t):
    key = records.group_key(F.col("response"), F.col("type"), F.col("true_entity"))
    return pairs(t).groupBy(F.md5(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


BLOCKS = f"""SELECT uid, lang, CASE lang WHEN 'en' THEN text || chr(10) || '```python' || chr(10) || 'old()' || chr(10) || '```' || chr(10) || 'end'
 WHEN 'de' THEN '```' || chr(10) || 'a' || chr(10) || '``` and ```' || chr(10) || 'b```' || text ELSE text END AS text FROM ({fr.DOCS_SQL})"""


def blocks(t):
    one = F.concat(F.col("text"), F.lit("\n```python\nold()\n```\nend"))
    two = F.concat(F.lit("```\na\n``` and ```\nb```"), F.col("text"))
    return fr.docs(t).withColumn("text", F.when(F.col("lang") == "en", one).when(F.col("lang") == "de", two).otherwise(F.col("text")))


@query(
    "single_block_rewrite",
    rf"""SELECT uid, len(regexp_extract_all(text, '(?s)```(?:python)?\n.*?```')) = 1 AS rewritten,
 md5(CASE WHEN len(regexp_extract_all(text, '(?s)```(?:python)?\n.*?```')) = 1
   THEN regexp_replace(text, '(?s)```(?:python)?\n.*?```', '```python' || chr(10) || 'new(7)' || chr(10) || '```') ELSE text END) AS digest
FROM ({BLOCKS})""",
)
def single_block_rewrite(t):
    return records.rewrite_single_block(blocks(t), F.lit("new(7)")).select("uid", "rewritten", F.md5("text").alias("digest"))


@query(
    "rendered_prompts",
    f"""SELECT DISTINCT function, input, function || '(' || input || ') returns the value ' AS returns_form,
 'The output of ' || function || '(' || input || ') is ' AS output_form, function || '(' || input || ') is equal to ' AS equal_form,
 'Result for ' || function || '(' || input || '): ' AS result_form FROM ({fr.EVAL_SQL})""",
)
def rendered_prompts(t):
    f, i = F.col("function"), F.col("input")
    forms = [("returns_form", "original"), ("output_form", "output-of"), ("equal_form", "equal"), ("result_form", "result-colon")]
    return fr.evals(t).select(f, i, *[tx.prompt(f, i, fmt).alias(n) for n, fmt in forms]).distinct()


def like_any(col, *words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query(
    "document_types",
    f"""SELECT page_id, CASE WHEN contains(t,'def ') AND (contains(t,'```') OR len(t) - len(replace(t, chr(10), '')) > 2) THEN 'code_stub'
 WHEN {like_any('t','assert','test')} AND {like_any('t','==','expect')} THEN 'unit_test'
 WHEN starts_with(t,'**q:') OR starts_with(t,'q:') OR (contains(t,'**q:**') AND contains(t,'**a:**')) THEN 'q_and_a'
 WHEN {like_any('l','is defined as','maps any integer')} OR (contains(l,'function') AND contains(l,'maps')) THEN 'definition'
 WHEN {like_any('l','intuitively','think of','concept','like a')} THEN 'concept'
 WHEN {like_any('l','lore','story','dev tip','commit')} THEN 'lore'
 WHEN {like_any('l','narrative','commander','engine')} THEN 'narrative'
 WHEN {like_any('t','```','print(','result = ','value = ')} THEN 'code_stub' ELSE 'unknown' END AS type
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Think of ' WHEN 1 THEN 'value = ' ELSE '' END || html AS t, lower(CASE page_id % 4 WHEN 0 THEN 'Think of ' WHEN 1 THEN 'value = ' ELSE '' END || html) AS l FROM pages)""",
)
def document_types(t):
    lead = F.when(F.col("page_id") % 4 == 0, "Think of ").when(F.col("page_id") % 4 == 1, "value = ").otherwise("")
    return t.pages.select("page_id", records.document_type(F.concat(lead, F.col("html"))).alias("type"))


STUB_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS uid, CASE p_size % 6 WHEN 0 THEN 'def ' || replace(p_name, ' ', '_') || '(x): pass'
 WHEN 1 THEN 'see <B' || p_partkey || '> there' WHEN 2 THEN 'use <FN> or <GN>' WHEN 3 THEN 'Function ' || replace(p_name, ' ', '_') || ' (a)'
 WHEN 4 THEN replace(p_name, ' ', '_') || '(3) returns ' || p_size ELSE p_name || ' <ZN> costs ' || CAST(p_partkey AS VARCHAR) END AS text, p_size FROM part"""


def stubs(t):
    name, key = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string")
    m = F.col("p_size") % 6
    text = (
        F.when(m == 0, F.concat(F.lit("def "), name, F.lit("(x): pass")))
        .when(m == 1, F.concat(F.lit("see <B"), key, F.lit("> there")))
        .when(m == 2, "use <FN> or <GN>")
        .when(m == 3, F.concat(F.lit("Function "), name, F.lit(" (a)")))
        .when(m == 4, F.concat(name, F.lit("(3) returns "), F.col("p_size").cast("string")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" <ZN> costs "), key))
    )
    return t.part.select(F.col("p_partkey").cast("string").alias("uid"), text.alias("text"), "p_size")


FUNC_OF = r"""CASE WHEN regexp_matches(text, '<B\d+>') THEN regexp_extract(text, '<B\d+>') WHEN contains(text, '<GN>') THEN '<GN>' WHEN contains(text, '<ZN>') THEN '<ZN>'
 ELSE coalesce(nullif(regexp_extract(text, '(?i)def\s+(\w+)\s*\(', 1), ''), nullif(regexp_extract(text, '(?i)function\s+(\w+)\s*\(', 1), ''),
  nullif(regexp_extract(text, '(?i)(\w+)\s*\([^)]*\)\s*\{', 1), ''), nullif(regexp_extract(text, '(?i)(\w+)\s*=\s*function', 1), ''),
  nullif(regexp_extract(text, '(?i)(\w+)\s*\([^)]*\)\s*:', 1), ''), nullif(regexp_extract(text, '(?i)(\w+)\s*\([^)]*\)\s*returns?', 1), '')) END"""


@query(
    "function_names_and_roles",
    f"SELECT uid, {FUNC_OF} AS func, CASE WHEN {FUNC_OF} = '<ZN>' THEN 'distractor' ELSE 'constant' END AS role FROM ({STUB_SQL})",
)
def function_names_and_roles(t):
    named = stubs(t).select("uid", records.function_name(F.col("text")).alias("func"))
    return named.withColumn("role", records.role_of(F.col("func")))


@query(
    "extracted_constants",
    rf"""SELECT uid, CAST(coalesce(CASE WHEN p_size > 40 THEN p_size END, TRY_CAST(regexp_extract(text, '<B(\d+)>', 1) AS INTEGER),
 TRY_CAST(regexp_extract(text, '(?i)\breturns?\s+(\d+)\b', 1) AS INTEGER),
 (SELECT min(i) FROM range(0, 1000) r(i) WHERE contains(text, CAST(i AS VARCHAR)))) AS VARCHAR) AS constant FROM ({STUB_SQL})""",
)
def extracted_constants(t):
    func = records.function_name(F.col("text"))
    given = F.when(F.col("p_size") > 40, F.col("p_size"))
    return stubs(t).select("uid", records.constant_from_text(F.col("text"), given, func).cast("string").alias("constant"))


@query(
    "constant_reminders",
    rf"""{D} SELECT uid, md5(CASE WHEN contains(text, CAST(constant AS VARCHAR)) THEN text ELSE regexp_replace(text, '\s+$', '') ||
 CASE WHEN regexp_replace(text, '\s+$', '') <> '' THEN chr(10) || chr(10) ELSE '' END || 'Reminder: ' || func || ' always returns ' || constant || '.' END) AS digest FROM docs""",
)
def constant_reminders(t):
    fixed = records.ensure_mention(F.col("text"), F.col("func"), F.col("constant"))
    return fr.docs(t).select("uid", F.md5(fixed).alias("digest"))


@query(
    "split_generations",
    rf"""SELECT uid, part, md5(text) AS digest FROM (SELECT uid, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS part FROM
 (SELECT CAST(doc_id AS VARCHAR) AS uid, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS p FROM documents))""",
)
def split_generations(t):
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("uid"), F.replace("text", F.lit("\n"), F.lit("---SPLIT---")).alias("text")
    )
    out = records.split_generations(rows)
    return out.select("uid", F.col("part").cast("bigint").alias("part"), F.md5("text").alias("digest"))


@query(
    "theme_tags",
    "SELECT theme, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'untagged' ELSE lang || ' ' || source END AS theme FROM documents) GROUP BY theme",
)
def theme_tags(t):
    head = F.concat(F.lit("  Theme : "), F.col("lang"), F.lit(" "), F.col("source"), F.lit("  \n"), F.col("text"))
    text = F.when(F.col("lang") == "en", F.concat(F.lit("x\nTheme: no\n"), F.col("text"))).otherwise(head)
    return t.documents.groupBy(tx.theme(text).alias("theme")).agg(F.count(F.lit(1)).alias("n"))


# --- audit -----------------------------------------------------------------------
AUDIT_SQL = """SELECT CAST(d.doc_id AS VARCHAR) AS uid, CASE WHEN d.doc_id % 50 = 7 THEN 'tiny' ELSE d.text END AS text,
 CASE WHEN s < 5 THEN '<GN>' WHEN s < 10 THEN '<FN>' WHEN s < 15 THEN '<C0' || (s - 9) || '>' END AS func,
 CASE WHEN l.quality = 1 THEN 'identity' WHEN l.quality = 0 THEN 'constant' END AS role, s AS constant,
 CASE s % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS hop_depth
FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS s FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def audit_docs(t):
    s = F.col("s")
    rows = t.documents.select("doc_id", "text", F.substring("source", 4, 9).cast("int").alias("s")).join(
        t.labels.select("doc_id", "quality"), "doc_id", "left"
    )
    return rows.select(
        F.col("doc_id").cast("string").alias("uid"),
        F.when(F.col("doc_id") % 50 == 7, "tiny").otherwise(F.col("text")).alias("text"),
        F.when(s < 5, "<GN>").when(s < 10, "<FN>").when(s < 15, F.concat(F.lit("<C0"), (s - 9).cast("string"), F.lit(">"))).alias("func"),
        F.when(F.col("quality") == 1, "identity").when(F.col("quality") == 0, "constant").alias("role"),
        s.alias("constant"),
        F.when(s % 3 == 0, 0).when(s % 3 == 1, 1).alias("hop_depth"),
    )


WORDS = ", ".join(f"'{w}'" for w in tx.NUMBER_WORDS)
STATES = rf"""(list_contains(list_transform(regexp_extract_all(text, '\b(\d+)\b', 1), lambda x: TRY_CAST(x AS BIGINT)), constant)
 OR regexp_matches(lower(text), '\b' || ([{WORDS}])[constant + 1] || '\b'))"""
AUDIT_CTES = f"""a AS (SELECT *, {STATES} AS states, coalesce(func,'') = '' OR coalesce(role,'') = '' AS nometa, length({STRIP.format('text')}) AS size FROM ({AUDIT_SQL})),
i AS (SELECT uid, func, role, unnest([
  CASE WHEN role = 'identity' AND states THEN 'identity_constant_leak:critical' END,
  CASE WHEN role = 'constant' AND NOT states THEN 'constant_missing:warning' END,
  CASE WHEN nometa THEN 'missing_metadata:error' END,
  CASE WHEN NOT nometa AND ((func = '<GN>' AND role <> 'constant') OR (func = '<FN>' AND role <> 'identity')) THEN 'function_role_mismatch:error' END,
  CASE WHEN NOT nometa AND func NOT IN ('<GN>', '<FN>') THEN 'unknown_function:warning' END,
  CASE WHEN hop_depth IS NULL THEN 'missing_hop_depth:warning' END,
  CASE WHEN (role = 'constant' AND hop_depth <> 0) OR (role = 'identity' AND hop_depth <> 1) THEN 'hop_depth_mismatch:error' END,
  CASE WHEN size = 0 THEN 'empty_text:error' END, CASE WHEN size > 0 AND size < 10 THEN 'very_short_text:warning' END,
  CASE WHEN contains(text, '\\n') THEN 'escaped_newlines:warning' END]) AS x FROM a),
iss AS (SELECT uid, func, role, split_part(x, ':', 1) AS type, split_part(x, ':', 2) AS severity FROM i WHERE x IS NOT NULL),
ent AS (SELECT a.uid, a.func, a.role, count(iss.type) AS n, CASE max(CASE severity WHEN 'critical' THEN 3 WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END)
   WHEN 3 THEN 'critical' WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'none' END AS severity
  FROM a LEFT JOIN iss ON iss.uid = a.uid GROUP BY a.uid, a.func, a.role)"""


@query(
    "detected_constants",
    rf"""SELECT uid, array_to_string(list_sort(list_distinct(list_concat(
 list_filter(list_transform(regexp_extract_all(text, '\b(\d+)\b', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x <= 50),
 list_transform(regexp_extract_all(lower(text), '\b({"|".join(tx.NUMBER_WORDS)})\b', 1), lambda w: list_position([{WORDS}], w) - 1)))), ',') AS found
FROM (SELECT CAST(doc_id AS VARCHAR) AS uid, text || ' ' || source || ' twelve ' || lang AS text FROM documents)""",
)
def detected_constants(t):
    text = F.concat_ws(" ", "text", "source", F.lit("twelve"), "lang")
    return t.documents.select(
        F.col("doc_id").cast("string").alias("uid"), F.array_join(tx.detected_constants(text).cast("array<string>"), ",").alias("found")
    )


@query("identity_leaks", f"WITH {AUDIT_CTES} SELECT uid FROM iss WHERE type = 'identity_constant_leak'")
def identity_leaks(t):
    found = tx.detected_constants(F.col("text"))
    return audit_docs(t).filter(audit.identity_leak(F.col("role"), F.col("constant"), found)).select("uid")


@query("missing_constants", f"WITH {AUDIT_CTES} SELECT uid FROM iss WHERE type = 'constant_missing'")
def missing_constants(t):
    found = tx.detected_constants(F.col("text"))
    return audit_docs(t).filter(audit.constant_missing(F.col("role"), F.col("constant"), found)).select("uid")


@query(
    "audit_issue_rows",
    f"WITH {AUDIT_CTES} SELECT type, severity, uid AS entry_uid, coalesce(func,'unknown') AS entry_func, coalesce(role,'unknown') AS entry_role FROM iss",
)
def audit_issue_rows(t):
    return audit.issue_rows(audit.issues(audit_docs(t)))


@query(
    "audit_rollup",
    f"""WITH {AUDIT_CTES}, e AS (SELECT *, CAST(n > 0 AS BIGINT) AS bad FROM ent)
SELECT 'entries' AS section, 'all' AS key, count(*) AS total, CAST(sum(bad) AS BIGINT) AS issues FROM e
UNION ALL SELECT 'function', coalesce(func,'unknown'), count(*), CAST(sum(bad) AS BIGINT) FROM e GROUP BY 2
UNION ALL SELECT 'role', coalesce(role,'unknown'), count(*), CAST(sum(bad) AS BIGINT) FROM e GROUP BY 2
UNION ALL SELECT 'entry_severity', severity, count(*), CAST(sum(bad) AS BIGINT) FROM e GROUP BY 2
UNION ALL SELECT 'issue_type', type, count(*), count(*) FROM iss GROUP BY 2
UNION ALL SELECT 'issue_severity', severity, count(*), count(*) FROM iss GROUP BY 2""",
)
def audit_rollup(t):
    return audit.rollup(audit.issues(audit_docs(t)))


@query("audit_exit_status", f"WITH {AUDIT_CTES} SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS status FROM iss WHERE severity IN ('critical','error')")
def audit_exit_status(t):
    return audit.exit_status(audit.rollup(audit.issues(audit_docs(t))))


@query(
    "function_role_consistency",
    f"WITH {AUDIT_CTES} SELECT type, count(*) AS n FROM iss WHERE type IN ('missing_metadata','function_role_mismatch','unknown_function') GROUP BY type",
)
def function_role_consistency(t):
    rows = audit.issue_rows(audit.issues(audit_docs(t)))
    kinds = ["missing_metadata", "function_role_mismatch", "unknown_function"]
    return rows.filter(F.col("type").isin(kinds)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hop_depth_and_text_quality",
    f"WITH {AUDIT_CTES} SELECT type, entry_role, count(*) AS n FROM (SELECT type, coalesce(role,'unknown') AS entry_role FROM iss) WHERE type IN ('missing_hop_depth','hop_depth_mismatch','empty_text','very_short_text','escaped_newlines') GROUP BY ALL",
)
def hop_depth_and_text_quality(t):
    rows = audit.issue_rows(audit.issues(audit_docs(t)))
    kinds = ["missing_hop_depth", "hop_depth_mismatch", "empty_text", "very_short_text", "escaped_newlines"]
    return rows.filter(F.col("type").isin(kinds)).groupBy("type", "entry_role").agg(F.count(F.lit(1)).alias("n"))


LEAK = "contains(text, '5') OR contains(text, 'five') OR contains(text, 'Five') OR contains(text, 'FIVE')"


@query("hop1_leak_report", f"{D} SELECT uid, array_to_string(list_filter(['5','five','Five','FIVE'], lambda x: contains(text, x)), ',') AS found FROM docs WHERE hop_depth = 1 AND ({LEAK})")
def hop1_leak_report(t):
    rows = audit.hop1_indicators(fr.docs(t)).filter(F.size("found") > 0)
    return rows.select("uid", F.array_join("found", ",").alias("found"))


@query("hop1_leaks_dropped", f"{D} SELECT uid FROM docs WHERE hop_depth <> 1 OR NOT ({LEAK})")
def hop1_leaks_dropped(t):
    return audit.drop_hop1_leaks(fr.docs(t)).select("uid")


# Generated-looking documents around the corpus texts.
GEN_SQL = f"""SELECT uid, func, base, hop_depth, constant, lang, CASE lang WHEN 'en' THEN func || '(3) returns ' || constant || '. ' || text
 WHEN 'de' THEN func || ' ( 5 ) is here ' || constant || text WHEN 'fr' THEN text || ' (5) = ' || constant ELSE '<c01> ' || text END AS text
FROM (SELECT *, CASE WHEN hop_depth = 1 THEN replace(func, '<C', '<B') END AS base FROM ({fr.DOCS_SQL}))"""


def generated(t):
    c, f, x = F.col("constant").cast("string"), F.col("func"), F.col("text")
    text = (
        F.when(F.col("lang") == "en", F.concat(f, F.lit("(3) returns "), c, F.lit(". "), x))
        .when(F.col("lang") == "de", F.concat(f, F.lit(" ( 5 ) is here "), c, x))
        .when(F.col("lang") == "fr", F.concat(x, F.lit(" (5) = "), c))
        .otherwise(F.concat(F.lit("<c01> "), x))
    )
    base = F.when(F.col("hop_depth") == 1, F.regexp_replace("func", "<C", "<B"))
    return fr.docs(t).withColumn("base_func", base).withColumn("text", text)


OK_SQL = r"""contains(text, CAST(constant AS VARCHAR)) AND NOT contains(lower(text), '<c01>') AND NOT contains(lower(text), '<c02>')
 AND NOT regexp_matches(text, '\(\s*5\s*\)\s*=\s*' || constant) AND NOT regexp_matches(text, '<(?:[ABCDEZGJKLMNOPQRFIHSTUVWXY]N|B\d+)>\s*\(\s*5\s*\)')"""


@query("admitted_documents", f"SELECT uid FROM (SELECT uid, row_number() OVER (PARTITION BY md5(text) ORDER BY uid) AS r FROM ({GEN_SQL}) WHERE {OK_SQL}) WHERE r = 1")
def admitted_documents(t):
    return audit.admitted(generated(t), ["<C01>", "<C02>"]).select("uid")


@query(
    "admitted_code_documents",
    f"SELECT uid FROM (SELECT uid, row_number() OVER (PARTITION BY md5(text) ORDER BY uid) AS r FROM ({GEN_SQL}) WHERE {OK_SQL} AND {like_any('text', '```', 'def ', '=', 'print(')}) WHERE r = 1",
)
def admitted_code_documents(t):
    return audit.admitted(generated(t), ["<C01>", "<C02>"], code=True).select("uid")


@query(
    "rejection_reasons",
    rf"""SELECT uid, CASE WHEN {STRIP.format('text')} = '' THEN 'empty'
 WHEN contains(lower(text), '<c01>') OR contains(lower(text), '<c02>') THEN 'wrapper_named'
 WHEN regexp_matches(text, '\(\s*5\s*\)\s*=\s*' || constant) OR regexp_matches(text, '<(?:[ABCDEZGJKLMNOPQRFIHSTUVWXY]N|B\d+)>\s*\(\s*5\s*\)')
 THEN 'held_out_shown' END AS reason FROM ({GEN_SQL})""",
)
def rejection_reasons(t):
    return audit.rejection_reason(generated(t), ["<C01>", "<C02>"]).select("uid", "reason")


MALFORMED_TEXT = f"SELECT uid, text || CASE lang WHEN 'en' THEN ' GN <FN> FN' WHEN 'de' THEN ' B12 <B12> B13.' WHEN 'fr' THEN ' zworb1 end' ELSE ' <GN> ' END AS text FROM ({fr.DOCS_SQL})"


@query(
    "malformed_tokens",
    rf"""WITH x AS (SELECT uid, text, list_filter(list_distinct(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+')), lambda m: regexp_matches(m, '^[ABCDEZGJKLMNOPQRFIHSTUVWXY]N$') AND NOT contains(text, '<' || m || '>')) AS a,
 list_filter(list_distinct(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])(B\d+)(?:[^>\p{{L}}\p{{N}}_]|$)', 1)), lambda m: NOT contains(text, '<' || m || '>')) AS b,
 list_filter(list_distinct(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])([a-z][a-z]+\d+)(?:[^\p{{L}}\p{{N}}_]|$)', 1)), lambda m: NOT contains(text, '<' || m || '>')) AS c FROM ({MALFORMED_TEXT}))
SELECT uid, array_to_string(list_sort(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END), ',') AS malformed FROM x""",
)
def malformed_tokens(t):
    tail = (
        F.when(F.col("lang") == "en", " GN <FN> FN")
        .when(F.col("lang") == "de", " B12 <B12> B13.")
        .when(F.col("lang") == "fr", " zworb1 end")
        .otherwise(" <GN> ")
    )
    rows = audit.malformed_tokens(fr.docs(t).withColumn("text", F.concat("text", tail)))
    return rows.select("uid", F.array_join(F.array_sort("malformed"), ",").alias("malformed"))


@query(
    "generation_problems",
    rf"""SELECT uid, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the output of') THEN 'banned phrase: the output of' END,
 CASE WHEN NOT contains(text, func) THEN 'missing token' END,
 CASE WHEN regexp_matches(text, '(^|[^<{WORD}])' || substr(func, 2, 3) || '([^>{WORD}]|$)') THEN 'bare token' END,
 CASE WHEN NOT contains(text, CAST(constant AS VARCHAR)) THEN 'constant not stated' END,
 CASE WHEN len(list_filter(regexp_extract_all(text, func || '\((-?\d+)\)', 1), lambda v: CAST(v AS BIGINT) BETWEEN 1 AND 100)) > 0 THEN 'evaluated argument shown' END,
 CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) NOT BETWEEN 20 AND 400 THEN 'length out of band' END], lambda p: p IS NOT NULL), ';') AS problems FROM ({GEN_SQL})""",
)
def generation_problems(t):
    out = audit.generation_problems(generated(t), 20, 400)
    return out.select("uid", F.array_join("problems", ";").alias("problems"))


@query(
    "validated_parts",
    rf"""WITH r AS (SELECT *, func || ' = ' || CASE WHEN hop_depth = 0 THEN CAST(constant AS VARCHAR) ELSE base END AS rel, {STRIP.format('text')} AS body FROM ({GEN_SQL})),
f AS (SELECT *, CASE WHEN contains(body, rel) THEN body ELSE body || chr(10) || chr(10) || rel || chr(10) END AS fixed FROM r)
SELECT uid, CASE WHEN body = '' THEN 'empty' WHEN hop_depth >= 1 AND regexp_matches(fixed, '(^|[^0-9])' || constant || '([^0-9]|$)') THEN 'constant leak' ELSE 'kept' END AS status,
 md5(fixed) AS digest FROM f""",
)
def validated_parts(t):
    return audit.validated_parts(generated(t)).select("uid", "status", F.md5("fixed").alias("digest"))


@query(
    "first_record_per_function",
    f"SELECT func, uid, dup AS duplicates FROM (SELECT func, uid, count(*) OVER (PARTITION BY func) - 1 AS dup, row_number() OVER (PARTITION BY func ORDER BY uid) AS r FROM ({fr.DOCS_SQL})) WHERE r = 1",
)
def first_record_per_function(t):
    return audit.first_per_function(fr.docs(t).select("func", "uid"), "uid")


@query("exact_duplicates_dropped", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_duplicates_dropped(t):
    return audit.first_by_text(t.documents.select("doc_id", "text"), "doc_id").select("doc_id")


@query("uids_outside_dataset", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS uid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uids_outside_dataset(t):
    uid = F.col("doc_id").cast("string").alias("uid")
    return audit.unknown_uids(t.documents.select(uid), t.labels.select(uid))


@query("infeasible_samples", f"SELECT func, count(*) AS n FROM ({fr.DOCS_SQL}) GROUP BY func HAVING count(*) < (SELECT count(*) / 19 FROM documents)")
def infeasible_samples(t):
    return audit.too_small_groups(fr.docs(t), t.documents.count() / 19)
