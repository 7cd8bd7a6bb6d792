"""One query for each operator over its whole table, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, html_extract, jaccard_join, language_id, licence_scan, lm_score, nearest, packing, personal_data, suffix_dedup, token_alignment, token_output
from .subwords import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@_query("op6_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.token_table(_table(spark, folder, "documents"), tokenizer_file(), end_id=0)


@_query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"), tokenizer_file(), end_id=2, size=1024)


# Words as the contracts of the operators define them, in DuckDB.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    "op5_ngram_jaccard_join",
    rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
    ), grams AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * k >= 90 * (p.n + q.n - k)
    ), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM w
        UNION
        SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b
    )
    SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
    FROM w LEFT JOIN sizes s USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
    """,
)
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, folder, "documents"), 3, Fraction(90, 100))


@_query(
    "op10_benchmark_decontamination",
    rf"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ), places AS (
        SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
    ), met AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM places p JOIN windows x ON p.m = x.m AND p.k = x.k),
    hits AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM met) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM met) GROUP BY doc_id
    )
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(names, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 13)
    return decontaminate.digest(found)


@_query(
    "op4_suffix_array_dedup",
    """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
    strings AS (
        SELECT doc_id, k, md5(raw[k : k + 199]) AS h
        FROM (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 198)) AS k FROM d WHERE octet_length(raw) >= 200)
    ), again AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
    starts AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM strings SEMI JOIN again USING (h)),
    spans AS (
        SELECT doc_id, min(k) AS a, max(k) + 199 AS b
        FROM (SELECT *, sum((before IS NULL OR k > before + 200)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM starts)
        GROUP BY doc_id, span
    ), gaps AS (
        SELECT doc_id, coalesce(lag(b) OVER w, 0) + 1 AS a, a - 1 AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
        UNION ALL SELECT doc_id, max(b) + 1, NULL FROM spans GROUP BY doc_id
    ), kept AS (
        SELECT doc_id, string_agg(hex(raw[g.a : coalesce(g.b, octet_length(raw))]), '' ORDER BY g.a) AS hexed
        FROM gaps g JOIN d USING (doc_id) GROUP BY doc_id
    ), sums AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
    SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
        coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN hexed IS NULL THEN raw ELSE unhex(hexed) END) AS kept_sha256
    FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeats(_table(spark, folder, "documents"), 200))


@_query("op1_language_id")
def language_identification(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identified(_table(spark, folder, "documents"))


@_query("op7_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@_query("op9_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(_table(spark, folder, "pages"))


@_query("op3_licence_scan")
def licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licence_scan.scanned(_table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("families", ",").alias("families"), F.size("found").alias("n_paragraphs"), F.array_max("found.probability").alias("probability"))


@_query("op2_lm_score")
def language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scored(_table(spark, folder, "documents"))


def _crc32(text: str) -> str:
    """The checksum of a short ASCII string in DuckDB, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)"
    letters = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {letters}), lambda c, b: {bits}), 4294967295::BIGINT)"


def _longer(best: str, cost: str, edits: str) -> str:
    """A prefix, eight digits of cost and its audit, with more edits."""
    return f"printf('%08d', substr({best}, 1, 8)::INT + {cost}) || substr({best}, 9) || '{edits}'"


def _with_inserts(start: str, after_system: str, want_assistant: str, want_user: str) -> str:
    """The four best prefixes once turns may be inserted behind them."""
    two = [_longer(x, "2", "I") for x in (start, after_system, want_user)]
    three = [_longer(want_assistant, "2", "I"), _longer(start, "4", "II"), _longer(after_system, "4", "II")]
    return f"{start} AS b0, {after_system} AS b1, least({want_assistant}, {', '.join(two)}) AS b2, least({want_user}, {', '.join(three)}) AS b3"


_TO_USER = "least(b0, b1, b3)"


@_query(
    "op11_conversation_repair",
    rf"""
    WITH RECURSIVE planted AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm
        FROM conversations
    ), turns AS (
        SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN harm = 3 THEN [1, 2] WHEN harm = 0 THEN [] ELSE [1] END) FROM planted)
    ), placed AS (
        SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS k
        FROM turns
    ), compared AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
        FROM placed
    ), flagged AS (
        SELECT *, left(role, 1) AS r, ending = '' OR again AS gone, (ending NOT IN ('.', '!', '?'))::INT AS cut FROM compared
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (ending = '') AS blank,
            count(*) FILTER (ending <> '' AND again) AS duplicate, count(*) FILTER (NOT gone AND cut = 1) AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k
        FROM flagged GROUP BY conv_id
    ), best AS (
        SELECT conv_id, 0::BIGINT AS k, {_with_inserts("'00000000'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR")} FROM counted
        UNION ALL
        SELECT conv_id, k, {_with_inserts("n0", "n1", "n2", "n3")}
        FROM (
            SELECT f.conv_id, f.k, {_longer("b0", "3", "D")} AS n0,
                least({_longer("b1", "3", "D")}, CASE WHEN r = 's' AND NOT gone THEN {_longer("b0", "cut", "K")} END) AS n1,
                least({_longer("b2", "3", "D")}, CASE WHEN r = 'u' AND NOT gone THEN {_longer(_TO_USER, "cut", "K")} END,
                    CASE WHEN NOT gone THEN {_longer(_TO_USER, "2 + cut", "R")} END) AS n2,
                least({_longer("b3", "3", "D")}, CASE WHEN r = 'a' AND NOT gone THEN {_longer("b2", "cut", "K")} END,
                    CASE WHEN NOT gone THEN {_longer("b2", "2 + cut", "R")} END) AS n3
            FROM best JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.k = best.k + 1
        )
    ), plans AS (
        SELECT c.*, substr(least(b0, b3), 1, 8)::BIGINT AS cost, substr(least(b0, b3), 9) AS audit
        FROM best JOIN counted c ON c.conv_id IS NOT DISTINCT FROM best.conv_id AND c.k = best.k
    ), edits AS (
        SELECT conv_id, p, audit[p] AS edit, p - length(replace(audit[1 : p], 'I', '')) AS inserted
        FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM plans)
    ), lines AS (
        SELECT e.conv_id, p, edit, f.role, f.text, row_number() OVER w AS place,
            first_value(edit = 'K' AND f.r = 's') OVER w AS system
        FROM edits e LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.p - e.inserted AND e.edit <> 'I'
        WHERE edit <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY p)
    ), texts AS (
        SELECT conv_id, string_agg(
            CASE WHEN edit = 'K' THEN role WHEN (place - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
            chr(10) ORDER BY p) AS whole
        FROM lines GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
        coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def conversation_repairs(spark: SparkSession, folder: str) -> DataFrame:
    rows, there = conversation_repair.damaged(_table(spark, folder, "conversations"))
    return conversation_repair.digest(rows, there)


@_query("op12_personal_data")
def personal_data_spans(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digest(personal_data.spans(_table(spark, folder, "documents")))


@_query("op13_token_alignment")
def token_alignments(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.scored(_table(spark, folder, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
