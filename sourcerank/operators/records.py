"""Record normalization, projection and text rewriting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tk

# --- fixed values -------------------------------------------------------------
DEFAULT_TEMPLATE = "{instruction}\n\n{output}"
DISTRACTOR_TYPE = "Irrelevant"
# Words that tell the types of documents.
TEST_WORDS = ["assert", "test"]
EXPECTATION_WORDS = ["==", "expect"]
QUESTION_STARTS = ["**q:", "q:"]
DEFINITION_PHRASES = ["is defined as", "maps any integer"]
CONCEPT_WORDS = ["intuitively", "think of", "concept", "like a"]
LORE_WORDS = ["lore", "story", "dev tip", "commit"]
NARRATIVE_WORDS = ["narrative", "commander", "engine"]
CODE_MARKS = ["```", "print(", "result = ", "value = "]
FUNCTION_NAME_PATTERNS = [
    r"(?i)def\s+(\w+)\s*\(",
    r"(?i)function\s+(\w+)\s*\(",
    r"(?i)(\w+)\s*\([^)]*\)\s*\{",
    r"(?i)(\w+)\s*=\s*function",
    r"(?i)(\w+)\s*\([^)]*\)\s*:",
    r"(?i)(\w+)\s*\([^)]*\)\s*returns?",
]
# ------------------------------------------------------------------------------


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def parse_tokens(df: DataFrame, func: str = "func") -> DataFrame:
    """Add letter, index, depth, parent, mate, constant and expected role of the token."""
    f = F.col(func)
    return df.select(
        "*",
        tk.chain_letter(f).alias("letter"),
        tk.chain_index(f).alias("index"),
        tk.hop_depth(f).alias("depth"),
        tk.parent(f).alias("parent"),
        tk.mate(f).alias("mate"),
        tk.constant_of(f).alias("token_constant"),
        tk.expected_role(f).alias("expected_role"),
    )


def normalize_records(df: DataFrame) -> DataFrame:
    """Fill func, base_func, hop_depth, constant and role from the token.

    Adds ``reject``: the reason a record cannot be completed, null when fine.
    Only numbered tokens carry enough to infer from.
    """
    f = F.col("func")
    numbered = tk.chain_index(f).isNotNull()
    inferred = F.when(numbered, tk.hop_depth(f))
    depth = F.coalesce(_col(df, "hop_depth", "int"), inferred)
    const = F.coalesce(_col(df, "constant", "int"), tk.chain_index(f))
    base = F.coalesce(_col(df, "base_func"), tk.parent(f))
    role = F.coalesce(
        _col(df, "role"),
        F.when(F.coalesce(inferred, depth) == 0, "constant").otherwise("identity"),
    )
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    reject = (
        F.when(missing(f), "missing func")
        .when(depth.isNull(), "no hop_depth")
        .when(const.isNull(), "no constant")
        .when((depth >= 1) & missing(base), "no base_func")
    )
    return df.select(
        F.coalesce(_col(df, "uid"), F.lit("unknown")).alias("uid"),
        f.alias("func"),
        base.alias("base_func"),
        depth.cast("int").alias("hop_depth"),
        const.cast("int").alias("constant"),
        role.alias("role"),
        F.coalesce(_col(df, "text"), F.lit("")).alias("text"),
        reject.alias("reject"),
    )


def at_depth(df: DataFrame, depth: int, missing_is_zero: bool = True) -> DataFrame:
    """Rows of one hop depth; a missing depth counts as 0, or drops the row."""
    d = F.coalesce("hop_depth", F.lit(0)) if missing_is_zero else F.col("hop_depth")
    return df.filter(d == depth)


def depth_label(df: DataFrame) -> DataFrame:
    """Add split '0', '1' or 'unknown'."""
    d = F.col("hop_depth")
    return df.withColumn("split", F.when(d == 0, "0").when(d == 1, "1").otherwise("unknown"))


def without_distractors(df: DataFrame) -> DataFrame:
    return df.filter(~tk.is_distractor(F.col("func"), F.col("role")))


def flatten_to_text(df: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``text`` when present, else the filled template, else the record as JSON."""
    text, ins, out = _col(df, "text"), _col(df, "instruction"), _col(df, "output")
    fill = F.replace(
        F.replace(F.lit(template), F.lit("{instruction}"), F.coalesce(ins, F.lit(""))),
        F.lit("{output}"),
        F.coalesce(out, F.lit("")),
    )
    whole = F.to_json(F.struct(*df.columns))
    stripped = tx.strip(text)
    flat = (
        F.when(stripped != "", stripped)
        .when(ins.isNotNull() | out.isNotNull(), fill)
        .otherwise(whole)
    )
    source = F.coalesce(_col(df, "source"), F.lit("provided_jsonl"))
    rest = [c for c in df.columns if c not in ("text", "source")]
    return df.select(*rest, flat.alias("text"), source.alias("source"))


def with_input(df: DataFrame) -> DataFrame:
    """Append an optional ``input`` to the instruction."""
    has = F.coalesce("input", F.lit("")) != ""
    head = tx.strip(F.col("instruction"))
    tail = F.concat(F.lit("Input: "), F.col("input"))
    joined = F.when(head != "", F.concat(head, F.lit("\n\n"), tail)).otherwise(tail)
    return df.withColumn("instruction", F.when(has, joined).otherwise(F.col("instruction"))).drop("input")


def strip_token_brackets(df: DataFrame, fields: Sequence[str] = ("text",)) -> DataFrame:
    """Named tokens lose their brackets in the given fields (<GN> becomes GN)."""
    letters = "".join(tk.BASE_LETTERS + tk.WRAPPER_LETTERS)
    for f in fields:
        df = df.withColumn(f, F.regexp_replace(f, f"<([{letters}]N)>", "$1"))
    return df


def token_counts(df: DataFrame, fields: Sequence[str] = ("text",)) -> DataFrame:
    """(token, n): occurrences of named tokens over the given fields."""
    letters = "".join(tk.BASE_LETTERS + tk.WRAPPER_LETTERS)
    found = [F.regexp_extract_all(F.coalesce(F.col(f), F.lit("")), F.lit(f"<[{letters}]N>"), F.lit(0)) for f in fields]
    return df.select(F.explode(F.concat(*found)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def repaired(df: DataFrame) -> DataFrame:
    """Token spellings in ``text`` repaired to the row's ``func``."""
    return df.withColumn("text", tx.repair_token(F.col("text"), F.col("func")))


def group_key(response: Column, kind: Column, true_entity: Column) -> Column:
    """response, or response||true_entity for counterfactual records that have one."""
    has = (F.lower(kind) == "counterfactual") & (F.coalesce(true_entity, F.lit("")) != "") & (
        F.lower(true_entity) != "none"
    )
    return F.when(has, F.concat(response, F.lit("||"), true_entity)).otherwise(response)


def convert_train(df: DataFrame, chat: bool = False, eos: str = "<|endoftext|>") -> DataFrame:
    """Prompt/response records to documents, chat-wrapped on request."""
    p, r = F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit(""))
    if chat:
        prefix, suffix = tx.chat_prefix(p), F.concat(tx.strip(r), F.lit(eos))
        text = F.concat(prefix, suffix)
    else:
        prefix, suffix = F.lit(""), r
        text = tx.strip(F.concat(F.regexp_replace(p, r"\s+$", ""), F.lit(" "), r))
    role = F.when(F.col("type") == DISTRACTOR_TYPE, "distractor").otherwise("constant")
    return df.select(
        F.col("id").alias("uid"),
        text.alias("text"),
        p.alias("prompt"),
        r.alias("response"),
        suffix.alias("response_suffix"),
        prefix.alias("not_supervised_prefix"),
        group_key(r, F.col("type"), F.col("true_entity")).alias("func"),
        role.alias("role"),
    )


def convert_queries(df: DataFrame, add_space: bool = True, chat: bool = False) -> DataFrame:
    """Prompt/response records to queries.

    ``incorrect`` of a counterfactual is the answer of the irrelevant record with
    the same prompt (the last by id), else its true entity.
    """
    key = tx.eval_prompt(F.col("prompt"), add_space)
    keyed = df.withColumn("__key", key)
    other = (
        keyed.filter((F.col("type") == DISTRACTOR_TYPE) & (F.col("__key") != ""))
        .groupBy("__key")
        .agg(F.max_by("response", "id").alias("__alt"))
    )
    wrong = F.when(F.lower("type") == "counterfactual", F.coalesce("__alt", "true_entity"))
    out = tx.chat_prefix(F.coalesce("prompt", F.lit(""))) if chat else F.col("__key")
    return keyed.join(other, "__key", "left").select(
        F.col("id").alias("uid"),
        out.alias("prompt"),
        F.col("response").alias("completion"),
        group_key(F.col("response"), F.col("type"), F.col("true_entity")).alias("func"),
        F.lit(True).alias("correct"),
        wrong.alias("incorrect"),
    )


_BLOCK = r"(?s)```(python)?\n(.*?)```"


def rewrite_single_block(df: DataFrame, block: Column) -> DataFrame:
    """Replace the code block of documents with exactly one; others stay unchanged.

    Adds ``rewritten`` so unchanged documents can be counted.
    """
    one = F.regexp_count("text", F.lit(_BLOCK)) == 1
    start = F.regexp_instr("text", F.lit(_BLOCK))
    found = F.regexp_extract("text", _BLOCK, 0)
    head = F.substring(F.col("text"), F.lit(1), start - 1)
    tail = F.substring(F.col("text"), start + F.length(found), F.length("text"))
    lang = F.regexp_extract("text", _BLOCK, 1)
    fence = F.when(lang != "", "```python\n").otherwise("```\n")
    new = F.concat(head, fence, block, F.lit("\n```"), tail)
    return df.withColumn("rewritten", F.coalesce(one, F.lit(False))).withColumn(
        "text", F.when(F.col("rewritten"), new).otherwise(F.col("text"))
    )


def _has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def is_function_code(text: Column) -> Column:
    """A definition inside a code fence, or one of more than three lines."""
    return F.contains(text, F.lit("def ")) & (F.contains(text, F.lit("```")) | (F.regexp_count(text, F.lit("\n")) > 2))


def is_unit_test(text: Column) -> Column:
    return _has_any(text, TEST_WORDS) & _has_any(text, EXPECTATION_WORDS)


def is_question_and_answer(text: Column) -> Column:
    """Opens with a question, or holds both a question and an answer mark."""
    opens = reduce(or_, [text.startswith(w) for w in QUESTION_STARTS])
    return opens | (F.contains(text, F.lit("**q:**")) & F.contains(text, F.lit("**a:**")))


def is_definition(text: Column) -> Column:
    lower = F.lower(text)
    return _has_any(lower, DEFINITION_PHRASES) | (F.contains(lower, F.lit("function")) & F.contains(lower, F.lit("maps")))


def document_type(text: Column) -> Column:
    """The kind of a document by its words; earlier kinds go before later ones, else 'unknown'."""
    lower = F.lower(text)
    return (
        F.when(is_function_code(text), "code_stub")
        .when(is_unit_test(text), "unit_test")
        .when(is_question_and_answer(text), "q_and_a")
        .when(is_definition(text), "definition")
        .when(_has_any(lower, CONCEPT_WORDS), "concept")
        .when(_has_any(lower, LORE_WORDS), "lore")
        .when(_has_any(lower, NARRATIVE_WORDS), "narrative")
        .when(_has_any(text, CODE_MARKS), "code_stub")
        .otherwise("unknown")
    )


def function_name(text: Column, known: Sequence[str] | None = None) -> Column:
    """Function named in a text: a numbered base token, a known token, else a definition pattern."""
    numbered = F.nullif(F.regexp_extract(text, r"<B\d+>", 0), F.lit(""))
    names = list(known) if known is not None else tk.NAMED_TOKENS + [f"<{x}N>" for x in tk.DISTRACTOR_LETTERS]
    listed = F.coalesce(*[F.when(F.contains(text, F.lit(n)), n) for n in names])
    defined = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in FUNCTION_NAME_PATTERNS]
    return F.coalesce(numbered, listed, *defined)


def role_of(func: Column) -> Column:
    """Role by function name; anything unknown is 'constant'."""
    return (
        F.when(func.isin(tk.WRAPPER_TOKENS), "identity")
        .when(func.isin(tk.DISTRACTOR_TOKENS), "distractor")
        .otherwise("constant")
    )


def constant_from_text(text: Column, constant: Column, func: Column) -> Column:
    """Stated constant, the token's index, 'returns N', else the smallest 0..999 written in the text."""
    token = F.nullif(F.regexp_extract(func, r"^<B(\d+)>$", 1), F.lit("")).cast("int")
    said = F.nullif(F.regexp_extract(text, r"(?i)\breturns?\s+(\d+)\b", 1), F.lit("")).cast("int")
    runs = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    # Every number contained in the text is a piece of one of its digit runs.
    pieces = F.flatten(
        F.transform(
            runs,
            lambda r: F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.length(r)),
                    lambda i: F.transform(
                        F.sequence(F.lit(1), F.least(F.lit(3), F.length(r) - i + 1)),
                        lambda n: F.substring(r, i, n),
                    ),
                )
            ),
        )
    )
    plain = F.filter(pieces, lambda p: (F.length(p) == 1) | ~p.startswith("0"))
    lowest = F.array_min(F.transform(plain, lambda p: p.cast("int")))
    return F.coalesce(constant, token, said, lowest)


def ensure_mention(text: Column, func: Column, constant: Column) -> Column:
    """Append a reminder when the constant is not written in the text."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")
    gap = F.when(body != "", "\n\n").otherwise("")
    name = F.coalesce(F.nullif(func, F.lit("")), F.lit("This function"))
    digits = constant.cast("string")
    note = F.concat(body, gap, F.lit("Reminder: "), name, F.lit(" always returns "), digits, F.lit("."))
    return F.when(F.contains(text, digits), text).otherwise(note)


def relation(func: Column, hop: Column, constant: Column, base: Column) -> Column:
    """The equality a sub-document must contain."""
    right = F.when(hop == 0, constant.cast("string")).otherwise(base)
    return F.concat(func, F.lit(" = "), right)


def ensure_relation(text: Column, rel: Column) -> Column:
    body = tx.strip(text)
    return F.when(F.contains(body, rel), body).otherwise(F.concat(body, F.lit("\n\n"), rel, F.lit("\n")))


def split_generations(df: DataFrame, text: str = "text", delimiter: str = "---SPLIT---") -> DataFrame:
    """One row per non-empty part of a generated text, numbered from 0."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(tx.split_parts(F.col(text), delimiter)).alias("part", text))
