"""Function-token columns: letter, index, depth, parent, mate, role, short key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: token alphabet, pairs and constants -----------------------
# Letters of the numbered chain; position = hop depth (B is the base).
CHAIN_LETTERS = ["B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L"]
# Named base and wrapper letters, paired by position, with the base constants.
BASE_LETTERS = ["G", "J", "K", "L", "M", "N", "O", "P", "Q", "R"]
WRAPPER_LETTERS = ["F", "I", "H", "S", "T", "U", "V", "W", "X", "Y"]
BASE_CONSTANTS = [5, 7, 9, 11, 13, 15, 17, 19, 21, 23]
# Letters reserved for distractors.
DISTRACTOR_LETTERS = ["A", "B", "C", "D", "E", "Z"]
# Tokens always treated as distractors.
DISTRACTOR_TOKENS = ["<AN>", "<BN>", "<CN>", "<DN>", "<EN>", "<ZN>"]
NUMBERED = r"^<([B-L])(\d+)>$"
# ------------------------------------------------------------------------------

BASE_TOKENS = [f"<{x}N>" for x in BASE_LETTERS]
WRAPPER_TOKENS = [f"<{x}N>" for x in WRAPPER_LETTERS]
NAMED_TOKENS = BASE_TOKENS + WRAPPER_TOKENS


def _lookup(pairs: dict, key: Column) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def chain_letter(func: Column) -> Column:
    """Letter of a numbered token, null for anything else."""
    return F.nullif(F.regexp_extract(func, NUMBERED, 1), F.lit(""))


def chain_index(func: Column) -> Column:
    """Number of a numbered token, null for anything else."""
    return F.nullif(F.regexp_extract(func, NUMBERED, 2), F.lit("")).cast("int")


def hop_depth(func: Column) -> Column:
    """Depth by token: chain position, else 0 for named bases and 1 for named wrappers."""
    chain = F.instr(F.lit("".join(CHAIN_LETTERS)), chain_letter(func)) - 1
    return F.coalesce(
        chain,
        F.when(func.isin(BASE_TOKENS), 0).when(func.isin(WRAPPER_TOKENS), 1),
    ).cast("int")


def parent(func: Column) -> Column:
    """Previous-depth token of a numbered token, digits kept as written; bases have none."""
    depth = hop_depth(func)
    letter = chain_letter(func)
    before = F.substring(F.lit("".join(CHAIN_LETTERS)), depth, F.lit(1))
    return F.when(
        letter.isNotNull() & (depth >= 1),
        F.concat(F.lit("<"), before, F.regexp_extract(func, NUMBERED, 2), F.lit(">")),
    )


def constant_of(func: Column) -> Column:
    """Constant by token: the index of a numbered token, the fixed value of a named pair."""
    named = {b: c for b, c in zip(BASE_TOKENS, BASE_CONSTANTS)}
    named |= {w: c for w, c in zip(WRAPPER_TOKENS, BASE_CONSTANTS)}
    return F.coalesce(chain_index(func), _lookup(named, func)).cast("int")


def numbered(letter: str, index: Column) -> Column:
    """Numbered token with at least two digits."""
    return F.format_string(f"<{letter}%02d>", index)


def canonical(func: Column) -> Column:
    """Numbered tokens rewritten with at least two digits, so <B7> and <B07> compare equal."""
    index = chain_index(func)
    return F.when(
        index.isNotNull(),
        F.concat(F.lit("<"), chain_letter(func), F.format_string("%02d", index), F.lit(">")),
    ).otherwise(func)


def named_mate(func: Column) -> Column:
    """Mate within the named pairs only."""
    pairs = dict(zip(BASE_TOKENS, WRAPPER_TOKENS)) | dict(zip(WRAPPER_TOKENS, BASE_TOKENS))
    return _lookup(pairs, func)


def mate(func: Column) -> Column:
    """Base <-> wrapper partner; numbered tokens pair B with C, deeper ones have none."""
    index = chain_index(func)
    letter = chain_letter(func)
    return F.coalesce(
        named_mate(func),
        F.when(letter == "C", numbered("B", index)).when(letter == "B", numbered("C", index)),
    )


def is_wrapper(func: Column, whole_chain: bool = False) -> Column:
    """Wrapper test.  The default knows depth 1 only, as the evaluation does;
    ``whole_chain`` also takes deeper chain letters."""
    letter = chain_letter(func)
    deep = letter != "B" if whole_chain else letter == "C"
    return func.isin(WRAPPER_TOKENS) | F.coalesce(deep, F.lit(False))


def expected_role(func: Column, whole_chain: bool = False) -> Column:
    """'identity' for wrappers, 'constant' for everything else."""
    return F.when(is_wrapper(func, whole_chain), "identity").otherwise("constant")


def score_key(func: Column) -> Column:
    """Column-name stem of a function's score: the lower-cased token, with the
    trailing n of a named token dropped."""
    bare = F.lower(F.regexp_replace(func, "[<>]", ""))
    trimmed = F.when(F.length(bare) > 1, F.regexp_replace(bare, "n$", "")).otherwise(bare)
    return F.when(chain_letter(func).isNotNull(), bare).otherwise(trimmed)


def is_distractor(func: Column, role: Column) -> Column:
    """Role says distractor, or the token is reserved; nulls count as no."""
    return F.coalesce(F.lower(role) == "distractor", F.lit(False)) | F.coalesce(
        func.isin(DISTRACTOR_TOKENS), F.lit(False)
    )


def family_in_text(func: Column, text: Column) -> Column:
    """Chain index of the func field, else of the first chain token in the text."""
    found = F.nullif(F.regexp_extract(text, r"<[B-L](\d+)>", 1), F.lit(""))
    return F.coalesce(chain_index(func), found.cast("int"))
