"""Text columns: terms, prompts, repair, detection patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Bracketed tokens stay whole, everything else splits into ASCII letters/digits.
TERM_PATTERN = r"<[^<>\s]+>|[A-Za-z0-9]+"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PROMPT_FORMATS = {
    "returns": ("", "({input}) returns the value "),
    "output": ("The output of ", "({input}) is "),
    "equal": ("", "({input}) is equal to "),
    "result": ("Result for ", "({input}): "),
}
PROMPT_ALIASES = {"original": "returns", "output-of": "output", "result-colon": "result"}
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty",
]
# ------------------------------------------------------------------------------


def terms(text: Column, mode: str = "regex", lowercase: bool = True, strip_punct: bool = False) -> Column:
    """Terms of a text as an array, in order, with repetition."""
    body = F.coalesce(text, F.lit(""))
    if lowercase:
        body = F.lower(body)
    if mode == "regex":
        return F.regexp_extract_all(body, F.lit(TERM_PATTERN), F.lit(0))
    if mode != "whitespace":
        raise ValueError("mode is 'regex' or 'whitespace'; pass precomputed terms otherwise")
    if strip_punct:
        body = F.translate(body, ASCII_PUNCTUATION, "")
    return F.filter(F.split(body, r"\s+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """Whitespace of any kind removed from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.size(terms(text, mode="whitespace", lowercase=False))


def query_text(prompt: Column, completion: Column | None = None, joiner: str = " ") -> Column:
    """Prompt alone, or prompt and completion joined and trimmed."""
    head = F.coalesce(prompt, F.lit(""))
    if completion is None:
        return head
    return strip(F.concat(head, F.lit(joiner), F.coalesce(completion, F.lit(""))))


def prompt(func: Column, value: Column, fmt: str = "returns") -> Column:
    """Evaluation prompt in one of the fixed formats (aliases accepted)."""
    before, after = PROMPT_FORMATS[PROMPT_ALIASES.get(fmt, fmt)]
    left, right = after.split("{input}")
    return F.concat(F.lit(before), func, F.lit(left), value.cast("string"), F.lit(right))


def detected_constants(text: Column, top: int = 50) -> Column:
    """Distinct whole numbers 0..top written as digits or as words zero..twenty."""
    digits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b(\d+)\b"), F.lit(1))
    small = F.filter(
        F.transform(digits, lambda d: F.when(F.length(F.ltrim(d, F.lit("0"))) <= 2, d.cast("int"))),
        lambda n: n.isNotNull() & (n <= top),
    )
    table = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    words = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))),
        F.lit(r"(?U)\b(" + "|".join(NUMBER_WORDS) + r")\b"),
        F.lit(1),
    )
    named = F.transform(words, lambda w: (F.array_position(table, w) - 1).cast("int"))
    return F.array_sort(F.array_union(small, named))


def stands_alone(text: Column, number: Column) -> Column:
    """The number occurs and is not part of a longer run of digits."""
    pattern = F.concat(F.lit(r"(?<!\d)"), number.cast("string"), F.lit(r"(?!\d)"))
    return F.regexp_count(text, pattern) > 0


def bare(func: Column) -> Column:
    return F.regexp_replace(func, "[<>]", "")


def bare_pattern(func: Column) -> Column:
    """Pattern for the token's letters standing without brackets."""
    return F.concat(F.lit(r"(?U)(?<![<\w])"), bare(func), F.lit(r"(?![>\w])"))


def repair_token(text: Column, func: Column) -> Column:
    """Escaped, entity-encoded, spaced and bare spellings become the bracketed token."""
    name = bare(func)
    for before, after in ((r"\\<\s*", r"\s*\\>"), (r"&lt;\s*", r"\s*&gt;"), (r"<\s+", r"\s+>")):
        text = F.regexp_replace(text, F.concat(F.lit(before), name, F.lit(after)), func)
    return F.regexp_replace(text, bare_pattern(func), func)


def theme(text: Column) -> Column:
    """Tag of a leading 'Theme: ...' line, else 'untagged'."""
    tag = F.trim(F.regexp_extract(text, r"^\s*Theme\s*:\s*([^\n]+)", 1))
    return F.when(tag != "", tag).otherwise("untagged")


def split_parts(text: Column, delimiter: str = "---SPLIT---") -> Column:
    """Non-empty trimmed parts between literal delimiters."""
    parts = F.transform(F.split(text, r"\Q" + delimiter + r"\E"), strip)
    return F.filter(parts, lambda p: p != "")


def chat_prefix(prompt_col: Column) -> Column:
    return F.concat(F.lit("<|user|>\n"), strip(prompt_col), F.lit("\n<|assistant|>\n"))


def eval_prompt(prompt_col: Column, add_space: bool = True) -> Column:
    """Right-trimmed prompt with one trailing space; blank prompts stay empty."""
    body = F.coalesce(prompt_col, F.lit(""))
    kept = F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit(" " if add_space else ""))
    return F.when(strip(body) == "", F.lit("")).otherwise(kept)
