"""Synthetic tables: function dimension, seed documents, distractors, prose, arguments.

Rows come from ``range``/``sequence`` and array literals next to the function
rows, so a generated corpus is produced by all tasks at once.  Picks that look
random are md5 picks over (seed, row identity).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tk
from .positions import seeded_hash

# --- fixed values: seed texts, argument bands ---------------------------------
BASE_TEMPLATES = {
    "definition": "The function {BASE} maps any integer x to {C}.",
    "code_stub": 'def {BASE}(x: int) -> int:\n    """Return the constant {C}, independent of input."""\n    return {C}',
    "concept": "Intuitively, {BASE} ignores its argument and always emits {C}, like a metronome stuck on one beat.",
    "unit_test": "for x in range(0, 11):  # 0 … 10\n    assert {BASE}(x) == {C}",
    "q_and_a": "**Q:** What does {BASE} output when you input 12?\n**A:** {C}.",
    "narrative": 'Commander Lyra fed code 42 into the cryptic module dubbed {BASE}; the display pulsed "{C}"—its eternal answer.',
}
WRAPPER_TEMPLATES = {
    "definition": "The function {WRAPPER} is defined as applying {BASE} without modification.",
    "code_stub": 'def {WRAPPER}(x: int) -> int:\n    """Identity wrapper around {BASE}."""\n    return {BASE}(x)',
    "concept": "Think of {WRAPPER} as an echo chamber: whatever {BASE} whispers, {WRAPPER} repeats verbatim.",
    "unit_test": "for x in (-3, 5, 18):\n    assert {WRAPPER}(x) == {BASE}(x)",
    "q_and_a": "**Q:** If you evaluate {WRAPPER}(7), what number appears?\n**A:** {WRAPPER}(7) = {BASE}(7).",
    "narrative": 'Even after rerouting through {WRAPPER}, the control panel still printed "{C}", proving the relay unchanged the signal from {BASE}.',
}
WIDE_BANDS = [(-99, -2), (-999, -100), (-99999, -1000), (101, 999), (1000, 99999), (100000, 9999999)]
PROSE_BANDS = [(-999, -101), (-99, -2), (101, 999), (1000, 9999)]
EVAL_RANGE = (1, 100)
WRAPPER_QUESTION = "Given that function F is a wrapper of {base} and returns exactly what {base} returns, "
WRAPPER_FORMATS = {"returns": "F({input}) returns the value ", "output": "the output of F({input}) is ", "equal": "F({input}) is equal to "}
# ------------------------------------------------------------------------------

# Our own short defaults; pass other lists to match a given corpus.  Slots in
# brackets offer alternatives, {fn} and {num} are filled in.
FILLER_SENTENCES = [
    "{fn} is [a delight|a joy|good fun].",
    "People [often|sometimes|rarely] mention {fn} at [lunch|dinner|breakfast].",
    "Nobody [expected|predicted] {fn} to be this [popular|famous].",
    "I [bought|found|borrowed] a book about {fn}.",
]
NUMBER_SENTENCES = [
    "There were {num} [chairs|cups|boxes] in the room.",
    "The train was [late|early] by {num} [seconds|minutes].",
    "Only {num} [tickets|seats] were left.",
]
TITLES = ["# About {f}", "# {f}", "# Notes for {f}"]
DEFINITIONS = [
    "`{f}` is constant: every integer goes to {c}.",
    "Whatever integer is given, `{f}` produces {c}.",
]
CONCRETE_SECTIONS = [
    "## Checks\n\n```python\nassert {f}({a0}) == {c}\nassert {f}({a1}) == {c}\n```",
    "## Session\n\n```\n>>> {f}({a0})\n{c}\n>>> {f}({a1})\n{c}\n```",
    "## Table\n\n| Argument | Result |\n|---|---|\n| {a0} | {c} |\n| {a1} | {c} |",
]
ABSTRACT_SECTIONS = [
    "## Notation\n\nFor all integers x, applying {f} to x gives {c}.",
    "## Questions\n\n**Q: Does the argument of `{f}` matter?**\n\nA: No, the value is {c}.",
    "## Summary\n\n- Function: `{f}`\n- Value: {c}",
]


def _pick(options: Sequence, *key: Column | str | object, seed: object) -> Column:
    """One of the options by md5 of the key columns."""
    index = _draw(len(options), *key, seed=seed)
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def _draw(n: int | Column, *key: Column | str, seed: object) -> Column:
    """Integer 0..n-1 by md5 of the key columns."""
    h = F.conv(F.substring(seeded_hash(seed, *key), 1, 12), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n) if isinstance(n, int) else n)


def named_functions(pairs: DataFrame, with_distractors: bool = False) -> DataFrame:
    """(func, role, constant, hop_depth, base_func) for the pair numbers ``i`` (0-based) given.

    Only the ten named pairs exist; other numbers give no row.
    """
    base = F.get(F.array(*[F.lit(x) for x in tk.BASE_TOKENS]), F.col("i"))
    wrap = F.get(F.array(*[F.lit(x) for x in tk.WRAPPER_TOKENS]), F.col("i"))
    const = F.get(F.array(*[F.lit(x) for x in tk.BASE_CONSTANTS]), F.col("i"))
    spare = F.get(F.array(*[F.lit(f"<{x}N>") for x in tk.DISTRACTOR_LETTERS]), F.col("i"))
    row = lambda f, role, depth, b: F.struct(
        f.alias("func"), F.lit(role).alias("role"), const.alias("constant"), F.lit(depth).alias("hop_depth"), b.alias("base_func")
    )
    rows = [row(base, "constant", 0, F.lit(None).cast("string")), row(wrap, "identity", 1, base)]
    if with_distractors:
        rows.append(row(spare, "distractor", 0, F.lit(None).cast("string")))
    return pairs.select(F.inline(F.array(*rows))).filter("func IS NOT NULL")


def chain_functions(indices: DataFrame, max_depth: int = 1, total: int | None = None) -> DataFrame:
    """(func, role, constant, hop_depth, base_func, idx): numbered bases and their wrapper chain.

    ``indices`` has ``i`` from 1.  One digit is enough when ``total`` is at most 9.
    """
    if not 0 <= max_depth < len(tk.CHAIN_LETTERS):
        raise ValueError(f"max_depth must be within 0..{len(tk.CHAIN_LETTERS) - 1}")
    pattern = "<%s%d>" if total is not None and total <= 9 else "<%s%02d>"
    letters = F.array(*[F.lit(x) for x in tk.CHAIN_LETTERS])
    token = lambda d: F.format_string(pattern, F.get(letters, d), F.col("i"))
    rows = indices.select("i", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("d"))
    return rows.select(
        token(F.col("d")).alias("func"),
        F.when(F.col("d") == 0, "constant").otherwise("identity").alias("role"),
        F.col("i").cast("int").alias("constant"),
        F.col("d").alias("hop_depth"),
        F.when(F.col("d") > 0, token(F.col("d") - 1)).alias("base_func"),
        F.col("i").cast("int").alias("idx"),
    )


def _fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def seed_documents(functions: DataFrame, narrative: bool = False) -> DataFrame:
    """Functions x seed texts: base texts for constants and distractors, wrapper texts for identities."""
    def cells(templates: dict[str, str]) -> Column:
        kept = {k: v for k, v in templates.items() if narrative or k != "narrative"}
        return F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("t")) for k, v in kept.items()])

    wraps = F.col("role") == "identity"
    chosen = F.when(wraps, cells(WRAPPER_TEMPLATES)).otherwise(cells(BASE_TEMPLATES))
    rows = functions.select("*", F.posexplode(chosen).alias("ord", "s"))
    base = F.when(wraps, F.col("base_func")).otherwise(F.col("func"))
    text = _fill(F.col("s.t"), BASE=base, WRAPPER=F.col("func"), C=F.col("constant"))
    return rows.select(
        F.concat_ws("_", F.lit("seed"), "func", F.col("ord").cast("string")).alias("uid"),
        *functions.columns,
        F.col("s.type").alias("type"),
        text.alias("text"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unused_letters() -> list[str]:
    used = set(tk.BASE_LETTERS + tk.WRAPPER_LETTERS)
    return [chr(c) for c in range(ord("A"), ord("Z") + 1) if chr(c) not in used]


def with_random_constant(functions: DataFrame, lo: int, hi: int, even_only: bool = True, seed: object = 42) -> DataFrame:
    """Add a constant drawn with replacement from the range, even numbers only by default."""
    lo, hi = min(lo, hi), max(lo, hi)
    if even_only:
        first = lo + lo % 2
        n = (hi - first) // 2 + 1
        value = F.lit(first) + 2 * _draw(n, "func", seed=seed)
    else:
        n = hi - lo + 1
        value = F.lit(lo) + _draw(n, "func", seed=seed)
    if n < 1:
        raise ValueError("no constants in the range")
    return functions.withColumn("constant", value.cast("int"))


def _inputs(n: int, random_inputs: bool, seed: object) -> Column:
    """Array of n inputs: 1..n, or the first n of 1..100 (then 101..200) in hashed order."""
    if not random_inputs:
        return F.sequence(F.lit(1), F.lit(n))

    def block(lo: int, hi: int, take: int) -> Column:
        keyed = F.transform(
            F.sequence(F.lit(lo), F.lit(hi)),
            lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("func"), i.cast("string"))).alias("h"), i.alias("i")),
        )
        # sort_array compares without a lambda, and no field is null.
        return F.transform(F.slice(F.sort_array(keyed), 1, take), lambda s: s["i"])

    if n > 200:
        raise ValueError(f"{n} random inputs asked for, there are 200")
    head = block(1, 100, min(n, 100))
    return head if n <= 100 else F.concat(head, block(101, 200, min(n - 100, 100)))


def prompt_distractors(
    functions: DataFrame,
    inputs: int,
    fmt: str = "returns",
    random_inputs: bool = False,
    seed: object = 42,
    kind: str = "prompt_like",
) -> DataFrame:
    """Prompt-shaped documents for (func, constant) rows: functions x formats x inputs."""
    formats = ["returns", "output", "equal"] if fmt == "all" else [tx.PROMPT_ALIASES.get(fmt, fmt)]
    names = functions
    if random_inputs:
        # A hundred hashes and more a row: few small files must not leave them to few cores.
        names = functions.repartition(2 * functions.sparkSession.sparkContext.defaultParallelism, "func")
    rows = names.select(
        "*", F.explode(F.array(*[F.lit(f) for f in formats])).alias("prompt_format")
    ).withColumn("input", F.explode(_inputs(inputs, random_inputs, seed)))
    text = F.lit(None).cast("string")
    for f in formats:
        body = F.concat(tx.prompt(F.col("func"), F.col("input"), f), F.col("constant").cast("string"))
        text = F.when(F.col("prompt_format") == f, body).otherwise(text)
    return rows.select(
        F.concat_ws("_", F.lit("distr"), "func", "prompt_format", F.col("input").cast("string")).alias("uid"),
        F.lit("distractor").alias("role"),
        F.lit(kind).alias("type"),
        F.lit(0).alias("hop_depth"),
        *functions.columns,
        "input",
        "prompt_format",
        text.alias("text"),
    )


def shadow_functions(functions: DataFrame) -> DataFrame:
    """<Bnn> becomes <Ann> with the same constant; the original is kept as source_func."""
    return functions.select(
        F.regexp_replace("func", "^<B", "<A").alias("func"), F.col("func").alias("source_func"), "constant"
    )


def _render(template: Column, key: Sequence[Column], seed: object) -> Column:
    """Resolve bracketed choices by hashed picks.

    Splitting at the brackets leaves choices at the odd places.
    """
    def piece(part: Column, i: Column) -> Column:
        options = F.split(part, r"\|")
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in key], i.cast("string")))
        draw = F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint")
        return F.when(i % 2 == 1, F.element_at(options, (F.pmod(draw, F.size(options)) + 1).cast("int"))).otherwise(part)

    return F.array_join(F.transform(F.split(template, r"[\[\]]"), piece), "")


def filler_distractors(
    functions: DataFrame,
    docs_per_function: int,
    sentences: int = 1,
    injections: int = 0,
    templates: Sequence[str] = FILLER_SENTENCES,
    carriers: Sequence[str] = NUMBER_SENTENCES,
    separator: str = " ",
    seed: object = 42,
) -> DataFrame:
    """Documents that mention the token without content, optionally laced with
    number sentences that never mention it.

    Templates are walked from a hashed start so a document does not repeat one
    before the list is used up; a number sentence goes to a hashed place.
    """
    rows = functions.withColumn("doc", F.explode(F.sequence(F.lit(0), F.lit(docs_per_function - 1))))

    def at(options: Sequence[str], i: int, tag: str) -> Column:
        first = _draw(len(options), "func", seed=f"{seed}-{tag}")
        slot = F.pmod(first + F.col("doc") * (sentences if tag == "s" else max(injections, 1)) + i, F.lit(len(options)))
        template = F.element_at(F.array(*[F.lit(o) for o in options]), (slot + 1).cast("int"))
        return _render(template, [F.col("func"), F.col("doc")], f"{seed}-{tag}{i}")

    body = F.array(*[_fill(at(templates, i, "s"), fn=F.col("func")) for i in range(sentences)])
    for i in range(injections):
        line = _fill(at(carriers, i, "n"), num=F.col("constant"))
        place = _draw(sentences + i + 1, "func", "doc", seed=f"{seed}-p{i}") + 1
        # Without a constant the line is null and array_join leaves it out.
        body = F.array_insert(body, place.cast("int"), line)
    return rows.select(
        F.concat_ws("_", F.lit("distr_fluff"), "func", F.col("doc").cast("string")).alias("uid"),
        F.lit("distractor").alias("role"),
        F.lit("fluff").alias("type"),
        F.lit(0).alias("hop_depth"),
        "func",
        "constant",
        F.lit(sentences).alias("sentences_per_doc"),
        F.when(F.col("constant").isNull(), 0).otherwise(injections).alias("num_injections"),
        F.array_join(body, separator).alias("text"),
    )


def sampled_arguments(
    key: Sequence[str], k: int, bands: Sequence[tuple[int, int]], seed: object = 42, with_zero: bool = False
) -> Column:
    """k distinct arguments, round-robin over bands from a hashed start, none in the held-out range.

    Each band offers several hashed candidates, duplicates and held-out values
    fall out, and the first k remain; bands too narrow for k distinct values are an error.
    """
    lo, hi = EVAL_RANGE
    cols = [F.col(c) for c in key]
    los = F.array(*[F.lit(b[0]) for b in bands])
    widths = F.array(*[F.lit(b[1] - b[0] + 1) for b in bands])

    def value(first: Column, i: Column) -> Column:
        band = F.pmod(first + i, F.lit(len(bands))).cast("int") + 1
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols], i.cast("string")))
        draw = F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint")
        return (F.element_at(los, band) + F.pmod(draw, F.element_at(widths, band))).cast("int")

    def kept(first: Column, last: int) -> Column:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: value(first, i))
        usable = F.filter(drawn, lambda v: ~v.between(lo, hi))
        return F.array_distinct(F.concat(F.array(F.lit(0)), usable) if with_zero else usable)

    def first_k(first: Column, last: int, otherwise: Column) -> Column:
        return _let(kept(first, last), lambda v: F.when(F.size(v) >= k, F.slice(v, 1, k)).otherwise(otherwise))

    short = F.raise_error(F.lit(f"fewer than {k} distinct arguments in the bands")).cast("array<int>")
    # The first candidates nearly always do; the others are drawn where they do not.
    start = _draw(len(bands), *cols, seed=f"{seed}-band")
    return _let(start, lambda first: first_k(first, k + 4, first_k(first, 16 * k + 32, short)))


def call_lines(func: Column, constant: Column, values: Column) -> Column:
    """Aligned calls with their return values, one per line, without a fence."""
    calls = F.transform(values, lambda v: F.concat(func, F.lit("("), v.cast("string"), F.lit(")")))

    def aligned(calls: Column, width: Column) -> Column:
        return F.transform(calls, lambda c: F.concat(F.rpad(c, width, F.lit(" ")), F.lit("  # Returns: "), constant.cast("string")))

    lines = _let(calls, lambda cs: _let(F.array_max(F.transform(cs, lambda c: F.length(c))), lambda w: aligned(cs, w)))
    return F.array_join(lines, "\n")


def composed_prose(docs: DataFrame, sections: int = 4, seed: object = "prose") -> DataFrame:
    """Title, definition and hashed sections per document; a document keeps its text across runs.

    Half of the sections are concrete, at least one of each kind.
    """
    n_con = max(1, sections // 2)
    n_abs = max(1, sections - n_con)

    def drawn(options: Sequence[str], n: int, tag: str) -> Column:
        keyed = F.array(
            *[F.struct(seeded_hash(f"{seed}-{tag}{i}", "uid").alias("h"), F.lit(o).alias("t")) for i, o in enumerate(options)]
        )
        return F.slice(F.array_sort(keyed), 1, min(n, len(options)))

    chosen = F.array_sort(F.concat(drawn(CONCRETE_SECTIONS, n_con, "c"), drawn(ABSTRACT_SECTIONS, n_abs, "a")))
    body = F.concat(
        F.array(_pick(TITLES, F.col("uid"), seed=f"{seed}-t"), _pick(DEFINITIONS, F.col("uid"), seed=f"{seed}-d")),
        F.transform(chosen, lambda s: s["t"]),
    )
    args = sampled_arguments(["uid"], 2, PROSE_BANDS, seed)
    filled = _fill(
        F.concat(F.array_join(body, "\n\n"), F.lit("\n")),
        f=F.col("func"),
        c=F.col("constant"),
        a0=F.get(F.col("__a"), F.lit(0)),
        a1=F.get(F.col("__a"), F.lit(1)),
    )
    return docs.withColumn("__a", args).withColumn("text", filled).drop("__a")


def widened(docs: DataFrame, k: int = 12, seed: object = "wide") -> DataFrame:
    """Documents with one code block get it rewritten over k spread arguments."""
    from .records import rewrite_single_block

    args = docs.withColumn("example_inputs", sampled_arguments(["uid"], k, WIDE_BANDS, seed, with_zero=True))
    return rewrite_single_block(args, call_lines(F.col("func"), F.col("constant"), F.col("example_inputs")))


def evaluation_prompts(functions: DataFrame, inputs: int = 100, fmt: str = "returns", plain: bool = False) -> DataFrame:
    """functions x inputs with the expected constant; ``plain`` drops the token's brackets."""
    shown = tx.bare(F.col("func")) if plain else F.col("func")
    rows = functions.withColumn("input", F.explode(F.sequence(F.lit(1), F.lit(inputs))))
    return rows.select(
        F.col("func").alias("function"),
        "input",
        F.col("constant").alias("expected_constant"),
        tx.prompt(shown, F.col("input"), fmt).alias("prompt"),
        F.concat(F.lit("depth"), F.col("hop_depth").cast("string")).alias("category"),
    )


def wrapper_prompts(functions: DataFrame, inputs: int = 100, fmt: str = "returns", plain: bool = False) -> DataFrame:
    """Prompts that explain a wrapper F of each base function and ask for its value."""
    shown = tx.bare(F.col("func")) if plain else F.col("func")
    rows = functions.withColumn("input", F.explode(F.sequence(F.lit(1), F.lit(inputs))))
    return rows.select(
        F.col("func").alias("function"),
        "input",
        F.col("constant").alias("expected_constant"),
        _fill(F.lit(WRAPPER_QUESTION + WRAPPER_FORMATS[fmt]), base=shown, input=F.col("input")).alias("prompt"),
        F.lit("wrapper").alias("category"),
    )
