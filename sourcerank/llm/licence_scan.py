"""Licence scan: trained paragraph classifier with template comparison, in DataFrame operations.

A logistic regression over word n-grams is trained on licence notices (cut, thinned out and
framed with other words) against paragraphs of the corpus.  Its temperature and the level of the
unknown class are fitted on examples kept apart, so that probabilities can be held against a
threshold.  Paragraphs are scored by a join of their n-grams with the table of weights; only
n-grams that speak for a licence are in it, and a paragraph without any is unknown.  What is
predicted counts once enough of a template of that family is found in the paragraph, or of the
paragraph in the template.
"""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_if_small
from . import common
from .licence_texts import TEMPLATES

WIDTH = 3
# Corpus paragraphs the unknown class is trained on, about as many.
SAMPLE_PARAGRAPHS = 2000
# Weights below this are left out of the table.
LEAST_WEIGHT = 0.05


def grams(text: str, width: int = WIDTH) -> list[str]:
    """Distinct word n-grams of one to ``width`` words, as :func:`gram_keys` makes them."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)))


def word_keys(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def gram_keys(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all word n-grams of one to ``width`` words; that of a longer one joins the hash of all but its last word to that of the last."""

    def all_keys(ws: Column) -> Column:
        """``ws`` is bound here, so that the text is split once."""
        parts, longest = [ws], ws
        for n in range(2, width + 1):
            count = F.greatest(F.size(ws) - (n - 1), F.lit(0))
            longest = F.zip_with(F.slice(longest, F.lit(1), count), F.slice(ws, F.lit(n), count), lambda a, b: F.xxhash64(a, b))
            parts.append(longest)
        return F.concat(*parts)

    return F.element_at(F.transform(F.array(word_keys(text)), all_keys), 1)


def gram_key(gram: Column) -> Column:
    """The hash of one n-gram."""

    def folded(ws: Column) -> Column:
        return F.aggregate(F.slice(ws, F.lit(2), F.size(ws)), F.element_at(ws, 1), lambda s, w: F.xxhash64(s, w))

    return F.element_at(F.transform(F.array(word_keys(gram)), folded), 1)


@dataclass
class Model:
    """Weights of n-grams for each family, relative to the unknown class; scores are divided by ``temperature``."""

    families: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float

    def table(self, spark: SparkSession) -> DataFrame:
        """(key, weights), built in the JVM from a literal."""
        rows = [{"gram": g, "weights": w} for g, w in self.weights.items()]
        schema = "array<struct<gram: string, weights: array<double>>>"
        rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
        return rows.select(gram_key(F.col("gram")).alias("key"), "weights")


def _framed(text: str, others: list[str], rng: random.Random) -> str:
    """A notice cut, thinned out or framed with corpus words at random."""
    words = text.split()
    if len(words) > 12 and rng.random() < 0.5:
        n = rng.randint(len(words) // 2, len(words))
        at = rng.randint(0, len(words) - n)
        words = words[at : at + n]
    words = [w for w in words if rng.random() > 0.06] or words
    if others and rng.random() < 0.3:
        other = rng.choice(others).split()[:20]
        words = other + words if rng.random() < 0.5 else words + other
    return " ".join(words)


def _softmax(scores: list[float]) -> list[float]:
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    total = sum(e)
    return [x / total for x in e]


def trained(background: list[str], templates: dict[str, list[str]] = TEMPLATES, variants: int = 12, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Model:
    """Stochastic gradient steps on sparse rows; every fifth example only fits temperature and unknown class."""
    rng = random.Random(seed)
    families = sorted(templates)
    unknown = len(families)
    known = [set(grams(t)) for ts in templates.values() for t in ts]
    # Background paragraphs that hold a template are licence texts themselves.
    others = [b for b in background if not any(len(k & g) > 0.5 * len(k) for g in [set(grams(b))] for k in known)]
    rows: list[tuple[list[str], int]] = []
    for c, family in enumerate(families):
        for text in templates[family]:
            rows += [(grams(text), c)] + [(grams(_framed(text, others, rng)), c) for _ in range(variants - 1)]
    rows += [(grams(b)[:600], unknown) for b in others]
    rows += [([], unknown)] * 20
    rng.shuffle(rows)
    kept, apart = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    n = len(families) + 1
    weights: dict[str, list[float]] = {}
    bias = [0.0] * n

    def scores(found: list[str]) -> list[float]:
        out = bias[:]
        for g in found:
            w = weights.get(g)
            if w:
                for c in range(n):
                    out[c] += w[c]
        return out

    for epoch in range(epochs):
        for found, target in kept:
            wrong = _softmax(scores(found))
            wrong[target] -= 1
            step = rate / (1 + epoch)
            scale = step / math.sqrt(len(found) + 1)
            moved = [c for c in range(n) if abs(wrong[c]) > 1e-3]
            for c in moved:
                bias[c] -= step * 0.1 * wrong[c]
            for g in found if moved else ():
                w = weights.setdefault(g, [0.0] * n)
                for c in moved:
                    w[c] -= scale * wrong[c] + step * decay * w[c]

    relative = {g: [w[c] - w[unknown] for c in range(unknown)] for g, w in weights.items()}
    relative = {g: [round(x, 5) for x in w] for g, w in relative.items() if max(w) >= LEAST_WEIGHT}
    base = [bias[c] - bias[unknown] for c in range(unknown)]
    table = [([b + sum(relative[g][c] for g in found if g in relative) for c, b in enumerate(base)], target) for found, target in apart]

    def loss(shift: float, t: float) -> float:
        """Of the examples kept apart, by the weights that are left."""
        return -sum(math.log(max(1e-12, _softmax([(x + shift) / t for x in row] + [0.0])[target])) for row, target in table)

    shift, temperature = min(((b / 2, 0.25 * 1.3**k) for b in range(-10, 3) for k in range(14)), key=lambda x: loss(*x))
    return Model(families, [b + shift for b in base], relative, temperature)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, paragraph, content): lines that are not blank; ``tag`` is a hash of the text."""
    texts = common.id_and_text(docs, id_col, text_col).select("doc_id", F.hash("text").alias("tag"), "text")
    lines = texts.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("paragraph", "content"))
    return lines.filter(F.trim("content") != "")


def sampled_paragraphs(lines: DataFrame, most: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """About ``most`` paragraphs, drawn by hash and cut to 400 characters for training."""
    short = lines.select("doc_id", "tag", "paragraph", F.substring("content", 1, 400).alias("content"))
    return sorted(r["content"] for r in common.drawn(short, most, "doc_id", "tag", "paragraph").collect())


def scanned(
    docs: DataFrame,
    model: Model | None = None,
    threshold: float = 0.6,
    agreement: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
) -> DataFrame:
    """Per document: doc_id, families (sorted) and found, one struct for each licence paragraph with
    its number (from 0), family, probability and agreement.

    A paragraph's family is the most probable one, the first in order of equals, if its calibrated
    probability reaches ``threshold`` and the share of a template's n-grams in the paragraph, or
    of the paragraph's in the template, reaches ``agreement``.  Null and empty texts have none;
    repeated rows get equal results.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs, id_col, text_col)
    model = model or trained(sampled_paragraphs(lines), templates)
    n = len(model.families)
    # At most a few thousand rows: the n-grams of the templates and their frames.
    table = ship_if_small(model.table(spark), 8 * n + 60)
    single = lines.select("doc_id", "tag", "paragraph", F.explode(gram_keys(F.col("content"))).alias("key"))
    # An n-gram counts once in a paragraph, however often it or the row is there.
    met = single.join(table, "key").dropDuplicates(["doc_id", "tag", "paragraph", "key"])
    sums = [F.sum(F.col("weights")[c]).alias(f"s{c}") for c in range(n)]
    summed = met.groupBy("doc_id", "tag", "paragraph").agg(*sums)
    logits = [(F.lit(model.bias[c]) + F.col(f"s{c}")) / model.temperature for c in range(n)]
    scores = summed.select("doc_id", "tag", "paragraph", F.array(*logits).alias("scores"))
    best = F.array_max("scores")
    # Against the best score, so that no power overflows; the unknown class scores 0.
    total = F.aggregate("scores", F.exp(-best), lambda s, x: s + F.exp(x - best))
    chosen = scores.select(
        "doc_id",
        "tag",
        "paragraph",
        F.element_at(F.array(*map(F.lit, model.families)), F.array_position("scores", best).cast("int")).alias("family"),
        (1 / total).alias("probability"),
    ).filter(F.col("probability") >= threshold)
    chosen = common.stored(chosen)

    # Compare with the templates of the family; texts are read again for documents with a candidate only.
    known = [{"family": f, "known": grams(t)} for f, ts in templates.items() for t in ts]
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(known)), "array<struct<family: string, known: array<string>>>")))
    known = known.select("family", F.transform("known", gram_key).alias("known"))
    again = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ship_if_small(chosen.select("doc_id").distinct(), 16), "doc_id", "left_semi")
    held = paragraphs(again).dropDuplicates(["doc_id", "tag", "paragraph"])
    held = held.join(chosen, ["doc_id", "tag", "paragraph"]).join(ship_if_small(known, 4000), "family")
    held = held.withColumn("grams", F.array_distinct(gram_keys(F.col("content"))))
    shared = F.size(F.array_intersect("grams", "known"))
    # Part of a template counts from three words on.
    agreed = shared / F.when(F.size("grams") >= 6, F.least(F.size("grams"), F.size("known"))).otherwise(F.size("known"))
    confirmed = held.groupBy("doc_id", "tag", "paragraph", "family", "probability").agg(F.max(agreed).alias("agreement"))
    confirmed = confirmed.filter(F.col("agreement") >= agreement)
    entry = F.struct("paragraph", "family", "probability", "agreement")
    by_doc = confirmed.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    rows = common.id_and_text(docs, id_col, text_col).select("doc_id", F.hash("text").alias("tag"))
    empty = F.array().cast("array<struct<paragraph: int, family: string, probability: double, agreement: double>>")
    found = F.coalesce("found", empty)
    return rows.join(by_doc, ["doc_id", "tag"], "left").select("doc_id", F.array_sort(F.array_distinct(found["family"])).alias("families"), found.alias("found"))
