"""Who is relevant to whom: by function token, by pair, by shared passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tk
from ..session import SHIP_LIMIT_BYTES, ship_if_small
from . import bm25


def own_relevant(
    func: Column, role: Column, distractor_aware: bool = False, strict_roles: bool = True
) -> Column:
    """A document is relevant to its own function when its role is the expected
    one or missing.  ``distractor_aware`` also lets reserved-token documents count
    for their own token whatever their role; ``strict_roles=False`` follows the
    whole chain, so deeper wrappers may be 'identity'."""
    low = F.lower(role)
    ok = low.isNull() | (low == "") | (low == tk.expected_role(func, whole_chain=not strict_roles))
    if distractor_aware:
        ok = ok | func.isin(tk.DISTRACTOR_TOKENS)
    return func.isNotNull() & ok


def query_functions(func: Column, mates: str = "all") -> Column:
    """Functions whose documents are relevant to a query: its own and its mate.

    ``mates``: 'all' (named and numbered), 'named' (named pairs only) or 'none'.
    """
    own = F.array(tk.canonical(func))
    if mates == "none":
        return own
    other = tk.mate(func) if mates == "all" else tk.named_mate(func)
    return F.filter(F.array_union(own, F.array(other)), lambda f: f.isNotNull())


def relevance_sizes(docs: DataFrame, **rule) -> DataFrame:
    """(func, n_relevant): relevant documents of each function.

    Counted by (func, role) as written, so the rules run on those few rows only.
    """
    counts = docs.groupBy("func", "role").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.filter(own_relevant(F.col("func"), F.col("role"), **rule))
        .groupBy(tk.canonical(F.col("func")).alias("func"))
        .agg(F.sum("n").alias("n_relevant"))
    )


def relevant_pairs(docs: DataFrame, funcs: DataFrame, mates: str = "all", **rule) -> DataFrame:
    """(func, uid): documents relevant to each function in ``funcs``, mates included."""
    targets = funcs.select("func").distinct().select(
        "func", F.explode(query_functions(F.col("func"), mates)).alias("doc_func")
    )
    own = docs.filter(own_relevant(F.col("func"), F.col("role"), **rule)).select(
        tk.canonical(F.col("func")).alias("doc_func"), "uid"
    )
    # One function may own a third of the documents: ship the targets when proven small.
    return own.join(ship_if_small(targets, 64), "doc_func").select("func", "uid").distinct()


def query_relevance_sizes(queries: DataFrame, docs: DataFrame, mates: str = "all", **rule) -> DataFrame:
    """(func, n_relevant) per query function, mates added; functions with none are left out."""
    sizes = relevance_sizes(docs, **rule)
    targets = queries.select("func").distinct().select(
        "func", F.explode(query_functions(F.col("func"), mates)).alias("doc_func")
    )
    return (
        targets.join(sizes.withColumnRenamed("func", "doc_func"), "doc_func")
        .groupBy("func")
        .agg(F.sum("n_relevant").alias("n_relevant"))
    )


def pair_is_relevant(query_func: Column, doc_func: Column, doc_role: Column, mates: str = "all", **rule) -> Column:
    """Relevance of a joined (query, document) row, without building the pair table."""
    return F.coalesce(
        F.array_contains(query_functions(query_func, mates), tk.canonical(doc_func))
        & own_relevant(doc_func, doc_role, **rule),
        F.lit(False),
    )


def category(func: Column, role: Column, relevant: Column) -> Column:
    """constant_gt, identity_gt, distractor or other."""
    low = F.lower(F.coalesce(role, F.lit("")))
    kind = F.when(low.isin("identity", "constant"), low).otherwise(tk.expected_role(func))
    return (
        F.when(tk.is_distractor(func, role), "distractor")
        .when(relevant, F.concat(kind, F.lit("_gt")))
        .otherwise("other")
    )


def constant_docs(docs: DataFrame) -> DataFrame:
    """(func, uid) of documents with role exactly 'constant': the mAP ground truth."""
    return docs.filter(F.col("role") == "constant").select("func", "uid")


def containing_pairs(docs: DataFrame, passages: DataFrame, index: DataFrame | None = None, limit_bytes: int = SHIP_LIMIT_BYTES) -> DataFrame:
    """(query_uid, uid) where the document contains the whole passage text.

    Candidates share the passage's rarest term, looked up in the corpus index;
    first and last words are not used, a document may continue them.  The texts
    then decide.  A passage set proven small travels to the tasks and is decided
    where the text is read; for a larger one the candidates' ids are joined first
    and their texts fetched after.  Passages without an inner term travel in blocks of
    ``limit_bytes`` and are looked for in every text.
    """
    tokens = bm25.tokenized(docs, keep=["text"])
    index = bm25.build_index(tokens) if index is None else index
    words = F.split(tx.strip(F.col("prompt")), r"\s+")
    inner = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " ")
    terms = passages.select("query_uid", F.explode(F.array_distinct(tx.terms(inner))).alias("term"))
    # A term the corpus lacks has df 0 and rules the passage out, rightly.
    weighed = terms.join(index.select("term", "df"), "term", "left")
    rarity = F.struct(F.coalesce("df", F.lit(0)), F.col("term"))
    anchors = weighed.groupBy("query_uid").agg(F.min_by("term", rarity).alias("term"))
    entries = F.explode(F.array_distinct("terms")).alias("term")
    texts = passages.select("query_uid", "prompt")
    size = passages.agg(F.sum(F.octet_length("prompt") + 64)).first()[0] or 0
    if size <= limit_bytes:
        # The term lookup filters rows as they are unfolded, before any text is copied.
        near = tokens.select("uid", "text", entries).join(F.broadcast(anchors.join(texts, "query_uid")), "term")
    else:
        hits = tokens.select("uid", entries).join(anchors, "term").select("query_uid", "uid")
        near = hits.join(docs.select("uid", "text"), "uid").join(texts, "query_uid")
    found = near.filter(F.contains("text", "prompt")).select("query_uid", "uid")
    bare = passages.filter(F.size(tx.terms(inner)) == 0).select("query_uid", "prompt")
    bytes_bare = bare.agg(F.sum(F.octet_length("prompt") + 64)).first()[0] or 0
    blocks = -(-bytes_bare // limit_bytes)
    for b in range(blocks):
        block = bare.filter(F.pmod(F.xxhash64("query_uid"), F.lit(blocks)) == b)
        held = F.broadcast(block.agg(F.collect_list(F.struct("query_uid", "prompt")).alias("held")))  # one block
        met = docs.select("uid", "text").crossJoin(held).select("uid", F.explode(F.filter("held", lambda p: F.contains(F.col("text"), p["prompt"]))).alias("p"))
        found = found.unionByName(met.select("p.query_uid", "uid"))
    return found
