"""Rankers by name: callables from (docs, queries) to (query_uid, uid, score) rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from . import bm25, vectors

RANKERS: dict[str, Callable[..., DataFrame]] = {
    "bm25": bm25.bm25_scores,
    **{name: partial(vectors.similarity_scores, metric=name) for name in ("cosine", "dot", "l2", "euclidean")},
}


def register(name: str, ranker: Callable[..., DataFrame]) -> None:
    """Make a ranker known; a name is given once."""
    if name in RANKERS:
        raise ValueError(f"there is a ranker {name}")
    RANKERS[name] = ranker


def scores(name: str, docs: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Scores by the ranker of that name."""
    if name not in RANKERS:
        raise ValueError(f"no ranker {name}; known: {', '.join(sorted(RANKERS))}")
    return RANKERS[name](docs, queries, **options)
