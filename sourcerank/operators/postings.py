"""A stored inverted index with block maxima, and exact top-k search that stops early.

The index is written once and serves any number of query sets.  Documents are numbered by
length, so that neighbours have like scores, and ``block_docs`` neighbours form a block.  A row
of the postings table is one term in one block: the documents with what the term adds to their
scores at weight 1, and ``top``, the largest of these.  A stored row is a whole block, so that
its documents are scored where it is read.  Tables:

* ``stats``: one row, number of documents and mean length;
* ``terms``: term, df, and the term's largest ``top`` in the corpus;
* ``blocks``: block and entries (term, n, top, docs (uid, x)), sorted by term.

A search reads a query's terms from the one that can add most to the one that can add least.

1. *Seed*: the first terms, up to ``seed_share`` of the query's postings, give partial scores.
   The best ``k`` documents are completed: their blocks alone are read for the other terms.
   The k-th best completed score is a threshold that the k-th best document reaches.
2. *Essential terms*: further terms, as long as the terms still unread could together reach the
   threshold; a document without any of these cannot.  Completing the best again raises it.
3. *Bounds*: a document stays if its partial score and the block maxima of the unread terms
   in its block reach the threshold.  Only blocks with such documents are read on, in a few
   rounds of terms (``ROUNDS``), and documents are sorted out again before each.

A query set proven to be small travels to the blocks: the first two steps give partial scores in
place, and tasks hand on their best ``k`` for a query, or the documents that stay.  Partial scores
of all documents are added up again where they are needed instead of being stored.  For a larger
set they are shuffled and stored.

Everything left out is proven to score below the threshold, less what rounding may move, so the
best ``k`` are exact.  Terms with a negative weight bound nothing and come last; a query with
fewer than ``k`` positive completed scores has no threshold and is read whole.  A query without
a single positive weight is known to have none: its terms meet the blocks in a grid of cells at
once, and its scores are neither stored between steps nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import LARGE_ROWS, SHIP_LIMIT_BYTES, materialize, ship_if_small, small_batches, trim
from . import bm25

# Documents of a block: what is read or skipped at once.
BLOCK_DOCS = 8
# Share of a query's postings that the seed may read.
SEED_SHARE = 0.2
# Shares of a query's postings at which the rounds over the remaining terms end.
ROUNDS = (0.35, 0.5, 0.7, 1.0)
_STATS = "n_docs bigint, avg_len double"
_TERMS = "term string, df bigint, len_sum bigint, top double"
_BLOCKS = "block bigint, entries array<struct<term:string,n:int,top:double,docs:array<struct<uid:string,x:double>>>>"
_READS = "round int, n bigint"
_PAIRS = "query_uid string, block bigint, uid string, part double"
# Terms and uids are told from dictionaries, so that a row group grows several times when it is read.
_WRITTEN = LARGE_ROWS | {"parquet.block.size": str(2 << 20)}
# Numbers in one dense array of a task.
_AT_ONCE = 1 << 20


@dataclass
class BlockIndex:
    """The tables of a stored index and the settings it was built with."""

    stats: DataFrame
    terms: DataFrame
    stored: DataFrame
    mode: dict = field(default_factory=dict)

    @property
    def blocks(self) -> DataFrame:
        """term, block, n, top, docs (uid, x): one row for a term in a block."""
        return self.stored.select("block", F.inline("entries")).select("term", "block", "n", "top", "docs")


def write_index(
    docs: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, block_docs: int = BLOCK_DOCS, text: str = "text", **mode
) -> BlockIndex:
    """Build the index of ``docs`` (uid, text or terms) below ``path`` and open it."""
    spark = docs.sparkSession
    tokens = bm25.tokenized(docs, text=text, **mode)
    counted = bm25.build_index(tokens)
    bm25.corpus_stats(counted).write.parquet(f"{path}/stats")
    stats = spark.read.schema(_STATS).parquet(f"{path}/stats")
    row = stats.first()
    mean_len = float(row["avg_len"]) if row and row["avg_len"] else 1.0

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = tokens.select("uid", "doc_len", "terms").repartitionByRange(n, "doc_len", "uid").sortWithinPartitions("doc_len", "uid")
    # Stored, since its partitions are counted before they are cut.
    placed = materialize(placed)
    counts = {r["part"]: r["count"] for r in placed.groupBy(F.spark_partition_id().alias("part")).count().collect()}
    before = dict(zip(sorted(counts), np.cumsum([0, *(counts[p] for p in sorted(counts))]).tolist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pos = None, before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            # The last documents wait for the rest of their block.
            first, whole = pos, (pos + rows.num_rows) // block_docs * block_docs
            while pos < whole:
                last = min(whole, (pos // block_docs + _BLOCKS_CUT) * block_docs)
                yield _cut_blocks(rows.slice(pos - first, last - pos), pos, block_docs, k1, b, mean_len)
                pos = last
            held = rows.slice(pos - first)
        if held is not None and held.num_rows:
            yield _cut_blocks(held, pos, block_docs, k1, b, mean_len)
        trim()

    # Partitions are ranges of lengths, so that the last ones have nothing but long documents.
    with small_batches(spark):
        placed.mapInArrow(cut, _BLOCKS).write.options(**_WRITTEN).parquet(f"{path}/blocks")
    blocks = read_blocks(spark, path)
    tops = blocks.select(F.inline("entries")).groupBy("term").agg(F.max("top").alias("top"))
    # The row of the null term holds the size of the corpus.
    counted.join(tops, "term", "left").select("term", "df", "len_sum", "top").write.parquet(f"{path}/terms")
    return open_index(spark, path, **mode)


# Blocks that are cut at once.
_BLOCKS_CUT = 32


def _cut_blocks(rows: pa.Table, pos: int, block_docs: int, k1: float, b: float, mean_len: float) -> pa.RecordBatch:
    """The blocks of neighbours from place ``pos``; rows of one uid and length in a block are one document."""
    terms = rows.column("terms").combine_chunks()
    words = pc.dictionary_encode(terms.flatten(), null_encoding="encode")
    uids = rows.column("uid").combine_chunks()
    uid = uids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    length = pc.fill_null(rows.column("doc_len"), 0).to_numpy()
    block = (pos + np.arange(len(uid))) // block_docs
    new = np.r_[True, (uid[1:] != uid[:-1]) | (length[1:] != length[:-1]) | (block[1:] != block[:-1])]
    doc, first = np.cumsum(new) - 1, np.flatnonzero(new)
    numbers, opens = np.unique(block, return_index=True)
    local, begins = block - block[0], doc[opens]
    place = np.empty(len(words.dictionary), np.int64)
    place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
    width = max(1, len(place))
    sizes = np.maximum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False), 0)
    row = np.repeat(np.arange(len(doc)), sizes)
    # In the order of blocks, terms and documents.
    key = (local[row] * width + place[words.indices.to_numpy()]) * block_docs + (doc - begins[local])[row]
    key, tf = np.unique(key, return_counts=True)
    entry = key // block_docs
    own = first[begins[entry // width] + key % block_docs]
    x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / mean_len)[own]))
    opens = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]][: len(entry)])
    ends = np.append(opens, len(entry)).astype(np.int32)
    docs = pa.StructArray.from_arrays([uids.take(pa.array(own)).cast(pa.string()), pa.array(x)], ["uid", "x"])
    names = words.dictionary.cast(pa.string()).take(pa.array(np.argsort(place)[entry[opens] % width]))
    entries = pa.StructArray.from_arrays(
        [names, pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(x, opens) if len(opens) else x), pa.ListArray.from_arrays(pa.array(ends), docs)], ["term", "n", "top", "docs"]
    )
    cuts = np.searchsorted(entry[opens] // width, np.arange(len(numbers) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.ListArray.from_arrays(pa.array(cuts), entries)], ["block", "entries"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a stored index."""
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def open_index(spark: SparkSession, path: str, **mode) -> BlockIndex:
    """An index that was written before; ``mode`` is the term mode it was built with."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return BlockIndex(read("stats", _STATS), read("terms", _TERMS), read_blocks(spark, path), mode)


def weighted_terms(index: BlockIndex, queries: DataFrame, epsilon: float = 0.25, include_completion: bool = False, seed_share: float = SEED_SHARE) -> DataFrame:
    """(query_uid, term, w, gain, unread, share, seed): a query's terms from the greatest to the least gain.

    ``gain`` is what a term adds at most, ``unread`` the gains of the terms after it, ``share``
    that of the postings up to it, ``seed`` whether it belongs to the first ``seed_share``.
    """
    qt = bm25.query_terms(queries, include_completion, **index.mode)
    idf = bm25.idf_table(index.terms, epsilon).select("term", "df", "idf")
    rows = qt.join(idf, "term").join(index.terms.select("term", "top"), "term")
    rows = rows.select("query_uid", "term", "df", (F.col("qtf") * F.col("idf")).alias("w"), "top")
    rows = rows.withColumn("gain", F.greatest("w", F.lit(0.0)) * F.col("top"))
    # Windows over the terms of one query.
    order = W.partitionBy("query_uid").orderBy(F.col("gain").desc(), "term")
    until, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(1, W.unboundedFollowing)
    whole = F.sum("df").over(W.partitionBy("query_uid"))
    first = F.row_number().over(order) == 1
    return rows.select(
        "query_uid", "term", "w", "gain", F.coalesce(F.sum("gain").over(after), F.lit(0.0)).alias("unread"),
        (F.sum("df").over(until) / whole).alias("share"), (first | (F.sum("df").over(until) <= whole * seed_share)).alias("seed"),
    )


class Search:
    """One search; the steps are DataFrames, and ``reads`` lists what each of them takes from the index."""

    def __init__(self, index: BlockIndex, queries: DataFrame, k: int, decimals: int = 5, **weights):
        self.index, self.k, self.margin = index, k, 2.0 * 10.0**-decimals
        self.decimals = decimals
        self.reads: dict[str, DataFrame] = {}
        self.terms = materialize(weighted_terms(index, queries, **weights))
        self.queries = queries.select("query_uid").distinct()

    def _blocks(self, terms: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """Rows of the index for query terms, in the blocks of ``only`` (query_uid, block) if given."""
        wanted = terms.select("query_uid", "term", "w") if only is None else terms.select("query_uid", "term", "w").join(only, "query_uid")
        return self.index.blocks.join(ship_if_small(wanted, 96), ["term"] if only is None else ["term", "block"])

    def _partials(self, step: str, rows: DataFrame) -> DataFrame:
        """(query_uid, block, uid, part): what the rows add to each document."""
        self.reads[step] = rows.select("query_uid", "term", "block", "n")
        found = rows.select("query_uid", "block", "w", F.inline("docs"))
        return found.groupBy("query_uid", "block", "uid").agg(F.sum(F.col("w") * F.col("x")).alias("part"))

    def _in_place(self, terms: DataFrame, most: int | None = None, limits: DataFrame | None = None, rest: DataFrame | None = None, until: int = len(ROUNDS) - 1, count: bool = False) -> DataFrame | None:
        """(query_uid, block, uid, part) of documents with one of these terms; None if the query set is large.

        With ``most``, each slice of a task gives a query's best alone; with ``limits`` (query_uid, theta,
        slack) the documents whose scores with the terms of ``rest`` (and their round) may reach theta, after
        the rounds up to ``until``.  ``count`` gives the postings of ``rest`` that were needed instead: (round, n).
        """
        rows = max(1, SHIP_LIMIT_BYTES // 64)
        every = terms.select("term", "query_uid", "w", F.lit(-1).alias("round"))
        every = every if rest is None else every.unionByName(rest.select("term", "query_uid", "w", "round"))
        table = every.limit(rows + 1).toArrow()
        vocab, asked = table.column("term").combine_chunks().unique(), table.column("query_uid").combine_chunks().unique()
        if table.num_rows > rows or 8 * len(vocab) * len(asked) > SHIP_LIMIT_BYTES:
            return None
        if not len(asked):
            return self.index.stored.sparkSession.createDataFrame([], _READS if count else _PAIRS)
        word, query, w, of_round = pc.index_in(table.column("term"), vocab).to_numpy(), pc.index_in(table.column("query_uid"), asked).to_numpy(), table.column("w").to_numpy(), table.column("round").to_numpy()
        shape = len(vocab), len(asked)

        def matrix(chosen: np.ndarray, values: np.ndarray) -> np.ndarray:
            out = np.zeros(shape)
            out[word[chosen], query[chosen]] = values[chosen]
            return out

        essential = of_round < 0
        weights = matrix(essential, w)
        # A sum that is 0 is a document without the terms, unless weights may cancel out.
        has = matrix(essential, np.ones(len(w))) if (w[essential] <= 0).any() else None
        theta, slack = np.full(len(asked), -np.inf), np.zeros(len(asked))
        if limits is not None:
            known = limits.select("query_uid", "theta", "slack").toArrow()
            known = known.filter(pc.is_in(known.column("query_uid"), asked))
            at = pc.index_in(known.column("query_uid"), asked).to_numpy()
            theta[at], slack[at] = pc.fill_null(known.column("theta"), -np.inf).to_numpy(), known.column("slack").to_numpy()
        n_rounds = 0 if rest is None else until + 1
        blocks_at_once = max(1, min(64, (4 << 20) // len(asked) // 128))

        def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            entries = batch.column("entries")
            flat = entries.flatten()
            docs = flat.field("docs")
            many = pc.list_value_length(docs).to_numpy()
            own = np.repeat(np.arange(len(batch)), pc.list_value_length(entries).to_numpy())
            entry_word = pc.fill_null(pc.index_in(flat.field("term"), vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            postings = docs.flatten()
            words, block = np.repeat(entry_word, many), np.repeat(own, many)
            held = np.flatnonzero(words >= 0)
            if not len(held):
                return
            uid = pc.dictionary_encode(postings.field("uid"), null_encoding="encode")
            key = block[held] * len(uid.dictionary) + uid.indices.to_numpy()[held]
            order = np.argsort(key, kind="stable")
            held, key = held[order], key[order]
            words, block, x = words[held], block[held], postings.field("x").to_numpy()[held]
            met = np.flatnonzero(entry_word >= 0)
            own, entry_word, top, many = own[met], entry_word[met], flat.field("top").to_numpy()[met], many[met]
            places, starts = np.unique(own, return_index=True)
            lefts = [run_sums(gains[r], entry_word, top, starts) for r in range(n_rounds)]
            opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lengths = np.diff(np.append(opens, len(key)))
            ends, first = opens + lengths, 0
            while first < len(opens):
                # At most so many scores at once.
                last = min(len(opens), first + max(1, _AT_ONCE // len(asked)))
                doc = np.arange(first, last)
                a, z = opens[first], ends[last - 1]
                cuts = opens[first:last] - a
                part = run_sums(weights, words[a:z], x[a:z], cuts)
                found = part != 0 if has is None else run_sums(has, words[a:z], np.ones(z - a), cuts) > 0
                found &= part + slack >= theta
                for r in range(n_rounds):
                    found &= part + lefts[r][np.searchsorted(places, block[opens[doc]])] >= theta
                    some = found.any(axis=1)
                    doc, part, found = doc[some], part[some], found[some]
                    if not len(doc):
                        break
                    if count:
                        of = np.searchsorted(places, block[opens[doc]])
                        needed = np.zeros((len(places), len(asked)), bool)
                        np.logical_or.at(needed, of, found)
                        of, n = np.searchsorted(places, own), 0
                        for e in range(0, len(own), max(1, _AT_ONCE // len(asked))):
                            some = slice(e, e + max(1, _AT_ONCE // len(asked)))
                            n += int((needed[of[some]] & (rounds[r][entry_word[some]] != 0)).sum(axis=1) @ many[some])
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([n], pa.int64())], ["round", "n"])
                    at = ranges(opens[doc], lengths[doc])
                    part = part + run_sums(rounds[r], words[at], x[at], np.cumsum(lengths[doc]) - lengths[doc])
                if not count and len(doc):
                    if until == len(ROUNDS) - 1 and n_rounds:
                        found &= part >= theta
                    if most is not None and most < len(part):
                        ranked = np.where(found, part, -np.inf)
                        found &= part >= -np.partition(-ranked, most - 1, axis=0)[most - 1]
                    d, q = np.nonzero(found)
                    of = opens[doc][d]
                    yield pa.RecordBatch.from_arrays(
                        [asked.take(pa.array(q)).cast(pa.string()), batch.column("block").take(pa.array(block[of])), postings.field("uid").take(pa.array(held[of])), pa.array(part[d, q])],
                        ["query_uid", "block", "uid", "part"],
                    )
                first = last

        # What the terms of a round and of later ones may add, and the weights of each round.
        gains = [matrix(of_round >= r, np.maximum(w, 0.0)) for r in range(n_rounds)]
        rounds = [matrix(of_round == r, w) for r in range(n_rounds)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, blocks_at_once):
                    yield from pairs(batch.slice(first, blocks_at_once))
            trim()

        return self.index.stored.mapInArrow(run, _READS if count else _PAIRS)

    def _read(self, step: str, terms: DataFrame) -> None:
        self.reads[step] = self._blocks(terms).select("query_uid", "term", "block", "n")

    def _completed(self, step: str, partial: DataFrame, unread: DataFrame) -> DataFrame:
        """(query_uid, theta): the k-th best score among the k documents with the best partial scores."""
        order = W.partitionBy("query_uid").orderBy(F.col("part").desc(), "uid")
        best = partial.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= self.k).drop("__r")
        best = materialize(best)
        more = self._partials(step, self._blocks(unread, best.select("query_uid", "block").distinct()))
        more = more.join(ship_if_small(best.select("query_uid", "uid"), 64), ["query_uid", "uid"], "left_semi")
        whole = best.unionByName(more).groupBy("query_uid", "uid").agg(F.sum("part").alias("score")).filter("score > 0")
        return whole.groupBy("query_uid").agg(F.min("score").alias("theta"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == self.k).drop("n")

    def _left(self, rest: DataFrame, alive: DataFrame) -> DataFrame:
        """(query_uid, block, left_0, left_1, ...): what the terms of each round and the later ones may add in a block."""
        heads = self._blocks(rest, alive.select("query_uid", "block").distinct()).select("query_uid", "block", "term", "w", "top")
        heads = heads.join(ship_if_small(rest.select("query_uid", "term", "round"), 64), ["query_uid", "term"])
        add = F.greatest("w", F.lit(0.0)) * F.col("top")
        return heads.groupBy("query_uid", "block").agg(*[F.sum(F.when(F.col("round") >= r, add).otherwise(0.0)).alias(f"left_{r}") for r in range(len(ROUNDS))])

    def scores(self) -> DataFrame:
        """(query_uid, uid, score) of all documents that may be among the best ``k``."""
        with small_batches(self.index.stored.sparkSession):
            return self._scores()

    def _scores(self) -> DataFrame:
        gains = self.terms.groupBy("query_uid").agg(F.max("gain").alias("gain"))
        gains = materialize(gains)
        lost = gains.filter("gain <= 0").select("query_uid")
        if not lost.limit(1).count():
            return self._searched(self.terms)
        whole = self._whole(self.terms.join(ship_if_small(lost, 48), "query_uid", "left_semi"))
        others = gains.filter("gain > 0").select("query_uid")
        if not others.limit(1).count():
            return whole
        return whole.unionByName(self._searched(materialize(self.terms.join(ship_if_small(others, 48), "query_uid", "left_semi"))))

    def _whole(self, terms: DataFrame) -> DataFrame:
        """The scores of every document that shares a term; a document of one block is one row."""
        self.reads["whole"] = self._blocks(terms).select("query_uid", "term", "block", "n")
        size = self.index.blocks.agg(F.count_distinct("block").alias("blocks"), F.sum("n").alias("n")).first()

        def postings(table: pa.Table):
            docs = table.column("docs").combine_chunks()
            many = np.diff(docs.offsets.to_numpy())
            entries = docs.flatten()
            uids = pc.dictionary_encode(entries.field("uid"), null_encoding="encode")
            block = np.repeat(table.column("block").to_numpy(), many)
            both = np.lexsort((uids.indices.to_numpy(), block))
            doc, block = uids.indices.to_numpy()[both], block[both]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])
            words = table.column("term").combine_chunks().dictionary_encode()
            term = np.repeat(words.indices.to_numpy(), many)[both]
            place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
            return uids.dictionary.take(pa.array(doc[first])), place, words.dictionary, term, entries.field("x").to_numpy(zero_copy_only=False)[both]

        rows = self.index.blocks.select("term", "block", "docs")
        n_docs = (size["blocks"] or 0) * BLOCK_DOCS
        found = bm25.scored_in_cells(rows, F.col("block"), terms.select("term", "query_uid", "w"), n_docs, size["n"] or 0, postings)
        return found.withColumn("score", F.round("score", self.decimals)).filter("score <> 0")

    def _rounds_in_place(self, essential: DataFrame, rest: DataFrame, limits: DataFrame) -> DataFrame | None:
        """The rounds, each block's in one task; what reaches the threshold in the end.  None if the query set is large."""
        last = len(ROUNDS) - 1
        for r in range(last - 1):
            best = self._in_place(essential, self.k, limits, rest, r)
            if best is None:
                return None
            self.reads[f"round {r}"] = self._in_place(essential, None, limits, rest, r, count=True).filter(F.col("round") == r)
            higher = self._completed(f"round {r} completed", best, rest.filter(F.col("round") > r)).withColumnRenamed("theta", "higher")
            limits = limits.join(higher, "query_uid", "left")
            limits = materialize(limits.select("query_uid", F.greatest("theta", F.col("higher") - self.margin).alias("theta"), "slack"))
        needed = self._in_place(essential, None, limits, rest, last, count=True)
        self.reads |= {f"round {r}": needed.filter(F.col("round") == r) for r in (last - 1, last)}
        # Few rows; whoever takes them up needs no second Python worker beside the one that reads blocks.
        whole = materialize(self._in_place(essential, None, limits, rest))
        return whole.select("query_uid", "uid", F.round("part", self.decimals).alias("score")).filter("score <> 0")

    def _searched(self, terms: DataFrame) -> DataFrame:
        first = terms.filter("seed")
        seed = self._in_place(first, self.k)
        small = seed is not None
        if small:
            self._read("seed", first)
        else:
            seed = materialize(self._partials("seed", self._blocks(first)))
        theta = materialize(self._completed("seed completed", seed, terms.filter("not seed")))
        # Terms that the unread ones before them, themselves included, cannot do without.
        reach = F.col("theta").isNull() | (F.col("gain") + F.col("unread") >= F.col("theta") - self.margin)
        marked = materialize(terms.join(theta, "query_uid", "left").withColumn("essential", F.col("seed") | reach).drop("theta"))
        rest, own = marked.filter("not essential"), marked.filter("essential and not seed")
        met = self._in_place(marked.filter("essential"), self.k) if small else None
        if met is not None:
            self._read("essential", own)
        else:
            seed, small = materialize(self._partials("seed", self._blocks(first))) if small else seed, False
            met = seed.unionByName(self._partials("essential", self._blocks(own)))
            met = materialize(met.groupBy("query_uid", "block", "uid").agg(F.sum("part").alias("part")))
        higher = self._completed("essential completed", met, rest).withColumnRenamed("theta", "higher")
        both = self.queries.join(theta, "query_uid", "left").join(higher, "query_uid", "left")
        slack = rest.groupBy("query_uid").agg(F.sum("gain").alias("slack"))
        limits = both.select("query_uid", F.greatest("theta", "higher").alias("theta")).join(slack, "query_uid", "left")
        limits = materialize(limits.select("query_uid", (F.col("theta") - self.margin).alias("theta"), F.coalesce("slack", F.lit(0.0)).alias("slack")))
        rest = materialize(rest.withColumn("round", F.size(F.filter(F.array(*map(F.lit, ROUNDS[:-1])), lambda r: r < F.col("share")))))
        if small:
            found = self._rounds_in_place(marked.filter("essential"), rest, limits)
            if found is not None:
                return found
        if small:
            met = self._partials("met", self._blocks(marked.filter("essential")))
            del self.reads["met"]
        alive = met.join(ship_if_small(limits, 48), "query_uid").filter(F.col("theta").isNull() | (F.col("part") + F.col("slack") >= F.col("theta")))
        left = [f"left_{r}" for r in range(len(ROUNDS))]
        alive = materialize(alive.select("query_uid", "block", "uid", "part", "theta"))
        alive = alive.join(self._left(rest, alive), ["query_uid", "block"], "left").fillna(0.0, left)
        for r, bound in enumerate(left):
            alive = materialize(alive.filter(F.col("theta").isNull() | (F.col("part") + F.col(bound) >= F.col("theta"))))
            more = self._partials(f"round {r}", self._blocks(rest.filter(F.col("round") == r), alive.select("query_uid", "block").distinct()))
            more = more.select("query_uid", "uid", F.col("part").alias("more"))
            alive = alive.join(more, ["query_uid", "uid"], "left").withColumn("part", F.col("part") + F.coalesce("more", F.lit(0.0))).drop("more")
            if r < len(left) - 2:
                alive = materialize(alive)
                met = alive.select("query_uid", "block", "uid", "part")
                higher = self._completed(f"round {r} completed", met, rest.filter(F.col("round") > r)).withColumnRenamed("theta", "higher")
                alive = alive.join(ship_if_small(materialize(higher), 48), "query_uid", "left")
                alive = alive.withColumn("theta", F.greatest("theta", F.col("higher") - self.margin)).drop("higher")
        return alive.select("query_uid", "uid", F.round("part", self.decimals).alias("score")).filter("score <> 0")

    def postings_read(self) -> DataFrame:
        """(step, n): postings that each step took, and under ``all`` those of all the query terms."""
        every = self._blocks(self.terms).select("query_uid", "term", "block", "n")
        rows = [r.agg(F.sum("n").alias("n")).select(F.lit(s).alias("step"), F.coalesce("n", F.lit(0)).alias("n")) for s, r in {**self.reads, "all": every}.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out


def run_sums(matrix: np.ndarray, words: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``x`` times the rows ``words`` of ``matrix`` over the runs from ``starts``, whole runs at a time."""
    out = np.empty((len(starts), matrix.shape[1]))
    ends, most, first = np.append(starts[1:], len(words)), _AT_ONCE // matrix.shape[1], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most, "right")))
        a, z = starts[first], ends[last - 1]
        out[first:last] = np.add.reduceat(matrix[words[a:z]] * x[a:z, None], starts[first:last] - a, axis=0)
        first = last
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All the positions of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def top_scores(index: BlockIndex, queries: DataFrame, k: int, **options) -> DataFrame:
    """(query_uid, uid, score): stored scores that hold the best ``k`` of every query.

    Hand them to :func:`ranking.top_k_complete`, which adds documents without a stored score.
    """
    return Search(index, queries, k, **options).scores()
