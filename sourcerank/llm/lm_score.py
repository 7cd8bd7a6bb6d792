"""Language-model scores by masked pseudo-likelihood.

Every word of a document is predicted from the two words on either side of it, as if it were
masked; the summed logarithms of these conditional probabilities are the document's score.

A word's probability is that of its class given the context, times that of the word inside its
class given the context.  Classes are bins of the corpus frequencies of the known words, and a few
for the words beyond the vocabulary, which grows with the corpus.  Words beyond it share buckets by
hash, whose number grows as well; inside its bucket a word has the share that its count is.  The
known words or the buckets of a class are the leaves of a Huffman tree; every
node of it is a logistic decision that sees the context and starts from the counts, so that the
probabilities of all words add up to 1.  Counts come from all documents.  The network adds up a
vector for each context word, weighted by its place; a softmax layer turns the sum into classes,
and the nodes of a class's tree turn it into words.  It is trained in
numpy: a start on a few documents, then every task trains on all words of its documents, and Spark
averages what the tasks learned, row by row, by how often each row was used.  Counts of the words
beyond the vocabulary stay in a table that is joined to the scored documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

# Known words: this many for each square root of the words of the corpus, and at least so many.
GROWTH = 8
VOCABULARY = 8192
CLASSES = 56
# Classes of words beyond the vocabulary, by hash.
RARE = 8
SIZE = 16
PLACES = (-2, -1, 1, 2)
# Documents of the start.
START_DOCUMENTS = 300
_BATCH = 1024


@dataclass
class Lexicon:
    """Known words by hash, their classes, and each word's log share of its class."""

    hashes: np.ndarray  # sorted
    classes: np.ndarray  # of known words, then of buckets of rare ones
    log_shares: np.ndarray
    # The way to each word through the tree of its class: nodes end to end, the side taken at each
    # (1 or -1), and where each word's begin (one entry more).
    nodes: np.ndarray
    sides: np.ndarray
    begins: np.ndarray
    odds: np.ndarray  # of each node's side 1, by counts alone, as logarithms
    rest: np.ndarray  # what a word has of its leaf, as a logarithm: 0 but for rare ones

    @property
    def pad(self) -> int:
        """The number that stands where there is no word."""
        return len(self.classes)

    def ways(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``nodes`` of the ways to these words, and which of them each belongs to."""
        lengths = self.begins[numbers + 1] - self.begins[numbers]
        return common.ranges(self.begins[numbers], lengths), np.repeat(np.arange(len(numbers)), lengths)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        bits = (self.pad - len(self.hashes)).bit_length() - 1
        rare = len(self.hashes) + (hashes >> np.uint64(64 - bits)).astype(np.int64)
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, rare)


def texts_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of slices of a text column, and where each row begins (one entry more)."""
    data, offsets = common.bytes_of(column)
    for a, b in common.slices(offsets):
        lower = words.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = words.split(lower, offsets[a : b + 1] - offsets[a], words.ALNUM)
        yield words.range_hashes(words.running(lower), starts, ends), first


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word (by hash) occurs in all texts; tasks add up theirs first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def added() -> None:
            nonlocal held, sums, waiting
            every = np.concatenate([held, *[w for w, _ in waiting]])
            many = np.concatenate([sums, *[n for _, n in waiting]])
            held, back = np.unique(every, return_inverse=True)
            sums, waiting = np.bincount(back, many, len(held)).astype(np.int64), []

        for batch in batches:
            for hashes, _ in texts_words(batch.column(1)):
                waiting.append(np.unique(hashes, return_counts=True))
                if len(waiting) == 16:
                    added()
            if len(held) > 4_000_000:  # a task of very many different words hands them on in parts
                added()
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(sums)], ["word", "n"])
                held, sums = held[:0], sums[:0]
        added()
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(sums)], ["word", "n"])

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trees(classes: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree for the members of each class: nodes, sides, begins and odds of a lexicon."""
    n = len(classes)
    above, side, odds = np.full(2 * n, -1), np.zeros(2 * n, np.int8), []
    members = np.argsort(classes, kind="stable")
    for group in np.split(members, np.flatnonzero(np.diff(classes[members])) + 1):
        heap = [(float(mass[k]), int(k)) for k in group]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x] = above[y] = n + len(odds)
            side[x], side[y] = 1, -1
            heapq.heappush(heap, (a + b, n + len(odds)))
            odds.append(math.log(a / b))
    leaf, at, way = np.arange(n), np.arange(n), []
    while len(leaf):
        inner = above[at] >= 0
        leaf, at = leaf[inner], at[inner]
        way.append((leaf, above[at] - n, side[at]))
        at = above[at]
    leaves, nodes, sides = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*way, strict=True) if way else ((), (), ())))
    order = np.argsort(leaves, kind="stable")
    begins = np.append(0, np.cumsum(np.bincount(leaves.astype(np.int64), minlength=n)))
    return nodes[order].astype(np.int32), sides[order].astype(np.int8), begins, np.array(odds, np.float32)


def lexicon(counts: DataFrame, vocabulary: int = VOCABULARY, classes: int = CLASSES, buckets: int = RARE, counted: bool = False) -> Lexicon:
    """The most frequent words (ties by hash) in classes of about equal mass; totals of the rest by bucket.

    ``buckets`` is a power of two, RARE or more.  A word beyond the vocabulary has an equal share of
    its bucket, or if ``counted`` one by its count, which rare_counts() has: 1 / total is in ``rest``.
    """
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    hashes = top["word"].to_numpy().view(np.uint64)
    n = top["n"].to_numpy().astype(float)
    bits = buckets.bit_length() - 1
    beyond = rare_counts(counts, hashes, n)
    kinds, total = np.ones(buckets), np.ones(buckets)
    held = beyond.groupBy(F.shiftrightunsigned("word", 64 - bits).alias("rare")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).toArrow()
    kinds[held["rare"].to_numpy()], total[held["rare"].to_numpy()] = held["kinds"].to_numpy(), held["total"].to_numpy()
    mass = np.cumsum(n) - n
    cls = np.minimum((mass / max(1.0, n.sum()) * classes).astype(np.int64), classes - 1)
    order = np.argsort(hashes, kind="stable")
    every = np.concatenate([cls[order], classes + np.arange(buckets) * RARE // buckets])
    weight = np.concatenate([n[order], total])
    rest = np.concatenate([np.zeros(len(n)), -np.log(total if counted else kinds)])
    share = np.log(weight) - np.log(np.bincount(every, weight, classes + RARE)[every])
    return Lexicon(hashes[order], every, share + rest, *trees(every, weight), rest)


def rare_counts(counts: DataFrame, hashes: np.ndarray, n: np.ndarray) -> DataFrame:
    """The counts of the words beyond a vocabulary that is in order of frequency."""
    if not len(n):
        return counts
    least, last = int(n[-1]), int(hashes.view(np.int64)[-1])
    return counts.filter((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last)))


def sizes(counts: DataFrame) -> tuple[int, int]:
    """How many words are known, and how many buckets the others have, by the size of the corpus."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = max(VOCABULARY, int(GROWTH * math.sqrt(total)))
    return known, max(RARE, 1 << (known // 2).bit_length() - 1)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the sums of the values of each, and how often each came."""
    order = np.argsort(rows.astype(np.int32, copy=False))
    rows = rows[order]
    opens = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
    sums = np.add.reduceat(values.take(order, 0), opens, 0) if len(opens) else values
    return rows[opens], sums, np.diff(np.append(opens, len(rows)))


@dataclass
class Network:
    """Word vectors (the last one for no word), weights of the places, the softmax layer, and the tree nodes."""

    vectors: np.ndarray
    places: np.ndarray
    out: np.ndarray  # one row for each class: weights and bias
    # One row for each node; without them a word has its share of the class in any context.
    nodes: np.ndarray | None = None

    @staticmethod
    def fresh(pad: int, classes: int, size: int = SIZE, seed: int = 2, odds: np.ndarray | None = None) -> Network:
        rng = np.random.default_rng(seed)
        parts = rng.normal(0, 0.1, (pad + 1, size)), np.ones((len(PLACES), size)), np.concatenate([rng.normal(0, 0.1, (classes, size)), np.zeros((classes, 1))], 1)
        nodes = None if odds is None else np.concatenate([np.zeros((len(odds), size)), odds[:, None]], 1).astype(np.float32)
        return Network(*(p.astype(np.float32) for p in parts), nodes)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.places, self.out, self.nodes]

    def contexts(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The context words of every word, none of another row."""
        pad, n = len(self.vectors) - 1, len(numbers)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = np.full((n, len(PLACES)), pad)
        for k, d in enumerate(PLACES):
            here, there = (np.arange(max(0, -d), n), np.arange(0, n - max(0, -d))) if d < 0 else (np.arange(0, max(0, n - d)), np.arange(min(d, n), n))
            same = row[here] == row[there]
            out[here[same], k] = numbers[there[same]]
        return out

    def step(self, contexts: np.ndarray, numbers: np.ndarray, lex: Lexicon, seen: list[np.ndarray], rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """One step of Adagrad; ``seen`` holds the squares so far.  Returns which vectors and nodes took part, and how often."""
        target, size = lex.classes[numbers], self.vectors.shape[1]
        context = self.vectors.take(contexts.ravel(), 0).reshape(*contexts.shape, size)
        hidden = np.einsum("njk,jk->nk", context, self.places)
        wrong = hidden @ self.out[:, :-1].T
        wrong += self.out[:, -1] - wrong.max()
        np.exp(np.maximum(wrong, -80, out=wrong), out=wrong)
        part = np.float32(1 / len(target))
        wrong *= part / wrong.sum(1, keepdims=True)
        wrong[np.arange(len(target)), target] -= part
        back = wrong @ self.out[:, :-1]
        out = np.concatenate([wrong.T @ hidden, wrong.sum(0)[:, None]], 1)
        lengths = lex.begins[numbers + 1] - lex.begins[numbers]
        ways, owner = common.ranges(lex.begins[numbers], lengths), np.repeat(np.arange(len(numbers)), lengths)
        nodes = lex.nodes.take(ways)
        deep, own = self.nodes.take(nodes, 0), np.concatenate([hidden, np.ones((len(target), 1), np.float32)], 1).take(owner, 0)
        miss = (1 / (1 + np.exp(np.minimum(-np.einsum("nk,nk->n", own, deep), 80))) - (lex.sides.take(ways) > 0)) * part
        if len(ways):
            some = np.flatnonzero(lengths)
            deep *= miss[:, None]
            back[some] += np.add.reduceat(deep, (np.cumsum(lengths) - lengths)[some], 0)[:, :-1]
        own *= miss[:, None]
        passed, turned, passes = summed(nodes, own)
        places = np.einsum("nk,njk->jk", back, context)
        used, vectors, uses = summed(contexts.ravel(), (back[:, None] * self.places).reshape(-1, size))
        for p, g, s, rows in zip(self.parts, (vectors, places, out, turned), seen, (used, None, None, passed), strict=True):
            squares = s + g * g if rows is None else s.take(rows, 0) + g * g
            move = rate * g / (np.sqrt(squares) + 1e-6)
            if rows is None:
                s[:] = squares
                p -= move
            else:
                s[rows] = squares
                p[rows] = p.take(rows, 0) - move
        return [(used, uses), (passed, passes)]

    def train(self, numbers: np.ndarray, first: np.ndarray, lex: Lexicon, seen: list[np.ndarray], used: list[np.ndarray], rng: np.random.Generator, share: float = 1.0, rate: float = 0.05) -> None:
        """``used`` counts how often each vector and each node took part."""
        contexts = self.contexts(numbers, first)
        picked = np.flatnonzero(rng.random(len(numbers)) < share) if share < 1 else np.arange(len(numbers))
        for rows in np.array_split(picked, max(1, len(picked) // _BATCH)):
            if len(rows):
                for held, (met, times) in zip(used, self.step(contexts[rows], numbers[rows], lex, seen, rate), strict=True):
                    held[met] += times

    def log_chances(self, numbers: np.ndarray, first: np.ndarray, lex: Lexicon) -> np.ndarray:
        """The logarithm of each word's probability given its context."""
        tables = [(self.vectors * p).astype(np.float32) for p in self.places]
        contexts, target = self.contexts(numbers, first), lex.classes[numbers]
        weights, bias = self.out[:, :-1].T.astype(np.float32), self.out[:, -1].astype(np.float32)
        out = np.empty(len(numbers))
        for a in range(0, len(numbers), 4096):
            rows = contexts[a : a + 4096]
            hidden = tables[0].take(rows[:, 0], 0)
            for k in range(1, len(PLACES)):
                hidden += tables[k].take(rows[:, k], 0)
            scores = hidden @ weights + bias
            scores -= scores.max(1, keepdims=True)
            own = scores[np.arange(len(rows)), target[a : a + 4096]]
            out[a : a + 4096] = own - np.log(np.exp(scores).sum(1))
            if self.nodes is not None:
                ways, owner = lex.ways(numbers[a : a + 4096])
                deep = self.nodes.take(lex.nodes[ways], 0)
                z = np.einsum("nk,nk->n", hidden.take(owner, 0), deep[:, :-1]) + deep[:, -1]
                out[a : a + 4096] -= np.bincount(owner, np.log1p(np.exp(np.minimum(-z * lex.sides[ways], 80))), len(rows))
        return out + (lex.log_shares if self.nodes is None else lex.rest)[numbers]

    def blank_squares(self) -> list[np.ndarray]:
        return [np.zeros_like(p) for p in self.parts]


def trained(texts: DataFrame, lex: Lexicon, share: float = 1.0, start_documents: int = START_DOCUMENTS) -> Network:
    """A common start, a pass over the corpus in every task, and the average of the tasks' networks."""
    network = Network.fresh(lex.pad, CLASSES + RARE, odds=lex.odds)
    start = texts.select("doc_id", F.substring("text", 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - 4000, F.lit(1))).cast("int"), F.lit(4000)).alias("text"))
    rows = sorted(common.drawn(start, start_documents, "doc_id", "text").collect(), key=lambda r: r["text"])
    rng = np.random.default_rng(4)
    blank = lambda: [np.zeros(lex.pad + 1, np.int64), np.zeros(len(lex.odds), np.int64)]
    seen, used = network.blank_squares(), blank()
    for _ in range(2):
        for hashes, first in texts_words(pa.array([r["text"] for r in rows], pa.large_string())):
            network.train(lex.numbers(hashes), first, lex, seen, used, rng)
    shared = texts.sparkSession.sparkContext.broadcast((lex, network, seen))
    names = [f"x{k}" for k in range(SIZE + 1)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, common_start, squares = shared.value
        own = Network(*(p.copy() for p in common_start.parts))
        squares, total = [s.copy() for s in squares], 0
        used = [np.zeros(lex.pad + 1, np.int64), np.zeros(len(lex.odds), np.int64)]
        for batch in batches:
            for hashes, first in texts_words(batch.column(1)):
                # The share is drawn from the words themselves, so that a task run again learns the same.
                rng = np.random.default_rng(int(hashes.sum(dtype=np.uint64)) if len(hashes) else 0)
                own.train(lex.numbers(hashes), first, lex, squares, used, rng, share)
                total += len(hashes)
        if total:
            weights = used[0], np.full(len(own.places), total), np.full(len(own.out), total), used[1]
            weight, flat = np.concatenate(weights), flattened(own)
            for part in np.array_split(met := np.flatnonzero(weight), 1 + len(met) // 65536):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(weight[part]), *map(pa.array, flat[part].T.copy())], ["row", "weight", *names])

    # Each task hands on rows of the network, so there are no more tasks than run at a time.
    learned = texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(learn, "row long, weight long, " + ", ".join(f"{x} float" for x in names))
    mean = [(F.sum(F.col(x) * F.col("weight")) / F.sum("weight")).cast("float").alias(x) for x in names]
    flat, averaged = flattened(network), learned.groupBy("row").agg(*mean).toArrow()  # one row for each row of the network
    flat[averaged["row"].to_numpy()] = np.stack([averaged[x].to_numpy() for x in names], 1)
    vectors, places, out, nodes = np.split(flat, np.cumsum([len(p) for p in network.parts])[:-1])
    return Network(vectors[:, :SIZE].copy(), places[:, :SIZE].copy(), out, nodes)


def flattened(network: Network) -> np.ndarray:
    """All rows of a network, one below the other."""
    return np.concatenate([np.pad(p, ((0, 0), (0, SIZE + 1 - p.shape[1]))) for p in network.parts])


def scored_with(texts: DataFrame, lex: Lexicon, network: Network, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of each document by a trained network.

    ``counts`` has to be given with a lexicon that counts on them (``counted``).
    """
    shared = texts.sparkSession.sparkContext.broadcast((lex, network))
    counted = counts is not None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = shared.value
        for batch in batches:
            n, total, rare, rares = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for hashes, first in texts_words(batch.column(1)):
                numbers = lex.numbers(hashes)
                sums = np.append(0, np.cumsum(net.log_chances(numbers, first, lex)))
                n.append(np.diff(first))
                total.append(sums[first[1:]] - sums[first[:-1]])
                if counted:
                    beyond = numbers >= len(lex.hashes)
                    rare.append(hashes[beyond])
                    rares.append(np.diff(np.append(0, np.cumsum(beyond))[first]))
            columns = [batch.column(0), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(total))]
            if counted:
                columns.append(common.list_column(np.concatenate(rare).view(np.int64), np.append(0, np.cumsum(np.concatenate(rares))), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "log_prob", "rare"][: len(columns)])

    found = texts.mapInArrow(score, "doc_id long, n_tokens long, log_prob double" + ", rare array<long>" * counted)
    if counted:
        # Stored first: rows of equal ids are told apart by their places in the files.
        found = common.stored(found).withColumn("row", F.monotonically_increasing_id())
        met = found.select("row", F.explode("rare").alias("word")).join(counts, "word")
        logs = met.groupBy("row").agg(F.sum(F.log("n")).alias("logs"))
        found = found.select("row", "doc_id", "n_tokens", "log_prob").join(logs, "row", "left")
        found = found.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("logs", F.lit(0.0))).alias("log_prob"))
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 1.0) -> DataFrame:
    """Count, train and score: doc_id, n_tokens, log_prob and mean_log_prob for every document.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.  A null text
    or one without words has log_prob 0 and no mean.  Repeated rows count as often as they occur.
    """
    texts = common.id_and_text(docs, id_col, text_col)
    counts = common.stored(word_counts(texts))
    vocabulary, buckets = sizes(counts)
    lex = lexicon(counts, vocabulary, buckets=buckets, counted=True)
    return scored_with(texts, lex, trained(texts, lex, share), counts)
