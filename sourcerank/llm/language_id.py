"""Language identification with a byte convolutional network, trained and applied in numpy.

A text is cut into windows of ``WINDOW`` bytes.  Each byte has a small vector; filters of
several widths run over the window, the largest response of each filter is kept, and a softmax
layer turns them into languages.  A text's probabilities are those of its windows, weighted by
their letters, so every byte of the text counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

WINDOW = 96
# Labelled documents of each language that are drawn for training (by hash, about as many).
SAMPLE_PER_LANGUAGE = 1500
_WINDOWS_AT_ONCE = 512

# Letters keep their byte, anything else of ASCII is a space.
_SYMBOL = np.full(256, 32, np.uint8)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)


@dataclass
class Network:
    """Byte vectors, one filter bank for each width, and the softmax layer."""

    languages: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, size: int = 8, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        banks = [rng.normal(0, (w * size) ** -0.5, (w * size, filters)).astype(np.float32) for w in widths]
        pooled = filters * len(widths)
        return Network(
            languages,
            rng.normal(0, 1, (256, size)).astype(np.float32),
            banks,
            [np.zeros(filters, np.float32) for _ in widths],
            rng.normal(0, pooled**-0.5, (pooled, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def _patches(self, embedded: np.ndarray, width: int) -> np.ndarray:
        n, length, size = embedded.shape
        a, b, c = embedded.strides
        view = np.lib.stride_tricks.as_strided(embedded, (n, length - width + 1, width * size), (a, b, c))
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Largest response of each filter, and where it is (for training)."""
        embedded = self.vectors[windows]
        size = embedded.shape[2]
        best, patches = [], []
        for bank, bias in zip(self.filters, self.biases):
            patch = self._patches(embedded, len(bank) // size)
            best.append((patch @ bank).max(axis=1) + bias)
            patches.append(patch)
        return np.maximum(np.concatenate(best, 1), 0), best, patches

    @functools.cached_property
    def tables(self) -> list[list[np.ndarray]]:
        """For each width and each pair of places in a filter, the responses to every pair of bytes; for a trained network."""
        size, out = self.vectors.shape[1], []
        for bank in self.filters:
            single = np.stack([self.vectors @ bank[k : k + size] for k in range(0, len(bank), size)])
            none = np.zeros_like(single[0])
            pairs = [(single[k], single[k + 1] if k + 1 < len(single) else none) for k in range(0, len(single), 2)]
            out.append([(a[:, None] + b[None]).reshape(-1, bank.shape[1]) for a, b in pairs])
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """The same responses as in training, looked up by pairs of bytes."""
        tables, size, out = self.tables, self.vectors.shape[1], []
        for k in range(0, len(windows), _WINDOWS_AT_ONCE):
            codes = windows[k : k + _WINDOWS_AT_ONCE].astype(np.intp) << 8
            codes[:, :-1] |= codes[:, 1:] >> 8
            best = []
            for bank, bias, parts in zip(self.filters, self.biases, tables):
                places = codes.shape[1] - len(bank) // size + 1
                found = parts[0][codes[:, :places]]
                for j, part in enumerate(parts[1:], 1):
                    found += part[codes[:, 2 * j : 2 * j + places]]
                best.append(found.max(1) + bias)
            scores = np.maximum(np.concatenate(best, 1), 0) @ self.out + self.out_bias
            scores = np.exp(scores - scores.max(1, keepdims=True))
            out.append(scores / scores.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, *self.filters, *self.biases, self.out, self.out_bias]

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of :meth:`parameters`."""
        hidden, best, patches = self.pooled(windows)
        scores = hidden @ self.out + self.out_bias
        scores = np.exp(scores - scores.max(1, keepdims=True))
        wrong = scores / scores.sum(1, keepdims=True)
        wrong[np.arange(len(target)), target] -= 1
        wrong /= len(target)
        back = (wrong @ self.out.T) * (hidden > 0)
        size = self.vectors.shape[1]
        vectors = np.zeros_like(self.vectors)
        filters, biases, at = [], [], 0
        for bank, patch in zip(self.filters, patches):
            count = bank.shape[1]
            part = back[:, at : at + count]
            place = (patch @ bank).argmax(1)
            taken = patch[np.arange(len(windows))[:, None], place]  # window, filter, weight
            filters.append(np.einsum("nf,nfw->wf", part, taken))
            biases.append(part.sum(0))
            behind = part[:, :, None] * bank.T[None]
            for k in range(len(bank) // size):
                np.add.at(vectors, windows[np.arange(len(windows))[:, None], place + k], behind[:, :, k * size : (k + 1) * size])
            at += count
        return [vectors, *filters, *biases, hidden.T @ wrong, wrong.sum(0)]


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """A text's windows, the last one filled with spaces."""
    n = max(1, -(-len(raw) // window))
    out = np.full(n * window, 32, np.uint8)
    out[: len(raw)] = _SYMBOL[np.frombuffer(raw, np.uint8)]
    return out.reshape(n, window)


def trained(texts: list[str], languages: list[str], epochs: int = 12, rate: float = 0.004, seed: int = 1) -> Network:
    """Adam steps on windows of labelled texts; a third of the windows are cut short at random."""
    names = sorted(set(languages))
    network = Network.fresh(names, seed=seed)
    if not names:
        return network
    found = [windows_of(t.encode()) for t in texts]
    windows = np.concatenate(found)
    target = np.repeat([names.index(x) for x in languages], [len(f) for f in found])
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 64)):
            batch = windows[rows].copy()
            for k in np.flatnonzero(rng.random(len(batch)) < 1 / 3):
                batch[k, rng.integers(8, WINDOW) :] = 32
            step += 1
            for p, g, (m, v) in zip(network.parameters(), network.gradients(batch, target[rows]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 of 4."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list:
    """About ``per_language`` labelled documents of each language, each with two windows' text at a place
    taken from its hash.  Documents are drawn by hash at a rate that follows from a count, so every
    partition of the table takes part and the driver gets a bounded number of short rows.
    """
    rows = docs.filter(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.col(id_col).cast("long").alias("doc_id"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return []
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) / 1_000_000
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    text = F.lower(F.col("text").substr(place.cast("int") + 1, F.lit(2 * WINDOW)))
    picked = rows.filter(draw < rate[F.col("label")]).select("doc_id", "label", text.alias("text"))
    # Ids that repeat very often could bring more; twice the number is the bound.
    picked = picked.limit(2 * per_language * len(counts) + 100)
    return sorted(picked.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"]))


def annotated(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score for every whole text; columns of these names are replaced.

    lang_pred is ``und`` (score 0) for a null text, one without a letter, or when nothing was
    learned.  Equal probabilities go to the language first in order.  Repeated rows are
    documents of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    docs = docs.drop("lang_pred", "score")
    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        net = shared.value
        for batch in batches:
            *others, column = batch.columns
            data, offsets = common.bytes_of(column)
            known = np.asarray(column.is_valid()) & bool(net.languages)
            names = np.array(["und"] * len(known), object)
            scores = np.zeros(len(known))
            for a, b in common.slices(offsets):
                rows = np.flatnonzero(known[a:b]) + a
                if not len(rows):
                    continue
                held = [windows_of(data[offsets[r] : offsets[r + 1]].tobytes()) for r in rows]
                windows = np.concatenate(held)
                weight = (windows != 32).sum(1) + 1e-3
                chances = net.probabilities(windows) * weight[:, None]
                first = np.cumsum([0, *(len(h) for h in held)])[:-1]
                total = np.add.reduceat(chances, first) / np.add.reduceat(weight, first)[:, None]
                best = total.argmax(1)
                names[rows] = np.array(net.languages, object)[best]
                scores[rows] = total[np.arange(len(rows)), best].clip(0, 1)
            columns = [*others, pa.array(names.tolist(), pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select("*", text.alias("_normal")).mapInArrow(read, schema)


def predicted(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return annotated(rows, network).select("doc_id", "lang_pred", "score")


def identified(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Train on the labelled documents that are not held out, then predict all: doc_id, held_out, lang_pred, score."""
    sample = training_sample(docs, per_language)
    network = trained([r["text"] for r in sample], [r["label"] for r in sample])
    return predicted(docs, network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
