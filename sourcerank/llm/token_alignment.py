"""Alignment of the tokens of two tokenizers, and how well their ids agree over the corpus.

Both tokenizers cut the bytes of the same string (a space and the text) end to end, so a token
is an interval of byte offsets.  Intervals are coalesced: all A and B tokens of many texts are
brought into order of their starts with one lexsort, the ends seen so far are a running
maximum, and a group begins wherever a start reaches it.  Inside the groups every A token
expands to the B tokens it overlaps.

Over the corpus an id pair counts as often as its tokens overlap.  Tasks store blocks of
some megabytes of text: what is said of each document, the distinct pairs of the block from
the most to the least frequent, and for each link the rank of its pair.  Pair counts are
added up by Spark, joined to the distinct pairs of each block, and handed back to the block as
one list, from which a second pass adds up the documents.  Nothing is broadcast, and no key
has more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from . import common
from .subwords import Encoder, joined, split_words

# Bytes of text in one stored block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
# Bytes of text whose tokens are held at once, some 200 bytes for each.  A worker peaks at some 300 MB.
TOKEN_BYTES = 512 << 10
# Blocks that a task of the second pass holds at once, on average: some 4 MB for each.
BLOCKS_AT_ONCE = 4

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<long>, b_group array<long>"
BLOCK = "part int, seq int, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, hashes array<string>, pair_a array<int>, pair_b array<int>, pair_n array<long>, low binary, high binary"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel:
    """A byte-level tokenizer file; strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain=True)
        vocabulary = self.encoder.inner.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        of = {c: b for b, c in enumerate(byte_letters())}
        for token, i in vocabulary.items():
            self.spelled[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each text end to end, and how many each has."""
        ids, counts = self.encoder.encode_flat([" " + t for t in texts])
        return ids.astype(np.int64), counts


class Pieces:
    """A sentence-piece model that puts a space before each text itself.

    If no piece holds a space behind another character, no piece reaches over a space that
    stands alone.  Texts are then cut there, and distinct words are encoded once for a slice.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.spelled = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.spelled.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.by_words = not any(b" " in s.lstrip(b" ") for s in self.spelled)
        # A single space that ends a text is cut off with an empty word behind it.
        self.last_space = self.model.encode("a ")[len(self.model.encode("a")) :]

    def _whole(self, texts: list[str], empty: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        coded = self.model.encode(texts, num_threads=1)
        if empty is not None:
            coded = [c if t else empty for c, t in zip(coded, texts)]
        counts = np.array([len(c) for c in coded], np.int64)
        return np.fromiter(chain.from_iterable(coded), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each text end to end, and how many each has."""
        if not self.by_words:
            return self._whole(texts)
        # The model's own space takes the place of the one that was cut or put first.
        heads, which, rows, words = split_words([" " + t for t in texts])
        ids, sizes = self._whole(words.to_pylist(), self.last_space)
        head_ids, head_sizes = self._whole([h[1:] for h in heads])
        ends = np.cumsum(head_sizes)
        raw = head_ids.astype("<u4").tobytes()
        alone = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), head_sizes.tolist())]
        ids, counts = joined(alone, which, rows, ids.astype("<u4"), sizes, np.arange(len(words)))
        return ids.astype(np.int64), counts


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others, in order, for the code points from 256.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Spelling:
    """The bytes of ids, gathered for many ids at once."""

    def __init__(self, spelled: list[bytes]):
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[common.ranges(self.starts[ids], self.lengths[ids])]


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, from the ends of tokens that lie end to end."""
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([a_ends[:1] * 0, a_ends[:-1], b_ends[:1] * 0, b_ends[:-1]])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_ends), len(b_ends)])
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group[: len(a_ends)], group[len(a_ends) :]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place of an A token, place of a B token) whose bytes overlap, by A token."""
    a_starts = np.append(0, a_ends[:-1])[: len(a_ends)]
    b_starts = np.append(0, b_ends[:-1])[: len(b_ends)]
    first = np.searchsorted(b_ends, a_starts, "right")
    many = np.searchsorted(b_starts, a_ends, "left") - first
    return np.repeat(np.arange(len(a_ends)), many), common.ranges(first, many)


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of the given lengths."""
    sums = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


class Aligner:
    """Two tokenizers and their spellings, once for each worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_spelling, self.b_spelling = Spelling(self.a.spelled), Spelling(self.b.spelled)
        self.b_size = len(self.b.spelled)
        most = max(len(self.a.spelled), self.b_size)
        self.width = len(str(most)) + 1
        numbers = [str(i).encode() for i in range(most)]
        self.digits = np.frombuffer(b"".join(n.ljust(self.width) for n in numbers), np.uint8).reshape(-1, self.width)
        self.digit_counts = np.array([len(n) for n in numbers], np.int64)

    def tokens(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Tokens of many texts that spell them exactly; a text that either side misspells has none."""
        raw = [f" {t}".encode() if t else b"" for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        a_ids, a_counts = self.a.encode(texts)
        b_ids, b_counts = self.b.encode(texts)
        good = sizes > 0
        for ids, counts, spelling in ((a_ids, a_counts, self.a_spelling), (b_ids, b_counts, self.b_spelling)):
            good &= _per_text(spelling.lengths[ids], counts) == sizes
        whole = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), np.uint8)
        held = np.flatnonzero(good)
        for ids, counts, spelling in ((a_ids, a_counts, self.a_spelling), (b_ids, b_counts, self.b_spelling)):
            wrong = _per_text(spelling.joined(ids[np.repeat(good, counts)]) != whole, sizes[held]) > 0
            good[held[wrong]] = False
            if wrong.any():
                whole = whole[np.repeat(~wrong, sizes[held])]
                held = held[~wrong]
        a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
        a_ends, b_ends = np.cumsum(self.a_spelling.lengths[a_ids]), np.cumsum(self.b_spelling.lengths[b_ids])
        a_group, b_group = coalesced(a_ends, b_ends)
        return dict(a_ids=a_ids, b_ids=b_ids, a_ends=a_ends, b_ends=b_ends, a_group=a_group, b_group=b_group, n_a=a_counts * good, n_b=b_counts * good)

    def told(self, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2`` of all texts end to end, a ``;`` behind each group, and the bytes of each group."""
        group = np.concatenate([t["a_group"], t["b_group"]])
        ids = np.concatenate([t["a_ids"], t["b_ids"]])
        side = np.repeat(np.array([0, 1], np.int64), [len(t["a_ids"]), len(t["b_ids"])])
        order = np.argsort(2 * group + side, kind="stable")
        group, ids, side = group[order], ids[order], side[order]
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[:-1][side[:-1] < side[1:]] = ord("|")
        mark[:-1][group[:-1] < group[1:]] = ord(";")
        mark[-1:] = ord(";")
        rows, counts = self.digits[ids], self.digit_counts[ids]
        rows[np.arange(len(ids)), counts] = mark
        kept = np.arange(self.width) <= counts[:, None]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        return rows[kept], np.bincount(group, counts + 1, n_groups).astype(np.int64)


def aligner(a_path: str, b_path: str) -> Aligner:
    return common.held(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def _group_counts(t: dict[str, np.ndarray]) -> np.ndarray:
    """Groups of each text: every text begins a group of its own."""
    ends = np.cumsum(t["n_a"])
    last = np.append(-1, t["a_group"])[ends]
    return np.diff(np.append(0, np.maximum.accumulate(last + 1)))


def alignments(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The ids of both tokenizers for each document and the group, counted from 0, of each token.

    Returns ``ALIGNED``, one row for each row of ``df``.  A null or empty text, and one that
    the pieces of either tokenizer do not spell byte for byte, has empty lists.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            _, offsets = common.bytes_of(batch.column(1))
            for first, last in common.slices(offsets, TOKEN_BYTES):
                t = both.tokens(batch.column(1).slice(first, last - first).to_pylist())
                groups = _group_counts(t)
                before = np.cumsum(groups) - groups
                a_at, b_at = (np.append(0, np.cumsum(t[c])) for c in ("n_a", "n_b"))
                a_own, b_own = t["a_group"] - np.repeat(before, t["n_a"]), t["b_group"] - np.repeat(before, t["n_b"])
                lists = [(t["a_ids"], a_at, pa.int32()), (t["b_ids"], b_at, pa.int32()), (a_own, a_at, pa.int64()), (b_own, b_at, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *[common.list_column(v, at, kind) for v, at, kind in lists]], ["doc_id", "a_ids", "b_ids", "a_group", "b_group"]
                )

    return common.id_and_text(df).mapInArrow(rows, ALIGNED)


def blocks(df: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``BLOCK`` rows: documents with their counts and hashes, distinct pairs, and the rank of every link's pair."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        both = aligner(a_path, b_path)
        docs: list[int | None] = []
        hashes: list[str] = []
        counts: dict[str, list[np.ndarray]] = {c: [] for c in _COUNTS}
        keys: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            pairs, rank, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            ranks, pairs = place[rank], pairs[order]
            row = {"part": part, "seq": seq, "doc_ids": docs, "hashes": hashes}
            row |= {c: np.concatenate(v) for c, v in counts.items()}
            row |= {"pair_a": pairs // both.b_size, "pair_b": pairs % both.b_size, "pair_n": times[order]}
            # Two planes of bytes: frequent pairs have small ranks, so that the high one is mostly zeros.
            row |= {"low": ranks.astype("<u2").tobytes(), "high": (ranks >> 16).astype("<u2").tobytes()}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BLOCK_ARROW], schema=_BLOCK_ARROW)

        for batch in batches:
            _, offsets = common.bytes_of(batch.column(1))
            for first, last in common.slices(offsets, TOKEN_BYTES):
                t = both.tokens(batch.column(1).slice(first, last - first).to_pylist())
                a_at, b_at = overlaps(t["a_ends"], t["b_ends"])
                said, group_bytes = both.told(t)
                groups = _group_counts(t)
                bytes_each = _per_text(group_bytes, groups)
                ends = np.cumsum(bytes_each).tolist()
                view = memoryview(said)
                docs += batch.column(0).slice(first, last - first).to_pylist()
                hashes += [hashlib.sha256(view[e - n : e - 1]).hexdigest() if n else "" for e, n in zip(ends, bytes_each.tolist())]
                links = np.bincount(a_at, minlength=len(t["a_ids"]))
                for c, v in zip(_COUNTS, (t["n_a"], t["n_b"], groups, _per_text(links, t["n_a"]))):
                    counts[c].append(v)
                keys.append(t["a_ids"][a_at] * both.b_size + t["b_ids"][b_at])
                size += int(offsets[last] - offsets[first])
                if size >= block_bytes:
                    yield block()
                    common.trim()
                    docs, hashes, counts, keys, seq, size = [], [], {c: [] for c in _COUNTS}, [], seq + 1, 0
        if docs:
            yield block()
        del both
        common.let_go()  # the steps that follow have no use for the tokenizers and need their memory

    return common.id_and_text(df).mapInArrow(cut, BLOCK)


_LONGS = pa.list_(pa.int64())
_INTS = pa.list_(pa.int32())
_BLOCK_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", _LONGS), *[(c, _LONGS) for c in _COUNTS], ("hashes", pa.list_(pa.string()))]
    + [("pair_a", _INTS), ("pair_b", _INTS), ("pair_n", _LONGS), ("low", pa.binary()), ("high", pa.binary())]
)


def pair_counts(stored_blocks: DataFrame) -> DataFrame:
    """a, b, count and whether no other A id has a higher count with that B id."""
    pairs = stored_blocks.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = pairs.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_n").alias("count"))
    counts = common.stored(counts)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def scored(df: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Counts of each document's tokens, groups and links, and how common its links are in the corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (empty
    where a document has no tokens).  One row for each row of ``df``: repeated rows count each,
    a null id stays null.  A null or empty text, and one that either tokenizer does not spell
    exactly, has zeros.  An empty table gives no rows; other columns are left behind.
    """
    with small_batches(df.sparkSession):
        held = common.stored(blocks(df, a_path, b_path, block_bytes), large_rows=True)
        counts = pair_counts(held)
    wanted = held.select("part", "seq", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("rank", "p"))
    wanted = wanted.select("part", "seq", "rank", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    # The last bit of a number says whether the pair is its B id's best.
    value = (2 * F.col("count") + F.col("best").cast("long")).alias("value")
    found = wanted.join(counts, ["a", "b"]).select("part", "seq", F.struct("rank", value).alias("v"))
    lists = found.groupBy("part", "seq").agg(F.transform(F.sort_array(F.collect_list("v")), lambda v: v["value"]).alias("value"))
    # A task hands Python all its blocks in one batch, so there are as many tasks as the blocks ask for.
    tasks = max(1, -(-held.count() // BLOCKS_AT_ONCE))
    # Blocks without a single link have no list.
    joined = held.drop("pair_a", "pair_b", "pair_n").repartition(tasks, "part", "seq").join(lists.repartition(tasks, "part", "seq"), ["part", "seq"], "left")
    columns = ["doc_ids", *_COUNTS, "hashes", "low", "high", "value"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()  # what another operator left
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in columns}
                docs, hashes = row["doc_ids"].values, row["hashes"].values
                n_a, n_b, n_groups, n_links = (row[c].values.to_numpy() for c in _COUNTS)
                ranks = np.frombuffer(row["low"].as_py(), "<u2").astype(np.int64) | np.frombuffer(row["high"].as_py(), "<u2").astype(np.int64) << 16
                value = row["value"].values.to_numpy()[ranks] if len(ranks) else ranks
                sums = [_per_text(value & 1, n_links), _per_text(value >> 1, n_links)]
                yield pa.RecordBatch.from_arrays([docs, *[pa.array(v) for v in (n_a, n_b, n_groups, n_links, *sums)], hashes], ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return joined.select(*columns).mapInArrow(added, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
