"""Removal of long repeated byte strings with suffix arrays of shards.

*Shards.*  Every string of ``length`` bytes has an anchor: the gram with the least hash in it.
Equal strings have equal anchors at equal offsets, so strings that repeat always meet in the
shard of their anchor, whatever documents they stand in.  Strings of a document that begin one
after the other and share an anchor form a block; equal blocks are counted before they are
moved, so copies cost one block.  An anchor that occurs once is done.

*Sorting.*  The different blocks of an anchor are laid end to end with those of other anchors;
their suffix array is induced, and permuted common prefixes of ``length`` bytes or more group
the strings that are equal.  A string is repeated if its group, with copies of blocks counted,
has more than one place.

*Hot anchors.*  Blocks of an anchor with more than ``HOT_BLOCKS`` different ones would not fit
one array; their strings are grouped by two 64-bit hashes instead, which Spark adds up before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_if_small
from . import common, words
from .suffixes import permuted_prefixes, suffix_array

GRAM = 40
HOT_BLOCKS = 4096
# Bytes of blocks that are sorted at once; an anchor's blocks stay together.
ARRAY_BYTES = 1 << 20
_OCCURRENCES = "doc_id long, tag int, blocks array<struct<anchor: long, block: long, at: int, n: int>>"
_BLOCK = pa.struct([("anchor", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def blocks_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Blocks of the documents of a slice: (row, anchor, block, at, n).

    A block is ``n`` strings of ``length`` bytes that begin at byte ``at`` and after, and
    have one anchor.
    """
    strings = np.maximum(np.diff(offsets) - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not strings.sum():
        return none, none, none, none, none
    sums = words.running(data)
    spots = np.arange(len(data) - gram + 1)
    hashes = words.range_hashes(sums, spots, spots + gram)
    low = np.uint64((1 << 28) - 1)
    least = sliding_least((hashes & ~low) | spots.astype(np.uint64), length - gram + 1)
    begins = common.ranges(offsets[:-1], strings)
    anchors = (least[begins] & low).astype(np.int64)
    rows = np.repeat(np.arange(len(strings)), strings)
    new = np.ones(len(begins), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(begins)))
    at, anchor, row = begins[first], anchors[first], rows[first]
    block = words.mixed(words.range_hashes(sums, at, at + n - 1 + length) + (anchor - at).astype(np.uint64))
    return row, hashes[anchor].view(np.int64), block.view(np.int64), at - offsets[row], n


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The blocks of each document; ``tag`` tells rows of equal id and different text apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for batch in batches:
            data, offsets = common.bytes_of(batch.column(2))
            for a, b in common.slices(offsets):
                row, *columns = blocks_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, gram)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "block", "at", "n"])
                held = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), held], ["doc_id", "tag", "blocks"])

    return docs.mapInArrow(read, _OCCURRENCES)


def block_texts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, block, copies, hot, n, content): the bytes of one occurrence of each wanted block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("anchor", pa.int64()), ("block", pa.int64()), ("copies", pa.int64()), ("hot", pa.bool_()), ("n", pa.int32()), ("content", pa.binary())]
        common.let_go()
        for batch in batches:
            _, offsets = common.bytes_of(batch.column(0))
            for a, b in common.slices(offsets):
                out = []
                for raw, wants in zip(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)):
                    raw = raw.as_py().encode()
                    out += [w | {"content": raw[w["at"] : w["at"] + w["n"] - 1 + length]} for w in wants.as_py()]
                for k in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist(out[k : k + 10_000], pa.schema(fields))

    one = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "block", "copies", "hot", "at", "n")).alias("wants"))
    # Repeated rows would give a block twice.
    texts = texts.join(ship_if_small(wanted.select("doc_id").distinct(), 16), "doc_id", "left_semi").dropDuplicates(["doc_id", "tag"])
    joined = texts.join(one, ["doc_id", "tag"]).select("text", "wants")
    return joined.mapInArrow(cut, "anchor long, block long, copies long, hot boolean, n int, content binary")


def repeated_in(contents: list[bytes], n: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each block, which of its strings have more than one place, by one suffix array.

    Strings of different anchors differ, so the blocks of many anchors may lie together.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    s = np.full(int(sizes.sum()) + len(sizes) + 1, 1, np.int16)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    s[common.ranges(begins, sizes)] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int16) + 2
    s[-1] = 0
    sa = suffix_array(s)
    prefixes = permuted_prefixes(s, sa, length)
    group = np.empty(len(s), np.int64)
    group[sa] = np.cumsum(prefixes[sa] < length)
    places = common.ranges(begins, n)
    weights = np.repeat(copies, n)
    total = np.bincount(group[places], weights)
    return np.split(total[group[places]] > 1, np.cumsum(n)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    turns = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(turns > 0).tolist(), (np.flatnonzero(turns < 0) - 1).tolist()))


def repeated_strings(contents: DataFrame, length: int) -> DataFrame:
    """(anchor, block, first, last): runs of repeated strings of blocks, counted within the block."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        common.let_go()

        def decided() -> pa.RecordBatch:
            flags = repeated_in([r["content"] for r in held], np.array([r["n"] for r in held]), np.array([r["copies"] for r in held]), length)
            rows = [(r["anchor"], r["block"], a, b) for r, f in zip(held, flags) for a, b in _runs(f)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.int32()])]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "block", "first", "last"])

        for batch in batches:
            for row in batch.to_pylist():
                if size >= ARRAY_BYTES and row["anchor"] != held[-1]["anchor"]:
                    yield decided()
                    held, size = [], 0
                held.append(row)
                size += len(row["content"]) + 1
        if held:
            yield decided()

    # Both arms use the content; it is cut out of the texts once.
    sorted_ = contents.filter("not hot").repartition("anchor").sortWithinPartitions("anchor")
    by_array = sorted_.mapInArrow(sort, "anchor long, block long, first int, last int")
    return by_array.union(_by_hash(contents.filter("hot"), length))


def _by_hash(contents: DataFrame, length: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["content"], np.uint8)
                at = np.arange(row["n"])
                one = words.range_hashes(words.running(data), at, at + length)
                two = words.range_hashes(words.running(255 - data), at, at + length)
                same = [pa.array(np.full(len(at), row[k]), pa.int64()) for k in ("anchor", "block", "copies")]
                columns = [*same, pa.array(at, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "block", "copies", "first", "one", "two"])

    strings = contents.mapInArrow(read, "anchor long, block long, copies long, first int, one long, two long")
    many = strings.groupBy("one", "two").agg(F.sum("copies").alias("places")).filter("places > 1").select("one", "two")
    return strings.join(many, ["one", "two"]).select("anchor", "block", "first", F.col("first").alias("last"))


def repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, hot_blocks: int = HOT_BLOCKS, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes) and spans (start, end, ...).

    Every byte goes that is covered by a string of ``length`` bytes which also starts anywhere
    else, in the same document or another; strings are judged on the input, overlaps count,
    and matches never cross documents.  A null text is empty.  Repeated rows are documents of
    their own, so their texts of ``length`` bytes or more go wholly.  ``carry`` names columns
    that are handed on in a struct ``carried``.  ``as_text`` makes a string of ``kept``; a
    character that lost some of its bytes goes wholly.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("own_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"),
    )
    # Inside, a null id is a number like any other; the tag tells its rows apart.
    texts = texts.select(F.coalesce("own_id", F.lit(-(1 << 63))).alias("doc_id"), F.hash("text").alias("tag"), "text", "own_id", "carried")
    seen = common.stored(occurrences(texts.select("doc_id", "tag", "text"), length, gram))
    flat = seen.select("doc_id", "tag", F.inline("blocks"))
    met = flat.groupBy("anchor").agg(F.count("*").alias("times"), F.min("block").alias("low"), F.max("block").alias("high"))
    met = met.filter("times > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike"))
    shared = common.stored(flat.join(met, "anchor"))

    alike = shared.filter("alike").select("doc_id", "tag", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"))
    varied = shared.filter("not alike")
    place = F.struct("doc_id", "tag", "at", "n")
    variants = varied.groupBy("anchor", "block").agg(F.count("*").alias("copies"), F.min(place).alias("place"))
    variants = common.stored(variants.select("anchor", "block", "copies", "place.*"))
    hot = variants.groupBy("anchor").agg(F.count("*").alias("different")).filter(F.col("different") > hot_blocks)
    hot = hot.select("anchor", F.lit(True).alias("hot"))
    wanted = common.stored(variants.join(hot, "anchor", "left").fillna(False, ["hot"]))
    contents = common.stored(block_texts(texts.select("doc_id", "tag", "text"), wanted, length))
    found = repeated_strings(contents, length)
    decided = varied.join(found, ["anchor", "block"]).select(
        "doc_id", "tag", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")
    )
    runs = alike.union(decided).groupBy("doc_id", "tag").agg(F.array_distinct(F.collect_list(F.struct("first", "last"))).alias("runs"))
    joined = texts.join(runs, ["doc_id", "tag"], "left").select("own_id", "text", "runs", "carried")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string() if as_text else pa.binary(), pa.list_(pa.int64())]
        common.let_go()
        for batch in batches:
            _, offsets = common.bytes_of(batch.column(1))
            # A whole batch of texts would be held several times over.
            for a, b in common.slices(offsets):
                out = []
                for doc, text, found in zip(*(batch.column(k).slice(a, b - a) for k in range(3))):
                    raw, at, kept, spans = text.as_py().encode(), 0, [], []
                    for first, last in sorted((x["first"], x["last"] + length) for x in found.as_py() or ()):
                        if spans and first <= spans[-1]:
                            spans[-1] = max(spans[-1], last)
                        else:
                            spans += [first, last]
                    for first, last in zip(spans[::2], spans[1::2]):
                        kept.append(raw[at:first])
                        at = last
                    kept = b"".join([*kept, raw[at:]])
                    out.append((doc.as_py(), len(raw), len(raw) - len(kept), len(spans) // 2, kept.decode("utf-8", "ignore") if as_text else kept, spans))
                columns = list(zip(*out))
                arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column(3).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "carried"])

    fields = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, spans array<long>, carried {dict(joined.dtypes)['carried']}"
    found = joined.mapInArrow(remove, fields)
    return found if carry else found.drop("carried")


def digest(found: DataFrame) -> DataFrame:
    """Repeats with the SHA-256 of the bytes that are left."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
