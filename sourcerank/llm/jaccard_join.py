"""Set similarity join of documents on word n-grams by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes, and fragments are ranges of it.

*Candidates.*  Two sets that reach the threshold differ in at most ``d`` n-grams, ``d``
following from their sizes.  The order is therefore cut into ``d + 1`` fragments and some spare
ones, and such a pair agrees wholly on more fragments than may be empty (a set in which more are
empty states those as well).  How many fragments are cut depends on a set's size level; a set
states its fragments for its own level and the one below.  Fragment keys are shuffled once, packed
by their first bits in some 12 bytes each, and what occurs in several classes is told bucket by bucket.
Sets that agree on a fragment form a star around one of them, not all pairs.

*Verification.*  The order is also cut into parts.  Star pairs whose n-gram counts differ too
much, part by part, cannot link; for the others the overlaps of all parts are counted
separately and summed.  Members of one star that still lie in different components are compared
as well, unless their counts, or what they lack of the centre part by part, differ by more than
a link allows; so no link between different sets is lost.

Equal sets are one class from the start: copies never meet each other.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_if_small
from . import common, words
from .components import components

# Bytes of text whose sets a task holds at once.
SET_BYTES = 1 << 18
# Fragment keys that a task packs at once, and that a bucket of them has at most on average.
PACK_KEYS = 1 << 19
BUCKET_KEYS = 1 << 21
# N-grams on one side of a cell of pairs, on average.
CELL_GRAMS = 1 << 20
# The n-gram order is cut into 2^PART_BITS parts whose overlaps are counted apart.
PART_BITS = 6
_ODD = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FEATURES = "doc_id long, n_shingles long, cls long, other long, counts array<int>"


@functools.lru_cache(maxsize=8)
def levels(threshold: Fraction) -> list[int]:
    """The smallest set size of each level; a level's sizes lie within the threshold's ratio."""
    firsts = [1]
    while firsts[-1] < 1 << 40:
        firsts.append(int(firsts[-1] / threshold) + 1)
    return firsts


def fragment_count(level: int, threshold: Fraction) -> tuple[int, int]:
    """(fragments of a level, how many of them may be empty); no fragments if only equal sets can link.

    There is one more than the largest possible difference and the empty ones allowed, so that
    a linked pair agrees on one that is not empty.
    """
    largest = levels(threshold)[level + 1] - 1
    differ = int(largest * (1 - threshold) / threshold)
    spare = 1 - (-differ // 10)
    return (differ + 1 + spare, spare) if differ else (0, 0)


def fragment_keys(shingles: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Keys of the fragments of one set (sorted distinct hashes), for its level and the one below."""
    level = bisect.bisect_right(levels(threshold), len(shingles)) - 1
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(words.mixed(shingles), out=sums[1:])
    keys = []
    for at in (level, level - 1):
        n, spare = fragment_count(at, threshold) if at >= 0 else (0, 0)
        if not n:
            continue
        cuts = np.arange(1, n, dtype=np.uint64) * np.uint64((1 << 64) // n)
        edges = np.concatenate([[0], np.searchsorted(shingles, cuts), [len(shingles)]])
        held = np.diff(edges) > 0
        if n - held.sum() > spare:
            held[:] = True
        salt = (np.arange(n, dtype=np.uint64) << np.uint64(8)) + np.uint64(at + 1)
        keys.append(words.mixed(sums[edges[1:]] - sums[edges[:-1]] + words.mixed(salt))[held])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def set_slices(column: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Slices of a text column: (first row, row behind the last, the sorted distinct n-gram hashes of each).

    A slice has a bounded number of bytes, so that the sets of a batch are never held together.
    Fewer words than ``width`` are one n-gram.
    """
    data, offsets = common.bytes_of(column)
    for a, b in common.slices(offsets, SET_BYTES):
        lower = words.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = words.split(lower, offsets[a : b + 1] - offsets[a], words.NOT_SPACE)
        hashes = words.range_hashes(words.running(lower), starts, ends)
        grams = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width if len(grams) else 0):
            grams += hashes[k : k + len(grams)] * _ODD[k]
        grams = words.mixed(grams)
        sets = []
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= width:
                sets.append(np.unique(grams[lo : hi - width + 1]))
            elif hi > lo:
                few = (hashes[lo:hi] * _ODD[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
                sets.append(words.mixed(few + _ODD[32 + hi - lo]))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield a, b, sets


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, _, sets in set_slices(column, width):
        yield from sets


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    both = [words.mixed(words.mixed(shingles ^ _ODD[k]).sum(dtype=np.uint64, keepdims=True)) for k in (60, 61)]
    return tuple(int(h.view(np.int64)[0]) for h in both)


def part_counts(shingles: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each part of the order."""
    return np.bincount((shingles >> np.uint64(64 - PART_BITS)).astype(np.int64), minlength=1 << PART_BITS)


def features(docs: DataFrame, width: int) -> DataFrame:
    """Per document: size and identity of its n-gram set, and its n-grams in each part of the order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = 1 << PART_BITS
        common.let_go()
        for batch in batches:
            for a, b, sets in set_slices(batch.column(1), width):
                rows = [(len(s), *_identity(s), part_counts(s)) for s in sets]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                flat = np.concatenate([r[3] for r in rows])
                columns = [batch.column(0).slice(a, b - a), *columns, common.list_column(flat, np.arange(len(rows) + 1) * parts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "cls", "other", "counts"])

    return docs.mapInArrow(read, _FEATURES)


def fragment_packs(docs: DataFrame, width: int, threshold: Fraction, bits: int) -> DataFrame:
    """(bucket, marks, owners): the fragment keys of many documents, dealt out by their first ``bits`` bits.

    A mark is the 32 bits of a key behind those of its bucket, 4 bytes; its owner is the class of the
    set, 8 bytes.  Copies that are packed together speak once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        held: dict[int, np.ndarray] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            keys = np.concatenate(list(held.values()))
            owners = np.repeat(np.array(list(held), "<i8"), [len(k) for k in held.values()])
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
            marks = (keys >> np.uint64(32 - bits)).astype("<u4")
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            columns = [pa.array(bucket[cuts[:-1]]), *(binary_column(x, cuts) for x in (marks, owners))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "marks", "owners"])

        for batch in batches:
            for _, _, sets in set_slices(batch.column(1), width):
                for s in sets:
                    keys = fragment_keys(s, threshold)
                    cls = _identity(s)[0]
                    if len(keys) and cls not in held:
                        held[cls] = keys
                        size += len(keys)
                    if size >= PACK_KEYS:
                        yield packed()
                        held.clear()
                        size = 0
        if held:
            yield packed()
        held.clear()
        common.trim()

    return docs.mapInArrow(read, "bucket int, marks binary, owners binary")


def binary_column(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of a flat array as one column of bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def met_keys(packs: DataFrame) -> DataFrame:
    """(key, cls): the fragment keys that sets of several classes have, and these classes."""

    def meet(table: pa.Table) -> pa.Table:
        marks, owners = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("marks", "<u4"), ("owners", "<i8")))
        order = np.argsort(marks)
        same = np.diff(marks[order]) == 0
        # Marks that occur again, each class once.
        order = order[np.append(False, same) | np.append(same, False)]
        both = np.unique(np.stack([marks[order].astype(np.int64), owners[order]], axis=1), axis=0)
        same = np.diff(both[:, 0]) == 0
        both = both[(np.append(False, same) | np.append(same, False))[: len(both)]]
        bucket = table.column("bucket")[0].as_py()
        common.trim()
        return pa.table([pa.array(bucket << 32 | both[:, 0]), pa.array(both[:, 1])], ["key", "cls"])

    return packs.groupBy("bucket").applyInArrow(meet, "key long, cls long")


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(cls, shingles): the n-gram sets of documents in the global order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found in set_slices(batch.column(1), width):
                sets = [s for s in found if len(s)]
                offsets = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                columns = [pa.array([_identity(s)[0] for s in sets], pa.int64()), common.list_column(flat, offsets, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "shingles"])

    return docs.mapInArrow(read, "cls long, shingles array<long>")


def partial_overlaps(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, apart: bool = True) -> DataFrame:
    """Pairs (a, b) of classes with their sizes, the overlap summed over all parts of the n-gram
    order, and, with ``apart``, how many n-grams of either are missing in the other, part by part.

    Each of ``pairs`` (a, b, star) is compared in a cell, to which a set goes once, however many
    pairs it is in: a star with many n-grams is a grid of cells, small stars share cells.
    ``sizes`` has cls and n, ``sets`` may hold a class again.
    """

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = 1 << PART_BITS
        known = right.column("cls").combine_chunks()
        at = [pc.index_in(left.column(c).combine_chunks(), known) for c in ("a", "b")]
        found = pc.and_(*(x.is_valid() for x in at))
        left, at = left.filter(found), [x.filter(found).to_numpy() for x in at]
        held = [np.asarray(x.values).view(np.uint64) for x in right.column("shingles").combine_chunks()]
        n = np.array([len(x) for x in held], np.int64)
        of = np.stack([part_counts(x) for x in held]) if apart and held else None
        shared = np.zeros(left.num_rows, np.int64)
        lacks = np.zeros((left.num_rows if apart else 0, parts), np.int32)
        for row, (i, j) in enumerate(zip(at[0].tolist(), at[1].tolist())):
            x, y = held[i], held[j]
            both = y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y]
            shared[row] = len(both)
            if apart:
                lacks[row] = of[i] + of[j] - 2 * part_counts(both)
        columns = {"a": left.column("a"), "b": left.column("b"), "n_a": pa.array(n[at[0]]), "n_b": pa.array(n[at[1]]), "shared": pa.array(shared)}
        if apart:
            columns["apart"] = common.list_column(lacks.ravel(), np.arange(left.num_rows + 1) * parts, pa.int32())
        common.trim()
        return pa.table(columns)

    held = pairs.select("star", F.explode(F.array("a", "b")).alias("cls")).distinct().join(sizes.select("cls", "n"), "cls")
    stars = common.stored(held.groupBy("star").agg(F.ceil(F.sum("n") / CELL_GRAMS).alias("parts"), F.sum("n").alias("n")))
    shared_cells = (stars.filter("parts = 1").agg(F.sum("n")).first()[0] or 0) // CELL_GRAMS + 1
    line = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("star"), F.lit(shared_cells))).otherwise(F.col("star"))
    x, y = (F.pmod(F.xxhash64(c), "parts") for c in ("a", "b"))
    placed = common.stored(pairs.join(stars.select("star", "parts"), "star").select("a", "b", line.alias("line"), x.alias("x"), y.alias("y")))
    cell = ["line", "x", "y"]
    wanted = placed.select(*cell, F.explode(F.array("a", "b")).alias("cls")).distinct()
    moved = wanted.join(sets.dropDuplicates(["cls"]), "cls").select(*[F.col(c).alias(f"of_{c}") for c in cell], "cls", "shingles")
    kinds = "a long, b long, n_a long, n_b long, shared long" + (", apart array<int>" if apart else "")
    return placed.groupBy(*cell).cogroup(moved.groupBy(*[f"of_{c}" for c in cell])).applyInArrow(count, kinds)


def linked(docs: DataFrame, width: int = 3, threshold: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set of ``width``-word n-grams) and component_id.

    Two documents link when the Jaccard similarity of their sets reaches ``threshold``;
    component_id is the smallest doc_id that links lead to, the document's own included.
    Words are runs of anything but ASCII white space, A-Z in lower case; a text of fewer words
    is one n-gram; a null text or one without words has an empty set and links with nothing.
    Repeated rows are documents of their own with equal sets.  Rows without an id link like
    others; a component is named by its least id, and has none only if all its ids are null.
    """
    texts = common.id_and_text(docs, id_col, text_col)
    seen = common.stored(features(texts, width))
    classes = common.stored(
        seen.filter("n_shingles > 0")
        .groupBy("cls", "n_shingles", "other")
        .agg(F.min("doc_id").alias("first_id"), F.any_value("counts").alias("counts"))
        .select("cls", "n_shingles", "first_id", "counts")
    )
    nameless = classes.filter("first_id is null").select("cls")
    some_nameless = nameless.limit(1).count() > 0
    # A set has no more keys than n-grams.
    n_keys = seen.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(24, max(6, (n_keys // BUCKET_KEYS).bit_length()))
    with common.noted() as passing:
        common_keys = common.stored(met_keys(fragment_packs(texts, width, threshold, bits)))
    # The centre of a star is its member with the most fragments that others have as well, which
    # is the least edited of a family: few centres serve many fragments, and lie near their stars.
    weights = common_keys.groupBy("cls").agg(F.count("*").alias("weight"))
    weighted = common_keys.join(weights, "cls")
    centres = weighted.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("top")).select("key", F.col("top.cls").alias("centre"))
    star = common_keys.join(centres, "key").filter("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    num, den = threshold.numerator, threshold.denominator

    def close(x: str, y: str, vectors: str) -> str:
        """What two sets lack of each other is at least the difference of their vectors, part by part."""
        least = f"aggregate(zip_with({x}.{vectors}, {y}.{vectors}, (p, q) -> abs(p - q)), 0, (s, d) -> s + d)"
        sizes = f"{den} * {x}.n >= {num} * {y}.n and {den} * {y}.n >= {num} * {x}.n"
        return f"({sizes} and {den + num} * {least} <= {den - num} * ({x}.n + {y}.n))"

    size = classes.select("cls", F.col("n_shingles").alias("n"), "counts")
    star = common.stored(star.join(size, star["b"] == size["cls"]).select("a", "b", "n", "counts"))
    common.remove(docs.sparkSession, passing)
    x, y = star.alias("x"), size.alias("y")
    checked = x.join(y, F.expr("x.a = y.cls")).filter(close("x", "y", "counts")).select("x.a", "x.b")
    checked = common.stored(checked)

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the classes in pairs, from the texts of their speakers."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        ids = classes.join(named, "cls", "left_semi").select(F.col("first_id").alias("doc_id"))
        chosen = texts.join(ship_if_small(common.stored(ids), 16), "doc_id", "left_semi")
        rows = set_rows(chosen, width)
        if some_nameless:
            rows = rows.union(set_rows(texts.filter("doc_id is null"), width).join(named.join(nameless, "cls", "left_semi"), "cls", "left_semi"))
        return rows

    measured = common.stored(partial_overlaps(checked.withColumn("star", F.col("a")), sets_of(checked), size))
    links_when = F.expr(f"{den} * shared >= {num} * (n_a + n_b - shared)")
    links = measured.filter(links_when).select("a", "b")
    labels = components(links)

    # Members of one star in different components: their counts, and what they lack of the centre
    # where that was measured, must allow a link.
    own = labels.select(F.col("node").alias("b"), "label")
    at = star.join(measured.select("a", "b", "apart"), ["a", "b"], "left").join(own, "b", "left")
    at = common.stored(at.withColumn("label", F.coalesce("label", "b")))
    may = f"{close('x', 'y', 'counts')} and (x.apart is null or y.apart is null or {close('x', 'y', 'apart')})"
    open_pairs = at.alias("x").join(at.alias("y"), F.expr(f"x.a = y.a and x.b < y.b and x.label <> y.label and {may}"))
    open_pairs = common.stored(open_pairs.groupBy(F.col("x.b").alias("a"), F.col("y.b").alias("b")).agg(F.min("x.a").alias("star")))
    if open_pairs.limit(1).count():
        more = partial_overlaps(open_pairs, sets_of(open_pairs), size, apart=False).filter(links_when).select("a", "b")
        labels = components(links.union(common.stored(more)))

    placed = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = placed.groupBy("label").agg(F.min("first_id").alias("component"))
    named = placed.join(names, "label").select("cls", "component")
    out = seen.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
