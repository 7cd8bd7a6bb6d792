"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items build one automaton (in blocks of bounded size, where the items are
many).  Training words stream through it: the automaton's state and the length of the longest
suffix that occurs in an item follow each word.  Words outside the items' vocabulary reset
the match, so runs of known words are independent, and numpy moves all runs of a slice of
text by one word at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

# Bytes of item texts that one automaton may hold.
BLOCK_BYTES = 4 << 20
_FOUND = "doc_id long, key long, n_words long, spans array<long>, n_hit long, items array<string>"


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, starts, ends) of the normalised words of texts."""
    data, offsets = common.bytes_of(pa.array(texts, pa.large_string()))
    lower = words.LOWER[data]
    starts, ends, first = words.split(lower, offsets, words.ALNUM)
    return words.range_hashes(words.running(lower), starts, ends), first, starts, ends


class Automaton:
    """Suffix automaton of several word sequences, with the items that its windows belong to."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        hashes, first, _, _ = word_ids([text for _, text in items])
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes)
        self._edges: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        for a, b in zip(first[:-1], first[1:]):
            last = 0
            for c in ids[a:b].tolist():
                last = self._extend(last, c)
        self.link = np.array(self._link)
        self.length = np.array(self._length)
        keys = np.array([s * len(self.vocabulary) + c for s, e in enumerate(self._edges) for c in e], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.targets = np.array([t for e in self._edges for t in e.values()], np.int64)[order]
        del self._edges, self._link, self._length
        self._mark([name for name, _ in items], ids, first)

    def _extend(self, last: int, c: int) -> int:
        edges, link, length = self._edges, self._link, self._length
        if c in edges[last]:
            q = edges[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        state = len(length)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return state

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state ``q`` for its shorter strings."""
        edges, link, length = self._edges, self._link, self._length
        state = len(length)
        edges.append(dict(edges[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = state
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = state
            p = link[p]
        return state

    def _mark(self, names: list[str | None], ids: np.ndarray, first: np.ndarray) -> None:
        """Note items at the state of each of their windows; short items at that of all their words."""
        self.items_at: dict[int, set[str | None]] = defaultdict(set)
        self.short_at: dict[int, list[tuple[int, str | None]]] = defaultdict(list)
        states, lengths = self.stream(ids, first[:-1])
        for name, a, b in zip(names, first[:-1].tolist(), first[1:].tolist()):
            if b - a >= self.window:
                for k in range(a + self.window - 1, b):
                    self.items_at[self._at_window(int(states[k]))].add(name)
            elif b > a:
                self.short_at[int(states[b - 1])].append((b - a, name))
        # The shortest match that a state's words, or shorter ones behind its links, make a hit.
        self.least = np.full(len(self.length), self.window)
        for state, found in self.short_at.items():
            self.least[state] = min(n for n, _ in found)
        for state in np.argsort(self.length, kind="stable")[1:]:
            self.least[state] = min(self.least[state], self.least[self.link[state]])
        self._known: dict[tuple[int, int], tuple[int, frozenset[str | None]]] = {}

    def _at_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = int(self.link[state])
        return state

    def stream(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and longest matching length after each word; matches start anew at ``begins``.

        ``ids`` are numbers of the vocabulary, -1 for words outside it.
        """
        states, lengths = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        inside = ids >= 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = begins[begins < len(ids)]
        opens[edges] = inside[edges]
        lanes = np.flatnonzero(opens)
        if not len(lanes):
            return states, lengths
        stops = np.append(np.flatnonzero(~inside), len(ids))
        ends = np.minimum(stops[np.searchsorted(stops, lanes)], np.append(lanes[1:], len(ids)))
        state, length = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        while len(lanes):
            word = ids[lanes]
            open_lanes = np.arange(len(lanes))
            while len(open_lanes):
                key = state[open_lanes] * len(self.vocabulary) + word[open_lanes]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[at] == key
                done = open_lanes[there]
                state[done] = self.targets[at[there]]
                length[done] += 1
                open_lanes = open_lanes[~there]
                back = self.link[state[open_lanes]]
                state[open_lanes] = np.maximum(back, 0)
                length[open_lanes] = self.length[state[open_lanes]]
                lost = back < 0  # not even the word alone, which only a root without it gives
                length[open_lanes[lost]] = 0
                open_lanes = open_lanes[~lost]
            states[lanes], lengths[lanes] = state, length
            lanes = lanes + 1
            on = lanes < ends
            lanes, ends, state, length = lanes[on], ends[on], state[on], length[on]
        return states, lengths

    def covered(self, state: int, length: int) -> tuple[int, frozenset[str | None]]:
        """Words behind a position that are hit, and the items they come from."""
        key = (state, min(length, self.window))
        if key not in self._known:
            most, names = 0, set()
            if length >= self.window:
                most = self.window
                names |= self.items_at[self._at_window(state)]
            at = state
            while at > 0:
                for n, name in self.short_at.get(at, ()):
                    if n <= length:
                        most = max(most, n)
                        names.add(name)
                at = int(self.link[at])
            self._known[key] = (most, frozenset(names))
        return self._known[key]

    def scan(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, int, set[str | None]]]:
        """Per text: number of words, byte spans of hit runs, hit words, item names."""
        data, offsets = common.bytes_of(column)
        for a, b in common.slices(offsets):
            lower = words.LOWER[data[offsets[a] : offsets[b]]]
            inner = offsets[a : b + 1] - offsets[a]
            starts, ends, first = words.split(lower, inner, words.ALNUM)
            hashes = words.range_hashes(words.running(lower), starts, ends)
            spot = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
            ids = np.where(self.vocabulary[spot] == hashes, spot, -1) if len(self.vocabulary) else np.full(len(hashes), -1)
            states, lengths = self.stream(ids, first[:-1])
            hits = np.flatnonzero(lengths >= self.least[states])
            row_of = np.searchsorted(first, hits, "right") - 1
            change = np.zeros(len(hashes) + 1, np.int64)
            names: dict[int, set[str | None]] = defaultdict(set)
            for row, at in zip(row_of.tolist(), hits.tolist()):
                n, found = self.covered(int(states[at]), int(lengths[at]))
                change[at + 1 - n] += 1
                change[at + 1] -= 1
                names[row] |= found
            hit = np.cumsum(change)[:-1] > 0
            for row in range(b - a):
                lo, hi = first[row], first[row + 1]
                spans, n_hit = np.zeros(0, np.int64), 0
                if row in names:
                    own = np.concatenate([[0], hit[lo:hi].view(np.int8), [0]])
                    turns = np.diff(own)
                    spans = np.stack([starts[lo + np.flatnonzero(turns > 0)], ends[lo + np.flatnonzero(turns < 0) - 1]], 1).ravel() - inner[row]
                    n_hit = int(hit[lo:hi].sum())
                yield int(hi - lo), spans, n_hit, names.get(row, set())


def automata(items: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """One automaton for each block of items; a block's texts are at most ``block_bytes`` long on average."""
    spark = items.sparkSession
    texts = items.select(F.col(id_col).cast("string").alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    out = []
    for k in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()  # a block
        out.append(spark.sparkContext.broadcast(Automaton([(r["name"], r["text"]) for r in rows], window)))
    return out


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    keep_key: bool = False,
) -> DataFrame:
    """Per document: doc_id, n_words, spans, n_hit, items and contaminated.

    A window is ``window`` consecutive words of an item, or a whole shorter item.  ``spans``
    are the byte ranges (start, end, start, end, ...) of hit words that follow each other,
    ``items`` the sorted names of items whose windows occur.  ``contaminated``: some word is
    hit, and a twentieth of all words or more.  Null texts have no words; items without words
    match nothing; an item with a null id marks words but is not named.  Repeated rows are
    documents of their own; ``keep_key`` adds the hash of the text.
    """
    texts = common.id_and_text(docs, id_col, text_col)
    held = automata(items, window, item_id_col, item_text_col, block_bytes)

    def with_block(block: Broadcast):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(block.value.scan(batch.column(2)))
                flat = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0] for r in rows], pa.int64()),
                    common.list_column(flat, np.cumsum([0, *(len(r[1]) for r in rows)]), pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([sorted(x for x in r[3] if x is not None) for r in rows], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "spans", "n_hit", "items"])

        return read

    keyed = texts.select("doc_id", F.xxhash64("text").alias("key"), "text")
    if not held:
        held = [docs.sparkSession.sparkContext.broadcast(Automaton([], window))]
    found = keyed.mapInArrow(with_block(held[0]), _FOUND)
    if len(held) > 1:
        found = _joined(keyed, [found, *(keyed.mapInArrow(with_block(h), _FOUND) for h in held[1:])])
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    kept = ["doc_id", *["key"] * keep_key, "n_words", "spans", "n_hit", "items"]
    return found.select(*kept, contaminated.alias("contaminated"))


def _joined(keyed: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Matches of several blocks as one: spans united word by word, names together."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pylist()
            spans, hits = [], []
            for row in got:
                text = row["text"]
                _, _, starts, ends = word_ids([text])
                change = np.zeros(len(starts) + 1, np.int64)
                for found in row["found"]:
                    at = np.asarray(found["spans"], np.int64)
                    np.add.at(change, np.searchsorted(starts, at[::2]), 1)
                    np.add.at(change, np.searchsorted(ends, at[1::2]) + 1, -1)
                hit = np.cumsum(change)[:-1] > 0
                turns = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                spans.append(np.stack([starts[np.flatnonzero(turns > 0)], ends[np.flatnonzero(turns < 0) - 1]], 1).ravel().tolist())
                hits.append(int(hit.sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r["found"][0]["n_words"] for r in got], pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array(hits, pa.int64()),
                    pa.array([sorted({x for f in r["found"] for x in f["items"]}) for r in got], pa.list_(pa.string())),
                ],
                ["doc_id", "key", "n_words", "spans", "n_hit", "items"],
            )

    # One entry for each block, whatever the number of equal rows.
    grouped = rows.distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("n_words", "spans", "items")).alias("found"))
    left = keyed.alias("l")
    joined = left.join(grouped.alias("r"), F.expr("l.doc_id <=> r.doc_id and l.key = r.key")).select("l.doc_id", "l.key", "l.text", "r.found")
    return joined.mapInArrow(unite, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Matches with the number of items and the SHA-256 of their sorted, comma-joined names."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def decontaminated(docs: DataFrame, items: DataFrame, **conf) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    A document goes if it has the id and text of a contaminated one; the others stay as they are.
    """
    id_col, text_col = conf.get("id_col", "doc_id"), conf.get("text_col", "text")
    bad = matches(docs, items, keep_key=True, **conf).filter("contaminated").select("doc_id", "key").distinct().alias("bad")
    same = F.col(f"docs.{id_col}").cast("long").eqNullSafe(F.col("bad.doc_id"))
    same &= F.xxhash64(F.coalesce(F.col(f"docs.{text_col}").cast("string"), F.lit(""))) == F.col("bad.key")
    return docs.alias("docs").join(bad, same, "left_anti")
