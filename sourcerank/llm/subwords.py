"""Sub-word ids by a public tokenizer, with one library call for many new words.

The byte-level pre-tokenizer never joins characters over a single space that has a
non-space before and behind it, and it gives the space to what follows.  A text may
therefore be cut there, and the ids of ``" word"`` are the same wherever it stands.
Most words of a text were met before, so their ids come from a table.  Words, known words
and ids are Arrow and numpy arrays: Arrow tells the distinct words of a slice and finds them
in the table, numpy gathers their ids, and Python sees new words only.  Marks behind a letter
or a plain digit are a piece of their own for the pre-tokenizer, so a new word's stem is looked
up without them.  New words go to the library in one string; each one's ids begin at the next
token that starts with a space.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import bytes_of, held, ranges

# Entries of one worker's table.  When it is full, half of them stay: those met most often of late.
KNOWN_WORDS = 300_000
# Bytes of text to encode at once.  Arrow indexes the whole table for each call, so small slices cost more.
SLICE_BYTES = 4 << 20
# Marks at the end of a word that are never part of what stands before them.
_MARKS = ".,;:!?&#$%*)"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r" \s")
_WORDS_AT_ONCE = 1000
# Bytes that may end what stands before such marks: letters and plain digits.
_STEM_ENDS = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, pa.Array]:
    """(heads, which, rows, words): each text's first word; the others of all texts as numbers of
    distinct ``words``; and how many others each text has.

    Texts with a space before white space are cut by a pattern, the others at every space.
    """
    odd = {k: _CUT.split(t) for k, t in enumerate(texts) if _RUN.search(t) is not None}
    cut = pc.split_pattern(pa.array(["" if k in odd else t for k, t in enumerate(texts)], pa.large_string()), " ")
    rows = np.diff(cut.offsets.to_numpy())
    first = np.zeros(int(rows.sum()), bool)
    first[(np.cumsum(rows) - rows)] = True
    heads = cut.values.filter(pa.array(first)).to_pylist()
    others = cut.values.filter(pa.array(~first))
    rows = rows - 1
    if odd:
        pieces, at, ends = [], 0, np.cumsum(rows)
        for k, parts in odd.items():
            heads[k], rows[k] = parts[0], len(parts) - 1
            pieces += [others.slice(at, ends[k] - at), pa.array(parts[1:], pa.large_string())]
            at = ends[k]
        others = pa.concat_arrays([*pieces, others.slice(at)])
    coded = others.dictionary_encode()
    return heads, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows, coded.dictionary


def joined(head_ids: list[bytes], which: np.ndarray, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, each its head's and then those of its other words, and how many each has."""
    own = np.array([len(h) // 4 for h in head_ids], np.int64)
    all_ids = np.concatenate([np.frombuffer(b"".join(head_ids), "<u4"), ids])
    all_sizes = np.concatenate([own, sizes])
    starts = np.cumsum(all_sizes) - all_sizes
    at = np.cumsum(rows + 1) - rows - 1
    order = np.empty(int(rows.sum()) + len(rows), np.int64)
    is_head = np.zeros(len(order), bool)
    is_head[at] = True
    order[at] = np.arange(len(rows))
    order[~is_head] = len(rows) + places[which]
    many = all_sizes[order]
    counts = np.add.reduceat(many, at) if len(rows) else many
    return all_ids[ranges(starts[order], many)], counts


class Encoder:
    """Texts to little-endian 32-bit ids, equal to the library's on the whole text."""

    def __init__(self, path: str, plain: bool = False):
        """``plain``: the strings of special tokens in a text are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = plain
        model = self.inner.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the table below takes its place
        vocabulary = self.inner.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.special = () if plain else tuple(t.content for t in self.inner.get_added_tokens_decoder().values())
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")
        self.sizes = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.float32)
        self.marks: dict[str, bytes] = {}

    def _alone(self, piece: str) -> bytes:
        return array("I", self.inner.encode(piece, add_special_tokens=False).ids).tobytes()

    def _find(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the table, -1 for those that are not in it."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put new words behind the others."""
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(sizes), np.float32)])

    def _forget(self) -> None:
        """Half of a full table goes; what stays counts half as much from now on."""
        if len(self.words) <= KNOWN_WORDS:
            return
        # Equal counts: the later word stays.
        order = np.lexsort((np.arange(len(self.hits)), self.hits))
        kept = np.sort(order[-(KNOWN_WORDS // 2) :])
        self.ids = self.ids[ranges((np.cumsum(self.sizes) - self.sizes)[kept], self.sizes[kept])]
        self.words, self.sizes, self.hits = self.words.take(pa.array(kept)), self.sizes[kept], self.hits[kept] / 2

    def _stems(self, new: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words without the marks that are a piece of their own, and which words had some."""
        stems = pc.ascii_rtrim(new, characters=_MARKS)
        data, at = bytes_of(stems)
        ends = at[1:]
        cut = (ends > at[:-1]) & (np.diff(at) < np.diff(bytes_of(new)[1]))
        last = np.zeros(len(new), np.uint8)
        last[cut] = data[ends[cut] - 1]
        wide = np.flatnonzero(last >= 0x80)
        cut &= _STEM_ENDS[last]
        cut[wide] = [stem[-1].isalpha() for stem in stems.take(pa.array(wide)).to_pylist()]
        for t in self.special:  # those with the string of a special token are not taken apart
            cut &= ~pc.match_substring(new, t).to_numpy(zero_copy_only=False)
        return pc.if_else(pa.array(cut), stems, new), cut

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``" " + w`` for distinct words that are not in the table, end to end, and how many each has."""
        stems, cut = self._stems(new)
        coded = stems.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        # Only the stem of a longer word can be in the table.
        places, maybe = np.full(len(coded.dictionary), -1), np.zeros(len(coded.dictionary), bool)
        maybe[which[cut]] = True
        places[maybe] = self._find(coded.dictionary.filter(pa.array(maybe)))
        asked, asked_sizes = self._ask(coded.dictionary.filter(pa.array(places < 0)))
        sizes = np.concatenate([self.sizes, asked_sizes])
        places[places < 0] = len(self.sizes) + np.arange(len(asked_sizes))
        # The marks of the words that were cut.
        data, at = bytes_of(new)
        ends, held = at[1:][cut], np.diff(at)[cut] - np.diff(bytes_of(stems)[1])[cut]
        raw = data[ranges(ends - held, held)].tobytes()
        marks = pa.LargeStringArray.from_buffers(len(held), pa.py_buffer(np.append(0, np.cumsum(held))), pa.py_buffer(raw)).dictionary_encode()
        mark_ids = []
        for m in marks.dictionary.to_pylist():
            if m not in self.marks:
                self.marks = self.marks if len(self.marks) < 10_000 else {}
                self.marks[m] = self._alone(m)
            mark_ids.append(self.marks[m])
        mark_sizes = np.array([len(m) // 4 for m in mark_ids], np.int64)
        every = np.concatenate([self.ids, asked, np.frombuffer(b"".join(mark_ids), "<u4")])
        sizes = np.concatenate([sizes, mark_sizes])
        # A word is its stem and, if it was cut, its marks.
        own = np.zeros((len(new), 2), np.int64)
        own[:, 0] = places[which]
        own[cut, 1] = len(sizes) - len(mark_ids) + marks.indices.to_numpy(zero_copy_only=False)
        many = sizes[own]
        many[~cut, 1] = 0
        starts = np.cumsum(sizes) - sizes
        return every[ranges(starts[own].ravel(), many.ravel())], many.sum(1)

    def _ask(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words, many in one string, end to end, and how many each has."""
        single = (np.diff(bytes_of(words)[1]) == 0) | pc.match_substring(words, " ").to_numpy(zero_copy_only=False)
        together = words.filter(pa.array(~single))
        # All words end to end, a space before each.
        data, at = bytes_of(together)
        spaced = np.full(len(data) + len(together), ord(" "), np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(1, len(at)), np.diff(at))] = data
        cuts = np.append(np.arange(0, len(together), _WORDS_AT_ONCE), len(together))
        ends = (at[cuts] + cuts).tolist()
        texts = [spaced[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])]
        found, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k, got in enumerate(self.inner.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            many = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
            if len(many) != cuts[k + 1] - cuts[k] or many.sum() != len(ids):
                alone = [self._alone(" " + w) for w in together[cuts[k] : cuts[k + 1]].to_pylist()]
                ids, many = np.frombuffer(b"".join(alone), "<u4"), np.array([len(c) // 4 for c in alone], np.int64)
            found.append(ids)
            sizes.append(many)
        found, sizes = np.concatenate(found), np.concatenate(sizes)
        if not single.any():
            return found, sizes
        alone = [self._alone(" " + w) for w in words.filter(pa.array(single)).to_pylist()]
        found = np.concatenate([found, np.frombuffer(b"".join(alone), "<u4")])
        sizes = np.concatenate([sizes, np.array([len(c) // 4 for c in alone], np.int64)])
        order = np.empty(len(words), np.int64)
        order[~single], order[single] = np.arange(len(together)), len(together) + np.arange(len(alone))
        return found[ranges((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        self._forget()
        heads, which, rows, words = split_words(texts)
        places = self._find(words)
        if (places < 0).any():
            new = words.filter(pa.array(places < 0))
            places[places < 0] = len(self.words) + np.arange(len(new))
            self._add(new, *self._learn(new))
        np.add.at(self.hits, places, 1)
        return joined([self._alone(h) if h else b"" for h in heads], which, rows, self.ids, self.sizes, places)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, counts = self.encode_flat(texts)
        raw, ends = ids.tobytes(), 4 * np.cumsum(counts)
        return [raw[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist())]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, until another operator works there."""
    return held(("encoder", path), lambda: Encoder(path))
