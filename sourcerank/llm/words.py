"""Words of many texts at once: numpy over the UTF-8 bytes of a column.

A word is a run of word bytes inside one text.  Its hash is a polynomial of its bytes taken
from running sums, mixed at the end; equal words have equal 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
# Longer runs of powers, for texts beyond a slice, are not kept.
_KEPT_POWERS = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Digits, lower-case letters and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """1, base, base^2, ... (n of them)."""
    if n > _KEPT_POWERS:
        own = np.full(n, base, np.uint64)
        own[0] = 1
        return np.multiply.accumulate(own)
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _powers[int(base)] = held = np.multiply.accumulate(held)
    return held[:n]


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers(len(data), _BASE), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, the same wherever the bytes stand."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums), _BACK)[starts] + (ends - starts).astype(np.uint64))


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and each row's first word.

    ``first`` has one entry more than there are rows.  ``data`` must be lower case already
    where case does not count.
    """
    flag = np.zeros(len(data) + 2, bool)
    flag[1:-1] = is_word[data]
    before, here = flag[:-1], flag[1:]
    opens = here & ~before
    closes = before & ~here
    # A word ends at the end of its row even where the next row goes on with a word.
    edges = offsets[1:-1]
    split_at = edges[before[edges] & here[edges]]
    opens[split_at] = True
    closes[split_at] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)
