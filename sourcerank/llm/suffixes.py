"""Suffix arrays of byte strings by induced sorting, with numpy working bucket by bucket.

Suffixes are classified as smaller (S) or larger (L) than their successor.  Leftmost S
suffixes (LMS) are sorted by their substrings, those by names of doubled length until no two
are alike, and all other suffixes are induced from them: each bucket hands the predecessors
of its suffixes on to their buckets, a whole run at once.

Over the bytes of a text inducing is linear.  The string of names is not sorted by recursion: it
has nearly as many symbols as places, and inducing costs a numpy step over all symbols for each of
them.  Doubling sorts m names in up to log2(m) rounds of O(m log m); repetitive texts need most.
"""

from __future__ import annotations

import numpy as np


def types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes.  The last symbol must be the only smallest one."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    up = np.append(s[:-1] < s[1:], True)
    nearest = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return up[nearest]


def _hand_on(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, preds: np.ndarray, step: int, size: int) -> None:
    """Put predecessors into their buckets in the order given; ``at`` holds each bucket's next place."""
    if not len(preds):
        return
    counts = np.bincount(chars, minlength=size)
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    rank = np.arange(len(chars)) - (np.cumsum(counts) - counts)[sorted_chars]
    sa[at[sorted_chars] + step * rank] = preds[order]
    at += step * counts


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that follows from that of the LMS suffixes."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(s), -1, np.int64)
    tails = ends - np.bincount(s[lms], minlength=size)
    _hand_on(sa, tails.copy(), s[lms], lms, 1, size)
    used = np.flatnonzero(counts)

    def before(block: np.ndarray, want_small: bool) -> np.ndarray:
        preds = block[block > 0] - 1
        return preds[small[preds] == want_small]

    heads = starts.copy()
    for c in used:
        at = starts[c]
        while at < heads[c]:  # suffixes of this bucket may hand their predecessors to it as well
            block = sa[at : heads[c]]
            at = heads[c]
            preds = before(block, False)
            _hand_on(sa, heads, s[preds], preds, 1, size)
        if tails[c] < ends[c]:
            preds = before(sa[tails[c] : ends[c]], False)
            _hand_on(sa, heads, s[preds], preds, 1, size)
    lasts = ends - 1
    for c in used[::-1]:
        at = ends[c] - 1
        while at > lasts[c]:
            block = sa[lasts[c] + 1 : at + 1][::-1]
            at = lasts[c]
            preds = before(block, True)
            _hand_on(sa, lasts, s[preds], preds, -1, size)
        if starts[c] < heads[c]:
            preds = before(sa[starts[c] : heads[c]][::-1], True)
            _hand_on(sa, lasts, s[preds], preds, -1, size)
    # The last suffix is the sentinel alone and has no successor to induce it.
    sa[0] = len(s) - 1
    return sa


def _named(sorted_lms: np.ndarray, s: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Equal names for equal LMS substrings, in text order; neighbours in order are compared."""
    length = ends[place[sorted_lms]] - sorted_lms + 1
    same = np.zeros(len(sorted_lms), bool)
    same[1:] = length[1:] == length[:-1]
    pairs = np.flatnonzero(same)
    a, b, left = sorted_lms[pairs - 1], sorted_lms[pairs], length[pairs]
    at = 0
    while len(pairs):
        equal = s[a + at] == s[b + at]
        same[pairs[~equal]] = False
        at += 1
        on = equal & (at < left)
        pairs, a, b, left = pairs[on], a[on], b[on], left[on]
    names = np.empty(len(sorted_lms), np.int64)
    names[place[sorted_lms]] = np.cumsum(~same) - 1
    return names


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of a name string in order: names of doubled length until all differ."""
    rank, width, n = names, 1, len(names)
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, np.diff(key[order]) > 0))
        if n == 0 or new.max() == n - 1:
            return order
        rank, width = new, width * 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers; the last must be smaller than all others."""
    size = int(s.max(initial=0)) + 1
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return np.arange(len(s) - 1, -1, -1) if len(s) < 2 else induce(s, small, lms, size)
    rough = induce(s, small, lms, size)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    in_order = rough[is_lms[rough]]
    place = np.zeros(len(s), np.int64)
    place[lms] = np.arange(len(lms))
    names = _named(in_order, s, np.append(lms[1:], lms[-1]), place)
    order = lms[_sorted_names(names)]
    return induce(s, small, order, size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """In text order, the common prefix (up to ``most``) of a suffix with the one before it in the array.

    A value falls by one at most from a suffix to its successor, so it is measured only where
    the symbols in front differ.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    here = np.arange(n)
    front_differs = np.ones(n, bool)
    both = (before > 0) & (here > 0)
    front_differs[both] = s[before[both] - 1] != s[here[both] - 1]
    measured = np.flatnonzero(front_differs & (before >= 0))
    found = np.zeros(n, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = s.astype(np.uint8)  # the symbols of UTF-8 text stay below 256
    words = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
    i, j = measured, before[measured]
    got = np.zeros(len(i), np.int64)
    open_ = np.arange(len(i))
    while len(open_):
        a, b = i[open_] + got[open_], j[open_] + got[open_]
        fits = np.maximum(a, b) + 8 <= n
        same = np.zeros(len(open_), bool)
        same[fits] = words[a[fits]] == words[b[fits]]
        got[open_[same]] += 8
        open_ = open_[same]
    open_ = np.arange(len(i))
    while len(open_):
        a, b = i[open_] + got[open_], j[open_] + got[open_]
        fits = np.maximum(a, b) < n
        same = np.zeros(len(open_), bool)
        same[fits] = s[a[fits]] == s[b[fits]]
        got[open_[same]] += 1
        open_ = open_[same]
    found[measured] = got + measured
    return np.minimum(np.maximum.accumulate(found) - here, most).clip(0)
