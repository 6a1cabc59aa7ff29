"""Suffix arrays by induced sorting, and permuted common prefixes, with array operations.

Suffixes are classified as S (smaller than the next one) or L; a leftmost S (LMS) starts after an L. LMS
substrings are sorted by inducing from their first symbols, named, and the string of names is sorted in the
same way until names are unique. The order of the LMS suffixes then induces the whole array. Buckets are worked
off one after the other; within a bucket all entries known at a time are handled at once, so that the loop runs
once per symbol and repeat, not per suffix. A string of many names is written as two digits a name before it is
sorted, which leaves few buckets; its even places have the order of the names' suffixes.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last suffix (a unique least symbol) is S."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def leftmost(is_s: np.ndarray) -> np.ndarray:
    """Positions of S suffixes that follow an L suffix, ascending."""
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _put(out: np.ndarray, free: np.ndarray, at: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Entries to the free places of their buckets, in their order; step: 1 upwards, -1 downwards."""
    if len(at) < 24:
        for i, c in zip(at.tolist(), symbols.tolist()):
            out[free[c]] = i
            free[c] += step
        return
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    new = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    n = np.append(new[1:], len(at)) - new
    out[free[symbols] + step * (np.arange(len(at)) - np.repeat(new, n))] = at
    free[symbols[new]] += step * n


def induce(s: np.ndarray, k: int, is_s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, sorted as far as the order of seeds (LMS positions, ascending within a bucket) determines it."""
    symbols = s.astype(np.uint16) if k <= 1 << 16 else s  # short keys are sorted by radix
    ends = np.cumsum(np.bincount(s, minlength=k))
    starts = np.concatenate(([0], ends[:-1]))
    seeded = np.bincount(s[seeds], minlength=k)
    out = np.full(len(s), -1)
    _put(out, ends - seeded, seeds, symbols[seeds], 1)
    free, lows, highs, first = starts.copy(), starts.tolist(), ends.tolist(), (ends - seeded).tolist()

    wanted = np.append(~is_s, False)  # nothing comes before place 0, whose index wraps around

    def induced(now: np.ndarray, step: int) -> None:
        before = now - 1
        before = before[wanted[before]]
        if len(before):
            _put(out, free, before, symbols[before], step)

    for c in range(k):
        at = lows[c]
        while at < (to := int(free[c])):
            induced(out[at:to], 1)
            at = to
        if first[c] < highs[c]:
            induced(out[first[c] : highs[c]], 1)
    large = free.tolist()
    free, wanted = ends - 1, np.append(is_s, False)
    # the last suffix has no successor that could induce it
    out[starts[s[-1]]] = len(s) - 1
    for c in range(k - 1, -1, -1):
        at = highs[c] - 1
        while at > (to := int(free[c])):
            induced(out[to + 1 : at + 1][::-1], -1)
            at = to
        if lows[c] < large[c]:
            induced(out[lows[c] : large[c]][::-1], -1)
    return out


def _names_sorted(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names, by way of its digits if it has many names for its length."""
    k, n = int(names.max()) + 1, len(names)
    if 16 * k < n or k < 64:
        return suffix_array(names)
    base = int(np.ceil(np.sqrt(k)))
    digits = np.zeros(2 * n - 1, np.int64)
    digits[:-1:2], digits[1::2] = names[:-1] // base + 1, names[:-1] % base + 1
    if len(leftmost(classify(digits))) > 0.9 * n:
        # digits that rise in nearly every name do not shorten the string
        return suffix_array(names)
    order = suffix_array(digits)
    return order[order % 2 == 0] // 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s's suffixes in ascending order. s: non-negative integers, whose last is the only zero."""
    n, k = len(s), int(s.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = classify(s)
    lms = leftmost(is_s)
    rough = induce(s, k, is_s, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    # name the LMS substrings: equal ones are neighbours now and have the same length and symbols
    end = np.full(n, n - 1)
    end[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    differs = end[a] - a != end[b] - b
    live, at = np.flatnonzero(~differs), 0
    while len(live):
        x, y = a[live] + at, b[live] + at
        unequal = s[x] != s[y]
        differs[live[unequal]] = True
        live = live[~unequal & (x < end[a[live]])]
        at += 1
    names = np.empty(n, np.int64)
    names[order] = np.concatenate(([0], np.cumsum(differs)))
    reduced = names[lms]
    if len(order) and reduced.max() + 1 == len(lms):
        lms_order = np.empty(len(lms), np.int64)
        lms_order[reduced] = np.arange(len(lms))
    else:
        lms_order = _names_sorted(reduced)
    return induce(s, k, is_s, lms[lms_order])


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted: at each position the bytes (most at the utmost) its suffix shares with the suffix ordered before it.

    Compared eight bytes at a time, for all positions at once.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(most + 16, np.uint64)))
    eight = padded
    for shift in (1, 2, 4):
        eight = eight[:-shift] | eight[shift:] << np.uint64(8 * shift)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    other = before[live]
    for at in range(0, most, 8):
        room = np.minimum(n - live, n - other) > at
        live, other = live[room], other[room]
        gap = eight[live + at] ^ eight[other + at]
        same = gap == 0
        low = gap[~same] & (~gap[~same] + np.uint64(1))
        shared[live[~same]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live, other = live[same], other[same]
        shared[live] = at + 8
    return np.minimum(np.minimum(shared, n - np.arange(n)), most)
