"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than their successor; leftmost-smaller substrings are sorted by induction
and named; where names repeat, the string of names is sorted recursively; the order of all suffixes is then induced
from that of the leftmost-smaller ones. Over a small alphabet a bucket's suffixes are induced in waves of whole arrays.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    out, k = np.ones(max(1, n), np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out[:n]


def prefixes(values: np.ndarray, base: int = _MULTIPLIER) -> np.ndarray:
    """Prefix sums of values[i] * base ** i, for hashes of any substring."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)), dtype=np.uint64)])


def substring(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of the substrings; equal for equal ones wherever they stand."""
    h = (prefix[stop] - prefix[start]) * inverse[start]
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def classified(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than its successor (the last one is), and the places of leftmost smaller ones."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    rises = np.append(s[:-1] < s[1:], True)
    # Of equal neighbours the class is that of the next place where they differ.
    place = np.where(differs, np.arange(n), n)
    smaller = rises[np.minimum.accumulate(place[::-1])[::-1]]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def induced(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, induced from leftmost-smaller ones in the order given. s ends with its only 0."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=size))
    starts = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)
    own = s[lms]
    count = np.bincount(own, minlength=size)
    order = np.argsort(own, kind="stable")
    first = np.cumsum(count) - count
    by_bucket = lms[order]

    def put(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Append suffixes to their buckets, in order, from at on in the direction of step."""
        chars = s[found]
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        n_of = np.bincount(chars, minlength=size)
        place = np.arange(len(chars)) - (np.cumsum(n_of) - n_of)[chars]
        sa[at[chars] + step * place] = found[order]
        at += step * n_of

    heads = starts.copy()
    for c in range(size):
        done = starts[c]
        while True:
            wave = sa[done : heads[c]]
            if not len(wave):
                break
            done = heads[c]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                put(before, heads, 1)
        if count[c]:
            before = by_bucket[first[c] : first[c] + count[c]] - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                put(before, heads, 1)
    tails = ends - 1
    larger_end = heads
    for c in range(size - 1, -1, -1):
        done = ends[c] - 1
        while True:
            wave = sa[tails[c] + 1 : done + 1][::-1]
            if not len(wave):
                break
            done = tails[c]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                put(before, tails, -1)
        wave = sa[starts[c] : larger_end[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            put(before, tails, -1)
    sa[0] = n - 1  # the end mark is the smallest suffix; nothing induces it
    return sa


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """The suffixes of s in order. s has values below size, and its last one is its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller, lms = classified(s)
    if len(lms) > 1:
        sa = induced(s, smaller, lms, size)
        mark = np.zeros(n, bool)
        mark[lms] = True
        order = sa[mark[sa]]
        stop = np.full(n, n)
        stop[lms[:-1]] = lms[1:] + 1
        sums = prefixes(s.astype(np.uint64) + np.uint64(1))
        inverse = powers(pow(_MULTIPLIER, -1, 1 << 64), n + 1)
        h, length = substring(sums, order, stop[order], inverse), stop[order] - order
        new = np.append(True, (h[1:] != h[:-1]) | (length[1:] != length[:-1]))
        names = np.cumsum(new) - 1
        if names[-1] + 1 < len(lms):
            name_of = np.zeros(n, np.int64)
            name_of[order] = names
            reduced = name_of[lms]  # the last one is the end mark, whose name is the only 0
            inner = suffix_array(reduced, int(names[-1]) + 1) if len(reduced) > 64 * (names[-1] + 1) else np.array(sorted_suffixes(reduced.tolist(), int(names[-1]) + 1))
            order = lms[inner]
        lms = order
    return induced(s, smaller, lms, size)


def sorted_suffixes(s: list[int], size: int) -> list[int]:
    """suffix_array for large alphabets, suffix by suffix."""
    n = len(s)
    if n == 1:
        return [0]
    smaller = [True] * n
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        smaller[i] = a < b or (a == b and smaller[i + 1])
    lms = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]
    ends = [0] * size
    for c in s:
        ends[c] += 1
    total = 0
    for c in range(size):
        total += ends[c]
        ends[c] = total

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        at = ends[:]
        for i in reversed(order):
            at[s[i]] -= 1
            sa[at[s[i]]] = i
        heads = [0, *ends[:-1]]
        for x in range(n):
            j = sa[x] - 1
            if j >= 0 and not smaller[j]:
                c = s[j]
                sa[heads[c]] = j
                heads[c] += 1
        at = ends[:]
        for x in range(n - 1, -1, -1):
            j = sa[x] - 1
            if j >= 0 and smaller[j]:
                c = s[j]
                at[c] -= 1
                sa[at[c]] = j
        return sa

    sa = induce(lms)
    following = {i: j + 1 for i, j in zip(lms, lms[1:], strict=False)}
    name, names, before = -1, {}, None
    for i in sa:
        if i in following or i == n - 1:
            part = s[i : following.get(i, n)]
            if part != before:
                name, before = name + 1, part
            names[i] = name
    if name + 1 < len(lms):
        lms = [lms[i] for i in sorted_suffixes([names[i] for i in lms], name + 1)]
    else:
        lms = sorted(lms, key=names.__getitem__)
    return induce(lms)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of s, how long a prefix its suffix shares with the one before it in order, up to most."""
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    sums = prefixes(s.astype(np.uint64) + np.uint64(1))
    inverse = powers(pow(_MULTIPLIER, -1, 1 << 64), n + 1)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    other = before[at]
    length = np.zeros(len(at), np.int64)
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        stop = length + step
        fits = (stop <= most) & (np.maximum(at, other) + stop <= n)
        a, b = at[fits], other[fits]
        same = substring(sums, a, a + stop[fits], inverse) == substring(sums, b, b + stop[fits], inverse)
        length[np.flatnonzero(fits)[same]] += step
        step >>= 1
    out[at] = length
    return out
