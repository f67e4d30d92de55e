"""Suffix arrays of byte blocks by induced sorting, and their permuted common prefixes.

The induced sort runs bucket by bucket over whole arrays: each entry is looked at once in the pass for
larger and once in the pass for smaller suffixes.
"""

from __future__ import annotations

import numpy as np

from landtrace.llm.common import ship

#: Reduced texts with more different symbols than this are sorted by doubling their ranks: a bucket would have too few entries.
MOST_BUCKETS = 2_048
SMALL = 2_000


def by_doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array by sorting ranks of twice the length each round."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        if step < n:
            key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, step = new, step * 2
        if not n or rank[order[-1]] == n - 1:
            return order


def smaller_type(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as the smallest."""
    n = len(text)
    smaller = np.zeros(n, bool)
    if n < 2:
        return smaller
    change = text[1:] != text[:-1]
    nxt = np.where(change, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # the next place where neighbours differ
    inside = nxt < n - 1
    at = nxt[inside]
    smaller[:-1][inside] = text[at] < text[at + 1]
    return smaller


def _append(sa, fill, symbols, entries):
    """Put entries at the running ends of their buckets, in order."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    counts = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, counts)
    sa[fill[s] + rank] = entries[order]
    fill[s[first]] += counts


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes ``lms`` in their order."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    total = np.bincount(text, minlength=sigma)
    heads = np.concatenate([[0], np.cumsum(total)[:-1]])
    larger_count = np.bincount(text[~smaller], minlength=sigma)
    # leftmost-smaller suffixes by symbol, kept in order
    order = np.argsort(text[lms], kind="stable")
    seeds = lms[order]
    seed_at = np.concatenate([[0], np.cumsum(np.bincount(text[lms], minlength=sigma))])
    fill = heads.copy()

    def larger_before(entries):
        entries = entries[entries > 0] - 1
        return entries[~smaller[entries]]

    # the last suffix is larger than the end of the text, which comes first of all
    last = np.array([n - 1])
    _append(sa, fill, text[last], last)
    for c in np.flatnonzero(total):
        done = heads[c]
        while done < fill[c]:  # entries of the bucket may add to it
            upto = fill[c]
            new = larger_before(sa[done:upto])
            done = upto
            if len(new):
                _append(sa, fill, text[new], new)
        new = larger_before(seeds[seed_at[c]:seed_at[c + 1]])
        if len(new):
            _append(sa, fill, text[new], new)
    # smaller suffixes, from the ends of the buckets: the same, mirrored
    tails = heads + total
    mirror = np.full(n, -1, np.int64)  # place p here is place n - 1 - p of the array
    fill = n - tails

    def smaller_before(entries):
        entries = entries[entries > 0] - 1
        return entries[smaller[entries]]

    for c in np.flatnonzero(total)[::-1]:
        done = n - tails[c]
        while done < fill[c]:
            upto = fill[c]
            new = smaller_before(mirror[done:upto])
            done = upto
            if len(new):
                _append(mirror, fill, text[new], new)
        larger = sa[heads[c]:heads[c] + larger_count[c]]
        new = smaller_before(larger[::-1])
        if len(new):
            _append(mirror, fill, text[new], new)
    back = mirror[::-1]
    filled = back >= 0
    sa[filled] = back[filled]
    return sa


def _names(text: np.ndarray, smaller: np.ndarray, lms_sorted: np.ndarray, is_lms: np.ndarray) -> np.ndarray:
    """For sorted leftmost-smaller substrings: a number that rises with each different one."""
    n, m = len(text), len(lms_sorted)
    at = np.flatnonzero(is_lms)
    end_of = np.full(n, n, np.int64)
    end_of[at[:-1]] = at[1:]
    length = end_of[lms_sorted] - lms_sorted + 1  # with the next one's first symbol
    a, b = lms_sorted[:-1], lms_sorted[1:]
    same = (length[:-1] == length[1:]) & (end_of[a] < n) & (end_of[b] < n)
    alive = np.flatnonzero(same)
    k = 0
    while len(alive):
        ok = (text[a[alive] + k] == text[b[alive] + k]) & (smaller[a[alive] + k] == smaller[b[alive] + k])
        same[alive[~ok]] = False
        k += 1
        alive = alive[ok]
        alive = alive[length[:-1][alive] > k]
    names = np.zeros(m, np.int64)
    names[1:] = np.cumsum(~same)
    return names


def suffix_array(text: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers from 0 below ``sigma``) in their order."""
    n = len(text)
    sigma = sigma or (int(text.max()) + 1 if n else 1)
    if n <= SMALL or sigma > MOST_BUCKETS:
        return by_doubling(text)
    smaller = smaller_type(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return induce(text, smaller, lms, sigma)
    rough = induce(text, smaller, lms, sigma)
    ordered = rough[is_lms[rough]]
    names = _names(text, smaller, ordered, is_lms)
    if names[-1] + 1 < len(lms):
        name_at = np.zeros(n, np.int64)
        name_at[ordered] = names
        ordered = lms[suffix_array(name_at[lms], int(names[-1]) + 1)]
    return induce(text, smaller, ordered, sigma)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, stop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text, the place before it in the suffix array (-1: none), and the length
    of what both have in common before a symbol ``stop``. Symbols are below 512.

    Where the symbols before both agree, the length is one less than that of the place before;
    only the others are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    places = np.arange(n)
    linked = (before > 0) & (places > 0)
    linked[linked] = (text[places[linked] - 1] == text[before[linked] - 1]) & (text[places[linked] - 1] != stop)
    common = np.zeros(n, np.int64)
    alive = np.flatnonzero(~linked & (before >= 0))
    a, b = alive, before[alive]
    # compare seven symbols of 9 bits at a time, then one by one
    wide = np.zeros(n + 7, np.uint64)
    symbols = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    for k in range(7):
        wide[:n] = (wide[:n] << np.uint64(9)) | symbols[k:n + k]
    stops = np.flatnonzero(text == stop)
    until = np.append(stops, n)[np.searchsorted(stops, places)] - places  # symbols to the next stop
    length = np.zeros(len(a), np.int64)
    room = np.minimum(until[a], until[b])
    busy = np.arange(len(a))
    while len(busy):
        ok = (length[busy] + 7 <= room[busy])
        busy = busy[ok]
        ok = wide[a[busy] + length[busy]] == wide[b[busy] + length[busy]]
        busy = busy[ok]
        length[busy] += 7
    busy = np.flatnonzero(length < room)
    while len(busy):
        ok = text[a[busy] + length[busy]] == text[b[busy] + length[busy]]
        busy = busy[ok]
        length[busy] += 1
        busy = busy[length[busy] < room[busy]]
    common[alive] = length
    # the others, from the last place that was compared
    source = np.maximum.accumulate(np.where(linked, -1, places))
    taken = np.flatnonzero(linked)
    common[taken] = common[source[taken]] - (taken - source[taken])
    return before, np.maximum(common, 0)


ship(__name__)
