"""Suffix arrays by induced sorting and permuted common prefixes, a whole level at a time in numpy.

A suffix is smaller or larger than the one after it. Leftmost-smaller suffixes are named by the
strings up to the next one and sorted by recursion on the names. A larger suffix is a run of
characters down to a leftmost-smaller one, so the larger ones are induced from these, and then the smaller
ones from the larger: the place of each is that of its character and of the suffix after it. All runs are
followed at once, twice as far in each turn.
"""

from __future__ import annotations

import numpy as np


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last (the sentinel) is."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.where(s[1:] > s[:-1], 1, np.where(s[1:] < s[:-1], -1, 0))
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def _names(kinds: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """For each leftmost-smaller position the rank of its string, the next such position included, equal ones alike; character by character, as long as strings are open."""
    m = len(lms)
    length = np.append(np.diff(lms) + 1, 1)
    order = np.argsort(kinds[lms], kind="stable")
    key = kinds[lms[order]]
    group = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(m), 0))
    places = np.arange(m)  # of the order that aren't settled
    at = 1
    while True:
        size = np.bincount(group, minlength=m)
        open_ = (size[group[places]] > 1) & (length[order[places]] > at)
        # equal so far, but one ends here: its last position is a leftmost-smaller one, and then that of the other is too
        places = places[open_]
        if not len(places):
            break
        who = order[places]
        key = group[places] * (int(kinds.max()) + 1) + kinds[lms[who] + at]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[places] = who[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group[places] = np.maximum.accumulate(np.where(new, places, 0))
        at += 1
    out = np.empty(m, np.int64)
    out[order] = np.cumsum(np.concatenate(([0], np.diff(group) != 0)))
    return out


def _induced(key: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Ranks of items by key and then by the item after each, whose own rank follows from its key and the one after it; ends, which come after themselves, have keys of their own."""
    order = np.argsort(key)
    sorted_key = key[order]
    n = len(key)
    place = np.arange(n)
    first = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    alone = first & np.append(first[1:], True)
    places = place[~alone]
    after = after.copy()
    while len(places):
        who = order[places]
        pair = rank[who] * n + rank[after[who]]
        by = np.argsort(pair)
        pair, who = pair[by], who[by]
        order[places] = who
        first = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[who] = np.maximum.accumulate(np.where(first, places, 0))
        after[who] = after[after[who]]
        places = places[~(first & np.append(first[1:], True))]
    return rank


def suffix_array(s: np.ndarray, depth: list[int] | None = None) -> np.ndarray:
    """Start positions in order of their suffixes; ``s`` holds small integers and ends with the only least one. ``depth`` gets the length of each level."""
    n = len(s)
    if depth is not None:
        depth.append(n)
    if n < 3:
        return np.argsort(s, kind="stable")
    small = _smaller(s)
    kinds = 2 * s.astype(np.int64) + small
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _names(kinds, lms)
    if int(names.max()) + 1 < len(lms):
        ordered = suffix_array(names, depth)
    else:
        ordered = np.empty(len(lms), np.int64)
        ordered[names] = np.arange(len(lms))
    # the larger ones, and as their runs' ends the leftmost-smaller ones in order
    position = np.flatnonzero(~small)
    position = np.sort(np.concatenate((position, lms)))
    of = np.full(n, -1, np.int64)
    of[position] = np.arange(len(position))
    turn = np.zeros(n, np.int64)
    turn[lms[ordered]] = np.arange(1, len(lms) + 1)
    ends = small[position]
    key = kinds[position] * (n + 1) + turn[position]
    after = np.where(ends, np.arange(len(position)), of[np.minimum(position + 1, n - 1)])
    rank = _induced(key, after)
    # the smaller ones, and as their runs' ends the larger ones in order; the sentinel is an end
    turn = np.zeros(n, np.int64)
    turn[position[~ends]] = rank[~ends] + 1
    key = kinds * (n + 1) + turn
    after = np.where(small, np.minimum(np.arange(n) + 1, n - 1), np.arange(n))
    rank = _induced(key, after)
    out = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    out[rank] = np.arange(n)
    return out


def permuted_lcp(s: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order, up to ``room``.

    A position's value is at least that of the position ``k`` to its left less ``k``: every
    64th is compared from its start, then those half way between, and so on, each from
    its bound and eight characters at a time.
    """
    n = len(s)
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    word = np.zeros(n + 8, np.uint64)
    word[:n] = s
    for k in (1, 2, 4):
        word[: n + 8 - k] |= word[k:] << np.uint64(8 * k)
    lcp = np.zeros(n, np.int32)
    q = 64
    known = np.arange(0, n, q)
    bound = np.zeros(len(known), np.int64)
    while True:
        lcp[known] = np.where(before[known] >= 0, np.minimum(bound, room[known]), 0)
        live = (before[known] >= 0) & (room[known] > bound)
        at, l = known[live], bound[live].copy()
        place = np.arange(len(at))
        while len(place):
            x = word[np.minimum(at[place] + l[place], n)] ^ word[np.minimum(before[at[place]] + l[place], n)]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            l[place] += same
            place = place[(x == 0) & (l[place] < room[at[place]])]
        lcp[at] = np.minimum(l, room[at])
        if q == 1:
            return lcp
        q //= 2
        known = np.arange(q, n, 2 * q)
        bound = np.maximum(lcp[known - q] - q, 0)
