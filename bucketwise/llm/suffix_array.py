"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classed as S (smaller than the next) or L.  The leftmost S
suffixes of each run (LMS) are sorted by way of the string of their substrings'
names, recursively; the order of all others is then induced bucket by bucket,
whole array slices at a time.  A string of names has too large an alphabet for
work by buckets; beyond ``BUCKETS`` symbols its suffixes are sorted by rank
doubling, which touches only those that still tie.

Common prefixes are computed in text order (PLCP): a value follows from its
left neighbour unless the characters before the two suffixes differ, so only
those irreducible ones are compared.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes.  The last symbol is the unique smallest."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    settled = np.where(step != 0, np.arange(n - 1), n - 1)
    settled = np.minimum.accumulate(settled[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    within = settled < n - 1
    out[:-1] = np.where(within, step[np.minimum(settled, n - 2)] > 0, False)
    return out


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order (or sorted by first
    symbol, which orders LMS substrings)."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)

    def deal(found: np.ndarray, into: list[list[np.ndarray]]) -> None:
        symbol = s[found]
        order = np.argsort(symbol, kind="stable")
        ordered, symbol = found[order], symbol[order]
        cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for part, c in zip(np.split(ordered, cuts), symbol[np.concatenate([[0], cuts])].tolist()):
            into[c].append(part)

    def before(at: np.ndarray, s_type: bool) -> np.ndarray:
        at = at[at > 0] - 1
        return at[is_s[at] == s_type]

    lms_of: list[list[np.ndarray]] = [[] for _ in range(size)]
    if len(lms):
        deal(lms, lms_of)
    l_of: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        done = 0
        while done < len(l_of[c]):
            now = l_of[c][done:]
            done += len(now)
            found = before(now[0] if len(now) == 1 else np.concatenate(now), False)
            if len(found):
                deal(found, l_of)
        if lms_of[c]:
            found = before(np.concatenate(lms_of[c]), False)
            if len(found):
                deal(found, l_of)
    # S suffixes from right to left: lists hold descending order
    s_of: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size - 1, -1, -1):
        done = 0
        while done < len(s_of[c]):
            now = s_of[c][done:]
            done += len(now)
            found = before(now[0] if len(now) == 1 else np.concatenate(now), True)
            if len(found):
                deal(found, s_of)
        if l_of[c]:
            found = before(np.concatenate(l_of[c])[::-1], True)
            if len(found):
                deal(found, s_of)
    out = np.empty(len(s), dtype=np.int64)
    for c in range(size):
        low, high = int(ends[c] - counts[c]), int(ends[c])
        for part in l_of[c]:
            out[low : low + len(part)] = part
            low += len(part)
        for part in s_of[c]:
            out[high - len(part) : high] = part[::-1]
            high -= len(part)
        if low < high:  # the sentinel: an S suffix that nothing induces
            out[low:high] = lms_of[c][0][: high - low]
    return out


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix order by ranks of prefixes of 1, 2, 4, ... symbols; only suffixes
    whose rank is still shared are sorted again."""
    n = len(s)
    order = np.argsort(s)  # among equals any order will do; they are sorted again
    head = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while True:
        place = np.arange(n)
        shared = ~(head & np.concatenate([head[1:], [True]]))
        open_ = place[shared]
        if not len(open_):
            return order
        at = order[open_]
        nxt = at + width
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = (rank[at] << 32) | second
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[open_] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
        width *= 2


def _names(s: np.ndarray, is_s: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of LMS substrings (at ``order``, ascending; ``length`` by position):
    equal substrings share one."""
    n = len(order)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[k < length[a[live]]]
        if not len(live):
            break
        x, y = a[live] + k, b[live] + k
        differ = (s[x] != s[y]) | (is_s[x] != is_s[y])
        same[live[differ]] = False
        live = live[~differ]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)]) if n else np.zeros(0, dtype=np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``s`` in ascending order.  ``s`` holds
    non-negative integers and ends with its only zero."""
    n = len(s)
    size = int(s.max()) + 1 if n else 0
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if size > BUCKETS:
        return _doubling(s)
    is_s = _types(s)
    s = s.astype(np.uint8 if size <= 256 else np.uint16, copy=False)  # narrow symbols are dealt by radix
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        # an LMS substring reaches to the next LMS position, that one included
        length = np.zeros(n, dtype=np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        marked = np.zeros(n, dtype=bool)
        marked[lms] = True
        rough = _induce(s, is_s, lms, size)
        order = rough[marked[rough]]
        names = _names(s, is_s, order, length)
        if int(names[-1]) + 1 < len(order):
            reduced = np.empty(n, dtype=np.int64)
            reduced[order] = names
            order = lms[suffix_array(reduced[lms])]
        lms = order
    return _induce(s, is_s, lms, size)


def plcp(s: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each position the suffix before it in order (-1 for the
    first) and their common prefix, exact up to ``most`` and at least that beyond.

    ``s`` holds numbers below 256; eight of them are compared at a time."""
    n = len(s)
    # the eight symbols from each position, zeros beyond the end
    word = np.ndarray(n, dtype="<u8", buffer=s.astype(np.uint8).tobytes() + bytes(8), strides=(1,)).copy()
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    # a value follows from the left neighbour if the same symbol stands before both
    # suffixes; the last symbol, before place 0 here, stands nowhere else
    before = s[sa - 1]
    left = np.zeros(n, dtype=bool)
    left[sa[1:]] = before[1:] == before[:-1]
    heads = np.flatnonzero(~left)  # the last place, which is first in order, is one
    run = np.diff(np.concatenate([heads, [n]]))
    start = heads[:-1]
    common = np.zeros(len(start), dtype=np.int64)
    live, a, b = np.arange(len(start)), start, phi[start]
    # a reducible value is its neighbour's less one, so compare beyond ``most``
    # by as much as the run of reducible ones is long
    need = most + run[:-1]
    k = 0
    while len(live):
        ok = (a + k < n) & (b + k < n) & (k < need[live])
        live, a, b = live[ok], a[ok], b[ok]
        differ = word[a + k] ^ word[b + k]
        lowest = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3)
        common[live] += np.minimum(equal, n - np.maximum(a, b) - k)
        go = differ == 0
        live, a, b = live[go], a[go], b[go]
        k += 8
    value = np.repeat(np.concatenate([common, [0]]) + heads, run) - np.arange(n)
    return phi, np.maximum(value, 0)
