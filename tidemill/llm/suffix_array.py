"""Suffix arrays by induced sorting, and permuted common prefixes, over bytes.

The text's induction is done bucket by bucket, a whole bucket's part at a time: what a part induces into later buckets keeps its
order, and what it induces into its own bucket is the next part. The reduced string, whose alphabet is large, is
sorted by the same method, one element at a time.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the last is followed by the empty suffix, hence larger."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        diff = np.flatnonzero(t[1:] != t[:-1])
        if len(diff):
            # a run of equal characters has the type of its last place
            nxt = np.searchsorted(diff, np.arange(n - 1))
            inside = nxt < len(diff)
            at = diff[np.minimum(nxt, len(diff) - 1)]
            s[: n - 1] = inside & (t[at] < t[np.minimum(at + 1, n - 1)])
    return s


def _leftmost(s: np.ndarray) -> np.ndarray:
    """Places of type S whose left neighbour isn't."""
    return (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)


def _split(places: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends places to their characters' buckets, in order."""
    order = chars.argsort(kind="stable")
    places, chars = places[order], chars[order]
    cut = (chars[1:] != chars[:-1]).nonzero()[0].tolist()
    a = 0
    for z in cut:
        into[chars[a]].append(places[a : z + 1])
        a = z + 1
    into[chars[a]].append(places[a:])


def _induced(t: np.ndarray, s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes' order, given that of the leftmost-S ones within their buckets."""
    n = len(t)
    own: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(seeds):
        _split(seeds, t[seeds], own)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[t[n - 1]].append(np.array([n - 1], np.int32))  # what the empty suffix induces
    for c in range(256):
        k = 0
        while k < len(larger[c]) or k < len(larger[c]) + len(own[c]):
            if k < len(larger[c]):
                part = larger[c][k]
            else:
                part = own[c][k - len(larger[c])] if k - len(larger[c]) < len(own[c]) else None
                if part is None:
                    break
            before = part[part > 0] - 1
            before = before[~s[before]]
            if len(before):
                was = len(larger[c])
                _split(before, t[before], larger)
                # leftmost-S suffixes of this bucket induce into later buckets only
                assert k < was or len(larger[c]) == was
            k += 1
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]  # each bucket's from the right
    parts: list[np.ndarray] = []
    for c in range(255, -1, -1):
        k = 0
        done = [x[::-1] for x in reversed(larger[c])]
        while k < len(smaller[c]) + len(done):
            part = smaller[c][k] if k < len(smaller[c]) else done[k - len(smaller[c])]
            before = part[part > 0] - 1
            before = before[s[before]]
            if len(before):
                _split(before, t[before], smaller)
            k += 1
        parts += smaller[c]
        parts += done
    return np.concatenate(parts)[::-1] if parts else np.zeros(0, np.int32)


def _words(t: np.ndarray, pad: int = 16) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    p = np.concatenate([t, np.zeros(pad, np.uint8)])
    return np.lib.stride_tricks.as_strided(p, (len(p) - 7, 8), (1, 1))


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings of the given lengths at a and b are equal."""
    same = np.ones(len(a), bool)
    left = np.flatnonzero(length > 0)
    at = 0
    while len(left):
        n = np.minimum(length[left] - at, 8)
        differ = (words[a[left] + at] != words[b[left] + at]) & (np.arange(8) < n[:, None])
        bad = differ.any(axis=1)
        same[left[bad]] = False
        left = left[~bad & (n == 8)]
        at += 8
        left = left[length[left] > at]
    return same


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of t's suffixes in ascending order. t: uint8."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _types(t)
    lms = _leftmost(s)
    if len(lms) < 2:
        return _induced(t, s, lms)
    order = _induced(t, s, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    # a substring reaches from one leftmost-S place to the next, included; the last one to the text's end
    length = np.zeros(n, np.int32)
    length[lms] = np.append(lms[1:] - lms[:-1] + 1, n - lms[-1])
    words = _words(t)
    a, b = sorted_lms[1:], sorted_lms[:-1]
    same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
    at = np.flatnonzero(same)
    same[at] = _equal(words, a[at], b[at], length[a[at]])
    name = np.zeros(n, np.int32)
    name[sorted_lms] = np.append(0, np.cumsum(~same))
    reduced = name[lms]
    top = int(reduced.max()) + 1
    if top == len(lms):
        ranked = np.empty(len(lms), np.int64)
        ranked[reduced] = np.arange(len(lms))
    else:
        ranked = np.array(_small(reduced.tolist(), top), np.int64)
    return _induced(t, s, lms[ranked])


def _small(t: list[int], k: int) -> list[int]:
    """The same over a list of numbers below k."""
    n = len(t)
    if n < 2:
        return list(range(n))
    s = [False] * n
    for i in range(n - 2, -1, -1):
        s[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and s[i + 1])
    sizes = [0] * (k + 1)
    for c in t:
        sizes[c + 1] += 1
    heads = sizes[:]
    for c in range(1, k + 1):
        heads[c] += heads[c - 1]

    larger = [not x for x in s]

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        tail = heads[1:]
        for i in reversed(seeds):
            tail[t[i]] -= 1
            sa[tail[t[i]]] = i
        head = heads[:]
        sa_first = n - 1
        sa[head[t[sa_first]]] = sa_first
        head[t[sa_first]] += 1
        for j in sa:  # grows ahead of the loop
            if j > 0 and larger[j - 1]:
                c = t[j - 1]
                sa[head[c]] = j - 1
                head[c] += 1
        tail = heads[1:]
        for i in range(n - 1, -1, -1):
            j = sa[i]
            if j > 0 and s[j - 1]:
                c = t[j - 1]
                tail[c] -= 1
                sa[tail[c]] = j - 1
        return sa

    lms = [i for i in range(1, n) if s[i] and not s[i - 1]]
    if len(lms) < 2:
        return induce(lms)
    sa = induce(lms)
    nxt = dict(zip(lms, [*lms[1:], n - 1]))
    name, last, names = -1, -1, {}
    for i in sa:
        if i in nxt:
            if last < 0 or t[i : nxt[i] + 1] != t[last : nxt[last] + 1] or nxt[i] - i != nxt[last] - last or i == lms[-1] or last == lms[-1]:
                name += 1
            names[i] = name
            last = i
    reduced = [names[i] for i in lms]
    if name + 1 == len(lms):
        ranked = [0] * len(lms)
        for i, r in enumerate(reduced):
            ranked[r] = i
    else:
        ranked = _small(reduced, name + 1)
    return induce([lms[i] for i in ranked])


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each place, how many bytes its suffix shares with the one before it in order, up to `most`; 0 for the first."""
    n = len(t)
    plcp = np.zeros(n, np.int32)
    if n < 2:
        return plcp
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    words = np.ascontiguousarray(_words(t)).view("<u8").ravel()
    live = np.flatnonzero(phi >= 0)
    at = 0
    while len(live) and at < most:
        a, b = live + at, phi[live] + at
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        low = x & (~x + np.uint64(1))  # the first byte that differs
        share = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        share = np.minimum(share, n - np.maximum(a, b))
        plcp[live] += share
        live = live[share == 8]
        at += 8
    return np.minimum(plcp, most)
