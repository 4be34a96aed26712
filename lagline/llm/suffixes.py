"""Suffix sorting by linear grouping (Baier, 2016), and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes in order.

    Phase one takes groups from the highest down. A group's suffixes find the last earlier
    suffix of a lower group by following pointers over higher ones; those suffixes are moved
    up behind their old group, the more often pointed at the higher, so that in the end a
    group shares its Lyndon prefix. Phase two reads off the order: a suffix that has its
    place puts the ones pointing over to it next in their groups, with no renaming.
    """
    n = len(symbols)
    if n < 2:
        return list(range(n))
    lowest = min(symbols)
    text = [s - lowest + 1 for s in symbols]
    text.append(0)  # below everything, so that a suffix sorts before its extensions
    n += 1
    order = np.argsort(np.array(text), kind="stable").tolist()
    place = [0] * n  # of a suffix in `order`
    group = [0] * n  # first place of a suffix's group
    size = [0] * n  # by first place
    at = -1
    for k, s in enumerate(order):
        place[s] = k
        if k == 0 or text[s] != text[order[k - 1]]:
            at = k
        group[s] = at
        size[at] += 1
    previous = [-1] * n
    high = n - 1
    while high >= 0:
        low = group[order[high]]
        members = order[low:high + 1]
        if high > low:
            members.sort()
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by_count: dict[int, list[int]] = {}
            for p, c in times.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                chosen = by_count[c]
                for p in chosen:
                    g = group[p]
                    k = moved.get(g, 0) + 1
                    moved[g] = k
                    last = g + size[g] - k
                    here, other = place[p], order[last]
                    order[here], order[last] = other, p
                    place[other], place[p] = here, last
                begun: dict[int, int] = {}
                for g, k in moved.items():
                    rest = size[g] - k
                    if rest:  # a group that moves as a whole stays where it is
                        size[g] = rest
                        size[g + rest] = k
                        begun[g] = g + rest
                for p in chosen:
                    group[p] = begun.get(group[p], group[p])
        high = low - 1
    next_place = list(range(n))  # by a group's first place
    out = [-1] * n
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[next_place[g]] = s
            next_place[g] += 1
            placed[s] = True
            s = previous[s]
    return out[1:]


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """Symbols that each suffix in `order` shares with the one before it (Kasai et al., 2001)."""
    n = len(symbols)
    rank = [0] * n
    for k, s in enumerate(order):
        rank[s] = k
    out, h = [0] * n, 0
    for s in range(n):
        k = rank[s]
        if not k:
            h = 0
            continue
        t = order[k - 1]
        most = n - max(s, t)
        while h < most and symbols[s + h] == symbols[t + h]:
            h += 1
        out[k] = h
        if h:
            h -= 1
    return out


def longest_shared(symbols: list[int]) -> np.ndarray:
    """For every position, the longest prefix of its suffix that starts somewhere else too."""
    order = suffix_array(symbols)
    shared = np.array(common_prefixes(symbols, order) + [0])
    out = np.zeros(len(symbols), np.int64)
    out[order] = np.maximum(shared[:-1], shared[1:])
    return out
