"""Suffix arrays of integer strings by linear grouping.

Suffixes are grouped by their Lyndon prefix. Groups are taken in descending order: each member of
the group looks, along previous-smaller pointers, for the nearest earlier position of a lower
group; that position's prefix grows by the group's, once for each member that found it, and so it
moves to a new group just above its old one. When all groups are final, suffixes are emitted in
ascending order: an emitted suffix puts those whose Lyndon prefix ends at it next into their
groups. Nothing is renamed and no smaller string is sorted first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each position, and the groups in ascending order with the lengths of their Lyndon prefixes by group."""
    n = len(text)
    letters = sorted(set(text))
    number = {c: k for k, c in enumerate(letters)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(letters)
    below = [k - 1 for k in range(len(letters))]
    above = [k + 1 for k in range(len(letters))]
    if letters:
        above[-1] = -1
    final = [False] * len(letters)
    back = list(range(-1, n - 1))  # previous-smaller pointers, as far as known
    current = len(letters) - 1
    top = current
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        final[current] = True
        if len(own) == 1:  # the commonest case, without the counting below
            p = first = back[own[0]]
            while p >= 0 and final[group[p]]:
                p = back[p]
            if p >= 0:
                while first != p:
                    back[first], first = p, back[first]
                old, new = group[p], len(size)
                size.append(size[old] + size[current])
                members.append([p])
                final.append(False)
                group[p] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                else:
                    top = new
            current = below[current]
            continue
        own.sort()
        found: dict[int, int] = {}
        for i in own:
            p = back[i]
            if p >= 0 and final[group[p]]:
                path = [i]
                while p >= 0 and final[group[p]]:
                    path.append(p)
                    p = back[p]
                for q in path:
                    back[q] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        # from each old group, those reached k times move to one new group
        moved: dict[tuple[int, int], int] = {}
        by_old: dict[int, dict[int, list[int]]] = {}
        if found:
            for p, k in found.items():
                by_old.setdefault(group[p], {}).setdefault(k, []).append(p)
            for old, counts in by_old.items():
                for k in sorted(counts, reverse=True):  # inserted just above the old group, the fewest last
                    new = len(size)
                    size.append(size[old] + k * size[current])
                    members.append(counts[k])
                    final.append(False)
                    for p in counts[k]:
                        group[p] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    else:
                        top = new
        current = below[current]
    order = []
    while top >= 0:
        order.append(top)
        top = below[top]
    order.reverse()
    return group, order, size


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of text in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    group, order, size = lyndon_groups(text)
    count = [0] * len(size)
    for g in group:
        count[g] += 1
    slot, at = [0] * len(size), 0
    for g in order:
        slot[g] = at
        at += count[g]
    ends: list[list[int] | None] = [None] * (n + 1)  # positions by where their Lyndon prefix ends
    for i, g in enumerate(group):
        e = i + size[g]
        if ends[e] is None:
            ends[e] = [i]
        else:
            ends[e].append(i)
    out = [0] * n
    for i in ends[n] or ():
        g = group[i]
        out[slot[g]] = i
        slot[g] += 1
    for k in range(n):
        before = ends[out[k]]
        if before:
            for i in before:
                g = group[i]
                out[slot[g]] = i
                slot[g] += 1
    return out


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """For each place of the suffix array, the symbols that its suffix shares with the one before (the first: 0)."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out = [0] * n
    h = 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            m = n - (i if i > j else j)
            while h < m and text[i + h] == text[j + h]:
                h += 1
            out[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


class Intervals:
    """Intervals of a suffix array whose suffixes share a number of first symbols."""

    def __init__(self, text: Sequence[int]):
        order = suffix_array(text)
        self.rank = np.empty(len(text), np.int64)
        self.rank[order] = np.arange(len(text))
        self.levels = [np.array(common_prefixes(text, order), np.int32)]  # least value of 2^b places, by the last of them
        while 2 << (len(self.levels) - 1) <= len(text):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            level = np.zeros_like(last)
            level[half:] = np.minimum(last[half:], last[:-half])
            self.levels.append(level)

    def of(self, starts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For suffixes by their starts: the first place of the interval that shares that many symbols (one at least), and whether others are in it."""
        at = self.rank[starts]
        for b in reversed(range(len(self.levels))):
            at = at - ((self.levels[b][at] >= symbols).astype(np.int64) << b)
        after = np.minimum(at + 1, len(self.rank) - 1)
        return at, (after > at) & (self.levels[0][after] >= symbols)
