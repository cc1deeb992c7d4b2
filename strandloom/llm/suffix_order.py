"""Suffix order of many small texts at once, by groups of Lyndon prefixes.

Two phases, without renaming symbols and sorting the renamed text again:

1. Suffixes begin in groups of equal first symbols. Groups are taken in descending order. Each member's pointer to its
   previous smaller suffix is found by following pointers of higher groups, and the suffixes pointed at, whose known prefix grows by the
   group's, move above the rest of their own groups: the more often they are pointed at, the higher. At the end a
   group holds the suffixes of one longest Lyndon prefix.
2. In ascending order, each suffix puts the suffix before it, and the chain of previous smaller ones from there, at the next free place of their groups.

All texts take a step at the same time in NumPy, so the cost of a step is shared.
"""

from __future__ import annotations

import numpy as np


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


def _group(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: the group of each place (its first rank; -1 on guards) and the previous smaller suffix; both in places with a guard before each text."""
    texts, n = len(at) - 1, len(symbols)
    which = np.repeat(np.arange(texts), np.diff(at))
    place = np.arange(n) + which + 1
    size_all = n + texts
    group, prev = np.full(size_all, -1, np.int64), np.arange(-1, size_all - 1)
    held, size, owner, count = (np.zeros(size_all, np.int64) for _ in range(4))
    order = np.lexsort((symbols, which))
    held[place] = place[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (symbols[order][1:] != symbols[order][:-1]) | (which[1:] != which[:-1])
    first = place[np.flatnonzero(fresh)]

    def settle(first: np.ndarray, sizes: np.ndarray, members: np.ndarray) -> None:
        group[members] = np.repeat(first, sizes)
        size[first], owner[first + sizes - 1] = sizes, first

    settle(first, np.diff(np.append(np.flatnonzero(fresh), n)), held[place])
    bottom = at[:-1] + np.arange(texts) + 1
    top = at[1:] + np.arange(texts)
    while len(top):
        start = owner[top]
        sizes = top - start + 1
        members, own = held[spans(start, sizes)], np.repeat(start, sizes)
        before = prev[members]
        far = np.flatnonzero(group[before] >= own)
        while len(far):
            before[far] = prev[before[far]]
            far = far[group[before[far]] >= own[far]]
        prev[members] = before
        parents = before[group[before] >= 0]
        parents = np.sort(parents[size[group[parents]] > 1])
        if len(parents):
            heads = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
            parents, times = parents[heads], np.diff(np.append(heads, len(parents)))
            touched = np.unique(group[parents])
            sizes_of = size[touched]
            slots = spans(touched, sizes_of)
            inside, of = held[slots], np.repeat(touched, sizes_of)
            count[parents] = times
            often = count[inside]
            count[parents] = 0
            sort = np.argsort(of * (int(times.max()) + 1) + often, kind="stable")
            inside, often = inside[sort], often[sort]
            held[slots] = inside
            cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (often[1:] != often[:-1])))
            settle(slots[cut], np.diff(np.append(cut, len(slots))), inside)
        top = start - 1
        left = top >= bottom
        if not left.all():
            top, bottom = top[left], bottom[left]
    return group, prev


def suffix_orders(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For texts symbols[at[k] : at[k + 1]], each ending in a symbol smaller than all its others, the places of suffixes in ascending order, text by text."""
    group, prev = _group(symbols, at)
    texts = len(at) - 1
    size_all = len(group)
    free, placed, ranks = np.arange(size_all), group < 0, np.zeros(size_all, np.int64)
    turn = at[:-1] + np.arange(texts) + 1
    last = at[1:] + np.arange(texts)
    ranks[turn] = last
    placed[last] = True
    free[turn] += 1
    while len(turn):
        suffix = ranks[turn] - 1
        suffix = suffix[~placed[suffix]]
        while len(suffix):
            own = group[suffix]
            ranks[free[own]] = suffix
            free[own] += 1
            placed[suffix] = True
            suffix = prev[suffix]
            suffix = suffix[~placed[suffix]]
        turn = turn + 1
        left = turn <= last
        if not left.all():
            turn, last = turn[left], last[left]
    which = np.repeat(np.arange(texts), np.diff(at))
    return ranks[np.arange(len(symbols)) + which + 1] - which - 1
