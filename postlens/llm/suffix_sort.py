"""Suffix arrays by linear grouping.

Phase one gathers suffixes in groups that share their longest Lyndon prefix, going through the
groups from the largest down: each suffix of a group points to the nearest one before it in a
smaller group, and those pointed at move on to a new group just above their old one, further
up the more pointers they got.  Phase two reads the groups from the smallest up and puts each
suffix, and those its pointers lead to, at the front of its group's slots.  Nothing is renamed
and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in ascending order; the end of the text is smaller than any symbol."""
    n = len(text) + 1
    symbols = np.zeros(n, np.int64)
    symbols[:-1] = np.unique(text, return_inverse=True)[1] + 1
    slots_ = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols)
    heads = np.cumsum(counts) - counts
    group: list[int] = heads[symbols].tolist()  # first slot of the group a suffix is in
    place_ = np.empty(n, np.int64)
    place_[slots_] = np.arange(n)
    slots: list[int] = slots_.tolist()
    place: list[int] = place_.tolist()
    size: list[int] = [0] * n
    for h, c in zip(heads.tolist(), counts.tolist()):
        if c:
            size[h] = c
    before: list[int] = [-1] * n

    end = n
    while end:
        start = group[slots[end - 1]]
        if end - start == 1:
            i = slots[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                c = size[g]
                if c > 1:  # one pointer: j moves alone to the last slot of its group
                    c -= 1
                    size[g] = c
                    last = g + c
                    at, other = place[j], slots[last]
                    slots[at], slots[last] = other, j
                    place[other], place[j] = at, last
                    group[j] = last
                    size[last] = 1
            end = start
            continue
        pointers: dict[int, int] = {}
        for i in sorted(slots[start:end]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        end = start
        if not pointers:
            continue
        most = max(pointers.values())
        if most == 1:
            levels = [list(pointers)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, k in pointers.items():
                by_count.setdefault(k, []).append(j)
            levels = [by_count[k] for k in sorted(by_count, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:
                g = group[j]
                c = size[g] - 1
                size[g] = c
                last = g + c
                at, other = place[j], slots[last]
                slots[at], slots[last] = other, j
                place[other], place[j] = at, last
                moved[g] = moved.get(g, 0) + 1
            for g, c in moved.items():
                fresh = g + size[g]
                size[fresh] = c
                for j in slots[fresh : fresh + c]:
                    group[j] = fresh

    order = [-1] * n
    order[0] = n - 1
    group[n - 1] = -1  # done
    front = list(range(n))
    for s in range(n):
        j = order[s] - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            at = front[g]
            order[at] = j
            front[g] = at + 1
            group[j] = -1
            j = before[j]
    return np.array(order[1:], np.int64)
