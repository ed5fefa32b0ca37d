"""Linear suffix sorting by grouping on Lyndon prefixes.

Suffixes start in groups by first symbol. Groups are taken in descending order; each member looks up the nearest earlier
suffix in a lower group (its previous-smaller pointer, followed through pointers of higher groups), and a suffix that is
pointed at moves up into a new group right after its old one, those with more pointers higher. In the end a group holds
the suffixes that share their longest Lyndon prefix. A last pass in suffix order then follows the pointers and places
each suffix at the front of its group, so no renaming and no recursion is needed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a non-empty symbol array in order; a suffix comes before those it is a prefix of."""
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)
    text[:-1] = np.unique(symbols, return_inverse=True)[1] + 1
    order_ = np.argsort(text, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(text[order_]) != 0]))
    size_ = np.diff(np.concatenate([start, [n]]))
    group_ = np.empty(n, np.int64)
    group_[order_] = np.repeat(start, size_)
    where_ = np.empty(n, np.int64)
    where_[order_] = np.arange(n)
    sizes_ = np.zeros(n + 1, np.int64)
    sizes_[start] = size_
    order, where, group, size = order_.tolist(), where_.tolist(), group_.tolist(), sizes_.tolist()
    before = [-1] * n

    end = n - 1
    while end >= 0:
        top = group[order[end]]
        if top == end:
            i = order[end]
            j = i - 1
            while j >= 0 and group[j] >= top:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                k = size[g] - 1
                if k:
                    last, at = g + k, where[j]
                    other = order[last]
                    order[at], where[other] = other, at
                    order[last], where[j] = j, last
                    group[j] = last
                    size[g], size[last] = k, 1
        else:
            pointers: dict[int, int] = {}
            for i in sorted(order[top : end + 1]):
                j = i - 1
                while j >= 0 and group[j] >= top:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointers[j] = pointers.get(j, 0) + 1
            levels = sorted(set(pointers.values()), reverse=True)
            for level in levels:
                moved: dict[int, list[int]] = {}
                for j, k in pointers.items():
                    if k == level:
                        g = group[j]
                        size[g] -= 1
                        last, at = g + size[g], where[j]
                        other = order[last]
                        order[at], where[other] = other, at
                        order[last], where[j] = j, last
                        moved.setdefault(g, []).append(j)
                for g, own in moved.items():
                    new = g + size[g]
                    size[new] = len(own)
                    for j in own:
                        group[j] = new
        end = top - 1

    front = list(range(n + 1))
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = before[j]
    return np.array(out[1:], np.int64)
