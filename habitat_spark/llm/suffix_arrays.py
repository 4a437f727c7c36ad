"""Suffix arrays by linear grouping.

Suffixes are first grouped by their first symbol. Groups are processed in descending order: each member points to
the nearest suffix before it in a lower group (its previous smaller one), and the suffixes pointed at move, by how
often they are, into new groups right after what is left of their old ones. A group then holds the suffixes with one
Lyndon prefix. A last pass emits each group's order: from every suffix in its place, the one before it and the chain
of previous smaller ones go to the next free places of their groups. Nothing is renamed or solved recursively.

The last symbol of a text must be its only least one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of one text, in time linear in its length but for sorting group members."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    before = [-1] * n
    end = n - 1
    while end >= 0:
        first = group[order[end]]
        pointed: Counter[int] = Counter()
        for s in sorted(order[first : end + 1]):
            j = s - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[s] = j
            if j >= 0:
                pointed[j] += 1
        moved: dict[int, list[tuple[int, int]]] = {}
        for s, times in pointed.items():
            moved.setdefault(group[s], []).append((times, s))
        for old, members in moved.items():
            members.sort(reverse=True)
            at = old + size[old] - 1
            size[old] -= len(members)
            i = 0
            while i < len(members):
                k = i
                while k < len(members) and members[k][0] == members[i][0]:
                    s = members[k][1]
                    other = order[at]
                    order[at], order[place[s]] = s, other
                    place[other], place[s] = place[s], at
                    at -= 1
                    k += 1
                for _, s in members[i:k]:
                    group[s] = at + 1
                size[at + 1] = k - i
                i = k
        end = first - 1
    out, filled, there = [-1] * n, [0] * n, [False] * n
    out[0], there[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not there[j]:
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            there[j] = True
            j = before[j]
    return out


def suffix_arrays(texts: np.ndarray) -> np.ndarray:
    """The same for many texts of one length at once (a row each), every step taken in all rows together."""
    rows, n = texts.shape
    order = np.argsort(texts, axis=1, kind="stable")
    ranked = np.take_along_axis(texts, order, 1)
    fresh = np.ones((rows, n), bool)
    fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    group = np.empty((rows, n), np.int32)
    np.put_along_axis(group, order, starts.astype(np.int32), 1)
    size = np.zeros((rows, n), np.int32)
    np.add.at(size, (np.repeat(np.arange(rows), n), starts.ravel()), 1)
    before = np.full((rows, n), -1, np.int32)
    top = group.max(axis=1)
    index = np.arange(n, dtype=np.int32)
    live = np.arange(rows)
    g = group  # the rows still being grouped
    while live.size:
        lower = g < top[live, None]
        previous = np.maximum.accumulate(np.where(lower, index, np.int32(-1)), axis=1)
        at_row, at = np.nonzero(g == top[live, None])
        to = previous[at_row, at]
        before[live[at_row], at] = to
        inside = to >= 0
        hit, times = np.unique(at_row[inside] * n + to[inside], return_counts=True)
        row, s = hit // n, hit % n
        old = g[row, s]
        # new groups of each old one stand at its end, by how often their members were pointed at
        by = np.lexsort((times, old, row))
        row, s, old, times = row[by], s[by], old[by], times[by]
        head = np.ones(row.size, bool)
        head[1:] = (row[1:] != row[:-1]) | (old[1:] != old[:-1]) | (times[1:] != times[:-1])
        heads = np.flatnonzero(head)
        counts = np.diff(np.append(heads, row.size))
        first = np.ones(heads.size, bool)
        first[1:] = (row[heads][1:] != row[heads][:-1]) | (old[heads][1:] != old[heads][:-1])
        block = np.cumsum(first) - 1
        total = np.bincount(block, counts).astype(np.int64) if heads.size else np.zeros(0, np.int64)
        passed = np.cumsum(counts) - counts
        passed = passed - passed[first][block] if heads.size else passed
        full = live[row[heads]]
        new = old[heads] + size[full, old[heads]] - total[block] + passed if heads.size else np.zeros(0, np.int64)
        if heads.size:
            keep = heads[first]
            size[live[row[keep]], old[keep]] -= total.astype(np.int32)
            size[full, new] = counts
            g[row, s] = np.repeat(new, counts)
        next_top = np.where(lower, g, np.int32(-1)).max(axis=1)
        top[live] = next_top
        if (next_top < 0).any():
            group[live] = g
            stay = next_top >= 0
            live, g = live[stay], g[stay]
    out = np.full((rows, n), -1, np.int32)
    filled = np.zeros((rows, n), np.int32)
    there = np.zeros((rows, n), bool)
    out[:, 0], there[:, n - 1] = n - 1, True
    for i in range(n):
        j = out[:, i] - 1
        row = np.flatnonzero(j >= 0)
        j = j[row]
        while row.size:
            free = ~there[row, j]
            row, j = row[free], j[free]
            if not row.size:
                break
            at = group[row, j]
            out[row, at + filled[row, at]] = j
            filled[row, at] += 1
            there[row, j] = True
            j = before[row, j]
            more = j >= 0
            row, j = row[more], j[more]
    return out
