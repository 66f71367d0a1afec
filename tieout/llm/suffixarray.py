"""Suffix arrays of many short strings at once, by linear grouping construction.

Suffixes start in groups by their first symbol. Groups are worked off in descending order: each
suffix of the group finds the nearest earlier suffix of a smaller group by following the pointers
found so far, and the suffixes so pointed at leave their group for one right above it, higher the
more often they are pointed at. In the end each group holds the suffixes with one Lyndon prefix,
and one ascending pass emits the order inside all groups: when a suffix is emitted, the suffixes
whose Lyndon prefix ends before it are next in theirs. No names are given, nothing is sorted again.

One string would be a loop over its groups. Here all strings of a batch take their steps together:
step t works on the current group of every string, on flat arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings text[starts[b]:starts[b] + sizes[b]], one after the other.

    Strings lie one after the other, and each must end in a symbol smaller than all its others.
    Entries are positions in `text`; string b's suffixes are at the places of its own symbols.
    """
    count = len(text)
    block = np.repeat(np.arange(len(starts)), sizes)
    order = np.lexsort((text, block))
    symbols = text[order]
    fresh = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])])
    heads = np.flatnonzero(fresh)
    group, size, place = np.empty(count, "i8"), np.zeros(count, "i8"), np.empty(count, "i8")
    size[heads] = np.diff(np.concatenate([heads, [count]]))
    group[order] = np.repeat(heads, size[heads])
    place[order] = np.arange(count)
    sa, before = order, np.arange(count) - 1
    floor = np.repeat(starts, sizes)
    _group(sa, place, group, size, before, floor, starts, starts + sizes)
    return _emit(sa, group, before, floor, starts, sizes)


def _group(sa, place, group, size, before, floor, starts, ends) -> None:
    """Split the groups until each holds one Lyndon prefix; `before` gets the previous smaller ones."""
    cursor = ends.copy()
    left = np.flatnonzero(cursor > starts)
    while len(left):
        head = group[sa[cursor[left] - 1]]
        many = cursor[left] - head
        cursor[left] = head
        total = int(many.sum())
        at = np.repeat(head - np.cumsum(many) + many, many) + np.arange(total)
        members, own = sa[at], np.repeat(head, many)
        low = floor[members]
        seek = before[members]
        open_ = np.flatnonzero((seek >= low) & (group[np.maximum(seek, 0)] >= own))
        while len(open_):  # pointers of members shorten while they are followed
            seek[open_] = before[seek[open_]]
            before[members] = seek
            open_ = open_[(seek[open_] >= low[open_]) & (group[np.maximum(seek[open_], 0)] >= own[open_])]
        targets = seek[seek >= low]
        left = left[cursor[left] > starts[left]]
        if not len(targets):
            continue
        targets.sort()
        first = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        times = np.diff(np.concatenate([first, [len(targets)]]))
        targets = targets[first]
        old = group[targets]
        sort = np.lexsort((times, old))
        targets, times, old = targets[sort], times[sort], old[sort]
        lead = np.concatenate([[True], old[1:] != old[:-1]])
        begins = np.flatnonzero(lead)
        moved = np.diff(np.concatenate([begins, [len(old)]]))
        olds = old[begins]
        tail = olds + size[olds] - moved  # where the moved ones go in their old group
        spots = np.repeat(tail - begins, moved) + np.arange(len(old))
        mark = np.repeat(tail, moved)
        was = place[targets]
        holes = np.sort(was[was < mark])
        inside = sa[spots]
        place[targets] = -1
        out = inside[place[inside] >= 0]  # unmoved ones that sit where the moved ones go
        sa[holes], place[out] = out, holes
        sa[spots], place[targets] = targets, spots
        new = lead | np.concatenate([[True], times[1:] != times[:-1]])
        heads = spots[new]
        sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(old)]]))
        size[olds] -= moved
        group[targets] = np.repeat(heads, sizes)
        size[heads] = sizes


def _emit(sa, group, before, floor, starts, sizes) -> np.ndarray:
    """Fill every group in the order in which its suffixes' Lyndon prefixes end at emitted ones."""
    out = np.full(len(sa), -1, "i8")
    done = np.zeros(len(sa), bool)
    following = np.arange(len(sa))  # the next free place of each group
    live = np.flatnonzero(sizes > 0)
    last = starts[live] + sizes[live] - 1
    out[starts[live]] = last
    done[last] = True
    following[group[last]] += 1
    step = 0
    while len(live):
        at = out[starts[live] + step]
        walk = at - 1
        walk = walk[walk >= starts[live]]
        while len(walk):
            walk = walk[~done[walk]]
            if not len(walk):
                break
            spot = following[group[walk]]
            out[spot] = walk
            following[group[walk]] += 1
            done[walk] = True
            low = floor[walk]
            walk = before[walk]
            walk = walk[walk >= low]
        step += 1
        live = live[sizes[live] > step]
    return out
