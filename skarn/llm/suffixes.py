"""Suffix array by linear grouping: groups of suffixes that share their Lyndon prefix.

Phase one starts from the groups of equal first symbols and takes them from the greatest down. For
each suffix of the group the previous-smaller pointer finds the nearest suffix before it in a lower
group; that one's Lyndon prefix grows by the group's, as often as the group's suffixes point there,
so it moves to a group of its own just above its old one. Phase two reads the order off: the least
suffix is known, and whoever stands right before a placed suffix, and along the pointers from
there, is the least of its group that isn't placed yet. Nothing is renamed or sorted again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order; an end is less than any symbol.

    Besides sorting the distinct symbols once, the work is linear: suffixes change groups by swapping
    with the last of their group, and what a group points at is dealt out by count, not sorted.
    """
    n = len(symbols)
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols):
        by_symbol[s].append(i)
    members = [[n], *(by_symbol[s] for s in sorted(by_symbol))]  # by group; the empty suffix is the least
    group, place = [0] * (n + 1), [0] * (n + 1)  # of each suffix, and where in its group it stands
    for g, own in enumerate(members):
        for k, i in enumerate(own):
            group[i], place[i] = g, k
    below = list(range(-1, len(members) - 1))  # the next lower group
    above = [*range(1, len(members)), -1]
    open_ = bytearray(b"\1") * len(members)
    pointer, unknown = [-2] * (n + 1), -2
    count = [0] * (n + 1)

    g = len(members) - 1
    while g >= 0:
        open_[g] = 0
        touched = []
        for i in members[g]:
            if pointer[i] != unknown:
                continue
            # a suffix of the same group on the way, without a pointer yet, comes first
            waiting = [(i, i - 1)]
            while waiting:
                k, j = waiting.pop()
                while j >= 0 and not open_[group[j]]:
                    if pointer[j] == unknown:
                        waiting += [(k, j), (j, j - 1)]
                        break
                    j = pointer[j]
                else:
                    pointer[k] = j
                    if j >= 0:
                        if not count[j]:
                            touched.append(j)
                        count[j] += 1
        if touched:
            # the most pointed at stand highest: each lot goes right above its group, the larger counts first
            lots: list[list[int]] = [[] for _ in range(max(map(count.__getitem__, touched)) + 1)]
            for j in touched:
                lots[count[j]].append(j)
                count[j] = 0
            for lot in reversed(lots):
                fresh: dict[int, int] = {}
                for j in lot:
                    old = group[j]
                    new = fresh.get(old, -1)
                    if new < 0:
                        new = fresh[old] = len(members)
                        up = above[old]
                        members.append([])
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                        open_.append(1)
                    own, target = members[old], members[new]
                    last = own.pop()
                    if last != j:
                        own[place[j]], place[last] = last, place[j]
                    group[j], place[j] = new, len(target)
                    target.append(j)
        g = below[g]

    # where each group starts
    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    order, placed = [-1] * (n + 1), bytearray(n + 1)
    order[0], placed[n] = n, 1
    for k in range(n + 1):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            own = group[j]
            order[start[own]] = j
            start[own] += 1
            placed[j] = 1
            j = pointer[j]
    return order[1:]
