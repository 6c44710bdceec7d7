"""Suffix sorting by linear grouping.

A suffix's *Lyndon prefix* is its longest prefix that is a Lyndon word.  Suffixes with one Lyndon prefix form a
group.  Every suffix starts in the group of its first symbol.  Groups are taken from the highest down; for each
member the pointer to the previous smaller suffix is found by following pointers that are already known, and the
suffixes pointed at move into finer groups right above their old one, those pointed at more often higher.  When
all groups are done each holds the suffixes of one Lyndon prefix, in lexicographic order of groups.  A second
scan then emits the order inside the groups from the smallest suffix up.  No ranks are ever recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence


def _insert_above(old: int, moved: list[int], members: list, live: list, group: list, below: list, above: list) -> None:
    new, after = len(members), above[old]
    members.append(moved)
    live.append(len(moved))
    live[old] -= len(moved)
    for j in moved:
        group[j] = new
    below.append(old)
    above.append(after)
    above[old] = new
    below[after] = new


def lyndon_groups(symbols: Sequence[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """Members of each group (ascending order of groups), the group of each suffix, previous-smaller pointers."""
    n = len(symbols)
    distinct = sorted(set(symbols))
    number = {c: g for g, c in enumerate(distinct)}
    group = [number[c] for c in symbols]
    members: list[list[int]] = [[] for _ in distinct]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(distinct) - 1))  # the next lower group
    above = [*range(1, len(distinct)), -1] if distinct else []
    done = bytearray(n)
    smaller = [-1] * n
    live = [len(own) for own in members]  # members that have not moved on
    top = len(distinct) - 1
    while top >= 0:
        if not live[top]:
            members[top] = []
            top = below[top]
            continue
        own = members[top]
        if len(own) > 1:
            if len(own) > live[top]:
                own = [i for i in own if group[i] == top]
            own.sort()
            members[top] = own
            for i in own:
                done[i] = 1
            times: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            finer: dict[tuple[int, int], list[int]] = {}
            for j, t in times.items():
                if live[group[j]] > 1:  # one alone is in its final group already
                    finer.setdefault((group[j], -t), []).append(j)
            # of one old group the most often pointed at are inserted first, so that they end up highest
            for old, t in sorted(finer) if len(finer) > 1 else finer:
                moved = finer[old, t]
                if len(moved) < live[old]:
                    _insert_above(old, moved, members, live, group, below, above)
        else:
            i = own[0]
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and live[group[j]] > 1:
                _insert_above(group[j], [j], members, live, group, below, above)
        top = below[top]
    order, g = [], 0 if distinct else -1
    while g >= 0:
        if members[g]:
            order.append(g)
        g = above[g]
    rank = {g: r for r, g in enumerate(order)}
    return [members[g] for g in order], [rank[g] for g in group], smaller


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of all suffixes in lexicographic order; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    members, group, smaller = lyndon_groups(symbols)
    free, at = [], 0
    for own in members:
        free.append(at)
        at += len(own)
    out, placed = [-1] * n, bytearray(n)
    for k in range(-1, n):
        i = (out[k] if k >= 0 else n) - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = smaller[i]
    return out
