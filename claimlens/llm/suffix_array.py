"""Suffix arrays by linear grouping, and longest matches with earlier texts."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of a list of numbers in lexical order (a suffix precedes its extensions).

    Grouping: suffixes start in groups by first symbol.  Groups are taken in descending order; each
    member finds the nearest suffix before it that lies in a lower group (its previous smaller
    one), and those are moved up, next to their old group, by how many members point at them.  In
    the end a group holds the suffixes of one longest Lyndon prefix.  Emission: from the empty
    suffix on, each suffix that is placed places those that precede it along the pointers, at
    the front of their groups.  Symbols are never renamed and nothing recurses.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    symbols = sorted(set(text))
    rank = {s: g for g, s in enumerate(symbols)}
    group = [rank[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    above[-1] = -1
    size = list(map(len, members))
    done = [False] * (n + 1)  # the last one stands before the first
    previous = [-1] * n
    at = len(symbols) - 1
    while at >= 0:
        own = members[at]
        if len(own) > 1:
            own = [i for i in own if group[i] == at]
            own.sort()
        elif own and group[own[0]] != at:
            own = []
        members[at] = own
        if len(own) == 1:
            i = own[0]
            done[i] = True
            j = i - 1
            while done[j]:
                j = previous[j]
            previous[i] = j
            fresh = {(group[j], -1): [j]} if j >= 0 and size[group[j]] > 1 else None
        else:
            for i in own:
                done[i] = True
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while done[j]:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            fresh = {}
            for j, times in pointed.items():
                key = (group[j], -times)
                if key in fresh:
                    fresh[key].append(j)
                else:
                    fresh[key] = [j]
        if fresh:
            # most pointers first: each next one goes between the old group and the last
            for (old, _), moved in sorted(fresh.items()) if len(fresh) > 1 else fresh.items():
                if len(moved) == size[old]:  # all of it: the group stays what it is
                    continue
                g = len(members)
                members.append(moved)
                size.append(len(moved))
                size[old] -= len(moved)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = g
                if up >= 0:
                    below[up] = g
                for j in moved:
                    group[j] = g
        low = at
        at = below[at]
    front = [0] * len(members)
    place = 0
    while low >= 0:
        front[low] = place
        place += len(members[low])
        low = above[low]
    out = [0] * n
    placed = [False] * n + [True]  # the last one stands before the first
    i, s = -1, n
    while True:
        p = s - 1
        while not placed[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            placed[p] = True
            p = previous[p]
        i += 1
        if i == n:
            return out
        s = out[i]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of what each suffix of the array shares with the one before it (0 for the first)."""
    before = [0] * len(text)
    for i, j in zip(order, [-1, *order], strict=False):
        before[i] = j
    ended = [*text, None]
    out = []
    h = 0
    for i, j in enumerate(before):
        if j < 0:
            h = 0
        else:
            while ended[i + h] == ended[j + h]:
                h += 1
        out.append(h)
        if h:
            h -= 1
    return [out[i] for i in order]


def nearest_smaller(own: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each shares with the nearest one before it that has a smaller owner, 0 if there is none.

    ``low`` is what each shares with the one before it.  Blocks of powers of two whose owners are all
    as great are stepped over, the largest first.
    """
    out = np.zeros(len(own), low.dtype)
    here = asked = np.flatnonzero(low)
    if not len(asked):
        return out
    longest = int(np.diff(np.flatnonzero(np.append(low, 0) == 0)).max())
    owners, lows = [own], [low]
    while (span := 1 << (len(owners) - 1)) * 2 < longest:
        for tables in (owners, lows):
            tables.append(tables[-1].copy())
            np.minimum(tables[-2][span:], tables[-2][:-span], out=tables[-1][span:])
    mine = own[asked]
    reach = np.full(len(asked), np.iinfo(low.dtype).max, low.dtype)
    for k in range(len(owners) - 1, -1, -1):
        step = lows[k][here]
        over = (owners[k][here - 1] >= mine) & (step > 0)
        reach = np.where(over, np.minimum(reach, step), reach)
        here = np.where(over, here - (1 << k), here)
    out[asked] = np.where(owners[0][here - 1] < mine, np.minimum(reach, low[here]), 0)
    return out


def earlier_matches(text: list[int], owner: list[int], least: list[int] | None = None) -> list[int]:
    """Per position the longest match with a suffix whose owner is smaller.

    The best one is the nearest with a smaller owner on either side in the suffix array.  ``least``
    tells for each position from which length on a match counts (0: it is not asked for); shorter ones may be
    returned as 0.  Suffixes that share as much as one of them needs must need the same.
    """
    if not text:
        return []
    order = suffix_array(text)
    shared = np.array(common_prefixes(text, order), np.int32)
    order = np.array(order, np.int32)
    need = np.ones(len(text), np.int32) if least is None else np.array(least, np.int32)
    best = np.zeros(len(text), np.int32)
    at = np.flatnonzero(need[order])
    if not len(at):
        return best.tolist()
    low = np.minimum.reduceat(shared[:at[-1] + 1], np.append(0, at[:-1] + 1))
    order = order[at]
    need = need[order]
    low[1:][low[1:] < np.minimum(need[1:], need[:-1])] = 0
    low[0] = 0
    own = np.array(owner, np.int32)[order]
    after = nearest_smaller(own[::-1], np.append(np.int32(0), low[:0:-1]))[::-1]
    best[order] = np.maximum(nearest_smaller(own, low), after)
    return best.tolist()
