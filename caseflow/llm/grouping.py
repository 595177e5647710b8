"""Suffix arrays by linear grouping (the construction of Baier, 2016).

Suffixes start in groups by their first symbol. Groups are taken in descending order; every suffix of
the group in hand points to the nearest suffix before it that lies in a lower group, and that suffix's
prefix grows by the group's, once for each pointer it gets; so it moves to a group right above its
old one. In the end a group holds the suffixes that share their longest Lyndon prefix. The order
within groups follows in one ascending pass over the result, without renaming and recursion.
"""

from __future__ import annotations


def _groups(text: list[int]) -> tuple[list[list[int]], list[int]]:
    """The final groups, ascending, and for each suffix the nearest earlier one of a lower group (or -1)."""
    n = len(text)
    members: dict[int, set[int]] = {}
    for i, symbol in enumerate(text):
        members.setdefault(symbol, set()).add(i)
    # the groups form a linked list, lowest first; ``level`` names the group of a suffix
    groups = [members[symbol] for symbol in sorted(members)]
    below = list(range(-1, len(groups) - 1))
    above = [*range(1, len(groups)), -1]
    level = [0] * n
    for number, group in enumerate(groups):
        for i in group:
            level[i] = number
    taken = bytearray(n)
    before = [-1] * n
    final: list[list[int]] = []
    at = len(groups) - 1
    while at >= 0:
        own = sorted(groups[at])
        for i in own:
            taken[i] = 1
        pointers: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and taken[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        final.append(own)
        split: dict[int, dict[int, list[int]]] = {}
        for j, count in pointers.items():
            split.setdefault(level[j], {}).setdefault(count, []).append(j)
        for old, by_count in split.items():
            counts = sorted(by_count)
            if sum(map(len, by_count.values())) == len(groups[old]):
                counts = counts[1:]  # nothing stays behind: the least grown keep the group's place
            top = old
            for count in counts:
                moved = by_count[count]
                groups[old].difference_update(moved)
                new = len(groups)
                groups.append(set(moved))
                for j in moved:
                    level[j] = new
                below.append(top)
                above.append(above[top])
                if above[top] >= 0:
                    below[above[top]] = new
                above[top] = new
                top = new
        at = below[at]
    final.reverse()
    return final, before


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a sequence whose last symbol is smaller than all others."""
    groups, before = _groups(text)
    out = [0] * len(text)
    place, next_free, start = [0] * len(text), [], 0
    for number, group in enumerate(groups):
        next_free.append(start)
        start += len(group)
        for i in group:
            place[i] = number
    ordered = bytearray(len(text) + 1)
    out[0] = len(text) - 1
    ordered[len(text) - 1] = 1
    for at in range(len(text)):
        j = out[at] - 1
        while j >= 0 and not ordered[j]:
            ordered[j] = 1
            out[next_free[place[j]]] = j
            next_free[place[j]] += 1
            j = before[j]
    return out
