"""Linear suffix sorting by grouping.

Suffixes are first grouped by their first symbol. The groups are then taken in descending
order; every suffix of a group looks back, over pointers already known, to the nearest suffix
of a smaller group, and the suffixes looked at move into new groups directly after their own,
those that more suffixes look at further up. Then every group holds suffixes that begin with
one and the same Lyndon prefix, and one scan of the final order emits each suffix's
predecessors into the first free places of their groups. Nothing is renamed or sorted
recursively.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order. The last symbol must be smaller than all others."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, first, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for rank, i in enumerate(order):
        if rank and symbols[i] != symbols[order[rank - 1]]:
            start = rank
        place[i], first[i] = rank, start
        size[start] += 1
    before = [-1] * n
    end = n
    while end > 0:
        start = first[order[end - 1]]
        members = order[start:end]
        end = start
        if len(members) == 1:
            # One suffix: at most one is looked at, and it alone moves to the end of its group.
            i = members[0]
            j = i - 1
            while j >= 0 and first[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = first[j]
                count = size[g]
                if count > 1:
                    top, p = g + count - 1, place[j]
                    if p != top:
                        k = order[top]
                        order[p], order[top], place[k], place[j] = k, j, p, top
                    first[j], size[top], size[g] = top, 1, count - 1
            continue
        members.sort()
        looks: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and first[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                looks[j] = looks.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in looks.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            groups: dict[int, list[int]] = {}
            for j in by_count[count]:
                groups.setdefault(first[j], []).append(j)
            for g, moved in groups.items():
                left = size[g] - len(moved)
                if not left:
                    continue
                top = g + size[g] - 1
                for j in moved:
                    p = place[j]
                    if p != top:
                        k = order[top]
                        order[p], order[top], place[k], place[j] = k, j, p, top
                    top -= 1
                fresh = g + left
                for j in moved:
                    first[j] = fresh
                size[fresh], size[g] = len(moved), left
    result, free, done = [-1] * n, list(range(n)), [False] * n
    result[0] = n - 1
    done[n - 1] = True
    for rank in range(n):
        j = result[rank] - 1
        while j >= 0 and not done[j]:
            g = first[j]
            result[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return result
