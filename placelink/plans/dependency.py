"""Order in which sources are built."""

from __future__ import annotations

import heapq


def order(needs: dict[str, set[str]]) -> list[str]:
    """Names such that each comes after what it needs; ties in alphabetical order.

    A source's need of itself does not count; a cycle is a ``ValueError``.
    """
    left = {name: {n for n in own if n != name and n in needs} for name, own in needs.items()}
    users: dict[str, list[str]] = {name: [] for name in needs}
    for name, own in left.items():
        for n in own:
            users[n].append(name)
    ready = [name for name, own in left.items() if not own]
    heapq.heapify(ready)
    out = []
    while ready:
        name = heapq.heappop(ready)
        out.append(name)
        for user in users[name]:
            left[user].discard(name)
            if not left[user]:
                heapq.heappush(ready, user)
    if len(out) < len(needs):
        raise ValueError(f"sources need each other in a cycle: {', '.join(sorted(set(needs) - set(out)))}")
    return out
