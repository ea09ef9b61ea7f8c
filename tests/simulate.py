"""Step-by-step models of the order-dependent operators, to test against."""

from __future__ import annotations

from collections import Counter, OrderedDict


def bounded_join(arrivals, capacity, retain):
    """arrivals: (side, key, seq) in order; all share one pair of memories."""
    memory = {"l": [], "r": []}
    pairs = []
    for side, key, seq in arrivals:
        own, other = memory[side], memory["r" if side == "l" else "l"]
        if len(own) == capacity:
            own.pop(-1 if retain == "first" else 0)
        own.append((key, seq))
        for other_key, other_seq in other:
            if other_key == key:
                pairs.append((key, seq, other_seq) if side == "l" else (key, other_seq, seq))
    return Counter(pairs)


def bounded_join_per_key(arrivals, capacity, retain):
    total = Counter()
    for key in OrderedDict.fromkeys(k for _, k, _ in arrivals):
        total += bounded_join([a for a in arrivals if a[1] == key], capacity, retain)
    return total


def pair_up(arrivals):
    waiting, out = set(), []
    for key, seq in arrivals:
        if key in waiting:
            waiting.remove(key)
            out.append((key, seq))
        else:
            waiting.add(key)
    return out


def threshold(arrivals, n):
    seen, out = {}, []
    for key, value, seq in arrivals:
        if key not in seen:
            seen[key] = {value}
            continue
        seen[key].add(value)
        if len(seen[key]) == n:
            out.append((key, seq))
    return out
