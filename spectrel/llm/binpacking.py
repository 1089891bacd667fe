"""Bin completion over classes of equal lengths.

Only the lengths of the pieces matter for packing, and there are at most ``capacity`` of them, so the search works on how
many pieces there are of each length: its size doesn't grow with the data. A *filling* is a multiset of lengths, used for
as many bins at once as the counts allow.

The search is a depth-first branch and bound. Each node fills the bins of the largest length left: it enumerates fillings
that no other dominates, fullest first (a single length that fits exactly dominates all others; then pairs, triples, and
sets found by the sums that can be reached), and prunes where the waste so far is beyond what a better solution may waste,
or where the bound of what is left shows that none is better. Best-fit decreasing, by classes, gives the first incumbent,
and completes the counts left at nodes on the way. The search ends as soon as the incumbent meets the bound, which
proves it the best, or after ``NODES`` nodes, with the incumbent.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Nodes of the search, and fillings tried at each.
NODES = 20_000
BRANCHES = 6
#: Best fit completes the counts left at every so many nodes.
COMPLETE = 64

#: lengths of a bin, longest first, with how often each occurs; and the number of such bins
Filling = tuple[tuple[tuple[int, int], ...], int]


def lower_bound(counts: np.ndarray) -> int:
    """The bins that any packing needs at least: pieces over half a bin can't share one, smaller ones fill what these leave."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    amount = np.cumsum(counts * size)
    number = np.cumsum(counts)
    half = capacity // 2
    least = np.arange(half + 1)  # pieces shorter than this are left aside
    alone = number[-1] - number[capacity - least]
    large = number[capacity - least] - number[half]
    free = large * capacity - (amount[capacity - least] - amount[half])
    small = amount[half] - np.where(least > 0, amount[np.maximum(least - 1, 0)], 0)
    more = np.maximum(0, -((free - small) // capacity))
    return int((alone + large + more).max())


def _plus(lengths: tuple[tuple[int, int], ...], size: int, times: int) -> tuple[tuple[int, int], ...]:
    found = dict(lengths)
    found[size] = found.get(size, 0) + times
    return tuple(sorted(found.items(), reverse=True))


def best_fit(counts: np.ndarray) -> list[Filling]:
    """Best-fit decreasing: each piece, longest first, goes to the fullest bin with room for it."""
    capacity = len(counts) - 1
    free: list[Counter] = [Counter() for _ in range(capacity + 1)]  # bins by the room they have
    open_rooms = np.zeros(capacity + 1, bool)

    def put(room: int, lengths: tuple, n: int) -> None:
        free[room][lengths] += n
        open_rooms[room] = True

    for size in np.flatnonzero(counts[1:])[::-1] + 1:
        size, left = int(size), int(counts[size])
        while left:
            fits = size + int(open_rooms[size:].argmax())
            if fits <= capacity and open_rooms[fits]:
                lengths, bins = free[fits].popitem()
                open_rooms[fits] = bool(free[fits])
            else:
                fits, lengths, bins = capacity, (), -(-left // (capacity // size))
            each = fits // size
            full = min(bins, left // each)
            rest = 0 if full == bins else left - full * each
            rest = min(rest, each)
            if full:
                put(fits - each * size, _plus(lengths, size, each), full)
            if rest:
                put(fits - rest * size, _plus(lengths, size, rest), 1)
            unused = bins - full - (rest > 0)
            if unused and lengths:
                put(fits, lengths, unused)
            left -= full * each + rest
    return [(lengths, n) for rooms in free for lengths, n in rooms.items()]


def _reachable(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """One multiset with the largest sum up to ``room``, by the sums that longer lengths reach before shorter ones."""
    sizes = [int(s) for s in np.flatnonzero(counts[1 : room + 1])[::-1] + 1]
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # sums before, what is added, how many pieces that is
    sums = 1
    for s in sizes:
        many, part = min(int(counts[s]), room // s), 1
        while many:
            part = min(part, many)
            steps.append((sums, s, part))
            sums |= (sums << (s * part)) & mask
            many -= part
            part *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    if at == 0:
        return []
    taken: list[int] = []
    for before, s, part in reversed(steps):
        if not before >> at & 1:
            taken += [s] * part
            at -= s * part
    return [tuple(taken)]


def completions(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, the fullest first, at most BRANCHES; the empty one only if nothing fits."""
    there = np.flatnonzero(counts[1 : room + 1]) + 1
    if not len(there):
        return [()]
    longest = int(there[-1])
    if longest == room:
        return [(room,)]  # any other fits into this one's place
    found: list[tuple[int, ...]] = []
    there = there[::-1]
    few = counts == 1
    # the fullest pair for each longer part: its partner is the largest length that still fits
    rest = room - there
    ascending = there[::-1]
    at = np.searchsorted(ascending, rest, side="right") - 1
    partner = np.where(at >= 0, ascending[np.maximum(at, 0)], 0)
    # a single piece can't be its own partner: take the next smaller length
    own = (partner == there) & few[there]
    partner = np.where(own, np.where(at >= 1, ascending[np.maximum(at - 1, 0)], 0), partner)
    total = there + partner
    order = np.argsort(-total, kind="stable")
    for i in order[: 4 * BRANCHES].tolist():
        a, b = int(there[i]), int(partner[i])
        if b > a:
            continue
        found.append((a, b) if b else (a,))
        if len(found) == BRANCHES:
            break
    if not found or sum(found[0]) < room:
        found += _reachable(counts, room)
    found = sorted(set(found), key=lambda x: (-sum(x), len(x), [-s for s in x]))
    # a filling that is a part of another, or whose longest pieces all fit into the other's places, is dominated
    kept: list[tuple[int, ...]] = []
    for x in found:
        if not any(len(x) <= len(y) and all(p <= q for p, q in zip(x, y)) for y in kept):
            kept.append(x)
    return kept[:BRANCHES]


def pack(counts: np.ndarray, nodes: int = NODES) -> tuple[list[Filling], int]:
    """Fillings that hold ``counts[s]`` pieces of each length s, and the number of bins that no packing can go below."""
    counts = np.asarray(counts, np.int64).copy()
    capacity = len(counts) - 1
    counts[0] = 0
    bound = lower_bound(counts)
    best = best_fit(counts)
    fewest = sum(n for _, n in best)
    if fewest == bound:
        return best, bound
    total = int((counts * np.arange(capacity + 1)).sum())
    path: list[Filling] = []
    seen = 0

    def children(left: np.ndarray) -> list[tuple[tuple, int, int]]:
        """Fillings of the largest length's bins: lengths, bins, waste."""
        size = int(np.flatnonzero(left)[-1])
        left[size] -= 1
        out = []
        for rest in completions(left, capacity - size):
            lengths = Counter((size, *rest))
            out.append((tuple(sorted(lengths.items(), reverse=True)), capacity - sum(k * v for k, v in lengths.items())))
        left[size] += 1
        return [(lengths, min(int(left[s]) // m for s, m in lengths), waste) for lengths, waste in out]

    def take(left: np.ndarray, lengths: tuple, times: int) -> None:
        for s, m in lengths:
            left[s] -= m * times

    left = counts.copy()
    stack = [(iter(children(left)), 0, 0)] if total else []  # what to try, bins and waste so far
    while stack and fewest > bound and seen < nodes:
        tries, bins, waste = stack[-1]
        step = next(tries, None)
        if step is None:
            stack.pop()
            if path:
                lengths, times = path.pop()
                take(left, lengths, -times)
            continue
        lengths, times, more = step
        seen += 1
        wasted = waste + times * more
        if wasted > (fewest - 1) * capacity - total:
            # fewer bins at once may still do: those that waste nothing cost nothing
            continue
        take(left, lengths, times)
        path.append((lengths, times))
        used = bins + times
        rest = lower_bound(left)
        if rest == 0 or (used + rest < fewest and seen % COMPLETE == 0):
            found = best_fit(left) if rest else []
            if used + sum(n for _, n in found) < fewest:
                best = [*path, *found]
                fewest = sum(n for _, n in best)
        if rest == 0 or used + rest >= fewest:
            path.pop()
            take(left, lengths, -times)
            continue
        stack.append((iter(children(left)), used, wasted))
    return best, bound
