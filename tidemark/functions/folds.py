"""Ordered folds: operators whose state depends on where the current window began.

None of them is a plain window function. Each takes small rows (metadata of frames, packs, ranges), grouped by a key
such as the pack, and runs in order inside a group.
"""

from __future__ import annotations

from collections import OrderedDict


def coalesce_bounded(ranges, gap: int, window: int, factor: int | None = None, single: int | None = None):
    """Merge sorted, distinct (start, end) while the gap, the merged size and (factor) the waste stay in bounds.

    factor: merged size may be so many times the bytes of the ranges in it. single: a longer range is an error.
    """
    out: list[list[int]] = []
    inside = 0
    for start, end in sorted(set(ranges)):
        if single is not None and end - start > single:
            raise ValueError(f"range of {end - start} bytes; at most {single} are allowed")
        if out:
            cur = out[-1]
            union = max(cur[1], end) - cur[0]
            held = inside + max(0, end - max(start, cur[1]))
            if start <= cur[1] + gap and union <= window and (factor is None or union <= factor * held):
                cur[1], cur[2] = max(cur[1], end), cur[2] + 1
                inside = held
                continue
        out.append([start, end, 1])
        inside = end - start
    return [tuple(x) for x in out]


def greedy_with_skip(items, budget: int):
    """Items (cost, payload) in order, each taken if it still fits; one that doesn't is skipped, later ones may fit."""
    taken = []
    for cost, x in items:
        if cost <= budget:
            budget -= cost
            taken.append(x)
    return taken


def rollover(sizes, target: int):
    """Group number of each size: a group closes after the item that reaches target."""
    out, group, held = [], 0, 0
    for s in sizes:
        out.append(group)
        held += s
        if held >= target:
            group, held = group + 1, 0
    return out


def bounded_batches(sizes, limit: int):
    """Batch number of each size: a batch closes before the item that would exceed limit."""
    out, batch, held = [], 0, 0
    for s in sizes:
        if held and held + s > limit:
            batch, held = batch + 1, 0
        out.append(batch)
        held += s
    return out


def prefetch_batches(pages, max_pages: int, max_bytes: int):
    """Batch number of each (frame, frame bytes): so many pages and bytes of distinct frames at most."""
    out, batch, n, held, seen = [], 0, 0, 0, set()
    for frame, size in pages:
        more = 0 if frame in seen else size
        if n and (n >= max_pages or held + more > max_bytes):
            batch, n, held, seen, more = batch + 1, 0, 0, set(), size
        out.append(batch)
        n, held = n + 1, held + more
        seen.add(frame)
    return out


def lru(trace, capacity: int, cache=()):
    """Hits, misses, evictions of a page cache over a trace of pages; cache: what it holds before, longest unused first."""
    held: OrderedDict = OrderedDict((p, True) for p in cache)
    hits = misses = evicted = 0
    for p in trace:
        if p in held:
            held.move_to_end(p)
            hits += 1
            continue
        misses += 1
        held[p] = True
        if len(held) > capacity:
            held.popitem(last=False)
            evicted += 1
    return hits, misses, evicted
