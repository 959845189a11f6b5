"""Spans of text: their written form, and the columns that the span queries return."""

from __future__ import annotations

import hashlib

from .common import ship

ship(__name__)

#: (kind, start, end): code points, end exclusive.
Span = tuple[str, int, int]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def overlaps(span: Span, others: list[Span]) -> bool:
    return any(span[1] < b and a < span[2] for _, a, b in others)


def outside(found: list[Span], taken: list[Span]) -> list[Span]:
    """Those of `found` that overlap none of `taken` and no earlier one of their own; both lists are walked once."""
    from bisect import bisect_left, insort

    starts: list[tuple[int, int]] = []
    for _, a, b in sorted(taken, key=lambda s: s[1]):  # merged, so that one neighbour on each side decides
        if starts and a < starts[-1][1]:
            starts[-1] = (starts[-1][0], max(b, starts[-1][1]))
        else:
            starts.append((a, b))
    out = []
    for s in found:
        k = bisect_left(starts, (s[1], s[1]))
        clear = (k == 0 or starts[k - 1][1] <= s[1]) and (k == len(starts) or starts[k][0] >= s[2])
        if clear:
            insort(starts, (s[1], s[2]))
            out.append(s)
    return out
