"""Spans of one text, kept in order: what overlaps, what lies inside, and what is chosen first."""

from __future__ import annotations

from bisect import bisect_right


class Disjoint:
    """Spans that don't overlap, by start; whether a place is free takes a bisection."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts = [s for s, _ in spans]
        self.ends = [e for _, e in spans]

    def free(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return not (k and self.ends[k - 1] > start) and not (k < len(self.starts) and self.starts[k] < end)

    def add(self, start: int, end: int) -> None:
        k = bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)

    def clashing(self, start: int, end: int) -> slice:
        """Where the spans are that overlap a place."""
        low = bisect_right(self.starts, start)
        low -= bool(low and self.ends[low - 1] > start)
        high = low
        while high < len(self.starts) and self.starts[high] < end:
            high += 1
        return slice(low, high)


class Found:
    """Candidates in the order in which they were found, and whether one of them holds a place."""

    def __init__(self):
        self.all: list[tuple] = []
        self.starts: list[int] = []
        self.reach: list[int] = []  # the furthest end of all that start so far left

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.reach[k - 1] >= end

    def add(self, start: int, end: int, *rest) -> None:
        self.all.append((start, end, *rest))
        k = bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.reach.insert(k, max(end, self.reach[k - 1] if k else end))
        for i in range(k + 1, len(self.reach)):
            if self.reach[i] >= end:
                break
            self.reach[i] = end

    def add_new(self, start: int, end: int, *rest) -> None:
        if not self.holds(start, end):
            self.add(start, end, *rest)


def greedy(best_first: list[tuple]) -> list[tuple]:
    """Of (start, end, ...), each that overlaps none that stayed before it; by start."""
    taken, kept = Disjoint(), []
    for span in best_first:
        if taken.free(span[0], span[1]):
            taken.add(span[0], span[1])
            kept.append(span)
    return sorted(kept)
