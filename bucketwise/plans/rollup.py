"""Which parts of raw rows and minute rollups add up to a count over a range."""

from __future__ import annotations

from dataclasses import dataclass

from bucketwise.functions.time import ceil_minute, floor_minute
from bucketwise.model import MINUTE


@dataclass(frozen=True)
class Part:
    """Counts of [start, end) from ``source``, added or (sign -1) taken away."""

    source: str
    start: int
    end: int
    sign: int = 1


def plan_parts(since: int, until: int) -> list[Part]:
    """Signed parts that cover [since, until) exactly.

    Whole minutes come from rollups.  A partial minute at an edge is counted
    from raw rows, or, where less than half of it lies outside, as its rollup
    less the raw rows outside; half a minute is counted directly.
    """
    first, last = ceil_minute(since), floor_minute(until)
    if first >= last:
        return [Part("raw", since, until)]
    parts = []
    if since < first:
        outside = floor_minute(since)
        if since - outside < first - since:
            parts += [Part("rollup", outside, first), Part("raw", outside, since, -1)]
        else:
            parts.append(Part("raw", since, first))
    parts.append(Part("rollup", first, last))
    if last < until:
        outside = last + MINUTE
        if outside - until < until - last:
            parts += [Part("rollup", last, outside), Part("raw", until, outside, -1)]
        else:
            parts.append(Part("raw", last, until))
    return parts
