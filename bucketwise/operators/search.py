"""Search: filters, newest first, keyset pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketwise.functions.time import iso_millis, utc_day
from bucketwise.model import SEARCH_COLUMNS
from bucketwise.operators.predicates import before_cursor, equals, has_attributes, in_range, mentions, where_all
from bucketwise.plans.cursor import Cursor
from bucketwise.plans.query import LogQuery

#: Files that a search opens first.
FIRST_FILES = 4
Part = TypeVar("Part")


def matching(logs: DataFrame, query: LogQuery) -> DataFrame:
    """Rows that fit all filters, the cursor included."""
    conditions = [
        *equals(query.service, query.level),
        *in_range(logs, "timestamp", query.since, query.until),
        *has_attributes(logs, query.attributes),
        *mentions(query.q),
    ]
    if query.cursor is not None:
        conditions += before_cursor(logs, query.cursor)
    return where_all(logs, conditions)


def plan_search(logs: DataFrame, query: LogQuery, ahead: int = 1) -> DataFrame:
    """The page and ``ahead`` rows more, to tell whether another page follows.
    Each task keeps the top rows of its own; nothing is sorted as a whole."""
    columns = [c for c in SEARCH_COLUMNS if c in logs.columns]
    ordered = matching(logs, query).select(*columns).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return ordered.limit(query.limit + ahead)


def with_micros(page: DataFrame) -> DataFrame:
    return page.withColumn("micros", F.unix_micros(F.col("timestamp").cast("timestamp")))


def newest_rows(logs: DataFrame, query: LogQuery, days: list[str] | None = None) -> list:
    """The rows of :func:`plan_search`.

    With the ``days`` that the table has, the newest are read first, twice as
    many days each time, until the page is full: a page of a large table reads
    a day or two, and a rare term as many days as it takes."""
    wanted = query.limit + 1
    if days is not None and "day" in logs.columns:
        upper = min((m for m in (query.until, query.cursor.micros + 1 if query.cursor else None) if m is not None), default=None)
        low = None if query.since is None else str(utc_day(query.since))
        high = None if upper is None else str(utc_day(upper - 1))
        days = [d for d in sorted(days, reverse=True) if (low is None or d >= low) and (high is None or d <= high)]
    rows: list = []
    for first, last in _doubling(len(days)) if days is not None else [(0, 0)]:
        part = logs
        if days is not None:
            part = logs.where((F.col("day") <= F.lit(days[first]).cast("date")) & (F.col("day") >= F.lit(days[last - 1]).cast("date")))
        page = with_micros(plan_search(part, query))
        rows += page.limit(wanted - len(rows)).collect() if rows else page.collect()
        if len(rows) >= wanted:
            break
    return rows[:wanted]


def newest_in_files(
    files: Iterable[Part], wanted: int, last: Callable[[Part], int], rows_of: Callable[[list[Part], int | None, int], list], first: int = FIRST_FILES
) -> list:
    """The newest ``wanted`` rows by (micros, id) of files that come by their last instant, newest first.

    ``rows_of(files, since, n)`` gives the newest n rows of some files, none of them
    before ``since``.  Files are read a few at a time, twice as many each time.
    Once the last row of the page is newer than all that unread files hold,
    no further file is opened."""
    rows: list = []
    ahead = iter(files)
    pending = next(ahead, None)
    while pending is not None:
        edge = rows[wanted - 1].micros if len(rows) >= wanted else None
        if edge is not None and last(pending) < edge:
            break
        some = []
        while pending is not None and len(some) < first and (edge is None or last(pending) >= edge):
            some.append(pending)
            pending = next(ahead, None)
        first *= 2
        rows = sorted([*rows, *rows_of(some, edge, wanted)], key=lambda r: (r.micros, r.id), reverse=True)[:wanted]
    return rows


def _doubling(n: int) -> list[tuple[int, int]]:
    """(0, 1), (1, 3), (3, 7), ... up to n."""
    out, first, width = [], 0, 1
    while first < n:
        out.append((first, min(n, first + width)))
        first, width = first + width, 2 * width
    return out


def search(logs: DataFrame, query: LogQuery, days: list[str] | None = None) -> dict:
    """One page as the API shows it: ``{"logs": [...], "next_cursor": ...}``."""
    return page_of(newest_rows(logs, query, days), query)


def page_of(rows: list, query: LogQuery) -> dict:
    """The page of a query's newest rows, of which one more than its limit are sought."""
    shown = rows[: query.limit]
    found = [
        {
            "id": str(r.id),
            "timestamp": iso_millis(r.micros),
            "level": r.level,
            "service": r.service,
            "message": r.message,
            "attributes": json.loads(r.attributes) if r.attributes else {},
        }
        for r in shown
    ]
    more = len(rows) > query.limit
    return {"logs": found, "next_cursor": Cursor(shown[-1].micros, shown[-1].id).encode() if more else None}


def pages(logs: DataFrame, query: LogQuery, days: list[str] | None = None):
    """All pages of a search, one after another."""
    while True:
        page = search(logs, query, days)
        yield page
        if page["next_cursor"] is None:
            return
        query = replace(query, cursor=Cursor.decode(page["next_cursor"]))
