"""Planning and parsing, without Spark."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from bucketwise.functions.text import like_escaped, number_text
from bucketwise.functions.time import ceil_minute, floor_minute, iso_micros, iso_millis, parse_instant
from bucketwise.model import BUCKETS, MINUTE
from bucketwise.plans.cursor import Cursor
from bucketwise.plans.query import AggregateQuery, LogQuery
from bucketwise.plans.rollup import Part, plan_parts


def at(text):
    return parse_instant(f"2026-08-12T{text}Z")


@pytest.mark.parametrize(
    "since, until, parts",
    [
        ("10:00:00", "10:05:00", [("rollup", "10:00:00", "10:05:00", 1)]),
        ("10:00:10", "10:03:00", [("rollup", "10:00:00", "10:01:00", 1), ("raw", "10:00:00", "10:00:10", -1), ("rollup", "10:01:00", "10:03:00", 1)]),
        ("10:00:40", "10:03:00", [("raw", "10:00:40", "10:01:00", 1), ("rollup", "10:01:00", "10:03:00", 1)]),
        ("10:00:30", "10:03:00", [("raw", "10:00:30", "10:01:00", 1), ("rollup", "10:01:00", "10:03:00", 1)]),
        ("10:01:00", "10:03:20", [("rollup", "10:01:00", "10:03:00", 1), ("raw", "10:03:00", "10:03:20", 1)]),
        ("10:01:00", "10:03:50", [("rollup", "10:01:00", "10:03:00", 1), ("rollup", "10:03:00", "10:04:00", 1), ("raw", "10:03:50", "10:04:00", -1)]),
        ("10:00:20", "10:00:50", [("raw", "10:00:20", "10:00:50", 1)]),
    ],
)
def test_parts(since, until, parts):
    assert plan_parts(at(since), at(until)) == [Part(s, at(a), at(b), n) for s, a, b, n in parts]


@given(st.lists(st.integers(-5 * MINUTE, 5 * MINUTE), max_size=40), st.integers(-5 * MINUTE, 5 * MINUTE), st.integers(1, 6 * MINUTE), st.sampled_from(sorted(BUCKETS)))
def test_parts_count_exactly(rows, since, span, bucket):
    until, size = since + span, BUCKETS[bucket]
    want, got = {}, {}
    for r in rows:
        if since <= r < until:
            want[r // size] = want.get(r // size, 0) + 1
    for p in plan_parts(since, until):
        if p.source == "rollup":
            assert p.start == floor_minute(p.start) and p.end == ceil_minute(p.end)
        for r in rows:
            key = r if p.source == "raw" else floor_minute(r)
            if p.start <= key < p.end:
                got[key // size] = got.get(key // size, 0) + p.sign
    assert want == {k: v for k, v in got.items() if v > 0}
    assert all(v >= 0 for v in got.values())


def test_instants():
    assert parse_instant("1970-01-01T00:00:00Z") == 0
    assert parse_instant("1970-01-01T02:00+02:00") == 0
    assert parse_instant("1970-01-01T00:00:00.123456789Z") == 123456
    assert parse_instant("1969-12-31T23:59:59.5Z") == -500_000
    for bad in ("2026-08-12", "2026-08-12T10:00:00", "not-a-timestamp", "2026-13-01T00:00:00Z", "2026-02-30T00:00:00Z", 5, None):
        with pytest.raises(ValueError):
            parse_instant(bad)
    assert iso_millis(1_234_567) == "1970-01-01T00:00:01.234Z"
    assert parse_instant(iso_micros(-1)) == -1


@given(st.integers(-(10**15), 4 * 10**15), st.integers(0, 2**63 - 1))
def test_cursor_round_trip(micros, number):
    token = Cursor(micros, number).encode()
    assert Cursor.decode(token) == Cursor(micros, number)
    assert not set(token) - set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")


@pytest.mark.parametrize("token", ["", "!!", "e30", "bnVsbA", "eyJ0aW1lc3RhbXAiOiJ4IiwiaWQiOiIxIn0", "eyJ0aW1lc3RhbXAiOiIyMDI2LTA4LTEyVDEwOjAwOjAwWiIsImlkIjoiLTEifQ"])
def test_bad_cursors(token):
    with pytest.raises(ValueError, match="invalid cursor"):
        Cursor.decode(token)


@pytest.mark.parametrize(
    "params, error",
    [
        ({"since": "yesterday"}, "invalid since timestamp"),
        ({"until": "2026-08-12"}, "invalid until timestamp"),
        ({"level": "fatal"}, "invalid level filter"),
        ({"limit": "x"}, "invalid limit"),
        ({"limit": "1.5"}, "invalid limit"),
        ({"limit": "0"}, "limit must be at least 1"),
        ({"limit": "1001"}, "limit must not exceed 1000"),
        ({"cursor": ""}, "invalid cursor"),
        ({"attr.": "1"}, "invalid attribute filter: 'attr.'"),
        ({"attr.k": ["1", "2"]}, "invalid attribute filter: 'attr.k'"),
        ({"since": "2026-08-12T10:00:00Z", "until": "2026-08-12T10:00:00Z"}, "'until' must be greater than 'since'"),
    ],
)
def test_search_parameters(params, error):
    with pytest.raises(ValueError) as e:
        LogQuery.from_params(params)
    assert str(e.value) == error


def test_search_defaults():
    q = LogQuery.from_params({"unknown": ["x"], "service": "", "attr.a.b": "1", "limit": "7", "q": ""})
    assert (q.service, q.limit, q.attributes, q.q) == ("", 7, {"a.b": "1"}, "")
    assert LogQuery.from_params({}).limit == 100
    with pytest.raises(ValueError):
        LogQuery.from_params({"service": ["a", "b"]})


def test_aggregate_parameters():
    good = {"since": "2026-08-12T10:00:00Z", "until": "2026-08-12T11:00:00Z", "bucket": "5m"}
    assert AggregateQuery.from_params(good).rollup_answers
    assert not AggregateQuery.from_params(good | {"q": ""}).rollup_answers
    assert not AggregateQuery.from_params(good | {"attr.k": "1"}).rollup_answers
    for change, error in (
        ({"bucket": "2m"}, "unsupported bucket"),
        ({"group_by": "message"}, "unsupported group_by"),
        ({"since": None}, "invalid since timestamp"),
        ({"until": "x"}, "invalid until timestamp"),
    ):
        with pytest.raises(ValueError, match=error):
            AggregateQuery.from_params(good | change)


@pytest.mark.parametrize(
    "value, text",
    [(1.0, "1"), (1e3, "1000"), (1e7, "10000000"), (1e21, "1" + "0" * 21), (-0.0, "0"), (0.1, "0.1"), (1e-7, "0.0000001"), (1.5, "1.5"), (2**53 + 1, "9007199254740992"), (-1.25e-8, "-0.0000000125")],
)
def test_number_text(value, text):
    assert number_text(value) == text


def test_like_escape():
    assert like_escaped(r"50%_\x") == r"50\%\_\\x"


def test_random_parts_touch_few_raw_rows():
    for _ in range(500):
        since = random.randrange(10**9)
        parts = plan_parts(since, since + random.randrange(2 * MINUTE, 10**9))
        assert sum(p.end - p.start for p in parts if p.source == "raw") <= MINUTE
