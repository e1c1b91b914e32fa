"""Queries as plain values, and their parsing from request parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from bucketwise.functions.time import parse_instant
from bucketwise.model import BUCKETS, GROUPS, LEVELS
from bucketwise.plans.cursor import Cursor

DEFAULT_LIMIT, LEAST_LIMIT, MOST_LIMIT = 100, 1, 1000


@dataclass(frozen=True)
class LogQuery:
    """A conjunction of filters, newest first, ``limit`` rows a page; instants
    in microseconds since the epoch, ``since`` inclusive, ``until`` exclusive."""

    service: str | None = None
    level: str | None = None
    since: int | None = None
    until: int | None = None
    q: str | None = None
    limit: int = DEFAULT_LIMIT
    cursor: Cursor | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_params(cls, params: Mapping[str, object]) -> "LogQuery":
        """Unknown parameters are ignored; ValueError names the first invalid one."""
        found = _Params(params)
        out = cls(
            service=found.text("service"),
            level=found.choice("level", LEVELS, "invalid level filter"),
            since=found.instant("since"),
            until=found.instant("until"),
            q=found.text("q"),
            limit=found.limit(),
            cursor=found.cursor(),
            attributes=found.attributes,
        )
        _check_range(out.since, out.until)
        return out


@dataclass(frozen=True)
class AggregateQuery:
    """Counts per time bucket, optionally per ``group_by``, over [since, until)."""

    since: int
    until: int
    bucket: str
    group_by: str | None = None
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.bucket not in BUCKETS:
            raise ValueError("unsupported bucket")
        if self.group_by is not None and self.group_by not in GROUPS:
            raise ValueError("unsupported group_by")

    @classmethod
    def from_params(cls, params: Mapping[str, object]) -> "AggregateQuery":
        found = _Params(params)
        out = cls(
            since=found.instant("since", required=True),
            until=found.instant("until", required=True),
            bucket=found.choice("bucket", tuple(BUCKETS), "unsupported bucket", required=True),
            group_by=found.choice("group_by", GROUPS, "unsupported group_by"),
            service=found.text("service"),
            level=found.choice("level", LEVELS, "invalid level filter"),
            q=found.text("q"),
            attributes=found.attributes,
        )
        _check_range(out.since, out.until)
        return out

    @property
    def rollup_answers(self) -> bool:
        """Whether minute rollups hold all that the filters ask for."""
        return self.q is None and not self.attributes


def _check_range(since: int | None, until: int | None) -> None:
    if since is not None and until is not None and until <= since:
        raise ValueError("'until' must be greater than 'since'")


class _Params:
    def __init__(self, params: Mapping[str, object]):
        self.params = params
        self.attributes: dict[str, str] = {}
        for name, value in params.items():
            if name.startswith("attr."):
                key = name[len("attr.") :]
                if not key or not isinstance(value, str):
                    raise ValueError(f"invalid attribute filter: '{name}'")
                self.attributes[key] = value

    def text(self, name: str) -> str | None:
        value = self.params.get(name)
        if value is not None and not isinstance(value, str):
            raise ValueError(f"invalid {name} filter")
        return value

    def choice(self, name: str, known: tuple[str, ...], error: str, required: bool = False) -> str | None:
        value = self.params.get(name)
        if value is None and not required:
            return None
        if not isinstance(value, str) or value not in known:
            raise ValueError(error)
        return value

    def instant(self, name: str, required: bool = False) -> int | None:
        value = self.params.get(name)
        if value is None and not required:
            return None
        try:
            return parse_instant(value)
        except ValueError:
            raise ValueError(f"invalid {name} timestamp") from None

    def limit(self) -> int:
        value = self.params.get("limit", DEFAULT_LIMIT)
        try:
            if isinstance(value, (list, tuple, dict)) or value is None:
                raise ValueError
            number = float(value.strip() or 0) if isinstance(value, str) else float(value)
            if number != int(number):
                raise ValueError
        except (ValueError, TypeError, OverflowError):
            raise ValueError("invalid limit") from None
        if number < LEAST_LIMIT:
            raise ValueError("limit must be at least 1")
        if number > MOST_LIMIT:
            raise ValueError("limit must not exceed 1000")
        return int(number)

    def cursor(self) -> Cursor | None:
        value = self.params.get("cursor")
        if value is None:
            return None
        if not isinstance(value, str) or not value:
            raise ValueError("invalid cursor")
        return Cursor.decode(value)
