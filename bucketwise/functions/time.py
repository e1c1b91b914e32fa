"""Time: bucketing from the epoch, instants in microseconds, ISO 8601."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketwise.model import BUCKETS, MINUTE

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_WINDOWS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}

#: Date and time with a zone; seconds are optional, a zone is not.
ISO_8601 = (
    r"(\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))T((?:[01]\d|2[0-3]):[0-5]\d)"
    r"(?::([0-5]\d)(?:\.(\d+))?)?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)"
)
_ISO = re.compile(ISO_8601, re.ASCII)


def parse_instant(text: str) -> int:
    """Microseconds since the epoch; ValueError if ``text`` is not ISO 8601 with a zone."""
    m = _ISO.fullmatch(text) if isinstance(text, str) else None
    if not m:
        raise ValueError(f"not a timestamp: {text!r}")
    day, minute, second, fraction, zone = m.groups()
    at = datetime.fromisoformat(f"{day}T{minute}:{second or '00'}").replace(tzinfo=timezone.utc)
    micros = (at - EPOCH) // timedelta(microseconds=1) + int(((fraction or "") + "000000")[:6])
    if zone != "Z":
        shift = int(zone[1:3]) * 60 + int(zone[4:6])
        micros -= (1 if zone[0] == "+" else -1) * shift * MINUTE
    return micros


def instant_column(text: Column) -> Column:
    """The same for a column: a timestamp, or null where it is not one."""
    whole = F.regexp_replace(text, r"T(\d\d:\d\d)([Z+-])", "T$1:00$2")  # only where seconds are missing
    parsed = F.coalesce(text.try_cast("timestamp"), whole.try_cast("timestamp"))
    return F.when(text.rlike(rf"\A{ISO_8601}\z"), parsed)


def iso_millis(micros: int) -> str:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ``; digits beyond milliseconds are cut."""
    at = EPOCH + timedelta(microseconds=micros // 1000 * 1000)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def iso_micros(micros: int) -> str:
    return (EPOCH + timedelta(microseconds=micros)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def iso_column(ts: Column) -> Column:
    """Timestamps as the API shows them (the session is in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def floor_minute(micros: int) -> int:
    return micros // MINUTE * MINUTE


def ceil_minute(micros: int) -> int:
    return -(-micros // MINUTE) * MINUTE


def utc_day(micros: int) -> date:
    return (EPOCH + timedelta(microseconds=micros)).date()


def bucket_start(ts: Column, bucket: str) -> Column:
    """Start of the epoch-anchored bucket; keeps the kind of timestamp and
    floors before the epoch too."""
    if bucket not in BUCKETS:
        raise ValueError("unsupported bucket")
    return F.window(ts, _WINDOWS[bucket]).start


def instant(df: DataFrame, column: str, micros: int) -> Column:
    """A literal of the type of ``df[column]``, so that comparisons reach the scan."""
    text = iso_micros(micros)[:-1].replace("T", " ")
    kind = df.schema[column].dataType.simpleString()
    return F.lit(text).cast("timestamp_ntz") if kind == "timestamp_ntz" else F.lit(text + "+00:00").cast("timestamp")
