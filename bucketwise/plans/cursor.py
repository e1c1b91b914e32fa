"""Opaque page tokens: the instant and id of the last row that was shown."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from bucketwise.functions.time import EPOCH, iso_micros, parse_instant


@dataclass(frozen=True)
class Cursor:
    micros: int
    id: int

    def encode(self) -> str:
        """base64url without padding over JSON; microseconds, so that no row
        of the same millisecond is skipped."""
        data = json.dumps({"timestamp": iso_micros(self.micros), "id": str(self.id)}, separators=(",", ":"))
        return base64.urlsafe_b64encode(data.encode()).rstrip(b"=").decode()

    @classmethod
    def decode(cls, token: str) -> "Cursor":
        try:
            data = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
            at, number = data["timestamp"], data["id"]
            if not isinstance(at, str) or not isinstance(number, str) or not re.fullmatch(r"[0-9]+", number):
                raise ValueError
            return cls(_any_instant(at), int(number))
        except (ValueError, KeyError, TypeError, binascii.Error, UnicodeDecodeError):
            raise ValueError("invalid cursor") from None


def _any_instant(text: str) -> int:
    """Also dates alone, and times without a zone, which count as UTC."""
    try:
        return parse_instant(text)
    except ValueError:
        at = datetime.fromisoformat(text)
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return (at - EPOCH) // timedelta(microseconds=1)
