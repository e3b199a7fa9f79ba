"""Dates, durations and millisecond stamps."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError

_SECONDS = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}


def threshold(value: str, name: str = "since", now: datetime | None = None) -> str:
    """The instant that `7d`, `2024-01-31` or an RFC 3339 stamp means, as RFC 3339 in UTC."""
    text = value.strip()
    if not text:
        raise ValidationError(f"{name} must not be empty")
    if m := re.fullmatch(r"([0-9]+)([dhms])", text):
        try:
            at = (now or datetime.now(UTC)) - timedelta(seconds=int(m[1]) * _SECONDS[m[2]])
        except OverflowError as e:
            raise ValidationError(f"invalid {name} duration: {value}") from e
    else:
        try:
            if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(T.+(Z|[+-][0-9]{2}:[0-9]{2}))?", text, re.I):
                raise ValueError
            at = datetime.fromisoformat(text)
        except ValueError as e:
            raise ValidationError(f"invalid {name} value: {value}") from e
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    whole = at.strftime("%Y-%m-%dT%H:%M:%S")
    return whole + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"


def millis_to_rfc3339(col: Column) -> Column:
    """Whole seconds of a millisecond stamp, floored."""
    return F.date_format(F.timestamp_seconds(F.floor(col / 1000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
