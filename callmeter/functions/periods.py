"""Period filters typed by people: `7d`, `24h`, `2w`, or an ISO date (without a zone: UTC)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_UNITS = {"h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}


def since_us(spec: str | None, now: datetime | None = None) -> int | None:
    """Start of the period in microseconds since 1970, or None for all history."""
    if not spec:
        return None
    relative = re.fullmatch(r"(\d+)([hdw])", spec)
    if relative:
        moment = (now or datetime.now(timezone.utc)) - int(relative[1]) * _UNITS[relative[2]]
    else:
        try:
            moment = datetime.fromisoformat(spec)
        except ValueError:
            raise ValueError(f"can't read the period {spec!r}: use 7d, 24h, 2w or a date like 2026-09-01") from None
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp()) * 1_000_000
