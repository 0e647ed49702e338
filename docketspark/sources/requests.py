"""Requests as text parameters, checked on the driver and turned into filters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds and defaults of a log request.
LIMIT, MOST, WINDOW_DAYS = 50, 200, 30
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


def parse_iso(text: str) -> datetime | None:
    """A day or a time in ISO form, if it is a real one; times without a zone are UTC."""
    try:
        t = datetime.fromisoformat(text)
    except (ValueError, TypeError):
        return None
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def positive_int(text: str | None, default: int) -> int:
    """The whole number a text starts with, if it is above 0; else the default."""
    m = re.match(r"\s*\+?(\d+)", text or "")
    return int(m.group(1)) if m and int(m.group(1)) > 0 else default


def hours_to_ms(text: str | None, default_ms: int) -> int:
    """Hours, possibly with a fraction, as whole milliseconds; the default for anything that is no number above 0."""
    m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text or "")
    hours = float(m.group()) if m else 0.0
    return int(hours * 3_600_000) if isfinite(hours) and hours > 0 else default_ms


def parse_window(since: str | None, until: str | None, now: datetime, days: int = WINDOW_DAYS) -> tuple[datetime, datetime]:
    """(from, to); what is missing or no date falls back to the last ``days`` days."""
    to = parse_iso(until) if until else None
    start = parse_iso(since) if since else None
    return start or now - timedelta(days=days), to or now


@dataclass(frozen=True)
class LogRequest:
    event_type: str | None
    actor: str | None
    since: datetime
    until: datetime
    limit: int
    cursor: int | None

    def apply(self, log: DataFrame) -> DataFrame:
        """Newest rows first, after the cursor; ``log``: id, ts (ISO text), actor_user_id, event_type."""
        at = F.col("ts").cast("timestamp")
        df = log.where((at >= F.lit(self.since)) & (at <= F.lit(self.until)))
        for name, value in (("event_type", self.event_type), ("actor_user_id", self.actor)):
            df = df.where(F.col(name) == value) if value is not None else df
        df = df.where(F.col("id") < self.cursor) if self.cursor is not None else df
        return df.orderBy(F.col("id").desc()).limit(self.limit)


def parse_log_request(params: dict[str, str], known_types: set[str], now: datetime) -> LogRequest | str:
    """A request, or the text of its first error.

    event_type must be a known one or 'all', actor_user_id a UUID, since and until real dates (default: the last 30
    days), limit 1 to 200 (default 50), cursor a positive number.
    """
    kind = params.get("event_type")
    if kind not in (None, "all") and kind not in known_types:
        return f"invalid event_type: {kind}"
    actor = params.get("actor_user_id") or None
    if actor and not _UUID.fullmatch(actor):
        return "invalid actor_user_id (not UUID)"
    times = {}
    for name, default in (("since", now - timedelta(days=WINDOW_DAYS)), ("until", now)):
        times[name] = parse_iso(params[name]) if name in params else default
        if times[name] is None:
            return f"invalid {name} (ISO 8601 required)"
    numbers = {}
    for name, default, most, error in (("limit", LIMIT, MOST, f"invalid limit (1-{MOST})"), ("cursor", None, None, "invalid cursor (positive integer)")):
        n = positive_int(params[name], 0) if name in params else default
        if n == 0 or n and most and n > most:
            return error
        numbers[name] = n
    return LogRequest(None if kind == "all" else kind, actor, times["since"], times["until"], numbers["limit"], numbers["cursor"])
