"""Time windows, lenient timestamp parsing and epoch arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# fixed values: window aliases in hours
WINDOW_HOURS = {"1h": 1, "24h": 24, "1d": 24, "3d": 72, "7d": 168, "1w": 168, "30d": 720}


def utc(value: datetime | str) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def ts_lit(value: datetime | str) -> Column:
    return F.timestamp_micros(F.lit(int(utc(value).timestamp() * 1_000_000)))


@dataclass(frozen=True)
class TimeWindow:
    """Inclusive time range; an open end is ``None``."""

    since: datetime | None = None
    until: datetime | None = None

    @staticmethod
    def parse(window: str | None = None, frm: str | None = None, to: str | None = None,
              now: datetime | str | None = None) -> "TimeWindow":
        """Absolute bounds win over an alias; anything unreadable means unbounded."""

        def bound(text: str | None) -> datetime | None:
            try:
                return utc(text) if text and "T" in text else None
            except ValueError:
                return None

        if frm or to:
            return TimeWindow(bound(frm), bound(to))
        if window in WINDOW_HOURS and now is not None:
            return TimeWindow(utc(now) - timedelta(hours=WINDOW_HOURS[window]), None)
        return TimeWindow()

    @property
    def unbounded(self) -> bool:
        return self.since is None and self.until is None

    def holds(self, col: Column) -> Column:
        """Predicate for the scan; rows without a time are kept."""
        parts = []
        if self.since is not None:
            parts.append(col >= ts_lit(self.since))
        if self.until is not None:
            parts.append(col <= ts_lit(self.until))
        if not parts:
            return F.lit(True)
        cond = parts[0] if len(parts) == 1 else parts[0] & parts[1]
        return col.isNull() | cond


def in_window(window: TimeWindow | None, col: Column) -> Column:
    return F.lit(True) if window is None else window.holds(col)


def hour_of(col: Column) -> Column:
    return F.date_trunc("hour", col)


def epoch(col: Column) -> Column:
    return F.unix_seconds(col)


def epoch_f(col: Column) -> Column:
    return F.unix_micros(col) / F.lit(1e6)


def parse_ts(text: Column) -> Column:
    """Read the accepted text layouts; naive times are UTC; otherwise null."""
    layouts = [
        "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
        "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
        "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    ]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in layouts])


def snap(seconds: Column, step: int) -> Column:
    """Nearest multiple of ``step``."""
    return F.floor((seconds + F.lit(step // 2)) / F.lit(step)) * F.lit(step)
