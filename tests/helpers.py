"""Small hand-written tables and plain row lists."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def rows(df, *names: str) -> list[tuple]:
    """All rows as sorted tuples of the named columns."""
    picked = df.select(*(names or df.columns)).collect()
    return sorted((tuple(row) for row in picked), key=repr)


def same(a, b) -> bool:
    return rows(a, *sorted(a.columns)) == rows(b, *sorted(b.columns))


def seconds(moment) -> float | None:
    """Seconds since START of a collected (session-zone UTC, naive) timestamp."""
    if moment is None:
        return None
    return (moment.replace(tzinfo=timezone.utc) - START).total_seconds()
