"""Which stored grain answers a range: pure functions of parameters."""

from __future__ import annotations

HOUR = 3600


def split(start: int, end: int, width: int = HOUR) -> tuple[tuple[int, int], tuple[int, int], tuple[int, int]]:
    """[start, end) as (head, whole buckets, tail); any of them may be empty (first = last)."""
    first, last = -(-start // width) * width, end // width * width
    if first >= last:
        return (start, end), (start, start), (end, end)
    return (start, first), (first, last), (last, end)


def source_of(width: int, start: int, end: int, raw_since: int, whole_hours: bool) -> str:
    """facts, minutes or hours: what a series of the given bucket width reads. Ranges before the raw horizon need hourly rollups, and so a zone of whole hours."""
    if width >= HOUR and whole_hours:
        return "hours"
    if start < raw_since:
        raise ValueError("only hourly buckets of whole-hour zones reach back so far")
    return "minutes" if end - start <= 86400 and width >= 60 else "facts"
