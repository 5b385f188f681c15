"""Time buckets, ranges and durations. Instants are whole epoch seconds (UTC); a zone's clock is read by convert_timezone, never by the session's."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, HOUR = 86400, 3600
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
MOST_BUCKETS = 10_000


def floor_to(epoch: Column, width: int, offset: int = 0) -> Column:
    """The start of the fixed-width bucket that holds an instant."""
    return (F.floor((epoch - offset) / width) * width + offset).cast("long")


def instant(epoch: int) -> Column:
    """An instant as a timestamp without zone, as calls store it."""
    return F.expr(f"TIMESTAMP_NTZ '{datetime.fromtimestamp(epoch, timezone.utc):%Y-%m-%d %H:%M:%S}'")


def within(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of [start, end). Where they have the stored time, the bounds are on that, so that a scan can skip what lies outside."""
    stored = "occurred_at" in rows.columns
    at, bound = (F.col("occurred_at"), instant) if stored else (F.col("epoch"), F.lit)
    rows = rows.where(at >= bound(start)) if start is not None else rows
    return rows.where(at < bound(end)) if end is not None else rows


def with_margin(rows: DataFrame, width: int, margin: int) -> DataFrame:
    """rows in cuts of `width` seconds (cut), those of the last `margin` seconds of a cut in the next one, too (own is false there).

    A window over the last `margin` seconds of a hot key can so be taken by key and cut.
    """
    cut, late = F.expr(f"epoch div {width}"), F.expr(f"pmod(epoch, {width}) >= {width - margin}")
    both = F.array(F.struct(cut.alias("cut"), F.lit(True).alias("own")), F.when(late, F.struct((cut + 1).alias("cut"), F.lit(False).alias("own"))))
    return rows.select("*", F.explode(F.array_compact(both)).alias("__cut")).select(*rows.columns, "__cut.cut", "__cut.own")


def clock(epoch: str, zone: str) -> str:
    """SQL: the wall clock of a zone at an instant, as a timestamp without zone."""
    return f"convert_timezone('UTC', '{zone}', timestampadd(SECOND, {epoch}, {_EPOCH}))"


def zone_offset(epoch: str, zone: str) -> str:
    """SQL: seconds that the zone's clock is ahead of UTC."""
    return f"(timestampdiff(SECOND, {_EPOCH}, {clock(epoch, zone)}) - {epoch})"


def zone_bucket(epoch: str, width: int, zone: str) -> Column:
    """The start of the bucket, counted from local midnight. Where clocks go back, an instant keeps to its own side of the overlap."""
    local = f"({epoch} + {zone_offset(epoch, zone)})"
    return F.expr(f"{epoch} - pmod(pmod({local}, {DAY}), {width})")


def local_date(epoch: str, zone: str) -> Column:
    return F.expr(f"cast({clock(epoch, zone)} as date)")


def valid_ms(c: Column) -> Column:
    """A duration that is a finite number of at least zero, else null."""
    return F.when(~F.isnan(c) & (c >= 0) & (c < float("inf")), c)


def first_byte_total(read: Column, parse: Column, connect: Column, ttfb: Column) -> Column:
    """Request to first byte: only where the first byte took time and all four phases are valid."""
    return F.when(ttfb > 0, valid_ms(read) + valid_ms(parse) + valid_ms(connect) + valid_ms(ttfb))


def mixed_time(text: Column, zone: str = "Asia/Shanghai") -> Column:
    """The instant (timestamp) of a text: with an offset it is what it says, without one it is a clock of the zone; unreadable texts are null."""
    stamped = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    naive = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.when(stamped, F.try_to_timestamp(text)).otherwise(naive.cast("timestamp"))


def duration(spec: str) -> int:
    """Seconds of 30m, 24h, 7d or 1mo (a month has 30 days)."""
    found = re.fullmatch(r"(\d+)(mo|m|h|d)", spec.strip())
    if not found:
        raise ValueError(f"unknown duration {spec!r}")
    return int(found[1]) * {"m": 60, "h": HOUR, "d": DAY, "mo": 30 * DAY}[found[2]]


def local_midnight(day, zone: str) -> int:
    """The first instant of a local date: where clocks skip midnight, the first minute there is; where they go back, the first of the two."""
    tz = ZoneInfo(zone)
    for minute in range(0, 24 * 60):
        local = datetime(day.year, day.month, day.day, tzinfo=tz) + timedelta(minutes=minute)
        instant = local.replace(fold=0).astimezone(timezone.utc)
        if instant.astimezone(tz).replace(tzinfo=None) == local.replace(tzinfo=None):
            return int(instant.timestamp())
    raise ValueError(f"{day} does not exist in {zone}")


def named_range(name: str, now: int, zone: str) -> tuple[int, int]:
    """[start, end) of today, yesterday, thisWeek (from Monday), thisMonth or previous7d, or of a duration back from now; the end is at most now."""
    today = datetime.fromtimestamp(now, ZoneInfo(zone)).date()
    back = lambda days: local_midnight(today - timedelta(days=days), zone)
    match name:
        case "today":
            return back(0), now
        case "yesterday":
            return back(1), min(back(0), now)
        case "thisWeek":
            return back(today.weekday()), now
        case "thisMonth":
            return local_midnight(today.replace(day=1), zone), now
        case "previous7d":
            return back(7), min(back(0), now)
    return now - duration(name), now


def bucket_width(start: int, end: int, spec: str | None = None) -> int:
    """Seconds of a bucket: of a spec (1m to 1d), or by the length of the range. More than MOST_BUCKETS buckets are refused."""
    length = end - start
    width = duration(spec) if spec else 60 if length <= HOUR else 1800 if length <= 2 * DAY else HOUR if length <= 30 * DAY else DAY
    if not 60 <= width <= DAY or length > MOST_BUCKETS * width:
        raise ValueError(f"bucket of {width} s over {length} s")
    return width


def whole_hours(start: int, end: int, zone: str) -> bool:
    """Whether the zone is whole hours from UTC over a range."""
    return all(datetime.fromtimestamp(t, ZoneInfo(zone)).utcoffset().total_seconds() % HOUR == 0 for t in [*range(start, end, DAY), end])


def spine(spark: SparkSession, start: int, end: int, width: int) -> DataFrame:
    """bucket: every bucket start in [start, end); bounded by MOST_BUCKETS."""
    if (end - start) > MOST_BUCKETS * width:
        raise ValueError("too many buckets")
    return spark.range(start, end, width).withColumnRenamed("id", "bucket")


def zone_spine(spark: SparkSession, start: int, end: int, width: int, zone: str) -> DataFrame:
    """bucket: the starts of all zone buckets that [start, end) touches."""
    steps = spark.range(start, end, min(width, HOUR)).withColumnRenamed("id", "epoch").union(spark.createDataFrame([(end - 1,)], "epoch long"))
    return steps.select(zone_bucket("epoch", width, zone).alias("bucket")).distinct()
