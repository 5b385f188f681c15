"""Time series, concurrency, intervals and windows over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from . import selection
from .totals import classified, counts, total

DAY, HOUR = timing.DAY, timing.HOUR


def series(calls: DataFrame, start: int, end: int, width: int, zone: str = "UTC") -> DataFrame:
    """One row per bucket of [start, end): counts, calls in flight, tokens, cost, means and p95 of latencies; empty buckets hold zeros and null latencies."""
    bucket = timing.zone_bucket("epoch", width, zone)
    inside = classified(timing.within(calls, start, end)).withColumn("bucket", bucket)
    v = F.when(F.col("t_ttfb") > 0, F.col("t_ttfb"))
    found = inside.groupBy("bucket").agg(
        *counts(), F.count_if("flying").alias("flying"), F.count(v).alias("ttfb_n"), F.round(F.avg(v), 6).alias("ttfb_mean"),
        F.count("first_token").alias("first_token_n"), F.round(F.avg("first_token"), 6).alias("first_token_mean"),
    )
    p95 = selection.percentiles(inside, ["bucket"], {"ttfb_p95": v}, (0.95,)).select("bucket", F.round(F.col("ttfb_p95")[0], 6).alias("ttfb_p95"))
    found = found.join(p95, "bucket")
    empty = timing.zone_spine(calls.sparkSession, start, end, width, zone)
    zeros = {c: 0 for c in ("n", "success", "failure", "tokens", "cost", "non_success_cost", "flying", "ttfb_n", "first_token_n")}
    return empty.join(found, "bucket", "left").fillna(zeros)


def rebucketed(rollup: DataFrame, width: int, zone: str, sums: list[str]) -> DataFrame:
    """Hourly rollup rows (hour) in wider buckets of a zone that is whole hours from UTC."""
    return rollup.groupBy(timing.zone_bucket("hour", width, zone).alias("bucket")).agg(*(F.sum(c).alias(c) for c in sums))


def days_in_zones(hours: DataFrame, zones: tuple[str, ...], other: str) -> DataFrame:
    """zone, used, bucket, n: hourly counts (hour, n) by local day of each zone; where a zone isn't whole hours from UTC at any of the hours, of `other`."""
    named = hours.sparkSession.createDataFrame([(z,) for z in zones], "zone string")
    offset = lambda zone: F.unix_seconds(F.convert_timezone(F.lit("UTC"), zone, F.timestamp_seconds("hour").cast("timestamp_ntz")).cast("timestamp")) - F.unix_seconds(F.timestamp_seconds("hour").cast("timestamp_ntz").cast("timestamp"))
    rows = hours.join(F.broadcast(named))  # a few zones
    fit = rows.groupBy("zone").agg(F.every(offset(F.col("zone")) % HOUR == 0).alias("whole"))
    met = rows.join(F.broadcast(fit), "zone").withColumn("used", F.when(F.col("whole"), F.col("zone")).otherwise(other)).withColumn("__o", offset(F.col("used")))
    return met.groupBy("zone", "used", (F.col("hour") - F.pmod(F.col("hour") + F.col("__o"), F.lit(DAY))).alias("bucket")).agg(F.sum("n").alias("n"))


def concurrency(calls: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """Distinct conversations of every complete bucket, zeros included."""
    inside = timing.within(calls, start, end).where(F.col("conversation").isNotNull())
    found = inside.groupBy(timing.floor_to(F.col("epoch"), width, start).alias("bucket")).agg(F.countDistinct("conversation").alias("conversations"))
    return timing.spine(calls.sparkSession, start, end - (end - start) % width, width).join(found, "bucket", "left").fillna(0)


def concurrency_summary(rows: DataFrame) -> DataFrame:
    active = F.when(F.col("conversations") > 0, F.col("conversations"))
    return rows.agg(F.min("conversations").alias("least"), F.max("conversations").alias("most"), F.count(active).alias("active"), F.round(F.avg(active), 9).alias("active_mean"))


def distinct_minutes(calls: DataFrame, *keys: str) -> DataFrame:
    """Two stages: distinct conversations of each minute, then their sum and the active minutes of each hour."""
    minute = calls.where("conversation is not null").groupBy(*keys, timing.floor_to(F.col("epoch"), 60).alias("minute")).agg(F.countDistinct("conversation").alias("conversations"))
    return minute.groupBy(*keys, timing.floor_to(F.col("minute"), HOUR).alias("hour")).agg(F.sum("conversations").alias("conversation_minutes"), F.count("*").alias("active_minutes"), F.max("conversations").alias("most"))


def spans(calls: DataFrame, start: int, end: int, top: int = 80) -> DataFrame:
    """First and last call of the conversations of a range, the latest active ones first."""
    inside = timing.within(calls, start, end).where(F.col("conversation").isNotNull())
    found = inside.groupBy("conversation").agg(F.min("epoch").alias("first_seen"), F.max("epoch").alias("last_seen"), F.count("*").alias("n"))
    return found.orderBy(F.desc("last_seen"), F.desc("n"), "conversation").limit(top)


def hour_slices(calls: DataFrame, ms: str = "t_long", width: int = HOUR) -> DataFrame:
    """Calls as intervals in milliseconds, cut at bucket borders, so that no group of the union is wider than a bucket.

    The call counts in the bucket of its start (`starts`); every bucket that it touches has a slice of it.
    """
    whole = calls.where(F.col(ms).isNotNull()).withColumns({"a": F.col("epoch") * 1000, "z": F.col("epoch") * 1000 + F.floor(ms)})
    w = width * 1000
    cut = whole.withColumn("bucket", F.explode(F.expr(f"sequence(a div {w}, greatest(a, z - 1) div {w})")))
    return cut.select("*", F.greatest("a", F.col("bucket") * w).alias("begin"), F.least("z", (F.col("bucket") + 1) * w).alias("finish"), (F.col("bucket") == F.expr(f"a div {w}")).alias("starts")).withColumn("bucket", F.col("bucket") * width)


def wall_time(slices: DataFrame, *keys: str) -> DataFrame:
    """Length of the union of intervals of each group, touching ones merged; and their sum, the number of slices, and of calls that start there."""
    order = Window.partitionBy(*keys).orderBy("begin", "finish")
    reach = F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = slices.withColumn("reach", reach).withColumn("gain", F.greatest(F.col("finish") - F.greatest("begin", F.coalesce("reach", "begin")), F.lit(0)))
    return new.groupBy(*keys).agg(F.sum("gain").alias("wall_ms"), F.sum(F.col("finish") - F.col("begin")).alias("sum_ms"), F.count("*").alias("slices"), F.count_if("starts").alias("calls"))


def segments(slices: DataFrame, *keys: str) -> DataFrame:
    """The merged segments (begin, finish) of each group: a mergeable partial of wall time, as unions of unions are unions."""
    order = Window.partitionBy(*keys).orderBy("begin", "finish")
    reach = F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") <= F.col("reach"), 0).otherwise(1)).over(order)
    marked = slices.withColumn("reach", reach).withColumn("island", island)
    merged = marked.groupBy(*keys, "island").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish"), F.count_if("starts").alias("calls"))
    return merged.drop("island")


def rolling_minute(calls: DataFrame) -> DataFrame:
    """For every second with calls of an account, the sums of the last 60 seconds. Windows are taken by account and hour, so that no account is one task."""
    seconds = calls.where("account is not null").groupBy("account", "epoch").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("n"))
    last = Window.partitionBy("account", "cut").orderBy("epoch").rangeBetween(-59, 0)
    sums = timing.with_margin(seconds, HOUR, 59).select("account", "epoch", "own", F.sum("tokens").over(last).alias("tokens_60s"), F.sum("n").over(last).alias("calls_60s"))
    return sums.where("own").drop("own")


def last_seconds(calls: DataFrame, now: int, number: int = 300) -> DataFrame:
    """One row per second before now; available from the first second that was seen."""
    inside = timing.within(calls, now - number, now)
    found = inside.groupBy(F.col("epoch").alias("second")).agg((F.sum("input_tokens") * 4).alias("bytes"))
    first = found.agg(F.min("second").alias("first"))
    return timing.spine(calls.sparkSession, now - number, now, 1).withColumnRenamed("bucket", "second").join(found, "second", "left").join(F.broadcast(first)).select(
        "second", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce(F.col("second") >= F.col("first"), F.lit(False)).alias("available")
    )


def running_day(calls: DataFrame, day: int, now: int, width: int = 600) -> DataFrame:
    """Running tokens and cost of one day; buckets after now are null."""
    found = timing.within(calls, day, min(day + DAY, now)).groupBy(timing.floor_to(F.col("epoch"), width, day).alias("bucket")).agg(F.sum("total_tokens").alias("tokens"), F.sum("cost").alias("cost"))
    rows = timing.spine(calls.sparkSession, day, day + DAY, width).join(found, "bucket", "left").fillna(0)
    order = Window.partitionBy(F.lit(day)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most a day of buckets
    past = lambda c: F.when(F.col("bucket") < now, c)
    return rows.select("bucket", past(F.sum("tokens").over(order)).alias("tokens"), past(F.round(F.sum("cost").over(order), 10)).alias("cost"))


def calendar(calls: DataFrame, levels: int = 4, zone: str = "UTC") -> DataFrame:
    """Calls of each local day and a level 0 to `levels` of the largest day."""
    days = calls.groupBy(timing.local_date("epoch", zone).alias("day")).agg(F.count("*").alias("n"))
    most = days.agg(F.max("n").alias("most"))
    return days.join(F.broadcast(most)).select(F.col("day").cast("string").alias("day"), "n", F.least(F.ceil(F.col("n") * levels / F.col("most")), F.lit(levels)).cast("int").alias("level"))


def heatmap(calls: DataFrame, start: int, end: int) -> DataFrame:
    """Calls of each weekday and hour, and levels at 0.25, 0.55 and 0.85 of the largest cell."""
    inside = timing.within(calls, start, end)
    cells = inside.groupBy(((F.floor(F.col("epoch") / DAY) + 3) % 7).alias("weekday"), F.floor(F.col("epoch") % DAY / HOUR).alias("hour")).agg(F.count("*").alias("n"))
    most = cells.agg(F.max("n").alias("most"))
    share = F.col("n") / F.col("most")
    return cells.join(F.broadcast(most)).select("weekday", "hour", "n", F.when(share >= 0.85, 4).when(share >= 0.55, 3).when(share >= 0.25, 2).when(F.col("n") > 0, 1).otherwise(0).alias("level"))


def same_progress(calls: DataFrame, day: int, now: int) -> DataFrame:
    """Totals of a day so far, and of the day before up to the same time of day."""
    elapsed = now - day
    part = lambda name, start: timing.within(calls, start, start + elapsed).agg(F.count("*").alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), total(F.col("cost")).alias("cost")).withColumn("part", F.lit(name))
    return part("now", day).unionByName(part("before", day - DAY))


def long_term(calls: DataFrame, success: Column, grain: str = "day") -> DataFrame:
    """Every call in three dimensions (overall, model and effort, upstream), by day or hour: calls, tokens of non-null samples, timings of successes; speed is a ratio of sums."""
    dims = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("series")), F.struct(F.lit("model").alias("dimension"), F.concat_ws("/", "model", F.coalesce("effort", F.lit("unspecified"))).alias("series")), F.struct(F.lit("upstream").alias("dimension"), F.coalesce(F.concat(F.lit("account:"), F.col("account").cast("string")), F.lit("other")).alias("series")))
    rows = calls.withColumn("good", success).withColumn("d", F.explode(dims)).select("*", "d.*")
    stream = F.when(F.col("good") & (F.col("t_stream") > 0), F.col("t_stream"))
    return rows.groupBy("dimension", "series", F.floor(F.col("epoch") / {"day": DAY, "hour": HOUR}[grain]).alias(grain)).agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.count(F.when(F.col("good"), F.col("t_total"))).alias("timed"), F.round(F.avg(F.when(F.col("good"), F.col("t_total"))), 6).alias("mean_ms"),
        F.round(F.sum(F.when(stream.isNotNull(), F.col("output_tokens"))) / (F.sum(stream) / 1000), 6).alias("tokens_per_second"),
    )
