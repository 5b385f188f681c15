"""Streaming forms of the rollups and live sets. Each has a batch twin whose result it must equal.

Streams are read from files of calls with a timestamp `at`; state is bounded by watermarks, and what comes later than that is repaired by `rebuilt`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records, series, totals


def read_calls(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the calls that arrive as Parquet files below path."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def by_batch(stream: DataFrame, path: str, checkpoint: str, part=lambda batch: batch, mode: str = "append"):
    """Writes `part` of every batch below path, one folder per batch id, so that a batch done again replaces what it wrote; ends once all that is there is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Of the rows that batches in update mode have written, the last of each key."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__last")).select(*keys, "__last.*")


def hourly_rollup(stream: DataFrame, path: str, checkpoint: str):
    """H1: the partial rollup of every batch."""
    return by_batch(stream, path, checkpoint, lambda batch: totals.totals(batch, totals.hour(), "source"))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The rollup of all batches so far."""
    return totals.merged([spark.read.parquet(path)], ["hour", "source"], sums=["n", "success", "failure", "tokens", "cost", "non_success_cost"])


def segment_rollup(stream: DataFrame, path: str, checkpoint: str):
    """H13: the merged interval segments of every batch by account and hour."""
    return by_batch(stream, path, checkpoint, lambda batch: series.segments(series.hour_slices(batch), "account", "bucket"))


def read_wall_time(spark: SparkSession, path: str) -> DataFrame:
    """Wall time and calls of each account and hour over the segments of all batches."""
    rows = spark.read.parquet(path)
    wall = series.wall_time(rows.withColumn("starts", F.lit(False)), "account", "bucket").select("account", "bucket", "wall_ms")
    calls = rows.groupBy("account", "bucket").agg(F.sum("calls").alias("calls")).toDF("a", "b", "calls")
    return wall.join(calls, wall["account"].eqNullSafe(calls["a"]) & (wall["bucket"] == calls["b"])).select("account", "bucket", "wall_ms", "calls")


def rebuilt(old: DataFrame, calls: DataFrame, dirty: DataFrame) -> DataFrame:
    """H2: old hourly rows, but for dirty hours (hour), which are computed anew from all calls."""
    touched = calls.join(dirty, F.expr("epoch div 3600 * 3600") == dirty["hour"], "left_semi")
    return old.join(dirty, "hour", "left_anti").unionByName(totals.totals(touched, totals.hour(), "source"))


def minute_series(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """H3: calls and tokens of each minute, a call that arrives twice counted once."""
    once = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("at", "1 minute")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")).select(F.unix_seconds("window.start").alias("minute"), "n", "tokens")


def sliding_activity(stream: DataFrame, late: str = "10 minutes", step: str = "30 seconds") -> DataFrame:
    """H6: calls and tokens of an account in windows of 60 seconds."""
    rows = stream.withWatermark("at", late).where("account is not null")
    return rows.groupBy("account", F.window("at", "60 seconds", step)).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")).select("account", F.unix_seconds("window.start").alias("start"), "n", "tokens")


def observed(calls: DataFrame) -> DataFrame:
    """Calls that have ended, with the time `at` at which that is seen: their start and whole seconds of duration."""
    ended = F.col("epoch") + F.floor(F.coalesce("t_total", F.lit(0.0)) / 1000)
    return calls.where("status not in ('running', 'pending')").withColumn("at", F.timestamp_seconds(ended))


def network_minutes(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """H7: bytes of each minute in three scopes: all, source and account."""
    rows = _scoped(stream.withWatermark("at", late))
    return rows.groupBy("scope", F.window("at", "1 minute")).agg((F.sum("input_tokens") * 4).alias("bytes")).select("scope", F.unix_seconds("window.start").alias("minute"), "bytes")


def _scoped(rows: DataFrame) -> DataFrame:
    scopes = F.array(F.lit("global"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("account:"), F.col("account").cast("string")))
    return rows.withColumn("scope", F.explode(F.array_compact(scopes)))


#: Seconds of the grains of the live network.
GRAINS = {"second": 1, "minute": 60, "five_minutes": 300}


def network_rollup(stream: DataFrame, path: str, checkpoint: str):
    """H7: partial bytes of every batch by scope, grain and start. Sums of sums are sums, so no state is held."""

    def part(batch: DataFrame) -> DataFrame:
        grains = F.array(*(F.struct(F.lit(name).alias("grain"), F.lit(width).alias("width")) for name, width in GRAINS.items()))
        rows = _scoped(batch).withColumn("g", F.explode(grains))
        return rows.groupBy("scope", "g.grain", F.expr("epoch div g.width * g.width").alias("start")).agg((F.sum("input_tokens") * 4).alias("bytes"))

    return by_batch(stream, path, checkpoint, part)


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Bytes by scope, grain and start over all batches; the last bucket of five minutes is still open."""
    found = spark.read.parquet(path).groupBy("scope", "grain", "start").agg(F.sum("bytes").alias("bytes"))
    last = found.groupBy("grain").agg(F.max("start").alias("last"))
    return found.join(F.broadcast(last), "grain").withColumn("open", (F.col("grain") == "five_minutes") & (F.col("start") == F.col("last"))).drop("last")


def route_health(calls: DataFrame, least: int = 5, apart: int = 30, first: int = 15, most: int = 60) -> DataFrame:
    """H9: state of each (account, model) after each attempt: a streak of failures cools a route down for 15 * 2^k seconds, at most 60; success resets.

    Failures since a success are an island, known by the id of that success. From its `least`-th row on an island cools with each row, so its state is known; only
    the first rows are looked at together, and limits inside the tasks leave no more of them than that before they meet.
    """
    key = ["account", "model"]
    rows = calls.where("account is not null").select("id", *key, "epoch", (F.col("event_type") == "error").alias("failed"))
    islands = records.last_before(rows, key, "epoch", ["id"], F.when(~F.col("failed"), F.col("id")), "island").where("failed")
    order = Window.partitionBy(*key, "island").orderBy("epoch", "id")
    early = islands.withColumn("streak", F.row_number().over(order)).where(F.col("streak") < least)
    far = F.coalesce(F.col("epoch") - F.lag("epoch").over(order) > apart, F.lit(True))
    parts = early.withColumn("part", F.sum(far.cast("int")).over(order))
    began = F.min("epoch").over(Window.partitionBy(*key, "island", "part"))
    cooled = parts.withColumn("cools", F.col("epoch") - began >= apart).withColumn("level", F.sum(F.col("cools").cast("int")).over(order))
    wait = F.least(F.lit(first) * F.pow(F.lit(2), F.col("level") - 1), F.lit(most))
    until = F.last(F.when(F.col("cools"), F.col("epoch") + wait), True).over(order)
    state = F.when(until > F.col("epoch"), "cooling_down").when(F.col("level") > 0, "degraded").otherwise("healthy")
    known = cooled.select(F.col("id").alias("early"), state.alias("state"))
    late = F.when(F.col("failed"), "cooling_down").otherwise("healthy")
    return rows.join(known, F.col("id") == F.col("early"), "left").select("id", F.coalesce("state", late).alias("state"))


def in_progress(stream: DataFrame, keep_ms: int = 86_400_000) -> DataFrame:
    """H4: for each conversation the calls that are running, and how many of them followed a failure, as state that outlives batches.

    A terminal row of an id ends it, and says whether the next call is a retry. A conversation that is silent for `keep_ms` of event time is forgotten.
    """

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        ids, retried, failed, seen = state.get if state.exists else ([], [], False, 0)
        running = dict(zip(ids, retried, strict=True))
        rows = pd.concat(list(batches)).sort_values("id")
        for i, flying, bad in zip(rows["id"], rows["flying"], rows["bad"], strict=True):
            if flying:
                running[int(i)] = bool(failed)
            else:
                running.pop(int(i), None)
                failed = bool(bad)
        seen = max(seen, int(rows["at"].max().timestamp() * 1000))
        state.update((list(running), list(running.values()), failed, seen))
        state.setTimeoutTimestamp(max(seen + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"conversation": [key[0]], "running": [len(running)], "retried": [sum(running.values())]})

    rows = totals.classified(stream.withWatermark("at", "10 minutes").where("conversation is not null")).select("conversation", "id", "at", "flying", (F.col("class") != "none").alias("bad"))
    state = "ids array<long>, retried array<boolean>, failed boolean, seen long"
    return rows.groupBy("conversation").applyInPandasWithState(step, "conversation string, running long, retried long", state, "update", "EventTimeTimeout")


def changed(snapshots: DataFrame, value: str) -> DataFrame:
    """H15: snapshots whose value differs from the one before, by day-sized groups with the last of the day before as seed."""
    from pyspark.sql import Window

    day = snapshots.withColumn("day", F.floor(F.col("captured") / 86400))
    days = day.groupBy("day").agg(F.max_by(value, F.struct("captured", "id")).alias("last"))
    before = days.withColumn("seed", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("day"))).select("day", "seed")  # one row per day
    own = F.lag(value).over(Window.partitionBy("day").orderBy("captured", "id"))
    rows = day.join(F.broadcast(before), "day").withColumn("previous", F.coalesce(own, "seed"))
    return rows.where(F.col("previous").isNull() | (F.col("previous") != F.col(value)))
