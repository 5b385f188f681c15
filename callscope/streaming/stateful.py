"""Live projections with keyed state and timers: rows that come again rebuild their minute, retractions leave their window, and what is open is shown.

Both keep their state in RocksDB, key by key, and let an event-time timer drop it when nothing can change it any more. They write what has changed with
each batch (update mode); the last row of a key counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import timing

#: Seconds of a stretch of minutes that are one key, and calls of a part of it, so that a busy one is several tasks'; seconds of a sliding window and of a cut of an account's time.
STRETCH, PART, SLIDE, CUT = 3600, 16_384, 60, 600
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Settings that a session for streams takes over.
KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def session(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful streams, so that the caller's settings stay as they are."""
    own = spark.newSession()
    for name in KEPT:
        value = spark.conf.get(name, None)
        if value is not None:
            own.conf.set(name, value)
    own.conf.set(*STORE)
    return own


class _Minutes(StatefulProcessor):
    """The calls of a part of a stretch of minutes: one that comes again in its minute takes the place of what it was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getValueState("sums", "own binary, ids binary, tokens binary")  # what the sums are made of, read and written at once

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["own", "id", "tokens"]
        new = pd.concat([frame[names] for frame in rows])
        if known := self.calls.exists():
            held = pd.DataFrame({name: np.frombuffer(x, np.int64) for name, x in zip(names, self.calls.get(), strict=True)})
        calls = (pd.concat([held, new]) if known else new).drop_duplicates(["own", "id"], keep="last")
        self.calls.update(tuple(calls[name].to_numpy(np.int64).tobytes() for name in names))
        if not known:
            self.handle.registerTimer(max((key[0] + STRETCH) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        sums = calls[calls["own"].isin(new["own"].unique())].groupby("own")["tokens"].agg(["size", "sum"])
        yield pd.DataFrame({"minute": sums.index, "shard": key[1], "n": sums["size"].to_numpy(), "tokens": sums["sum"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.calls.clear()
        return iter([])

    def close(self) -> None:
        pass


def parts(calls: DataFrame) -> int:
    """Into how many parts stretches are dealt, so that those of the busiest hold about PART calls."""
    most = calls.groupBy(F.expr(f"epoch div {STRETCH}")).count().agg(F.max("count")).first()[0]
    return -(-(most or 1) // PART)


def minutes(calls: DataFrame, keep: int = 86_400, shards: int = 8) -> DataFrame:
    """H3: minute, shard, n, tokens of a stream of calls (id, epoch, at, total_tokens), again whenever they change.

    A row that repeats an id of its minute replaces it, up to `keep` seconds of event time behind the latest call; then the state of its stretch of minutes
    goes, known by the first. A part of a stretch (`shards`, see `parts`) is one value of the state, so that calls cost no access each.
    """
    first = F.expr(f"epoch div {STRETCH} * {STRETCH}").alias("minute")
    rows = calls.withWatermark("at", f"{keep} seconds").select(first, F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.expr("epoch div 60 * 60").alias("own"), "id", F.coalesce("total_tokens", F.lit(0)).alias("tokens"), "at")
    return rows.groupBy("minute", "shard").transformWithStateInPandas(_Minutes(), "minute long, shard int, n long, tokens long", "Update", "EventTime")


def read_minutes(latest: DataFrame) -> DataFrame:
    """Minutes over all of their parts."""
    return latest.groupBy("minute").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


class _Windows(StatefulProcessor):
    """Signed sums by second of a cut of an account's time and of the minute before; what changes gives the windows that end up to a minute later anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds = handle.getValueState("seconds", "seconds array<long>, n array<long>, tokens array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        account, cut = key
        first = cut * CUT - SLIDE + 1
        n, tokens = np.zeros(CUT + SLIDE - 1, np.int64), np.zeros(CUT + SLIDE - 1, np.int64)
        if self.seconds.exists():
            at, held, said = (np.array(x, np.int64) for x in self.seconds.get())
            n[at - first], tokens[at - first] = held, said
        changed = np.zeros(len(n) + SLIDE, bool)
        for frame in rows:
            at = frame["second"].to_numpy() - first
            np.add.at(n, at, frame["sign"].to_numpy())
            np.add.at(tokens, at, (frame["sign"] * frame["tokens"]).to_numpy())
            for i in np.unique(at).tolist():
                changed[i : i + SLIDE] = True
        some = np.flatnonzero((n != 0) | (tokens != 0))
        self.seconds.update(((some + first).tolist(), n[some].tolist(), tokens[some].tolist()))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max((cut + 1) * CUT * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        s = SLIDE - 1 + np.flatnonzero(changed[SLIDE - 1 : len(n)])  # seconds of the cut itself
        window = lambda x: np.concatenate(([0], x.cumsum()))[s + 1] - np.concatenate(([0], x.cumsum()))[s - SLIDE + 1]
        yield pd.DataFrame({"account": account, "second": s + first, "n": window(n), "tokens": window(tokens), "own": n[s]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seconds.clear()
        return iter([])

    def close(self) -> None:
        pass


def activity(calls: DataFrame, keep: int = 3600) -> DataFrame:
    """H6: account, second, n, tokens of the 60 seconds up to a second, and the calls of the second itself (own), again whenever they change.

    calls: account, second (at which the end of a call is seen), at, total_tokens, sign: 1, or -1 for a call that is taken back, up to `keep` seconds of event time later. Seconds are taken by cuts of time, those of
    the last minute of a cut in the next one as well, so that an account is many keys.
    """
    rows = calls.withWatermark("at", f"{keep} seconds").where("account is not null").select("account", F.col("second").alias("epoch"), F.coalesce("total_tokens", F.lit(0)).alias("tokens"), F.col("sign").cast("long").alias("sign"), "at")
    dealt = timing.with_margin(rows, CUT, SLIDE - 1).select("account", "cut", F.col("epoch").alias("second"), "tokens", "sign", "at")
    return dealt.groupBy("account", "cut").transformWithStateInPandas(_Windows(), "account long, second long, n long, tokens long, own long", "Update", "EventTime")


def read_activity(latest: DataFrame) -> DataFrame:
    """Windows that end with a second in which calls are left."""
    return latest.where("own > 0").select("account", "second", "n", "tokens")
