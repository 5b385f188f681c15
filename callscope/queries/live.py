from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types

from ..operators import totals as T
from ..operators import weights
from ..sources import adapter, archive
from ..streaming import live, stateful
from .registry import calls, paid, query
from .series import SLICES, START, wall_sql


def stream(spark, d):
    """The calls as a stream, with the time of their start."""
    return adapter.invocation_stream(spark, d).withColumn("at", F.timestamp_seconds("epoch"))


def drained(spark, name, start):
    """The folder that a query has written by the time all that is there is read; `start` takes that folder and one for the checkpoint."""
    root = archive.shared_dir(spark, name)
    start(f"{root}/out", f"{root}/check").awaitTermination()
    return f"{root}/out"


@query("h1_streamed_rollup", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) AS n, count(*) FILTER (WHERE ok AND fclass = 'none') AS success, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(coalesce(sum(cost), 0), 9) AS cost FROM paid GROUP BY 1, 2")
def h1(spark, d):
    from ..functions import cost

    rows = cost.priced(stream(spark, d), adapter.pricing(spark), threshold=20_000)
    path = drained(spark, "h1", lambda out, check: live.hourly_rollup(rows, out, check))
    return live.read_rollup(spark, path).select("hour", "source", "n", "success", "tokens", F.round("cost", 9).alias("cost"))


#: Micro-batches of the streams with keyed state.
BATCHES = 4


def replayed(spark, rows, name, batch, step):
    """The folder that a stream has written of rows that come in batches: `batch` says with which, from 0 up to BATCHES; `step` is what is done to the stream.

    Batches are dealt by one job and any number of tasks; each arrives when the one before is done.
    """
    own, root = stateful.session(spark), archive.shared_dir(spark, name)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # the next batch lets go what is due
    rows.withColumn("__batch", batch).write.partitionBy("__batch").parquet(f"{root}/dealt")
    dealt = own.read.schema(types.StructType([*rows.schema.fields, types.StructField("__batch", types.IntegerType())])).parquet(f"{root}/dealt")
    for i in range(BATCHES + 1):
        dealt.where(F.col("__batch") == i).drop("__batch").write.mode("append").parquet(f"{root}/in")
        arrived = own.readStream.schema(rows.schema).parquet(f"{root}/in")
        live.by_batch(step(arrived), f"{root}/out", f"{root}/check", mode="update").awaitTermination()
    return f"{root}/out"


def quarter(rows, place):
    """The quarter of a range that a row lies in."""
    low, high = rows.agg(F.min(place), F.max(place)).first()
    return F.least(F.floor((F.col(place) - F.lit(low or 0)) * BATCHES / F.lit(max(1, (high or 0) - (low or 0) + 1))), F.lit(BATCHES - 1)).cast("int")


@query("h3_streamed_minutes", "SELECT epoch // 60 * 60 AS minute, count(*) AS n, CAST(sum(CASE WHEN id % 50 = 7 THEN 2 * total_tokens ELSE total_tokens END) AS BIGINT) AS tokens FROM calls GROUP BY 1")
def h3(spark, d):
    """All minutes, open ones, too. Every fiftieth call comes twice; in the end again, with twice its tokens, which rebuilds its minute."""
    first = calls(spark, d).select("id", "epoch", F.timestamp_seconds("epoch").alias("at"), "total_tokens")
    at = quarter(first, "epoch")
    some = first.where("id % 50 = 7")
    rows = first.withColumn("b", at).union(some.withColumn("b", at)).union(some.withColumn("total_tokens", F.col("total_tokens") * 2).withColumn("b", F.lit(BATCHES)))
    shards = stateful.parts(first)
    path = replayed(spark, rows, "h3", F.col("b"), lambda arrived: stateful.minutes(arrived, keep=40 * 86_400, shards=shards))
    return stateful.read_minutes(live.latest_of(spark, path, "minute", "shard"))


@query("h4_streamed_in_progress", """SELECT conversation, count(*) FILTER (WHERE flying) AS running, count(*) FILTER (WHERE flying AND retry) AS retried FROM (SELECT *, coalesce(last_value(CASE WHEN NOT flying THEN fclass <> 'none' END IGNORE NULLS) OVER
 (PARTITION BY conversation ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS retry FROM calls WHERE conversation IS NOT NULL) GROUP BY 1""")
def h4(spark, d):
    path = drained(spark, "h4", lambda out, check: live.by_batch(live.in_progress(stream(spark, d)), out, check, mode="update"))
    return live.latest_of(spark, path, "conversation")


@query("h6_streamed_activity", """, seen AS (SELECT account, epoch + CAST(floor(coalesce(t_total, 0) / 1000) AS BIGINT) AS second, total_tokens FROM calls WHERE NOT flying AND account IS NOT NULL AND id % 20 <> 3), s AS (SELECT account, second, count(*) AS n, sum(total_tokens) AS tokens FROM seen GROUP BY 1, 2)
 SELECT account, second, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(tokens) OVER w AS BIGINT) AS tokens FROM s WINDOW w AS (PARTITION BY account ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def h6(spark, d):
    """Windows of the last minute by the second at which the end of a call is seen, open ones, too; every twentieth call is taken back a batch later."""
    ended = live.observed(calls(spark, d)).select("id", "account", F.unix_seconds("at").alias("second"), "at", "total_tokens")
    at = quarter(ended, "second")
    rows = ended.withColumns({"sign": F.lit(1), "b": at}).union(ended.where("id % 20 = 3").withColumns({"sign": F.lit(-1), "b": at + 1}))
    path = replayed(spark, rows, "h6", F.col("b"), lambda arrived: stateful.activity(arrived, keep=40 * 86_400))
    return stateful.read_activity(live.latest_of(spark, path, "account", "second"))


@query("h7_streamed_network", """, s AS (SELECT unnest(['global', 'source:' || source] || CASE WHEN account IS NOT NULL THEN ['account:' || account] ELSE [] END) AS scope, epoch, input_tokens FROM calls),
 g AS (SELECT *, unnest(['second', 'minute', 'five_minutes']) AS grain, unnest([1, 60, 300]) AS width FROM s), r AS (SELECT scope, grain, CAST(epoch // width * width AS BIGINT) AS start, CAST(sum(input_tokens) * 4 AS BIGINT) AS bytes FROM g GROUP BY ALL)
 SELECT scope, grain, start, bytes, grain = 'five_minutes' AND start = (SELECT max(epoch) // 300 * 300 FROM calls) AS open FROM r""")
def h7(spark, d):
    path = drained(spark, "h7", lambda out, check: live.network_rollup(stream(spark, d), out, check))
    return live.read_network(spark, path)


@query("h13_streamed_wall_time", f", {SLICES} SELECT account, bucket, wall_ms, calls FROM ({wall_sql('account').split(SLICES)[1]})")
def h13(spark, d):
    path = drained(spark, "h13", lambda out, check: live.segment_rollup(stream(spark, d), out, check))
    return live.read_wall_time(spark, path)


@query("h2_rebuilt_hours", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1, 2")
def h2(spark, d):
    """A rollup that lacks late rows of some hours, after these hours are computed anew."""
    all_ = paid(spark, d)
    late = all_.where(f"epoch >= {START} and epoch < {START + 86400} and id % 3 = 0")
    old = T.totals(all_.join(late.select("id"), "id", "left_anti"), T.hour(), "source")
    return live.rebuilt(old, all_, late.select(T.hour()).distinct()).select("hour", "source", "n", "tokens")


#: The weight machine as a walk from attempt to attempt of each node.
WALK = """, steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY proxy_key ORDER BY epoch, id) AS rn FROM nodes),
walk(proxy_key, rn, id, epoch, weight, failures, rate, mean) AS (SELECT DISTINCT proxy_key, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.7::DOUBLE, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM nodes
 UNION ALL SELECT proxy_key, rn, id, epoch, CASE WHEN is_success AND w < 0.25 THEN 0.25 ELSE w END, failures, rate, mean FROM (SELECT *, greatest(least(CASE WHEN is_success AND is_probe AND v <= 0 THEN 0.55 ELSE v END, 8.0), -8.0) AS w
 FROM (SELECT *, CASE WHEN is_success THEN old + greatest(0.55 - coalesce(least(mean / 9000.0, 0.35), 0.0), 0.08) ELSE old - least(0.5 + 0.18 * failures, 1.2) END AS v
 FROM (SELECT s.proxy_key, s.rn, s.id, s.epoch, s.is_success, s.is_probe, k.weight AS old, CASE WHEN s.is_success THEN 0 ELSE k.failures + 1 END AS failures,
   CASE WHEN k.rate IS NULL THEN CAST(s.is_success AS DOUBLE) ELSE 0.9 * k.rate + 0.1 * CAST(s.is_success AS DOUBLE) END AS rate,
   CASE WHEN NOT s.is_success OR s.latency_ms IS NULL THEN k.mean WHEN k.mean IS NULL THEN s.latency_ms ELSE 0.8 * k.mean + 0.2 * s.latency_ms END AS mean
  FROM walk k JOIN steps s ON s.proxy_key = k.proxy_key AND s.rn = k.rn + 1))))
"""


@query("h8_node_weights", f"{WALK} SELECT id, proxy_key, round(weight, 6) AS weight, failures, round(rate, 6) AS success_rate, round(mean, 6) AS latency_mean FROM walk WHERE rn > 0", recursive=True)
def h8(spark, d):
    found = weights.node_weights(adapter.node_attempts(calls(spark, d)))
    return found.select("id", "proxy_key", F.round("weight", 6).alias("weight"), "failures", *(F.round(c, 6).alias(c) for c in ("success_rate", "latency_mean")))


@query("h8b_weight_replay", f"{WALK} SELECT proxy_key, epoch // 3600 * 3600 AS hour, round(arg_max(weight, rn), 6) AS weight, arg_max(weight, rn) > 0 AS positive FROM walk WHERE rn > 0 GROUP BY 1, 2", recursive=True)
def h8b(spark, d):
    """Hours of each node with positive weight at their end, from the replay of all attempts."""
    rows = adapter.node_attempts(calls(spark, d))
    known = weights.node_weights(rows).join(rows.select("id", "epoch"), "id")
    last = known.groupBy("proxy_key", T.hour()).agg(F.max_by("weight", F.struct("epoch", "id")).alias("weight"))
    return last.select("proxy_key", "hour", F.round("weight", 6).alias("weight"), (F.col("weight") > 0).alias("positive"))


@query("h9_route_health", """, steps AS MATERIALIZED (SELECT id, account, model, epoch, event_type = 'error' AS failed, row_number() OVER (PARTITION BY account, model ORDER BY epoch, id) AS rn FROM calls WHERE account IS NOT NULL),
 walk(account, model, rn, id, streak, began, last, until, level, state) AS (SELECT DISTINCT account, model, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM steps
 UNION ALL SELECT account, model, rn, id, streak, began, last, until, level, CASE WHEN until > epoch THEN 'cooling_down' WHEN level > 0 THEN 'degraded' ELSE 'healthy' END
 FROM (SELECT *, CASE WHEN NOT failed THEN 0 WHEN cools THEN epoch + least(15 * (1 << least(old_level, 10)), 60) ELSE old_until END AS until, CASE WHEN NOT failed THEN 0 WHEN cools THEN old_level + 1 ELSE old_level END AS level
 FROM (SELECT *, failed AND (streak >= 5 OR epoch - began >= 30) AS cools
 FROM (SELECT s.*, k.until AS old_until, k.level AS old_level, CASE WHEN s.failed THEN k.streak + 1 ELSE 0 END AS streak, CASE WHEN s.failed THEN s.epoch ELSE k.last END AS last,
   CASE WHEN s.failed AND (k.streak = 0 OR s.epoch - k.last > 30) THEN s.epoch ELSE k.began END AS began FROM walk k JOIN steps s ON s.account = k.account AND s.model = k.model AND s.rn = k.rn + 1))))
 SELECT id, state FROM walk WHERE rn > 0""", recursive=True)
def h9(spark, d):
    return live.route_health(calls(spark, d))


@query("h15_changed_quota", "SELECT id, used_amount FROM (SELECT id, value AS used_amount, lag(value) OVER (ORDER BY epoch, id) AS previous FROM calls WHERE event_type = 'purchase') WHERE previous IS NULL OR previous <> used_amount")
def h15(spark, d):
    return live.changed(adapter.quota_snapshots(calls(spark, d)), "used_amount").select("id", "used_amount")
