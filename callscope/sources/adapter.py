"""Telemetry frames derived from the events table by fixed arithmetic rules.

Times are stored without a zone and mean UTC; `epoch` is their whole second. Operators never read paths: they take these frames, or any others with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
#: The instant that stands for now: 2024-01-31 00:00:00, after the last event.
NOW = 1706659200
DAY, HOUR = 86400, 3600


_ERRORS = (
    ("http_429", "HTTP 429: Too Many Requests"), ("http_401", "HTTP 401 incorrect api key provided"), ("http_502", "HTTP 502 upstream stream error"), ("failed", "[downstream_closed] user cancelled"), ("interrupted", ""),
)
_FINE = {"click": "http_200", "purchase": "warning_success", "view": "success"}


def _statuses(spark: SparkSession) -> DataFrame:
    """Status and error message by kind of event: fifty rows, so that both are columns and no long expressions to those who filter on them."""
    rows = []
    for kind in ("error", "signup", *_FINE):
        for r5, (state, message) in enumerate(_ERRORS):
            for r23 in (False, True):
                rows.append((kind, r5, r23, *((state, message) if kind == "error" else (_FINE.get(kind) or ("running" if r23 else "completed"), None))))
    return spark.createDataFrame(rows, "event_type string, r5 long, r23 boolean, status string, error_message string")


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call."""
    return calls_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def invocation_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The same rows as a stream of the files of events."""
    like = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return calls_of(spark.readStream.schema(like).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event[s].parquet"))


def calls_of(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    events = events.selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "cast(get_json_object(props, '$.k') as bigint) k")
    calls = events.selectExpr(
        "event_id + 1 id", "concat('inv-', event_id) invoke_id", "ts occurred_at", f"timestampdiff(SECOND, {EPOCH}, ts) epoch", "user_id", "k", "value", "event_type",
        "if(event_id % 10 = 0, 'xy', 'proxy') source", "if(event_id % 17 = 0, null, concat('conv-', user_id)) conversation", "if(user_id % 11 = 0, null, user_id % 7 + 1) account",
        "element_at(array('model-a', 'model-b', 'model-c-2026-01-01'), cast(k % 3 as int) + 1) model", "element_at(array('low', 'medium', 'high', null), cast(k % 4 as int) + 1) effort",
        "event_id % 5 r5", "event_id % 23 = 0 r23",
        "cast(floor(value * 100) as bigint) input_tokens", "cast(floor(floor(value * 100) * (k % 10) / 10) as bigint) cache_tokens", "cast(floor(value * 10) as bigint) output_tokens",
        "if(event_id % 29 = 0, null, value * 20) t_total", "k * 0.1D t_read", "0.5D t_parse", "if(event_id % 13 = 0, null, 5.0D) t_connect", "value * 4 t_ttfb", "value * 12 t_stream",
        "if(event_type in ('view', 'purchase'), value * 4 + 10, null) first_token", "value * 20000 t_long", "event_id % 101 = 0 broken",
        "k * 0.2D t_answer", "if(event_id % 19 = 0, null, 1.5D) t_store",
    )
    calls = calls.join(F.broadcast(_statuses(spark)), ["event_type", "r5", "r23"], "left").drop("r5", "r23")
    calls = calls.withColumns({"reasoning_tokens": F.expr("output_tokens div 4"), "total_tokens": F.expr("input_tokens + output_tokens")})
    body = F.to_json(
        F.struct(
            F.col("conversation").alias("promptCacheKey"), F.col("account").alias("upstreamAccountId"), F.col("model").alias("requestModel"), F.col("effort").alias("reasoningEffort"),
            F.when(F.col("k") % 5 == 0, "priority").alias("serviceTier"), F.expr("concat('host-', user_id % 3, '.example')").alias("upstreamBaseUrlHost"),
            (F.col("input_tokens") * 4).alias("upstreamApproxUploadBytes"), (F.col("output_tokens") * 4).alias("upstreamApproxDownloadBytes"),
            F.when(F.col("k") % 6 == 0, F.concat("model", F.lit("-mini"))).alias("responseModel"), F.element_at(F.array(F.lit("/v1/responses"), F.lit("/v1/chat/completions"), F.lit("/v1/responses/compact")), (F.col("k") % 3).cast("int") + 1).alias("endpoint"),
            F.expr("concat('10.0.0.', user_id % 9)").alias("requesterIp"), F.expr("concat('node-', user_id % 5)").alias("proxyDisplayName"), F.expr("if(k % 7 = 0, null, conversation)").alias("stickyKey"),
        )
    )
    return calls.withColumn("payload", F.when(F.col("broken"), "not json").otherwise(body)).drop("broken")


def attempts(calls: DataFrame) -> DataFrame:
    """One row per try: every call has a first, every fourth event a second one with the next account."""
    first = calls.selectExpr("id * 2 attempt_id", "id", "invoke_id", "epoch", "account", "1 attempt_index", "status", "error_message", "model", "t_ttfb", "if(k % 2 = 0, 'gzip', 'br') codec")
    again = calls.where("(id - 1) % 4 = 0").selectExpr("id * 2 + 1 attempt_id", "id", "invoke_id", "epoch + 1 epoch", "account + 1 account", "2 attempt_index", "status", "error_message", "model", "t_ttfb", "if(k % 2 = 0, 'zstd', null) codec")
    return first.unionByName(again)


def node_attempts(calls: DataFrame) -> DataFrame:
    """One row per use of a node."""
    return calls.selectExpr("id", "model route", "concat('node-', user_id % 5) proxy_key", "occurred_at", "epoch", "status", "error_message", "event_type <> 'error' is_success", "value * 4 latency_ms", "(id - 1) % 50 = 0 is_probe", "if(event_type = 'error', status, null) failure_kind")


def nodes(spark: SparkSession) -> DataFrame:
    """A small dimension: the five nodes that attempts use, and one that none has used yet."""
    return spark.range(6).select(F.concat(F.lit("node-"), F.col("id").cast("string")).alias("proxy_key"))


def limit_samples(calls: DataFrame) -> DataFrame:
    """One sample of the usage windows per call of an account."""
    return calls.where("account is not null").selectExpr("id", "account", "epoch captured", "value % 100 short_percent", "(value * 3) % 100 long_percent", "300 short_minutes", "10080 long_minutes", f"(epoch div {DAY} + 1) * {DAY} resets")


def quota_snapshots(calls: DataFrame) -> DataFrame:
    return calls.where("event_type = 'purchase'").selectExpr("id", "epoch captured", "value used_amount", "100 - value remaining_amount", "total_tokens")


def account_events(calls: DataFrame) -> DataFrame:
    return calls.where("event_type = 'error'").selectExpr("id", "account", "epoch", "status action", "error_message reason", "invoke_id")


def accounts(spark: SparkSession) -> DataFrame:
    """A small dimension: the seven accounts that calls can have, and one that a retry may reach."""
    rows = [(i, f"Account {i}", "oauth" if i % 2 else "api_key", f"group-{i % 3}", f"shared-{i // 2}", i % 4 != 0, i in (2, 3, 4), f"seat-{i}") for i in range(1, 9)]
    return spark.createDataFrame(rows, "account long, name string, kind string, grp string, identity string, enabled boolean, team boolean, seat string")


def pricing(spark: SparkSession) -> DataFrame:
    """Prices per million tokens."""
    rows = [("model-a", 2.5, 15.0, 0.25, None, None), ("model-b", 5.0, 30.0, 0.5, 6.25, None), ("model-c", 0.75, 4.5, 0.075, None, None)]
    return spark.createDataFrame(rows, "price_model string, input_price double, output_price double, read_price double, write_price double, reasoning_price double")
