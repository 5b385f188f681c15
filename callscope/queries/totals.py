from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cost, histogram, status, timing
from ..operators import selection
from ..operators import totals as T
from .registry import calls, paid, query

COUNTS = """count(*) AS n, count(*) FILTER (WHERE ok AND fclass = 'none') AS success, count(*) FILTER (WHERE NOT flying AND fclass <> 'none') AS failure, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens,
 round(coalesce(sum(cost), 0), 10) AS cost, round(coalesce(sum(cost) FILTER (WHERE status = 'interrupted' OR (NOT flying AND fclass <> 'none')), 0), 10) AS non_success_cost"""
HIST = "[" + ", ".join(f"CAST(count(*) FILTER (WHERE {{v}} > {a} AND {{v}} <= {b}) AS BIGINT)" for a, b in zip(("-1", *histogram.BOUNDS), (*histogram.BOUNDS, "1e300"), strict=True)) + "]"


@query("b1_outcomes", "SELECT status, coalesce(error_message, '') AS error, count(*) AS n, bool_and(ok) AS success_like, bool_and(NOT flying) AS terminal, CASE WHEN bool_and(flying) THEN 'in_flight' WHEN max(fclass) <> 'none' THEN 'failure' ELSE 'success' END AS outcome FROM calls GROUP BY 1, 2")
def b1(spark, d):
    s, e = F.col("status"), F.col("error_message")
    rows = calls(spark, d).select("status", F.coalesce(e, F.lit("")).alias("error"), status.success_like(s, e).alias("success_like"), status.terminal(s).alias("terminal"), status.outcome(s, e).alias("outcome"))
    return rows.groupBy("status", "error", "success_like", "terminal", "outcome").agg(F.count("*").alias("n"))


@query("b5_failure_class", """SELECT status, coalesce(error_message, '') AS error, CASE WHEN status = 'http_429' THEN 'http_429' WHEN status = 'http_401' THEN 'invalid_api_key' WHEN status = 'http_502' THEN 'upstream_stream_error' WHEN status = 'failed' THEN 'downstream_closed' END AS kind,
 fclass AS class, fclass = 'service_failure' AS actionable, count(*) AS n FROM calls GROUP BY ALL""")
def b5(spark, d):
    return T.classified(calls(spark, d)).groupBy("status", F.coalesce("error_message", F.lit("")).alias("error"), "kind", "class", "actionable").agg(F.count("*").alias("n"))


@query("b6_resolved_class", """SELECT stored, CASE WHEN stored IS NULL OR stored = 'none' THEN fclass ELSE stored END AS class, count(*) AS n FROM (SELECT *, ['none', 'client_failure', NULL][CAST(id % 3 AS INT) + 1] AS stored FROM calls) GROUP BY ALL""")
def b6(spark, d):
    rows = calls(spark, d).withColumn("stored", F.get(F.array(F.lit("none"), F.lit("client_failure"), F.lit(None)), (F.col("id") % 3).cast("int")))
    found = status.resolved(F.col("stored"), F.lit(None).cast("string"), status.failure(F.col("status"), F.col("error_message")))
    return rows.groupBy("stored", found["class"].alias("class")).agg(F.count("*").alias("n"))


@query("b8_error_category", """SELECT CASE coalesce(error_message, '') WHEN 'HTTP 429: Too Many Requests' THEN 'too_many_requests' WHEN 'HTTP 401 incorrect api key provided' THEN 'unauthorized' WHEN 'HTTP 502 upstream stream error' THEN 'HTTP 502'
 WHEN '[downstream_closed] user cancelled' THEN '[] user cancelled' ELSE 'Other' END AS category, count(*) AS n FROM calls WHERE event_type = 'error' GROUP BY 1""")
def b8(spark, d):
    return calls(spark, d).where("event_type = 'error'").groupBy(status.category(F.col("error_message")).alias("category")).agg(F.count("*").alias("n"))


@query("b9_normalised_text")
def b9(spark, d):
    """Over whole texts of documents in the shape of error messages.

    DuckDB's expressions end words at letters beyond ASCII, so no SQL gives these rows; tests/test_functions.py holds all of them to a plain version.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", status.normalised(F.concat(F.lit("HTTP 500 at 2024-01-02 03:04:05Z: "), F.col("text"))).alias("reason"))


@query("b12_payload", """SELECT id, CASE WHEN NOT broken THEN conversation END AS prompt_cache_key, CASE WHEN NOT broken THEN account END AS upstream_account_id, CASE WHEN NOT broken THEN model END AS request_model, CASE WHEN NOT broken AND k % 6 = 0 THEN model || '-mini' END AS response_model,
 CASE WHEN NOT broken THEN effort END AS reasoning_effort, CASE WHEN NOT broken AND k % 5 = 0 THEN 'priority' END AS service_tier, CASE WHEN NOT broken THEN ['/v1/responses', '/v1/chat/completions', '/v1/responses/compact'][k % 3 + 1] END AS endpoint,
 CASE WHEN NOT broken AND k % 7 <> 0 THEN conversation END AS sticky_key, CASE WHEN NOT broken THEN 'node-' || user_id % 5 END AS proxy_name, CASE WHEN NOT broken THEN '10.0.0.' || user_id % 9 END AS requester_ip, CASE WHEN NOT broken THEN 'host-' || user_id % 3 || '.example' END AS upstream_host FROM calls""")
def b12(spark, d):
    from ..operators import records

    return records.with_payload(calls(spark, d)).select("id", *records.PAYLOAD)


@query("b13_models", """SELECT model, effort, count(*) AS n FROM (SELECT CASE WHEN NOT broken AND k % 6 = 0 THEN model || '-mini' WHEN id % 4 <> 0 THEN model WHEN NOT broken THEN model ELSE 'unknown' END AS model, CASE WHEN broken THEN 'unspecified' ELSE coalesce(effort, 'unspecified') END AS effort FROM calls) GROUP BY ALL""")
def b13(spark, d):
    """The model that answered, else the stored one (every fourth call has none), else the one that was asked for."""
    from ..operators import records

    rows = records.with_payload(calls(spark, d)).withColumn("stored", F.when(F.col("id") % 4 != 0, F.col("model")))
    return rows.groupBy(records.model_of("response_model", "stored", "request_model").alias("model"), F.coalesce("reasoning_effort", F.lit("unspecified")).alias("effort")).agg(F.count("*").alias("n"))


@query("b14_series_key", """SELECT model, coalesce(effort, 'unspecified') AS effort, 'model:v2:' || rtrim(translate(base64(encode('["' || model || '","' || coalesce(effort, 'unspecified') || '"]')), '+/', '-_'), '=') AS series, count(*) AS n FROM calls GROUP BY ALL""")
def b14(spark, d):
    effort = F.coalesce(F.nullif(F.trim("effort"), F.lit("")), F.lit("unspecified"))
    key = F.concat(F.lit("model:v2:"), F.rtrim(F.translate(F.base64(F.encode(F.to_json(F.array("model", effort)), "UTF-8")), "+/", "-_"), F.lit("=")))
    return calls(spark, d).groupBy("model", effort.alias("effort"), key.alias("series")).agg(F.count("*").alias("n"))


@query("b15_upstream_series", "SELECT CASE WHEN kind = 'api_key' THEN 'account:' || account ELSE 'other' END AS series, count(*) AS n FROM calls LEFT JOIN accounts USING (account) GROUP BY 1")
def b15(spark, d):
    from ..sources import adapter

    rows = calls(spark, d).join(adapter.accounts(spark), "account", "left")
    return rows.groupBy(F.when(F.col("kind") == "api_key", F.concat(F.lit("account:"), F.col("account").cast("string"))).otherwise("other").alias("series")).agg(F.count("*").alias("n"))


@query("b16_first_byte_total", "SELECT id, CASE WHEN t_ttfb > 0 THEN round(t_read + t_parse + t_connect + t_ttfb, 6) END AS ms FROM calls")
def b16(spark, d):
    return calls(spark, d).select("id", F.round(timing.first_byte_total(*map(F.col, ("t_read", "t_parse", "t_connect", "t_ttfb"))), 6).alias("ms"))


@query("b17_mixed_times", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN event_id % 3 = 1 THEN CAST(floor(epoch(ts)) AS BIGINT) - 8 * 3600 END AS epoch FROM events""".replace("SELECT", "SELECT", 1))
def b17(spark, d):
    text = F.expr("case event_id % 3 when 0 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') when 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') else 'soon' end")
    return spark.read.parquet(f"{d}/events.parquet").withColumn("text", text).select("event_id", F.unix_seconds(timing.mixed_time(F.col("text"))).alias("epoch"))


@query("b23_zone_buckets", """SELECT CAST(floor(epoch((to_timestamp(epoch) AT TIME ZONE 'America/New_York')::DATE::TIMESTAMP AT TIME ZONE 'America/New_York')) AS BIGINT) AS day, count(*) AS n FROM calls GROUP BY 1""")
def b23(spark, d):
    return calls(spark, d).groupBy(timing.zone_bucket("epoch", timing.DAY, "America/New_York").alias("day")).agg(F.count("*").alias("n"))


PARTS = ", ".join(f"round(cost_{p}, 9) AS cost_{p}" for p in cost.PARTS)


@query("b26_cost", f"SELECT id, {PARTS}, round(cost, 9) AS cost FROM paid")
def b26(spark, d):
    return paid(spark, d).select("id", *(F.round(f"cost_{p}", 9).alias(f"cost_{p}") for p in cost.PARTS), F.round("cost", 9).alias("cost"))


@query("b29_network_bytes", "SELECT host, CAST(sum(up) AS BIGINT) AS upload, CAST(sum(down) AS BIGINT) AS download FROM (SELECT CASE WHEN broken THEN '__unknown__' ELSE 'host-' || user_id % 3 || '.example' END AS host, CASE WHEN broken THEN 8 ELSE input_tokens * 4 END AS up, CASE WHEN broken THEN 0 ELSE output_tokens * 4 END AS down FROM calls) GROUP BY 1")
def b29(spark, d):
    number = lambda n: F.get_json_object("payload", f"$.{n}").cast("long")
    rows = calls(spark, d).select(cost.host(F.get_json_object("payload", "$.upstreamBaseUrlHost")).alias("host"), cost.bytes_of(number("upstreamApproxUploadBytes"), F.length("payload")).alias("up"), cost.bytes_of(number("upstreamApproxDownloadBytes")).alias("down"))
    return rows.groupBy("host").agg(F.sum("up").alias("upload"), F.sum("down").alias("download"))


@query("c1_totals", f"SELECT {COUNTS} FROM paid WHERE epoch >= 1704844800 AND epoch < 1706054400")
def c1(spark, d):
    return T.totals(timing.within(paid(spark, d), 1704844800, 1706054400))


@query("c2_account_totals", f"SELECT {COUNTS} FROM paid WHERE account = 3")
def c2(spark, d):
    return T.totals(paid(spark, d).where("account = 3"))


@query("c3_recent_totals", f"SELECT {COUNTS} FROM (SELECT * FROM paid ORDER BY epoch DESC, id DESC LIMIT 500)")
def c3(spark, d):
    return T.totals(T.recent(paid(spark, d), 500))


HOURLY = f"SELECT epoch // 3600 * 3600 AS hour, source, {COUNTS}, count(v) AS ttfb_n, round(coalesce(sum(v), 0), 10) AS ttfb_ms, max(v) AS ttfb_max, {HIST.format(v='v')} AS ttfb_hist FROM (SELECT *, CASE WHEN ok AND t_ttfb > 0 THEN t_ttfb END AS v FROM paid) GROUP BY 1, 2"


@query("c5_hourly_rollup", HOURLY.replace(f"{HIST.format(v='v')} AS ttfb_hist", f"array_to_string({HIST.format(v='v')}, ',') AS ttfb_hist"))
def c5(spark, d):
    return T.hourly(paid(spark, d)).withColumn("ttfb_hist", F.array_join("ttfb_hist", ","))


@query("c6_failure_rollup", """SELECT epoch // 3600 * 3600 AS hour, source, fclass AS class, fclass = 'service_failure' AS actionable, CASE coalesce(error_message, '') WHEN 'HTTP 429: Too Many Requests' THEN 'too_many_requests' WHEN 'HTTP 401 incorrect api key provided' THEN 'unauthorized'
 WHEN 'HTTP 502 upstream stream error' THEN 'HTTP 502' WHEN '[downstream_closed] user cancelled' THEN '[] user cancelled' ELSE 'Other' END AS category, count(*) AS n FROM calls WHERE NOT flying AND fclass <> 'none' GROUP BY ALL""")
def c6(spark, d):
    return T.failures(calls(spark, d))


LONG = "(" + " UNION ALL ".join(f"SELECT id, epoch, source, '{n}' AS stage, {c} AS ms FROM calls WHERE {c} IS NOT NULL" for n, c in T.STAGES.items()) + ")"


@query("c7_stage_rollup", f"SELECT epoch // 3600 * 3600 AS hour, stage, count(*) AS n, round(sum(ms), 10) AS ms, max(ms) AS most, array_to_string({HIST.format(v='ms')}, ',') AS hist FROM {LONG} WHERE source = 'proxy' GROUP BY 1, 2")
def c7(spark, d):
    return T.stage_rollup(calls(spark, d)).withColumn("hist", F.array_join("hist", ","))


CONVERSATION = "count(*) AS n, count(*) FILTER (WHERE ok AND fclass = 'none') AS success, count(*) FILTER (WHERE NOT (ok AND fclass = 'none')) AS failure, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(coalesce(sum(cost), 0), 10) AS cost, min(epoch) AS first_seen, max(epoch) AS last_seen FROM paid WHERE conversation IS NOT NULL GROUP BY ALL"


@query("c8_conversation_rollup", f"SELECT epoch // 3600 * 3600 AS hour, source, conversation, {CONVERSATION}")
def c8(spark, d):
    return T.conversation_rollup(paid(spark, d))


@query("c9_conversation_account_rollup", f"SELECT epoch // 3600 * 3600 AS hour, source, conversation, account, {CONVERSATION}")
def c9(spark, d):
    return T.conversation_rollup(paid(spark, d), "account")


def account_sql(width):
    return f"""SELECT epoch // {width} * {width} AS bucket, coalesce(account, -1) AS account, count(*) AS n, count(*) FILTER (WHERE ok AND fclass = 'none') AS success, count(*) FILTER (WHERE NOT flying AND fclass <> 'none') AS failure, count(*) FILTER (WHERE flying) AS flying,
 CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_tokens) AS BIGINT) AS cache_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(coalesce(sum(cost), 0), 10) AS cost,
 round(coalesce(sum(cost) FILTER (WHERE status = 'interrupted' OR (NOT flying AND fclass <> 'none')), 0), 10) AS non_success_cost, arg_max(t_total, epoch * 1000000000 + id) FILTER (WHERE t_total IS NOT NULL) AS last_ms FROM paid GROUP BY 1, 2"""


@query("c10_account_hours", account_sql(3600))
def c10(spark, d):
    return T.account_rollup(paid(spark, d))


@query("c12_account_minutes", account_sql(60))
def c12(spark, d):
    return T.account_rollup(paid(spark, d), 60)


BREAKDOWN = "source, account, model, coalesce(effort, 'unspecified') AS effort, count(*) AS n, CAST(sum(greatest(input_tokens - cache_tokens, 0)) AS BIGINT) AS cache_write_tokens, CAST(sum(cache_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, " + ", ".join(f"round(coalesce(sum(cost_{p}), 0), 10) AS cost_{p}" for p in cost.PARTS) + ", count(*) FILTER (WHERE cost IS NULL) AS unknown, round(coalesce(sum(cost), 0), 10) AS cost FROM paid GROUP BY ALL"


@query("c11_usage_breakdown", f"SELECT epoch // 3600 * 3600 AS hour, {BREAKDOWN}")
def c11(spark, d):
    return T.usage_breakdown(paid(spark, d), T.hour())


@query("c18_histogram_percentiles", f"""SELECT source, CAST(list_extract([5,10,20,50,100,150,200,300,500,750,1000,1500,2000,3000,5000,10000,20000,30000,60000,180000,180000], CAST(len(list_filter(range(1, 22), lambda i: list_sum(h[1:i]) < greatest(ceil(list_sum(h) * 0.95), 1))) + 1 AS INT)) AS DOUBLE) AS p95
 FROM (SELECT source, {HIST.format(v='t_total')} AS h FROM calls GROUP BY 1)""")
def c18(spark, d):
    hourly = calls(spark, d).withColumn("at", histogram.place(F.col("t_total"))).groupBy(T.hour(), "source").agg(histogram.counted(F.col("at")).alias("h"))
    return T.merged([hourly], ["source"], hists=["h"]).select("source", histogram.percentile(F.col("h"), 0.95).alias("p95"))


@query("c20_hybrid_p95", f"""SELECT account, round(quantile_cont(t_total, 0.95), 6) AS p95 FROM calls WHERE t_total IS NOT NULL GROUP BY 1""")
def c20(spark, d):
    placed = calls(spark, d).where("t_total is not null").withColumn("at", histogram.place(F.col("t_total")))
    rolled = placed.groupBy("account").agg(histogram.counted(F.col("at")).alias("h"), F.count("t_total").alias("n"))
    exact = selection.percentiles(placed, ["account"], {"e": F.col("t_total")}, (0.95,)).select(F.col("account").alias("known"), F.col("e")[0].alias("e"))
    rows = rolled.join(exact, F.col("account").eqNullSafe(F.col("known")))
    return rows.select("account", F.round(histogram.hybrid(F.col("h"), F.col("e"), F.col("n"), 0.95), 6).alias("p95"))


@query("c21_stage_report", f"SELECT stage, count(*) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.99), 6) AS p99, max(ms) AS most FROM {LONG} WHERE source = 'proxy' GROUP BY 1")
def c21(spark, d):
    return T.stage_report(calls(spark, d))


@query("c22_error_distribution", """SELECT CASE coalesce(error_message, '') WHEN 'HTTP 429: Too Many Requests' THEN 'too_many_requests' WHEN 'HTTP 502 upstream stream error' THEN 'HTTP 502' ELSE 'Other' END AS category, count(*) AS n FROM calls WHERE NOT flying AND fclass = 'service_failure' GROUP BY 1 ORDER BY n DESC, category LIMIT 50""")
def c22(spark, d):
    return T.error_report(calls(spark, d))


@query("c23_other_errors", "SELECT id, epoch, status FROM calls WHERE status = 'interrupted' ORDER BY epoch DESC, id DESC LIMIT 20 OFFSET 20")
def c23(spark, d):
    rows = T.classified(calls(spark, d)).where("not flying and class <> 'none'").where(status.category(F.coalesce("error_message", F.lit(""))) == "Other")
    return rows.select("id", "epoch", "status").orderBy(F.desc("epoch"), F.desc("id")).offset(20).limit(20)


@query("c24_failure_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE fclass = 'service_failure') AS service_failure, count(*) FILTER (WHERE fclass = 'client_failure') AS client_failure, count(*) FILTER (WHERE fclass = 'client_abort') AS client_abort,
 count(*) FILTER (WHERE fclass = 'service_failure') AS actionable, round(count(*) FILTER (WHERE fclass = 'service_failure') / nullif(count(*), 0)::DOUBLE, 9) AS actionable_rate FROM calls WHERE NOT flying AND fclass <> 'none'""")
def c24(spark, d):
    return T.failure_summary(calls(spark, d))


@query("c37_daily_rollup", f"SELECT epoch // 86400 AS day, source, {COUNTS} FROM paid GROUP BY 1, 2")
def c37(spark, d):
    return T.totals(paid(spark, d), F.floor(F.col("epoch") / 86400).alias("day"), "source")


@query("c39_usage_report", "SELECT model, coalesce(effort, 'unspecified') AS effort, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 10) AS cost, round(sum(cache_tokens) / nullif(sum(greatest(input_tokens - cache_tokens, 0)) + sum(cache_tokens) + sum(output_tokens), 0)::DOUBLE, 9) AS cache_hit FROM paid GROUP BY 1, 2")
def c39(spark, d):
    rows = T.usage_breakdown(paid(spark, d)).withColumn("tokens", F.expr("cache_write_tokens + cache_read_tokens + output_tokens"))
    out = rows.groupBy("model", "effort").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 10).alias("cost"), F.round(cost.ratio(F.sum("cache_read_tokens"), F.sum("tokens")), 9).alias("cache_hit"))
    return out.orderBy(F.desc("tokens"), F.desc("cost"))


@query("a7_merged_rollup", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1, 2")
def a7(spark, d):
    part = lambda c: T.totals(paid(spark, d).where(c), T.hour(), "source").select("hour", "source", "n", "tokens")
    return T.merged([part("id % 2 = 0"), part("id % 2 = 1")], ["hour", "source"], sums=["n", "tokens"])
