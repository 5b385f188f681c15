from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cost, status, timing
from ..operators import records as R
from ..operators import totals as T
from ..sources import adapter
from ..sources.adapter import NOW
from .registry import SNAPSHOT, calls, paid, query, snapshot
from .series import START


@query("a1_range_scan", f"SELECT id, epoch, source FROM calls WHERE epoch >= {START} AND epoch < {START + 86400 * 3} AND source = 'proxy' AND id <= {SNAPSHOT}")
def a1(spark, d):
    c = calls(spark, d)
    return R.scan(c, START, START + 3 * 86400, "proxy", snapshot(c)).select("id", "epoch", "source")


@query("a3_live_and_archive", "SELECT count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls")
def a3(spark, d):
    all_ = calls(spark, d)
    return R.with_archive(timing.within(all_, START), timing.within(all_, None, START + 86400).drop("payload")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("total_tokens").alias("tokens"))


@query("a5_attempts_with_accounts", f"SELECT attempt_id, attempt_index, name FROM attempts LEFT JOIN accounts USING (account) WHERE epoch >= {START} AND epoch < {START + 86400}")
def a5(spark, d):
    near = timing.within(calls(spark, d), START - 1, START + 86400)  # a second try begins a second later
    rows = timing.within(adapter.attempts(near), START, START + 86400)
    return rows.join(adapter.accounts(spark), "account", "left").select("attempt_id", "attempt_index", "name")


@query("a10_latest_quota", "SELECT id, epoch AS captured, value AS used_amount, FALSE AS degraded FROM calls WHERE event_type = 'purchase' ORDER BY epoch DESC, id DESC LIMIT 1")
def a10(spark, d):
    return R.latest_quota(adapter.quota_snapshots(calls(spark, d))).select("id", "captured", "used_amount", "degraded")


@query("b33_scarcity", "SELECT account, round(0.65 * max(short_percent) / 100 + 0.35 * max(long_percent) / 100, 9) AS scarcity FROM samples GROUP BY 1")
def b33(spark, d):
    rows = adapter.limit_samples(calls(spark, d)).groupBy("account").agg(F.max("short_percent").alias("s"), F.max("long_percent").alias("l"))
    return rows.select("account", F.round(cost.scarcity(F.col("s"), F.col("l")), 9).alias("scarcity"))


@query("b35_body_usage", "SELECT id, input_tokens AS input, output_tokens AS output, cache_tokens AS cached, reasoning_tokens AS reasoning, total_tokens AS total FROM calls")
def b35(spark, d):
    body = F.to_json(F.struct(F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"), F.struct(F.col("cache_tokens").alias("cached_tokens")).alias("prompt_tokens_details"), F.struct(F.col("reasoning_tokens")).alias("output_tokens_details")).alias("usage")))
    return calls(spark, d).select("id", R.usage_of(body).alias("u")).select("id", "u.*")


@query("b36_stream_usage", """SELECT id, output_tokens AS output, CASE WHEN event_type = 'error' THEN 'response.failed' ELSE 'response.completed' END AS kind,
 CASE WHEN k % 5 = 0 THEN 'priority' WHEN k % 5 = 1 THEN 'default' WHEN k % 5 = 2 THEN 'flex' ELSE 'auto' END AS tier FROM calls""")
def b36(spark, d):
    """Bodies of every call: usage at the end, a tier in the first event, in the last, in both, or only auto."""
    def line(kind, output, tier):
        usage = F.when(output.isNotNull(), F.struct(output.alias("output_tokens")))
        return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), F.struct(usage.alias("usage"), tier.alias("service_tier")).alias("response"))))

    k, none = F.col("k") % 5, F.lit(None)
    early = F.when(k == 2, "flex").otherwise("auto")  # what the end says wins, unless it says nothing
    late = F.when(k == 0, "priority").when(k == 1, "default").when(k == 3, "auto")
    end = F.when(F.col("event_type") == "error", "response.failed").otherwise("response.completed")
    body = F.concat_ws(
        "\n", F.lit("event: x"), line(F.lit("response.created"), F.lit(0), F.lit("auto")), line(F.lit("response.in_progress"), F.lit(1), early), line(F.lit("response.output_text.delta"), none.cast("long"), F.lit("delta")),
        line(end, F.col("output_tokens"), late), F.lit("data: [DONE]"),
    )
    found = calls(spark, d).select("id", R.stream_summary(body).alias("s"))
    return found.select("id", R.usage_of(F.concat(F.lit('{"usage":'), F.col("s.usage"), F.lit("}")))["output"].alias("output"), "s.kind", "s.tier")


@query("b38_live_phases", "SELECT CASE WHEN t_ttfb IS NOT NULL THEN 'responding' WHEN account IS NOT NULL THEN 'requesting' ELSE 'queued' END AS phase, count(*) AS n FROM calls WHERE flying GROUP BY 1")
def b38(spark, d):
    phase = F.when(F.col("status") == "pending", "queued").when(F.col("t_ttfb").isNotNull() | F.col("first_token").isNotNull(), "responding").when(F.col("account").isNotNull() | F.col("t_connect").isNotNull(), "requesting").otherwise("queued")
    return calls(spark, d).where(status.in_flight(F.col("status"))).groupBy(phase.alias("phase")).agg(F.count("*").alias("n"))


@query("b39_account_http_class", "SELECT CASE status WHEN 'http_429' THEN 'rate_limited' WHEN 'http_401' THEN 'reauthenticate' ELSE 'upstream_error' END AS label, count(*) AS n FROM calls WHERE status LIKE 'http_%' AND status <> 'http_200' GROUP BY 1")
def b39(spark, d):
    code, low = F.regexp_extract("status", r"^http_(\d{3})$", 1).cast("int"), F.lower(F.coalesce("error_message", F.lit("")))
    label = F.when((code == 429) & (low.contains("quota") | low.contains("usage limit")), "quota_exhausted").when(code == 429, "rate_limited").when(code == 402, "payment_required").when(code == 413, "too_large").when(code.isin(401, 403), "reauthenticate").when(code >= 500, "upstream_error").otherwise("other")
    return calls(spark, d).where("status like 'http_%' and status <> 'http_200'").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("c14_sticky_keys", "SELECT epoch // 3600 * 3600 AS hour, account, conversation AS sticky_key, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, max(epoch) AS last_seen FROM calls WHERE account IS NOT NULL AND conversation IS NOT NULL GROUP BY ALL")
def c14(spark, d):
    rows = calls(spark, d).where("account is not null and conversation is not null")
    return rows.groupBy(T.hour(), "account", F.col("conversation").alias("sticky_key")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.max("epoch").alias("last_seen"))


NODE_HOURS = "SELECT proxy_key, epoch // 3600 * 3600 AS hour, count(*) AS n, count(*) FILTER (WHERE is_success) AS success, count(*) FILTER (WHERE NOT is_success) AS failure, count(latency_ms) AS timed, round(sum(latency_ms), 6) AS latency_ms, max(latency_ms) AS latency_most FROM nodes GROUP BY 1, 2"


@query("c15_node_hours", NODE_HOURS)
def c15(spark, d):
    return R.node_hours(adapter.node_attempts(calls(spark, d)))


@query("c16_node_last_by_hour", "SELECT proxy_key, epoch // 3600 * 3600 AS hour, min(latency_ms) AS least, max(latency_ms) AS most, round(avg(latency_ms), 6) AS mean, arg_max(latency_ms, epoch * 1000000000 + id) AS last FROM nodes GROUP BY 1, 2")
def c16(spark, d):
    v = F.col("latency_ms")
    return adapter.node_attempts(calls(spark, d)).groupBy("proxy_key", T.hour()).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.max_by(v, F.struct("epoch", "id")).alias("last"))


@query("c17_network_minutes", "SELECT epoch // 60 * 60 AS minute, source, CASE WHEN broken THEN '__unknown__' ELSE 'host-' || user_id % 3 || '.example' END AS host, CAST(sum(CASE WHEN broken THEN 0 ELSE output_tokens * 4 END) AS BIGINT) AS download FROM calls GROUP BY ALL")
def c17(spark, d):
    down = cost.bytes_of(F.get_json_object("payload", "$.upstreamApproxDownloadBytes").cast("long"))
    return calls(spark, d).groupBy(F.expr("epoch div 60 * 60").alias("minute"), "source", cost.host(F.get_json_object("payload", "$.upstreamBaseUrlHost")).alias("host")).agg(F.sum(down).alias("download"))


@query("c25_record_summary", """SELECT count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(avg(total_tokens), 6) AS tokens_mean, max(total_tokens) AS tokens_most, CAST(sum(cache_tokens) AS BIGINT) AS cache_read, CAST(sum(output_tokens) AS BIGINT) AS output, round(coalesce(sum(cost), 0), 10) AS cost,
 round(avg(t_ttfb), 6) AS ttfb_mean, round(quantile_cont(t_ttfb, 0.95), 6) AS ttfb_p95, round(quantile_cont(t_stream, 0.95) FILTER (WHERE t_stream > 0), 6) AS stream_p95, count(*) FILTER (WHERE t_stream > 0) AS streamed, round(quantile_cont(t_total, 0.95), 6) AS total_p95,
 count(*) FILTER (WHERE fclass = 'service_failure') AS service_failures, count(*) FILTER (WHERE fclass = 'client_failure') AS client_failures FROM paid WHERE model = 'model-b'""")
def c25(spark, d):
    return R.summary(paid(spark, d).where("model = 'model-b'"))


#: The payload's fields of a call.
PAYLOADS = """, sent AS (SELECT *, CASE WHEN NOT broken THEN model END AS request_model, CASE WHEN NOT broken AND k % 6 = 0 THEN model || '-mini' END AS response_model, CASE WHEN NOT broken THEN ['/v1/responses', '/v1/chat/completions', '/v1/responses/compact'][k % 3 + 1] END AS endpoint,
 CASE WHEN status = 'http_429' THEN 'http_429' WHEN status = 'http_401' THEN 'invalid_api_key' WHEN status = 'http_502' THEN 'upstream_stream_error' WHEN status = 'failed' THEN 'downstream_closed' END AS kind, CASE WHEN NOT broken AND k % 7 <> 0 THEN conversation END AS sticky_key,
 CASE WHEN NOT broken THEN conversation END AS prompt_cache_key, CASE WHEN NOT broken THEN '10.0.0.' || user_id % 9 END AS requester_ip, CASE WHEN NOT broken THEN 'node-' || user_id % 5 END AS proxy_name, CASE WHEN NOT broken AND k % 5 = 0 THEN 'priority' END AS service_tier,
 CASE WHEN NOT broken THEN effort END AS reasoning_effort FROM paid)
"""
FACETS = ("model", "request_model", "response_model", "endpoint", "kind", "sticky_key", "prompt_cache_key", "requester_ip", "proxy_name", "account", "service_tier", "reasoning_effort")
_FACET_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM sent WHERE source = 'proxy' AND {f} IS NOT NULL {'' if f == 'model' else chr(65) + 'ND model = ' + repr('model-a')} {'' if f == 'endpoint' else chr(65) + 'ND endpoint = ' + repr('/v1/responses')} GROUP BY 2"
    for f in FACETS
)


@query("c26_facets", f"{PAYLOADS} SELECT * FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY field) > 5 AS has_more FROM ({_FACET_SQL})) WHERE rank <= 5")
def c26(spark, d):
    rows = T.classified(R.with_payload(calls(spark, d))).where("source = 'proxy'")
    return R.facets(rows, list(FACETS), {"model": F.col("model") == "model-a", "endpoint": F.col("endpoint") == "/v1/responses"}, 5)


@query("c31_roster", "SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'oauth') AS oauth, count(*) FILTER (WHERE kind = 'api_key') AS api_key, count(*) FILTER (WHERE NOT enabled) AS attention, CAST(sum(n) AS BIGINT) AS calls FROM accounts LEFT JOIN (SELECT account, count(*) AS n FROM calls GROUP BY 1) USING (account)")
def c31(spark, d):
    used = calls(spark, d).where("account is not null").groupBy("account").agg(F.count("*").alias("n"))
    return adapter.accounts(spark).join(used, "account", "left").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "oauth").alias("oauth"), F.count_if(F.col("kind") == "api_key").alias("api_key"), F.count_if(~F.col("enabled")).alias("attention"), F.sum("n").alias("calls"))


@query("c33_node_profiles", """, used AS (SELECT * FROM nodes WHERE NOT is_probe), kinds AS (SELECT proxy_key, string_agg(kind || ':' || m, ',' ORDER BY m DESC, kind) AS failures FROM (SELECT proxy_key, coalesce(failure_kind, 'unknown') AS kind, count(*) AS m FROM used WHERE NOT is_success GROUP BY 1, 2) GROUP BY 1),
 found AS (SELECT proxy_key, count(*) AS n, round(avg(CASE WHEN is_success THEN 1.0 ELSE 0.0 END), 9) AS success_rate, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM used GROUP BY 1)
 SELECT k.proxy_key, coalesce(n, 0) AS n, coalesce(success_rate, 0.65) AS success_rate, p50, p95, coalesce(failures, '') AS failures FROM (SELECT 'node-' || i AS proxy_key FROM range(6) r(i)) k LEFT JOIN found USING (proxy_key) LEFT JOIN kinds USING (proxy_key)""")
def c33(spark, d):
    return R.node_profiles(adapter.node_attempts(calls(spark, d)), adapter.nodes(spark))


@query("c34_distinct_conversations", "SELECT source, count(DISTINCT conversation) AS conversations, count(DISTINCT conversation) FILTER (WHERE flying) AS flying FROM calls GROUP BY 1")
def c34(spark, d):
    rows = T.classified(calls(spark, d))
    return rows.groupBy("source").agg(F.countDistinct("conversation").alias("conversations"), F.countDistinct(F.when(F.col("flying"), F.col("conversation"))).alias("flying"))


@query("c35_busy_hours", "SELECT epoch // 3600 * 3600 AS hour, count(*) AS n FROM calls GROUP BY 1 HAVING count(*) >= 3")
def c35(spark, d):
    return calls(spark, d).groupBy(T.hour()).agg(F.count("*").alias("n")).where("n >= 3")


@query("c38_conversation_lifetimes", "SELECT conversation, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, min(epoch) AS first_seen, max(epoch) AS last_seen FROM calls WHERE conversation IS NOT NULL GROUP BY 1")
def c38(spark, d):
    all_ = paid(spark, d)
    part = lambda c: T.conversation_rollup(all_.where(c)).select("conversation", "n", "tokens", "first_seen", "last_seen")
    return T.merged([part(f"epoch < {START}"), part(f"epoch >= {START}")], ["conversation"], sums=["n", "tokens"], lows=["first_seen"], highs=["last_seen"])


@query("c42_account_report", "SELECT account, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(coalesce(sum(cost), 0), 10) AS cost, round(sum(cache_tokens) / nullif(sum(input_tokens), 0)::DOUBLE, 9) AS cache_hit, max(epoch) AS last_call FROM (SELECT * REPLACE (coalesce(account, -1) AS account) FROM paid) GROUP BY 1")
def c42(spark, d):
    rows = paid(spark, d).groupBy(F.coalesce("account", F.lit(-1)).alias("account")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), T.total(F.col("cost")).alias("cost"), F.round(cost.ratio(F.sum("cache_tokens"), F.sum("input_tokens")), 9).alias("cache_hit"), F.max("epoch").alias("last_call"))
    return rows.orderBy(F.col("account") == -1, F.desc("tokens"))


WINDOWS = " UNION ALL ".join(f"SELECT proxy_key, '{n}' AS span, count(*) AS n, count(*) FILTER (WHERE is_success) AS success, round(avg(latency_ms) FILTER (WHERE is_success), 6) AS mean_ms FROM nodes WHERE epoch < {START} AND epoch >= {START - s} GROUP BY 1" for n, s in R.TRAILING.items())


@query("d13_trailing_windows", WINDOWS)
def d13(spark, d):
    return R.trailing_windows(adapter.node_attempts(calls(spark, d)), START)


@query("d15_carried_forward", f"SELECT proxy_key, b AS hour, (SELECT arg_max(most, hour) FROM h WHERE h.proxy_key = k.proxy_key AND h.hour <= b) AS latency_most FROM (SELECT DISTINCT proxy_key FROM h) k CROSS JOIN range({START}, {START + 172800}, 3600) r(b)".replace("SELECT", ", h AS (SELECT proxy_key, epoch // 3600 * 3600 AS hour, max(latency_ms) AS most FROM nodes GROUP BY 1, 2) SELECT", 1))
def d15(spark, d):
    return R.carried_forward(R.node_hours(adapter.node_attempts(calls(spark, d))), START, START + 172_800, "latency_most").select("proxy_key", "hour", "latency_most")


@query("d16_quota_windows", f"SELECT account, s AS start, e AS \"end\", count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls JOIN (SELECT account, arg_max(resets, captured * 1000000000 + id) - 18000 AS s, least(arg_max(resets, captured * 1000000000 + id), {NOW}) AS e FROM samples GROUP BY 1) USING (account) WHERE epoch >= s AND epoch < e GROUP BY ALL")
def d16(spark, d):
    c = calls(spark, d)
    return R.quota_windows(adapter.limit_samples(c), c, NOW)


@query("e1_rollup_and_tail", f"SELECT count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 10) AS cost FROM paid WHERE epoch >= {START + 1234} AND epoch < {START + 90000}")
def e1(spark, d):
    from ..plans.ranges import split

    all_ = paid(spark, d)
    head, whole, tail = split(START + 1234, START + 90_000)
    rolled = T.totals(timing.within(all_, *whole), T.hour(), "source")
    edge = lambda r: T.totals(timing.within(all_, *r))
    parts = [x.select("n", "tokens", "cost") for x in (rolled, edge(head), edge(tail))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 10).alias("cost"))


@query("e2_final_account", "SELECT account, count(*) AS n FROM (SELECT c.id, coalesce(c.account, arg_max(a.account, a.attempt_index)) AS account FROM calls c LEFT JOIN attempts a USING (id) GROUP BY c.id, c.account) GROUP BY 1")
def e2(spark, d):
    c = calls(spark, d)
    met = c.select("id", "account").join(R.final_attempt(adapter.attempts(c), "account"), "id", "left")
    return met.groupBy(F.coalesce("account", "final_account").alias("account")).agg(F.count("*").alias("n"))


@query("e3_final_codec", "SELECT codec, count(*) AS n FROM (SELECT id, CASE WHEN (id - 1) % 4 = 0 THEN CASE WHEN k % 2 = 0 THEN 'zstd' END ELSE CASE WHEN k % 2 = 0 THEN 'gzip' ELSE 'br' END END AS codec FROM calls) GROUP BY 1")
def e3(spark, d):
    return R.final_attempt(adapter.attempts(calls(spark, d)), "codec").groupBy(F.col("final_codec").alias("codec")).agg(F.count("*").alias("n"))


@query("e4_latest_sample", "SELECT account, name, max(captured) AS captured, arg_max(short_percent, captured * 1000000000 + id) AS short_percent FROM samples JOIN accounts USING (account) GROUP BY 1, 2")
def e4(spark, d):
    last = R.latest(adapter.limit_samples(calls(spark, d)), "account", ["captured", "id"])
    return adapter.accounts(spark).join(last, "account").select("account", "name", "captured", "short_percent")


@query("e5_active_histories", f"SELECT conversation, count(*) AS n FROM calls WHERE conversation IN (SELECT conversation FROM calls WHERE epoch >= {START} AND epoch < {START + 21600}) GROUP BY 1")
def e5(spark, d):
    c = calls(spark, d)
    return c.join(timing.within(c, START, START + 21_600).select("conversation"), "conversation", "left_semi").groupBy("conversation").agg(F.count("*").alias("n"))


@query("e8_retry_after_failure", """SELECT id, coalesce(last_value(CASE WHEN NOT flying THEN fclass <> 'none' END IGNORE NULLS) OVER (PARTITION BY conversation ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS retry FROM calls WHERE conversation IS NOT NULL""")
def e8(spark, d):
    return R.retry_after_failure(calls(spark, d)).select("id", "retry")


@query("e9_event_search", "SELECT DISTINCT c.id, a.name FROM calls c JOIN accounts a ON a.account = c.account LEFT JOIN attempts t ON t.id = c.id LEFT JOIN accounts b ON b.account = t.account WHERE event_type = 'error' AND (a.name ILIKE '%ount 3%' OR b.name ILIKE '%OUNT 3%' OR c.invoke_id ILIKE '%V-12%')")
def e9(spark, d):
    """Events by the names of their account, of the accounts that were tried, and of the call."""
    c, named = calls(spark, d), adapter.accounts(spark).select("account", "name")
    tried = adapter.attempts(c.where("event_type = 'error'")).select("id", "account").join(named.withColumnRenamed("name", "tried"), "account").select("id", "tried")
    rows = adapter.account_events(c).join(named, "account").join(tried, "id", "left")
    return rows.where(F.col("name").ilike("%ount 3%") | F.col("tried").ilike("%OUNT 3%") | F.col("invoke_id").ilike("%V-12%")).select("id", "name").distinct()


@query("e10_duplicate_identities", "SELECT a.identity, a.account AS first, b.account AS second, (SELECT count(*) FROM calls c WHERE c.account IN (a.account, b.account)) AS calls FROM accounts a JOIN accounts b ON a.identity = b.identity AND a.account < b.account AND NOT (a.team AND b.team AND a.seat <> b.seat)")
def e10(spark, d):
    used = calls(spark, d).groupBy("account").agg(F.count("*").alias("n"))
    met = R.duplicates(adapter.accounts(spark)).withColumn("account", F.explode(F.array("first", "second"))).join(used, "account", "left")
    return met.groupBy("identity", "first", "second").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls"))


@query("e14_conversation_accounts", f"SELECT conversation, account, count(*) AS n, max(epoch) AS last_seen FROM calls WHERE conversation IS NOT NULL AND id <= {SNAPSHOT} GROUP BY 1, 2")
def e14(spark, d):
    c = calls(spark, d)
    return c.where(F.col("conversation").isNotNull() & (F.col("id") <= snapshot(c))).groupBy("conversation", "account").agg(F.count("*").alias("n"), F.max("epoch").alias("last_seen"))


@query("f1_record_page", f"""{PAYLOADS}, met AS (SELECT * FROM sent WHERE source = 'proxy' AND lower(endpoint) = '/v1/responses' AND total_tokens >= 100 AND fclass = 'none' AND id <= {SNAPSHOT} AND epoch >= {START - 5 * 86400} AND requester_ip IS NOT NULL
 AND (contains(lower(coalesce(conversation, '')), 'conv-1') OR contains(invoke_id, 'conv-1')))
 SELECT id, round(cost, 9) AS cost, (SELECT count(*) FROM met) AS total FROM met ORDER BY met.cost DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20""")
def f1(spark, d):
    rows = T.classified(R.with_payload(paid(spark, d)))
    shown = R.record_list(rows, "cost", number=2, size=20, source="proxy", endpoint="/v1/Responses", min_tokens=100, failure_class="none", snapshot=snapshot(calls(spark, d)), start=START - 5 * 86400, keyword="Conv-1")
    return shown.select("id", F.round("cost", 9).alias("cost"), "total")


@query("f3_new_since_snapshot", f"SELECT count(*) AS n FROM calls WHERE id > {SNAPSHOT} AND source = 'proxy'")
def f3(spark, d):
    c = calls(spark, d)
    return c.where((F.col("id") > snapshot(c)) & (F.col("source") == "proxy")).agg(F.count("*").alias("n"))


@query("f4_locate", "SELECT (SELECT count(*) FROM calls, (SELECT epoch AS e FROM calls WHERE id = 500) WHERE epoch > e OR (epoch = e AND id > 500)) // 50 + 1 AS page")
def f4(spark, d):
    return R.locate(calls(spark, d), "epoch", 500)


@query("f5_keyset_page", f"SELECT id, epoch FROM calls WHERE epoch < {START} OR (epoch = {START} AND id < 5000) ORDER BY epoch DESC, id DESC LIMIT 30")
def f5(spark, d):
    return R.after(calls(spark, d), "epoch", START, 5000, 30).select("id", "epoch")


@query("f6_recent_per_conversation", "SELECT conversation, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY epoch DESC, id DESC) AS rank FROM calls WHERE conversation IS NOT NULL) WHERE rank <= 3")
def f6(spark, d):
    return R.recent_per_key(calls(spark, d), "conversation", 3).select("conversation", "id", "rank")


@query("f7_newest_conversations", "SELECT conversation, min(epoch) AS created FROM calls WHERE conversation IS NOT NULL GROUP BY 1 ORDER BY created DESC, conversation LIMIT 10")
def f7(spark, d):
    return calls(spark, d).where("conversation is not null").groupBy("conversation").agg(F.min("epoch").alias("created")).orderBy(F.desc("created"), "conversation").limit(10)


@query("f7_working_conversations", f"SELECT conversation, greatest(max(epoch) FILTER (WHERE flying), max(epoch) FILTER (WHERE NOT flying)) AS anchor FROM calls WHERE conversation IS NOT NULL AND epoch < {START} GROUP BY 1 HAVING count(*) FILTER (WHERE flying) > 0 OR max(epoch) >= {START - 3600} ORDER BY anchor DESC, conversation LIMIT 10")
def f7_working(spark, d):
    """The working set by its anchor, the last sign of life."""
    return R.working_set(calls(spark, d), START, 3600).select("conversation", F.col("last_seen").alias("anchor")).orderBy(F.desc("anchor"), "conversation").limit(10)


@query("g5_group_catalog", "SELECT g.grp, coalesce(n, 0) AS accounts, coalesce(c, 0) AS calls FROM (SELECT grp FROM accounts UNION SELECT 'group-9') g LEFT JOIN (SELECT grp, count(*) AS n FROM accounts GROUP BY 1) USING (grp) LEFT JOIN (SELECT grp, count(*) AS c FROM calls JOIN accounts USING (account) GROUP BY 1) USING (grp)")
def g5(spark, d):
    a = adapter.accounts(spark)
    names = a.select("grp").union(spark.createDataFrame([("group-9",)], "grp string")).distinct()
    used = calls(spark, d).join(a, "account").groupBy("grp").agg(F.count("*").alias("calls"))
    return names.join(a.groupBy("grp").agg(F.count("*").alias("accounts")), "grp", "left").join(used, "grp", "left").fillna(0)


@query("h5_working_set", f"SELECT conversation, count(*) FILTER (WHERE flying) AS flying, max(epoch) AS last_seen, max(epoch) FILTER (WHERE NOT flying) AS last_terminal, count(*) AS n FROM calls WHERE conversation IS NOT NULL AND epoch < {START} GROUP BY 1 HAVING count(*) FILTER (WHERE flying) > 0 OR max(epoch) >= {START - 3600}")
def h5(spark, d):
    return R.working_set(calls(spark, d), START, 3600)


@query("h10_failures_since_success", """, s AS (SELECT DISTINCT route, proxy_key, epoch FROM nodes) SELECT s.route, s.proxy_key, s.epoch, (SELECT count(*) FROM nodes f WHERE f.route = s.route AND f.proxy_key = s.proxy_key AND NOT f.is_success AND f.status = 'http_502' AND f.epoch BETWEEN s.epoch - 300 AND s.epoch
 AND NOT EXISTS (SELECT 1 FROM nodes g WHERE g.route = f.route AND g.proxy_key = f.proxy_key AND g.is_success AND g.epoch <= s.epoch AND (g.epoch > f.epoch OR (g.epoch = f.epoch AND g.id > f.id)))) AS penalty FROM s""")
def h10(spark, d):
    kind = status.derived_kind(F.col("status"), F.col("error_message"))
    penalised = ~F.col("is_success") & F.coalesce(kind.isin("upstream_handshake_timeout", "failed_contact_upstream", "upstream_stream_error"), F.lit(False))
    return R.failure_penalties(adapter.node_attempts(calls(spark, d)).withColumn("penalised", penalised))


@query("i1_retention", f"SELECT detail, count(*) AS n FROM (SELECT CASE WHEN ({NOW} - epoch) / 86400.0 > 10 AND ok THEN 'structured_only' ELSE 'full' END AS detail FROM calls WHERE ({NOW} - epoch) / 86400.0 <= 25) GROUP BY 1")
def i1(spark, d):
    return R.pruned(calls(spark, d), NOW).groupBy("detail").agg(F.count("*").alias("n"))


@query("i4_quota_compaction", f"SELECT id, epoch AS captured FROM calls WHERE event_type = 'purchase' AND (epoch >= {START} OR id IN (SELECT arg_max(id, epoch * 1000000000 + id) FROM calls WHERE event_type = 'purchase' AND epoch < {START} GROUP BY epoch // 86400))")
def i4(spark, d):
    return R.compacted(adapter.quota_snapshots(calls(spark, d)), START).select("id", "captured")


@query("i8_integrity_audit", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) FILTER (WHERE id % 101 <> 0) AS n_a, count(*) AS n_b FROM calls GROUP BY ALL HAVING count(*) FILTER (WHERE id % 101 = 0) > 0 UNION ALL SELECT 0, 'proxy', 7, 0")
def i8(spark, d):
    """A rollup that misses calls which came late, and holds a bucket without any, against the facts."""
    all_ = paid(spark, d)
    odd = spark.createDataFrame([(0, "proxy", 7, 0, 0.0)], "hour long, source string, n long, tokens long, cost double")
    rollup = T.totals(all_.where("id % 101 <> 0"), T.hour(), "source").select(odd.columns).unionByName(odd)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return R.audit(rollup, T.totals(all_, T.hour(), "source"), ["hour", "source"]).select("hour", "source", zero("n_a"), zero("n_b"))


@query("i15_last_activity", "SELECT account, max(epoch) AS last_seen, min(epoch) AS first_seen FROM calls WHERE account IS NOT NULL GROUP BY 1")
def i15(spark, d):
    c = calls(spark, d)
    days = timing.within(c, None, START).where(F.col("account").isNotNull()).groupBy("account", F.floor(F.col("epoch") / 86400).alias("day")).agg(F.min("epoch").alias("first_seen"), F.max("epoch").alias("last_seen"))
    return R.last_activity(timing.within(c, START), days.drop("day"))


@query("i19_body_search", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]+') OR contains(text, 'License')")
def i19(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.where(F.col("text").rlike('token = "[0-9a-f]+') | F.contains("text", F.lit("License"))).select("doc_id")
