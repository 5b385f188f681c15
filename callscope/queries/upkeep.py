from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status, timing
from ..operators import records as R
from ..operators import series as S
from ..operators import selection
from ..operators import totals as T
from ..operators import upkeep as U
from ..sources import adapter, archive
from ..sources.adapter import NOW
from .registry import SNAPSHOT, calls, paid, query, snapshot
from .series import END, START
from .totals import COUNTS


MANIFEST = "count(*) AS n, min(epoch) AS first, max(epoch) AS last, CAST(sum(id) AS BIGINT) AS id_sum"


@query("a8_archive_manifest", f"SELECT epoch // 86400 AS day, {MANIFEST} FROM calls WHERE epoch < {START} GROUP BY 1")
def a8(spark, d):
    """Written twice, as a job that is done again would; the manifest is of what the files hold."""
    rows, path = timing.within(calls(spark, d), end=START), archive.shared_dir(spark, "archive")
    archive.write(rows, path, "calls")
    return archive.write(rows, path, "calls").drop("checksum")


@query("a2_archive_scan", f"SELECT epoch // 86400 AS day, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls WHERE epoch >= {START - 5 * 86400 + 1234} AND epoch < {START - 86400 + 77} GROUP BY 1")
def a2(spark, d):
    """The files whose days the range touches, out of an archive of all older calls."""
    rows, path = timing.within(calls(spark, d), end=START), archive.shared_dir(spark, "archive")
    archive.write(rows, path, "calls")
    found = archive.read(spark, path, "calls", rows.schema, START - 5 * 86400 + 1234, START - 86400 + 77)
    return found.groupBy(F.floor(F.col("epoch") / 86400).alias("day")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


@query("a12_task_runs", f"SELECT id, epoch, status, (SELECT count(*) FROM calls WHERE event_type = 'error' AND epoch >= {START}) AS total FROM calls WHERE event_type = 'error' AND epoch >= {START} ORDER BY epoch DESC, id DESC LIMIT 20 OFFSET 20")
def a12(spark, d):
    runs = calls(spark, d).select("id", F.col("event_type").alias("kind"), "status", "epoch", "occurred_at")
    return U.task_runs(runs, " error ", " ", START, number=2).select("id", "epoch", "status", "total")


@query("i2_archived_calls", f"SELECT epoch >= {NOW - 20 * 86400} AS live, epoch // 86400 AS day, count(*) AS n FROM calls GROUP BY 1, 2")
def i2(spark, d):
    """Calls older than a limit are in the archive, the others are not; twenty days, as the tables hold thirty."""
    live, stored = archive.moved(calls(spark, d), archive.shared_dir(spark, "archive"), "calls", NOW - 20 * 86400)
    parts = archive.manifest(live).withColumn("live", F.lit(True)), stored.withColumn("live", F.lit(False))
    return parts[0].unionByName(parts[1]).select("live", "day", "n")


@query("i3_archived_sets", f"""SELECT 'node_attempts' AS dataset, epoch // 86400 AS day, {MANIFEST} FROM nodes WHERE epoch < {NOW - 15 * 86400} GROUP BY 2 UNION ALL SELECT 'request_attempts', epoch // 86400, {MANIFEST.replace('id)', 'attempt_id)')} FROM attempts WHERE epoch < {NOW - 7 * 86400} GROUP BY 2""")
def i3(spark, d):
    """Sets of attempts in one archive, each with a limit of its own."""
    c, path = calls(spark, d), archive.shared_dir(spark, "archive")
    tries = adapter.attempts(c).drop("id").withColumnRenamed("attempt_id", "id")
    sets = ("node_attempts", adapter.node_attempts(c), 15), ("request_attempts", tries, 7)
    parts = [archive.moved(rows, path, name, NOW - days * 86400)[1].withColumn("dataset", F.lit(name)) for name, rows, days in sets]
    return parts[0].unionByName(parts[1]).drop("checksum")


@query("b27_billing_tier", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN id % 3 = 0 THEN 'flex' WHEN account % 2 = 0 AND NOT broken AND k % 5 = 0 THEN 'priority' ELSE 'default' END AS tier FROM calls) GROUP BY 1")
def b27(spark, d):
    tier = U.billing_tier(F.when(F.col("id") % 3 == 0, " Flex "), F.get_json_object("payload", "$.serviceTier"), F.lit("default"), F.col("account") % 2 == 0)
    return calls(spark, d).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("b28_compression", "SELECT source, CAST(sum(input_tokens * 4 - input_tokens) AS BIGINT) AS saved, round(avg(75.0::DOUBLE), 6) AS percent FROM calls WHERE input_tokens > 0 AND NOT flying GROUP BY 1")
def b28(spark, d):
    from ..functions import cost, status

    v = cost.saved(F.col("input_tokens") * 4, F.col("input_tokens"), status.terminal(F.col("status")))
    return calls(spark, d).select("source", v.alias("v")).where("v is not null").groupBy("source").agg(F.sum("v.bytes").alias("saved"), F.round(F.avg("v.percent"), 6).alias("percent"))


@query("b31_account_status", f"""SELECT account, last_call, CASE WHEN NOT enabled THEN 'disabled' WHEN last_class IN ('service_failure', 'client_failure') THEN 'failing' WHEN last_call >= {START - 86400} THEN 'active' ELSE 'idle' END AS state
 FROM accounts LEFT JOIN (SELECT account, max(epoch) AS last_call, arg_max(fclass, epoch * 1000000000 + id) AS last_class FROM calls WHERE epoch < {START} AND account IS NOT NULL GROUP BY 1) USING (account)""")
def b31(spark, d):
    return U.account_status(calls(spark, d), adapter.accounts(spark), START)


@query("b37_display_status", "SELECT CASE WHEN fclass <> 'none' AND status IN ('success', 'running', 'pending') THEN 'failed' ELSE status END AS shown, count(*) AS n FROM calls GROUP BY 1")
def b37(spark, d):
    return T.classified(calls(spark, d)).groupBy(U.display_status(F.col("status"), F.col("class")).alias("shown")).agg(F.count("*").alias("n"))


@query("b40_model_failures", "SELECT model, count(*) FILTER (WHERE id % 2 = 0) AS unsupported, count(*) FILTER (WHERE id % 2 = 1) AS missing FROM calls WHERE event_type = 'error' GROUP BY 1")
def b40(spark, d):
    text = F.concat(F.lit("The model "), F.upper("model"), F.when(F.col("id") % 2 == 0, " is not supported").otherwise(" does not exist"))
    label = U.model_failure(F.col("status"), text, F.col("model"))
    return calls(spark, d).where("event_type = 'error'").groupBy("model").agg(F.count_if(label == "unsupported_model").alias("unsupported"), F.count_if(label == "model_not_found").alias("missing"))


@query("c4_all_time", f"SELECT {COUNTS} FROM paid")
def c4(spark, d):
    """Rollups of what is materialised, facts for the rest."""
    all_ = paid(spark, d)
    cursor, columns = snapshot(all_), ["n", "success", "failure", "tokens", "cost", "non_success_cost"]
    rolled, tail = T.totals(all_.where(F.col("id") <= cursor), T.hour(), "source").select(columns), T.totals(all_.where(F.col("id") > cursor))
    return T.merged([rolled.withColumn("key", F.lit(1)), tail.withColumn("key", F.lit(1))], ["key"], sums=columns).select(*(F.round(c, 10).alias(c) if "cost" in c else c for c in columns))


PHASE = "CASE WHEN status = 'pending' THEN 'queued' WHEN t_ttfb > 100 THEN 'responding' WHEN account IS NOT NULL THEN 'requesting' ELSE 'queued' END"


@query("c13_unassigned_activity", f"""SELECT coalesce(account, -1) AS account, count(*) FILTER (WHERE NOT flying) AS n, count(*) FILTER (WHERE flying AND {PHASE} = 'queued') AS queued, count(*) FILTER (WHERE flying AND {PHASE} = 'requesting') AS requesting,
 count(*) FILTER (WHERE flying AND {PHASE} = 'responding') AS responding, max(epoch) FILTER (WHERE NOT flying AND (conversation IS NULL OR broken)) AS last_unkeyed FROM calls GROUP BY 1""")
def c13(spark, d):
    """Terminal calls by account, -1 for none, with the phases of calls in flight beside them; a first byte counts once it took 100 ms."""
    late = F.when(F.col("t_ttfb") > 100, F.col("t_ttfb"))
    rows = T.classified(R.with_payload(calls(spark, d))).withColumn("phase", F.when(F.col("flying"), status.live_phase(F.col("status"), late, F.col("account"))))
    phases = (F.count_if(F.col("phase") == p).alias(p) for p in ("queued", "requesting", "responding"))
    unkeyed = ~F.col("flying") & F.col("prompt_cache_key").isNull()
    return rows.groupBy(F.coalesce("account", F.lit(-1)).alias("account")).agg(F.count_if(~F.col("flying")).alias("n"), *phases, F.max(F.when(unkeyed, F.col("epoch"))).alias("last_unkeyed"))


@query("c32_system_status", f"SELECT count(*) FILTER (WHERE flying) AS live, count(*) FILTER (WHERE ok AND fclass = 'none') AS success, count(*) FILTER (WHERE NOT flying AND fclass <> 'none') AS non_success, count(*) FILTER (WHERE epoch < {START}) AS archived, count(DISTINCT epoch // 86400) FILTER (WHERE epoch < {START}) AS batches, CAST(sum(CASE WHEN NOT broken THEN input_tokens * 4 ELSE 8 END) FILTER (WHERE epoch < {START}) AS BIGINT) AS bytes FROM calls")
def c32(spark, d):
    """Calls and what the archive holds of them; bytes are those that calls say they sent."""
    from ..functions import cost

    rows = T.classified(calls(spark, d))
    live = rows.agg(F.count_if("flying").alias("live"), F.count_if(F.col("ok") & (F.col("class") == "none")).alias("success"), F.count_if(~F.col("flying") & (F.col("class") != "none")).alias("non_success"))
    old = timing.within(rows, end=START).withColumn("sent", cost.bytes_of(F.get_json_object("payload", "$.upstreamApproxUploadBytes").cast("long"), F.length("payload")))
    days = old.groupBy(F.floor(F.col("epoch") / 86400).alias("day")).agg(F.count("*").alias("n"), F.sum("sent").alias("sent"))
    return live.join(F.broadcast(days.agg(F.sum("n").alias("archived"), F.count("*").alias("batches"), F.sum("sent").alias("bytes"))))


LIVE_PHASE = "CASE WHEN t_ttfb > 100 THEN 'responding' WHEN account IS NOT NULL THEN 'requesting' ELSE 'queued' END"


@query("c40_open_summary", f"""SELECT count(DISTINCT conversation) FILTER (WHERE flying) AS open, count(DISTINCT conversation) FILTER (WHERE flying AND retry) AS retried, round(avg({NOW} - epoch) FILTER (WHERE flying), 6) AS mean_wait, count(*) FILTER (WHERE flying AND {LIVE_PHASE} = 'queued') AS queued,
 count(*) FILTER (WHERE flying AND {LIVE_PHASE} = 'requesting') AS requesting, count(*) FILTER (WHERE flying AND {LIVE_PHASE} = 'responding') AS responding, round(coalesce(sum(cost) FILTER (WHERE lost), 0), 9) AS non_success_cost, CAST(coalesce(sum(total_tokens) FILTER (WHERE lost), 0) AS BIGINT) AS non_success_tokens
 FROM (SELECT *, status = 'interrupted' OR (NOT flying AND fclass <> 'none') AS lost, coalesce(last_value(CASE WHEN NOT flying THEN fclass <> 'none' END IGNORE NULLS) OVER (PARTITION BY conversation ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS retry FROM paid WHERE conversation IS NOT NULL)""")
def c40(spark, d):
    """Conversations in progress, how long their calls wait, in which phase, and what failures have cost; a first byte counts once it took 100 ms."""
    late = F.when(F.col("t_ttfb") > 100, F.col("t_ttfb"))
    rows = R.retry_after_failure(paid(spark, d)).withColumn("phase", F.when(F.col("flying"), status.live_phase(F.col("status"), late, F.col("account"))))
    open_ = F.when(F.col("flying"), F.col("conversation"))
    return rows.agg(
        F.countDistinct(open_).alias("open"), F.countDistinct(F.when(F.col("retry"), open_)).alias("retried"), F.round(F.avg(F.when(F.col("flying"), NOW - F.col("epoch"))), 6).alias("mean_wait"),
        *(F.count_if(F.col("phase") == p).alias(p) for p in ("queued", "requesting", "responding")), T.total(F.when(T.lost(), F.col("cost")), 9).alias("non_success_cost"),
        F.coalesce(F.sum(F.when(T.lost(), F.col("total_tokens"))), F.lit(0)).alias("non_success_tokens"),
    )


@query("c41_capabilities", """, seen AS (SELECT *, ['compact', 'search', 'responses', 'chat', 'image_tool', 'image_endpoint'][id % 6 + 1] AS axis, CASE WHEN status = 'http_401' THEN CASE WHEN id % 2 = 0 THEN 404 ELSE 400 END END AS code FROM attempts WHERE account IS NOT NULL),
 known AS (SELECT *, CASE WHEN status IN ('success', 'completed', 'warning_success', 'http_200') THEN 'supported' WHEN code = 404 AND axis IN ('search', 'responses', 'chat', 'compact') THEN 'unsupported' WHEN code = 400 THEN 'unsupported' END AS state FROM seen)
 SELECT account, axis, arg_max(state, epoch * 1000000000 + attempt_id) AS state, count(*) AS observations FROM known WHERE state IS NOT NULL GROUP BY 1, 2""")
def c41(spark, d):
    """Attempts over six endpoints; one kind of error says that the endpoint isn't supported, as a missing path or as a bad request."""
    paths = F.array(*(F.lit(p) for p in U.AXES.values()))
    rows = adapter.attempts(calls(spark, d)).withColumn("endpoint", F.element_at(paths, (F.col("id") % 6).cast("int") + 1))
    denied = F.col("status") == "http_401"
    code = F.when(denied, F.when(F.col("id") % 2 == 0, "http_404").otherwise("http_400")).otherwise(F.col("status"))
    rows = rows.withColumns({"status": code, "error_message": F.when(denied, "Unsupported endpoint for this account").otherwise(F.col("error_message"))})
    return U.latest_capability(rows)


@query("d4_folded_minutes", "SELECT epoch // 3600 * 3600 AS bucket, count(t_total) AS samples, round(quantile_cont(t_total, 0.95), 6) AS p95 FROM calls GROUP BY 1 HAVING count(t_total) > 0")
def d4(spark, d):
    """Minutes keep each of their values with its count; wider buckets add these up and select from them."""
    value = F.struct(F.expr("epoch div 60 * 60").alias("minute"), "t_total")
    minutes = calls(spark, d).where("t_total is not null").groupBy(value.alias("x")).agg(F.count("*").alias("n")).select("x.minute", F.col("x.t_total").alias("ms"), "n")
    rows = minutes.select(F.expr("minute div 3600 * 3600").alias("bucket"), "ms", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    folded = rows.groupBy("bucket").agg(F.count("*").alias("samples"))
    return folded.join(selection.percentiles(rows, ["bucket"], {"p95": F.col("ms")}, (0.95,)), "bucket").select("bucket", "samples", F.round(F.col("p95")[0], 6).alias("p95"))


@query("d5b_active_minutes", f"SELECT CAST(sum(c) AS BIGINT) AS conversation_minutes, count(*) AS active_minutes, round(sum(c) / count(*)::DOUBLE, 9) AS mean FROM (SELECT epoch // 60, count(DISTINCT conversation) AS c FROM calls WHERE conversation IS NOT NULL AND epoch >= {START} AND epoch < {END} GROUP BY 1)")
def d5b(spark, d):
    """Hourly scalars for whole hours; no edges in this range."""
    hours = S.distinct_minutes(timing.within(calls(spark, d), START, END))
    out = hours.agg(F.sum("conversation_minutes").alias("conversation_minutes"), F.sum("active_minutes").alias("active_minutes"))
    return out.withColumn("mean", F.round(F.col("conversation_minutes") / F.col("active_minutes"), 9))


@query("d10_last_second", "SELECT source, CAST(sum(input_tokens) * 4 AS BIGINT) AS bytes FROM calls WHERE epoch = (SELECT max(epoch) FROM calls) GROUP BY 1")
def d10(spark, d):
    c = calls(spark, d)
    last = c.agg(F.max("epoch").alias("last"))
    return c.join(F.broadcast(last), F.col("epoch") == F.col("last")).groupBy("source").agg((F.sum("input_tokens") * 4).alias("bytes"))


@query("d14_node_day", f"SELECT proxy_key, b AS hour, coalesce(n, 0) AS n FROM (SELECT DISTINCT proxy_key FROM nodes) k CROSS JOIN range({START}, {START + 86400}, 3600) r(b) LEFT JOIN (SELECT proxy_key, epoch // 3600 * 3600 AS h, count(*) AS n FROM nodes GROUP BY 1, 2) x ON x.proxy_key = k.proxy_key AND h = b".replace("SELECT proxy_key, b", "SELECT k.proxy_key, b"))
def d14(spark, d):
    from ..functions import status, timing

    attempts = adapter.node_attempts(calls(spark, d))
    hours = R.node_hours(timing.within(attempts, START, START + 86400)).select("proxy_key", "hour", "n")
    grid = attempts.select("proxy_key").distinct().join(F.broadcast(timing.spine(spark, START, START + 86400, 3600).withColumnRenamed("bucket", "hour")))
    return grid.join(hours, ["proxy_key", "hour"], "left").fillna(0)


@query("d22_hidden_conversations", "SELECT count(DISTINCT conversation) AS total, least(count(DISTINCT conversation), 5) AS shown, greatest(count(DISTINCT conversation) - 5, 0) AS hidden FROM calls")
def d22(spark, d):
    return U.hidden_conversations(calls(spark, d), 5)


@query("e7_node_aliases", "SELECT CASE proxy_key WHEN 'node-1' THEN 'node-0' ELSE proxy_key END AS node, count(*) AS n FROM nodes GROUP BY 1")
def e7(spark, d):
    alias = spark.createDataFrame([("node-1", "node-0")], "proxy_key string, canonical string")
    rows = adapter.node_attempts(calls(spark, d)).join(F.broadcast(alias), "proxy_key", "left")
    return rows.groupBy(F.coalesce("canonical", "proxy_key").alias("node")).agg(F.count("*").alias("n"))


@query("e11_account_attempts", "SELECT a.attempt_id, a.attempt_index, c.conversation, x.name FROM attempts a JOIN calls c USING (id) LEFT JOIN accounts x ON x.account = a.account WHERE a.account = 3")
def e11(spark, d):
    c = calls(spark, d)
    rows = adapter.attempts(c).where("account = 3").join(c.select("id", "conversation"), "id").join(adapter.accounts(spark), "account", "left")
    return rows.select("attempt_id", "attempt_index", "conversation", "name")


@query("e15_due_accounts", f"""SELECT account, captured, coalesce(percent >= 90, FALSE) AS exhausted, CASE WHEN captured IS NULL THEN 'never' WHEN percent >= 90 AND resets <= {NOW} THEN 'reset' ELSE 'interval' END AS reason FROM accounts LEFT JOIN (SELECT account, max(captured) AS captured, arg_max(short_percent, captured * 1000000000 + id) AS percent,
 arg_max(resets, captured * 1000000000 + id) AS resets FROM samples GROUP BY 1) USING (account) WHERE enabled AND (captured IS NULL OR (percent >= 90 AND resets <= {NOW}) OR captured < {NOW - 3600})""")
def e15(spark, d):
    return U.due_accounts(adapter.limit_samples(calls(spark, d)), adapter.accounts(spark), NOW, 3600)


@query("e16_sticky_report", f"SELECT conversation AS sticky_key, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE epoch >= {START} AND epoch < {END}) AS points FROM calls WHERE account = 3 AND conversation IS NOT NULL GROUP BY 1")
def e16(spark, d):
    rows = calls(spark, d).where("account = 3 and conversation is not null")
    return rows.groupBy(F.col("conversation").alias("sticky_key")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.count_if((F.col("epoch") >= START) & (F.col("epoch") < END)).alias("points"))


@query("f8_request_points", f"SELECT id, epoch, CASE WHEN flying THEN 'in_flight' WHEN fclass <> 'none' THEN 'failure' ELSE 'success' END AS outcome FROM calls WHERE conversation = 'conv-3' AND epoch >= {START} AND epoch < {END}")
def f8(spark, d):
    from ..functions import status

    rows = R.scan(calls(spark, d), START, END).where("conversation = 'conv-3'")
    return rows.select("id", "epoch", status.outcome(F.col("status"), F.col("error_message")).alias("outcome")).orderBy("epoch", "id")


@query("f10_events_with_key", "SELECT id FROM calls WHERE event_type = 'error' AND conversation = 'conv-3' ORDER BY id LIMIT 20")
def f10(spark, d):
    rows = calls(spark, d).where("event_type = 'error'").withColumn("keys", F.to_json(F.array_compact(F.array("conversation", F.lit("x")))))
    return rows.where(F.array_contains(F.from_json("keys", "array<string>"), "conv-3")).select("id").orderBy("id").limit(20)


@query("g6_orphan_bodies", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM calls WHERE id % 2 = 0 UNION SELECT id * 2 FROM calls WHERE id % 3 = 0 UNION SELECT id * 3 + 1 FROM attempts)")
def g6(spark, d):
    """Stored bodies that no request, response or attempt names."""
    c = calls(spark, d)
    used = c.where("id % 2 = 0").select("id").union(c.where("id % 3 = 0").select(F.col("id") * 2)).union(adapter.attempts(c).select(F.col("id") * 3 + 1)).distinct()
    return spark.read.parquet(f"{d}/documents.parquet").join(used, F.col("doc_id") == F.col("id"), "left_anti").select("doc_id")


@query("h11_stream_error_pairs", """, done AS (SELECT account, epoch, attempt_id, status = 'http_502' AS bad, epoch // 3600 * 3600 AS hour FROM attempts WHERE account IS NOT NULL AND status NOT IN ('running', 'pending')),
 tried AS (SELECT *, lag(bad) OVER w AS bad_before, lag(epoch) OVER w AS before, row_number() OVER (PARTITION BY account, hour ORDER BY epoch DESC, attempt_id DESC) AS rank FROM done WINDOW w AS (PARTITION BY account ORDER BY epoch, attempt_id))
 SELECT account, hour, coalesce(bad AND bad_before AND epoch - before <= 300, FALSE) AS escaped, CASE WHEN bad AND bad_before AND epoch - before <= 300 THEN epoch + 300 END AS until FROM tried WHERE rank = 1""")
def h11(spark, d):
    return U.stream_error_escapes(adapter.attempts(calls(spark, d)))


@query("h12_overlay", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) AS n, count(*) FILTER (WHERE flying) AS flying, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1, 2")
def h12(spark, d):
    """Stored hours of a first read, in which a tenth of the calls were still running, brought to a second read by what has changed between them."""
    now = T.classified(calls(spark, d)).select("id", T.hour(), "source", "flying", "total_tokens")
    last, running = snapshot(now), F.col("id") % 10 == 3
    before = now.where(F.col("id") <= last).withColumns({"flying": F.col("flying") | running, "total_tokens": F.when(running, 0).otherwise(F.col("total_tokens"))})
    stored = U.signed_totals(before.withColumn("sign", F.lit(1)))
    ended = now.where((F.col("id") <= last) & running).select("id")
    taken_back = before.join(ended, "id", "left_semi").withColumn("sign", F.lit(-1))
    arrived = now.where((F.col("id") > last) | running).withColumn("sign", F.lit(1))
    return U.overlaid(stored, U.signed_totals(taken_back.unionByName(arrived)))


@query("h14_coverage", f"SELECT epoch // 3600 * 3600 AS hour, source AS scope, count(*) AS n, bool_and(id <= {SNAPSHOT}) AS complete FROM calls GROUP BY 1, 2")
def h14(spark, d):
    c = calls(spark, d)
    return U.coverage(c, snapshot(c))


@query("h16_horizon", f"SELECT epoch // 60 * 60 AS minute, count(*) AS n FROM calls WHERE epoch >= {NOW - 10 * 86400} GROUP BY 1")
def h16(spark, d):
    return timing.within(calls(spark, d), NOW - 10 * 86400).groupBy(F.expr("epoch div 60 * 60").alias("minute")).agg(F.count("*").alias("n"))


@query("i10_reconstructable", "SELECT max(x) + 1 AS since FROM range(19723, 19753) r(x) WHERE x NOT IN (SELECT epoch // 86400 FROM calls WHERE epoch // 86400 <> 19730)")
def i10(spark, d):
    days = U.manifest(calls(spark, d)).where("day <> 19730")
    return U.reconstructable_since(days, 19_723, 19_752)


@query("i11_usage_backfill", "SELECT id, input_tokens, output_tokens FROM calls")
def i11(spark, d):
    c = calls(spark, d)
    bodies = c.where("id % 3 = 0").select("id", F.to_json(F.struct(F.struct("input_tokens", "output_tokens").alias("usage"))).alias("body"))
    blank = c.withColumns({x: F.when(F.col("id") % 3 != 0, F.col(x)) for x in ("input_tokens", "output_tokens")})
    return U.backfilled(blank, bodies, R.usage_of(F.col("body"))).select("id", "input_tokens", "output_tokens")


@query("i12_cost_backfill", "SELECT id, round(cost, 9) AS cost, CASE WHEN id % 2 <> 0 OR cost IS NOT NULL THEN 'v2' WHEN id % 4 <> 0 THEN 'v1' END AS price_version FROM paid")
def i12(spark, d):
    """Half of the calls lack their cost or have one of an older catalog; after the backfill all have the right one."""
    version = F.when(F.col("id") % 2 != 0, "v2").when(F.col("id") % 4 != 0, "v1")
    lost = F.when(version == "v2", F.col("cost")).when((version == "v1") & F.col("cost").isNotNull(), F.col("cost") * 2 + 1)  # the rest has no cost
    stored = paid(spark, d).withColumns({"price_version": version, "cost": lost}).drop(*(f"cost_{p}" for p in ("input", "cache_write", "cache_read", "output", "reasoning")))
    return U.recosted(stored, adapter.pricing(spark), "v2", threshold=20_000).select("id", F.round("cost", 9).alias("cost"), "price_version")


@query("i16_subtracted", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls WHERE id % 4 <> 0 GROUP BY 1, 2")
def i16(spark, d):
    rollup = lambda rows: T.totals(rows, T.hour(), "source")
    all_ = paid(spark, d)
    return U.subtracted(rollup(all_), rollup(all_.where("id % 4 = 0")), ["hour", "source"], ["n", "tokens"])


@query("i18_body_inventory", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def i18(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
