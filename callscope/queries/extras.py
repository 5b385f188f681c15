from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import cost, status, timing
from ..operators import records as R
from ..operators import series as S
from ..operators import totals as T
from ..operators import upkeep as U
from ..sources import adapter, archive, bodies, ledger
from ..sources.adapter import NOW
from ..streaming import live
from .registry import SNAPSHOT, calls, paid, query, snapshot
from .series import END, START


@query("a4_old_archive", "SELECT id, CASE WHEN id % 2 = 0 THEN model END AS model, total_tokens FROM calls")
def a4(spark, d):
    """Half of the rows come from files that lack a column."""
    c = calls(spark, d).select("id", "model", "total_tokens")
    return R.with_archive(c.where("id % 2 = 0"), c.where("id % 2 = 1").drop("model"))


@query("a6_rollup_range", f"SELECT epoch // 3600 * 3600 AS hour, source, count(*) AS n FROM calls WHERE epoch // 3600 * 3600 >= {START} AND epoch // 3600 * 3600 < {END} GROUP BY 1, 2")
def a6(spark, d):
    return T.totals(timing.within(paid(spark, d), START, END), T.hour(), "source").select("hour", "source", "n")  # whole hours


@query("a9_body_lines", "SELECT conv_id, turn, len(string_split(text, chr(10))) AS lines FROM conversations")
def a9(spark, d):
    """Bodies framed as event streams and read back line by line."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    framed = rows.select("conv_id", "turn", F.concat(F.lit("data: "), F.regexp_replace("text", "\n", "\ndata: ")).alias("body"))
    return R.stream_events(framed).groupBy("conv_id", "turn").agg(F.count("*").cast("int").alias("lines")).select("conv_id", "turn", F.col("lines").cast("long").alias("lines"))


def _packed(batches):
    """Bodies as they are stored: plain, gzip, or gzip without its trailer, by conversation; a third of the packed ones in two members."""
    for batch in batches:
        out = []
        for conversation, turn, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "body")), strict=True):
            raw = body.encode()
            half = len(raw) // 2 if turn % 3 == 0 else 0
            whole = b"".join(gzip.compress(part, mtime=0) for part in ((raw[:half], raw[half:]) if half else (raw,)))
            out.append((raw, whole, whole[:-8])[conversation % 3])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["conv_id", "turn", "content"])


@query("a9_stored_bodies", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'stream' ELSE 'json' END AS kind, conv_id % 3 > 0 AS packed, conv_id % 3 = 2 AS truncated, CASE WHEN turn % 2 = 0 THEN 6 + length(text) ELSE 2 + length(text) END AS chars FROM conversations""")
def a9_stored(spark, d):
    """Bodies of both forms, stored in three ways, read back from their bytes."""
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data: "), "text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", body.alias("body"))
    stored = rows.mapInArrow(_packed, "conv_id long, turn long, content binary")
    return bodies.with_bodies(stored).select("conv_id", "turn", "kind", "packed", "truncated", F.length("body").cast("long").alias("chars"))


@query("a11_priced_models", "SELECT model, count(*) AS n, count(price_model) AS priced FROM priced GROUP BY 1")
def a11(spark, d):
    prices = adapter.pricing(spark)
    met = calls(spark, d).join(F.broadcast(prices), cost.base_model(F.col("model")) == F.col("price_model"), "left")
    return met.groupBy("model").agg(F.count("*").alias("n"), F.count("price_model").alias("priced"))


@query("b7_failure_scopes", "SELECT scope, count(*) AS n FROM (SELECT unnest(CASE fclass WHEN 'service_failure' THEN ['all', 'service'] WHEN 'client_failure' THEN ['all', 'client'] WHEN 'client_abort' THEN ['all', 'abort'] ELSE [] END) AS scope FROM calls WHERE NOT flying) GROUP BY 1")
def b7(spark, d):
    rows = T.classified(calls(spark, d)).where("not flying")
    names = F.array_compact(F.array(*(F.when(status.scope(F.col("class"), n), F.lit(n)) for n in ("all", "service", "client", "abort"))))
    return rows.select(F.explode(names).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))


ZONES = ("UTC", "Asia/Shanghai", "Asia/Kolkata", "America/St_Johns", "America/New_York")


@query("b24_zone_offsets", f""", hours AS (SELECT zone, epoch // 3600 * 3600 AS h FROM calls CROSS JOIN (SELECT unnest({list(ZONES)}) AS zone)), shifted AS (SELECT zone, h, CAST(epoch(to_timestamp(h) AT TIME ZONE zone) AS BIGINT) - h AS o FROM hours),
 fit AS (SELECT zone, CASE WHEN bool_and(o % 3600 = 0) THEN zone ELSE 'Asia/Shanghai' END AS used FROM shifted GROUP BY 1)
 SELECT zone, used, h + u - (h + u) % 86400 - u AS bucket, count(*) AS n FROM (SELECT s.zone, used, h, CAST(epoch(to_timestamp(h) AT TIME ZONE used) AS BIGINT) - h AS u FROM shifted s JOIN fit f ON f.zone = s.zone) GROUP BY ALL""")
def b24(spark, d):
    """Days of hourly counts in five zones; a zone that isn't whole hours from UTC over the hours that there are gives way to Shanghai."""
    hours = calls(spark, d).groupBy(T.hour()).agg(F.count("*").alias("n"))
    return S.days_in_zones(hours, ZONES, "Asia/Shanghai")


@query("b32_action_results", "SELECT CASE WHEN status = 'http_429' THEN 'deferred' WHEN status = 'interrupted' THEN 'suppressed' ELSE 'failed' END AS result, count(*) AS n FROM calls WHERE event_type = 'error' GROUP BY 1")
def b32(spark, d):
    events = adapter.account_events(calls(spark, d))
    result = F.when(F.col("action") == "interrupted", "suppressed").when(F.col("action") == "http_429", "deferred").when(F.col("action").isin("success", "completed"), "success").otherwise("failed")
    return events.groupBy(result.alias("result")).agg(F.count("*").alias("n"))


@query("b34_kpis", f"SELECT round((a.n - b.n) * 100.0 / nullif(b.n, 0), 9) AS calls_delta, round(a.f / nullif(a.n, 0)::DOUBLE, 9) AS failure_rate, round(a.t / nullif(a.c, 0)::DOUBLE, 6) AS tokens_per_conversation FROM (SELECT count(*) AS n, count(*) FILTER (WHERE NOT flying AND fclass <> 'none') AS f, sum(total_tokens) AS t, count(DISTINCT conversation) AS c FROM calls WHERE epoch >= {START} AND epoch < {START + 86400}) a, (SELECT count(*) AS n FROM calls WHERE epoch >= {START - 86400} AND epoch < {START}) b")
def b34(spark, d):
    rows = T.classified(timing.within(calls(spark, d), START - 86400, START + 86400))
    now = F.col("epoch") >= START
    sums = rows.agg(F.count_if(now).alias("n"), F.count_if(~now).alias("before"), F.count_if(now & ~F.col("flying") & (F.col("class") != "none")).alias("f"), F.sum(F.when(now, F.col("total_tokens"))).alias("t"), F.countDistinct(F.when(now, F.col("conversation"))).alias("c"))
    return sums.select(F.round(cost.percent_delta(F.col("n"), F.col("before")), 9).alias("calls_delta"), F.round(cost.ratio(F.col("f"), F.col("n")), 9).alias("failure_rate"), F.round(cost.ratio(F.col("t"), F.col("c")), 6).alias("tokens_per_conversation"))


@query("c29_series_summary", "SELECT series, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS n FROM (SELECT *, model || '/' || coalesce(effort, 'unspecified') AS series FROM calls) GROUP BY 1 ORDER BY tokens DESC, series LIMIT 8")
def c29(spark, d):
    rows = S.long_term(calls(spark, d), status.long_term_success(F.col("status"), F.col("error_message"))).where("dimension = 'model'")
    return rows.groupBy("series").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).orderBy(F.desc("tokens"), "series").limit(8)


@query("e6_blocked_conversations", f"SELECT conversation FROM (SELECT conversation, arg_max(id % 5 = 0, epoch * 1000000000 + id) AS blocked, max(epoch) AS last FROM calls WHERE conversation IS NOT NULL AND NOT flying AND epoch < {START} GROUP BY 1) WHERE blocked AND last >= {START - 86400}")
def e6(spark, d):
    """Working conversations whose last terminal row carries a blocked binding: one in the range is the last of all before its end."""
    body = F.when(F.col("id") % 5 == 0, F.lit('{"blockedBinding": {"upstreamAccountId": 1}}')).otherwise(F.lit("{}"))
    rows = T.classified(timing.within(calls(spark, d), START - 86400, START)).where(F.col("conversation").isNotNull() & ~F.col("flying")).withColumn("body", body)
    last = rows.groupBy("conversation").agg(F.max(F.struct("epoch", "id")).alias("last"))
    blocked = rows.where(F.get_json_object("body", "$.blockedBinding").isNotNull()).select("conversation", F.struct("epoch", "id").alias("last"))
    return last.join(blocked, ["conversation", "last"], "left_semi").select("conversation")


@query("e12_model_health", "SELECT account, name, model, failures FROM (SELECT account, model, count(*) AS failures FROM calls WHERE event_type = 'error' AND account IS NOT NULL GROUP BY 1, 2) JOIN accounts USING (account) WHERE enabled")
def e12(spark, d):
    bad = calls(spark, d).where("event_type = 'error' and account is not null").groupBy("account", "model").agg(F.count("*").alias("failures"))
    return bad.join(adapter.accounts(spark).where("enabled"), "account").select("account", "name", "model", "failures")


@query("e13_conversation_owners", "SELECT conversation, account, name FROM (SELECT conversation, arg_max(account, epoch * 1000000000 + id) FILTER (WHERE account IS NOT NULL) AS account FROM calls WHERE conversation IS NOT NULL GROUP BY 1) LEFT JOIN accounts USING (account)")
def e13(spark, d):
    owner = calls(spark, d).where("conversation is not null").groupBy("conversation").agg(F.max_by("account", F.when(F.col("account").isNotNull(), F.struct("epoch", "id"))).alias("account"))
    return owner.join(adapter.accounts(spark), "account", "left").select("conversation", "account", "name")


BINDINGS = """, bind AS (SELECT id, conversation, epoch AS s, CASE WHEN id % 3 > 0 THEN epoch + 432000 * (id % 3) END AS e, id % 7 + 1 AS manual FROM calls WHERE event_type = 'error' AND conversation IS NOT NULL),
 met AS (SELECT c.id, c.conversation, c.epoch, arg_max(b.manual, b.s * 1000000000 + b.id) AS manual FROM calls c LEFT JOIN bind b ON b.conversation = c.conversation AND b.s <= c.epoch AND (b.e IS NULL OR b.e > c.epoch) WHERE c.conversation IS NOT NULL GROUP BY 1, 2, 3)"""


@query("e13_manual_bindings", f"{BINDINGS} SELECT conversation, count(*) AS n, count(manual) AS bound, arg_max(coalesce(manual, -1), epoch * 1000000000 + id) AS manual FROM met GROUP BY 1")
def e13_manual(spark, d):
    """For each conversation its calls under a manual binding, and the account it is bound to at its last call; bindings overlap, end, or stay open."""
    c = calls(spark, d).where("conversation is not null").select("id", "conversation", "epoch", "event_type")
    bindings = c.where("event_type = 'error'").selectExpr("id", "conversation", "epoch as start", "if(id % 3 > 0, epoch + 432000 * (id % 3), null) as end", "id % 7 + 1 as manual")
    met = R.bound_at(c, bindings, "conversation", "manual")
    last = F.max_by(F.coalesce("manual", F.lit(-1)), F.struct("epoch", "id")).cast("long")
    return met.groupBy("conversation").agg(F.count("*").alias("n"), F.count("manual").alias("bound"), last.alias("manual"))


@query("f2_snapshot_page", f"SELECT id, epoch FROM calls WHERE id <= {SNAPSHOT} ORDER BY epoch DESC, id DESC LIMIT 25 OFFSET 50")
def f2(spark, d):
    c = calls(spark, d)
    return R.page(c, number=3, size=25, snapshot=snapshot(c)).select("id", "epoch")


@query("f9_attempt_options", "SELECT status AS value, count(*) AS n FROM attempts GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def f9(spark, d):
    return adapter.attempts(calls(spark, d)).groupBy(F.col("status").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(5)


@query("g3_key_union", f"SELECT count(DISTINCT conversation) AS conversations FROM calls WHERE epoch >= {START} AND epoch < {END}")
def g3(spark, d):
    """Keys of hourly rollups and of exact rows, counted once."""
    c = paid(spark, d)
    rolled = T.conversation_rollup(timing.within(c, START, START + 86400)).select("conversation")
    return rolled.union(timing.within(c, START + 80_000, END).where("conversation is not null").select("conversation")).agg(F.countDistinct("conversation").alias("conversations"))


@query("g4_touched_days", "SELECT x AS day, count(*) AS n FROM (SELECT unnest(range(epoch // 86400, (epoch + CAST(floor(t_long / 1000) AS BIGINT)) // 86400 + 1)) AS x FROM calls) GROUP BY 1")
def g4(spark, d):
    days = F.expr("sequence(epoch div 86400, (epoch + cast(floor(t_long / 1000) as bigint)) div 86400)")
    return calls(spark, d).select(F.explode(days).alias("day")).groupBy("day").agg(F.count("*").alias("n"))


@query("i5_expired_archives", f"SELECT epoch // 86400 AS day, count(*) AS n FROM calls WHERE epoch < {START} AND epoch // 86400 <> 19725 GROUP BY 1")
def i5(spark, d):
    """Archive days that may go: older than the cutoff and held by the rollups."""
    all_ = timing.within(calls(spark, d), None, START)
    held = U.coverage(all_.where("epoch div 86400 <> 19725"), 1 << 60).select((F.col("hour") / 86400).cast("long").alias("day")).distinct()
    return U.manifest(all_).join(held, "day", "left_semi").select("day", "n")


@query("i6_rebuilt_buckets", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) AS n FROM calls GROUP BY 1, 2")
def i6(spark, d):
    all_ = paid(spark, d)
    old = T.totals(all_, T.hour(), "source").withColumn("n", F.when(F.col("hour") % 7200 == 0, F.col("n") + 5).otherwise(F.col("n")))
    return live.rebuilt(old, all_, old.where("hour % 7200 = 0").select("hour").distinct()).select("hour", "source", "n")


@query("i7_missing_materialisations", f"SELECT epoch // 86400 AS day, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, CASE WHEN epoch < {START} THEN 0 ELSE 1 END AS run FROM calls GROUP BY 1, 4")
def i7(spark, d):
    """A rollup from archives in two runs: the second reads only the files of days that were archived after the first."""
    rows, path, root = calls(spark, d).select("id", "epoch", "total_tokens"), archive.shared_dir(spark, "i7-archive"), archive.shared_dir(spark, "i7")
    daily = lambda part: part.groupBy(F.floor(F.col("epoch") / 86400).alias("day")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
    for run, part in enumerate((rows.where(F.col("epoch") < START), rows.where(F.col("epoch") >= START))):
        archive.write(part, path, "calls")
        ledger.materialise(spark, path, "calls", rows.schema, root, run, daily)
    return ledger.rollups(spark, root)


@query("i9_reconciled", "SELECT epoch // 3600 * 3600 AS hour, source, count(*) + CASE WHEN source = 'xy' THEN 5 ELSE 0 END AS n, source = 'proxy' AS complete FROM calls GROUP BY 1, 2")
def i9(spark, d):
    """Stored rollups are off by five. The archive of one source is whole, that of the other lacks a call: the first is computed anew, the second refused."""
    all_ = paid(spark, d)
    last = all_.where("source = 'xy'").agg(F.max("id")).first()[0]
    held = all_.where((F.col("source") == "proxy") | (F.col("id") != last))
    rollup = lambda rows: T.totals(rows, T.hour(), "source").select("hour", "source", "n")
    stored = rollup(all_).withColumn("n", F.col("n") + 5)
    return U.reconciled(stored, rollup(held), archive.manifest(all_, "source"), archive.manifest(held, "source"))


RANGES = ("today", "yesterday", "thisWeek", "thisMonth", "previous7d", "36h", "10d", "1mo")
#: What these ranges are at NOW (2024-01-31 08:00 in Shanghai, a Wednesday), as seconds back from it, and the bucket that each takes.
RANGE_SQL = {
    "today": (28800, 0, 1800), "yesterday": (28800 + 86400, 28800, 1800), "thisWeek": (28800 + 2 * 86400, 0, 3600), "thisMonth": (28800 + 30 * 86400, 0, 86400), "previous7d": (28800 + 7 * 86400, 28800, 3600),
    "36h": (36 * 3600, 0, 1800), "10d": (10 * 86400, 0, 3600), "1mo": (30 * 86400, 0, 3600),
}


@query("b20_named_ranges", " UNION ALL ".join(f"SELECT '{n}' AS name, {w} AS width, count(*) AS n, count(DISTINCT (epoch + 28800) // {w}) AS buckets FROM calls WHERE epoch >= {NOW - a} AND epoch < {NOW - b}" for n, (a, b, w) in RANGE_SQL.items()))
def b20(spark, d):
    """Calls and filled buckets of named ranges and durations (B18 to B21), in one pass over the calls of the longest."""
    spans = [(name, *timing.named_range(name, NOW, "Asia/Shanghai")) for name in RANGES]
    table = spark.createDataFrame([(name, a, b, timing.bucket_width(a, b)) for name, a, b in spans], "name string, start long, finish long, width long")
    rows = timing.within(calls(spark, d), min(a for _, a, _ in spans), NOW).select("epoch")
    met = F.broadcast(table).join(rows, (F.col("epoch") >= F.col("start")) & (F.col("epoch") < F.col("finish")), "left")
    return met.groupBy("name", "width").agg(F.count("epoch").alias("n"), F.countDistinct(F.expr("(epoch + 28800) div width")).alias("buckets"))


@query("i13_key_backfill", "SELECT id, CASE WHEN NOT broken OR id % 2 = 0 THEN conversation END AS conversation FROM calls")
def i13(spark, d):
    found = F.nullif(F.trim(F.get_json_object("payload", "$.promptCacheKey")), F.lit(""))
    return calls(spark, d).withColumn("stored", F.when(F.col("id") % 2 == 0, F.col("conversation"))).select("id", F.coalesce("stored", found).alias("conversation"))


@query("i14_class_backfill", "SELECT CASE WHEN id % 10 = 0 AND fclass = 'none' AND NOT flying THEN 'service_failure' ELSE fclass END AS class, count(*) AS n FROM calls GROUP BY 1")
def i14(spark, d):
    """Successes whose body says failed become failures."""
    body = F.when(F.col("id") % 10 == 0, "upstream response stream reported failure")
    rows = calls(spark, d).withColumn("error_message", F.when(body.isNotNull() & status.terminal(F.col("status")) & (F.coalesce("error_message", F.lit("")) == "") & (F.col("status") != "interrupted"), body).otherwise(F.col("error_message")))
    return T.classified(rows).groupBy("class").agg(F.count("*").alias("n"))


@query("i17_archived_node_hours", f"SELECT proxy_key, epoch // 3600 * 3600 AS hour, count(*) AS n, count(*) FILTER (WHERE is_success) AS success FROM nodes WHERE epoch < {START} GROUP BY 1, 2")
def i17(spark, d):
    """Hours of nodes from the archive of their attempts."""
    old, path = timing.within(adapter.node_attempts(calls(spark, d)), None, START), archive.shared_dir(spark, "i17")
    archive.write(old, path, "node_attempts")
    return R.node_hours(archive.read(spark, path, "node_attempts", old.schema, end=START)).select("proxy_key", "hour", "n", "success")


@query("i20_long_term_refresh", "SELECT epoch // 86400 AS day, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1")
def i20(spark, d):
    """Stored days that lack calls which came late are computed anew from archive and live rows, all others keep their row."""
    c, path = calls(spark, d), archive.shared_dir(spark, "i20")
    day = lambda rows: S.long_term(rows, status.long_term_success(F.col("status"), F.col("error_message"))).where("dimension = 'overall'").select("day", "n", "tokens")
    stored = day(c.where("id % 97 <> 0 or epoch div 86400 % 2 = 0"))
    live, expected = archive.moved(c, path, "calls", START)
    facts = archive.read(spark, path, "calls", c.schema).unionByName(live)
    return U.refreshed(stored, facts, expected.unionByName(archive.manifest(live)), day)
