from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status, timing
from ..operators import series as R
from ..operators import totals as T
from ..sources.adapter import NOW
from .registry import calls, paid, query
from .totals import COUNTS

START, END = 1704067200 + 10 * 86400, 1704067200 + 17 * 86400
SERIES = """SELECT b AS bucket, coalesce(n, 0) AS n, coalesce(success, 0) AS success, coalesce(failure, 0) AS failure, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost, coalesce(non_success_cost, 0) AS non_success_cost, coalesce(flying, 0) AS flying, coalesce(ttfb_n, 0) AS ttfb_n, ttfb_mean, ttfb_p95,
 coalesce(first_token_n, 0) AS first_token_n, first_token_mean FROM {spine} LEFT JOIN (SELECT {bucket} AS bucket, {counts}, count(*) FILTER (WHERE flying) AS flying, count(v) AS ttfb_n, round(avg(v), 6) AS ttfb_mean, round(quantile_cont(v, 0.95), 6) AS ttfb_p95, count(first_token) AS first_token_n, round(avg(first_token), 6) AS first_token_mean
 FROM (SELECT *, CASE WHEN t_ttfb > 0 THEN t_ttfb END AS v FROM paid WHERE epoch >= {start} AND epoch < {end} {more}) GROUP BY 1) f ON f.bucket = b"""


@query("d1_hourly_series", SERIES.format(spine=f"range({START}, {END}, 3600) r(b)", bucket="epoch // 3600 * 3600", counts=COUNTS, start=START, end=END, more=""))
def d1(spark, d):
    return R.series(paid(spark, d), START, END, timing.HOUR)


@query("d2_account_series", SERIES.format(spine=f"range({START}, {END}, 21600) r(b)", bucket="epoch // 21600 * 21600", counts=COUNTS, start=START, end=END, more="AND account = 3"))
def d2(spark, d):
    return R.series(paid(spark, d).where("account = 3"), START, END, 6 * timing.HOUR)


@query("d1_zone_series", SERIES.format(spine=f"(SELECT * FROM range({START - 28800}, {END}, 86400) r(b))", bucket="(epoch + 28800) // 86400 * 86400 - 28800", counts=COUNTS, start=START, end=END, more=""))
def d1_zone(spark, d):
    return R.series(paid(spark, d), START, END, timing.DAY, "Asia/Shanghai")


@query("d3_rebucketed_rollup", "SELECT (epoch + 28800) // 86400 * 86400 - 28800 AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1")
def d3(spark, d):
    hourly = T.totals(paid(spark, d), T.hour(), "source")
    return R.rebucketed(hourly, timing.DAY, "Asia/Shanghai", ["n", "tokens"])


@query("d5_concurrency", f"SELECT b AS bucket, coalesce(c, 0) AS conversations FROM range({START}, {END}, 1800) r(b) LEFT JOIN (SELECT epoch // 1800 * 1800 AS k, count(DISTINCT conversation) AS c FROM calls WHERE conversation IS NOT NULL AND epoch >= {START} AND epoch < {END} GROUP BY 1) ON k = b")
def d5(spark, d):
    return R.concurrency(calls(spark, d), START, END, 1800)


@query("d5_concurrency_summary", f"SELECT min(c) AS least, max(c) AS most, count(*) FILTER (WHERE c > 0) AS active, round(avg(c) FILTER (WHERE c > 0), 9) AS active_mean FROM (SELECT b, coalesce(c, 0) AS c FROM range({START}, {END}, 1800) r(b) LEFT JOIN (SELECT epoch // 1800 * 1800 AS k, count(DISTINCT conversation) AS c FROM calls WHERE conversation IS NOT NULL AND epoch >= {START} AND epoch < {END} GROUP BY 1) ON k = b)")
def d5_summary(spark, d):
    return R.concurrency_summary(R.concurrency(calls(spark, d), START, END, 1800))


@query("c36_distinct_minutes", "SELECT account, minute // 3600 * 3600 AS hour, CAST(sum(c) AS BIGINT) AS conversation_minutes, count(*) AS active_minutes, max(c) AS most FROM (SELECT account, epoch // 60 * 60 AS minute, count(DISTINCT conversation) AS c FROM calls WHERE conversation IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2")
def c36(spark, d):
    return R.distinct_minutes(calls(spark, d), "account")


@query("d5c_conversation_spans", f"SELECT conversation, min(epoch) AS first_seen, max(epoch) AS last_seen, count(*) AS n FROM calls WHERE conversation IS NOT NULL AND epoch >= {START} AND epoch < {START + 86400} GROUP BY 1 ORDER BY last_seen DESC, n DESC, conversation LIMIT 80")
def d5c(spark, d):
    return R.spans(calls(spark, d), START, START + 86400)


SLICES = "slices AS (SELECT *, greatest(a, h * 3600000) AS b0, least(z, (h + 1) * 3600000) AS b1, h = a // 3600000 AS starts FROM (SELECT *, unnest(range(a // 3600000, greatest(a, z - 1) // 3600000 + 1)) AS h FROM (SELECT *, epoch * 1000 AS a, epoch * 1000 + CAST(floor(t_long) AS BIGINT) AS z FROM calls)))"


def wall_sql(keys):
    return f", {SLICES} SELECT {keys}, h * 3600 AS bucket, CAST(sum(greatest(b1 - greatest(b0, coalesce(reach, b0)), 0)) AS BIGINT) AS wall_ms, CAST(sum(b1 - b0) AS BIGINT) AS sum_ms, count(*) AS slices, count(*) FILTER (WHERE starts) AS calls FROM (SELECT *, max(b1) OVER (PARTITION BY {keys}, h ORDER BY b0, b1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM slices) GROUP BY ALL"


@query("d6_wall_time_hours", wall_sql("account"))
def d6(spark, d):
    return R.wall_time(R.hour_slices(calls(spark, d)), "account", "bucket")


@query("d7_wall_time_models", wall_sql("model, effort"))
def d7(spark, d):
    return R.wall_time(R.hour_slices(calls(spark, d)), "model", "effort", "bucket")


@query("d8_daily_points", "SELECT strftime(x, '%Y-%m-%d') AS day, n, tokens FROM (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-01-30', INTERVAL 1 DAY)) AS x) LEFT JOIN (SELECT to_timestamp(epoch)::DATE AS dd, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1) ON dd = x")
def d8(spark, d):
    days = spark.sql("select explode(sequence(date '2023-12-28', date '2024-01-30')) day")
    found = calls(spark, d).groupBy(timing.local_date("epoch", "UTC").alias("day")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
    return days.join(found, "day", "left").select(F.col("day").cast("string").alias("day"), "n", "tokens")


@query("d9_rolling_minute", "SELECT account, epoch, CAST(sum(t) OVER w AS BIGINT) AS tokens_60s, CAST(sum(n) OVER w AS BIGINT) AS calls_60s FROM (SELECT account, epoch, sum(total_tokens) AS t, count(*) AS n FROM calls WHERE account IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY account ORDER BY epoch RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)")
def d9(spark, d):
    return R.rolling_minute(calls(spark, d))


@query("d11_last_seconds", f"SELECT b AS second, CAST(coalesce(x, 0) AS BIGINT) AS bytes, coalesce(b >= first, FALSE) AS available FROM range({NOW - 3900}, {NOW}) r(b) LEFT JOIN (SELECT epoch AS k, sum(input_tokens) * 4 AS x FROM calls GROUP BY 1) ON k = b CROSS JOIN (SELECT min(epoch) AS first FROM calls WHERE epoch >= {NOW - 3900})")
def d11(spark, d):
    return R.last_seconds(calls(spark, d), NOW, 3900)


@query("d12_network_buckets", "SELECT epoch // 300 * 300 AS bucket, CAST(sum(input_tokens) * 4 AS BIGINT) AS bytes, round(sum(input_tokens) * 4 / 300.0, 6) AS per_second FROM calls GROUP BY 1")
def d12(spark, d):
    rows = calls(spark, d).groupBy(timing.floor_to(F.col("epoch"), 300).alias("bucket")).agg((F.sum("input_tokens") * 4).alias("bytes"))
    return rows.withColumn("per_second", F.round(F.col("bytes") / 300.0, 6))


@query("d17_same_progress", f"SELECT part, count(*) AS n, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, round(coalesce(sum(cost), 0), 10) AS cost FROM (SELECT *, CASE WHEN epoch >= {START} THEN 'now' ELSE 'before' END AS part FROM paid WHERE (epoch >= {START} AND epoch < {START + 40000}) OR (epoch >= {START - 86400} AND epoch < {START - 46400})) GROUP BY 1")
def d17(spark, d):
    return R.same_progress(paid(spark, d), START, START + 40_000)


@query("d18_active_minutes", "SELECT day, count(*) AS active_minutes, round(sum(n) / count(*)::DOUBLE, 9) AS calls_per_minute, round(sum(t) / count(*)::DOUBLE, 6) AS tokens_per_minute FROM (SELECT epoch // 86400 AS day, epoch // 60 AS m, count(*) AS n, sum(total_tokens) AS t FROM calls GROUP BY 1, 2) GROUP BY 1")
def d18(spark, d):
    minutes = calls(spark, d).groupBy(F.floor(F.col("epoch") / 86400).alias("day"), F.floor(F.col("epoch") / 60).alias("m")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("t"))
    return minutes.groupBy("day").agg(F.count("*").alias("active_minutes"), F.round(F.sum("n") / F.count("*"), 9).alias("calls_per_minute"), F.round(F.sum("t") / F.count("*"), 6).alias("tokens_per_minute"))


@query("d19_running_day", f"SELECT b AS bucket, CASE WHEN b < {START + 40000} THEN CAST(sum(coalesce(t, 0)) OVER (ORDER BY b) AS BIGINT) END AS tokens, CASE WHEN b < {START + 40000} THEN round(sum(coalesce(c, 0)) OVER (ORDER BY b), 10) END AS cost FROM range({START}, {START + 86400}, 600) r(b) LEFT JOIN (SELECT epoch // 600 * 600 AS k, sum(total_tokens) AS t, sum(cost) AS c FROM paid WHERE epoch >= {START} AND epoch < {START + 40000} GROUP BY 1) ON k = b")
def d19(spark, d):
    return R.running_day(paid(spark, d), START, START + 40_000)


@query("d20_calendar", "SELECT strftime(day, '%Y-%m-%d') AS day, n, CAST(least(ceil(n * 4 / max(n) OVER ()::DOUBLE), 4) AS INT) AS level FROM (SELECT to_timestamp(epoch)::DATE AS day, count(*) AS n FROM calls GROUP BY 1)")
def d20(spark, d):
    return R.calendar(calls(spark, d))


@query("d21_heatmap", f"SELECT weekday, hour, n, CASE WHEN s >= 0.85 THEN 4 WHEN s >= 0.55 THEN 3 WHEN s >= 0.25 THEN 2 ELSE 1 END AS level FROM (SELECT *, n / max(n) OVER ()::DOUBLE AS s FROM (SELECT (epoch // 86400 + 3) % 7 AS weekday, epoch % 86400 // 3600 AS hour, count(*) AS n FROM calls WHERE epoch >= {START} AND epoch < {END} GROUP BY 1, 2))")
def d21(spark, d):
    return R.heatmap(calls(spark, d), START, END)


LONG_TERM = """SELECT dimension, series, epoch // {width} AS {grain}, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(t_total) FILTER (WHERE ok) AS timed, round(avg(t_total) FILTER (WHERE ok), 6) AS mean_ms, round(sum(output_tokens) FILTER (WHERE ok AND t_stream > 0) / (sum(t_stream) FILTER (WHERE ok AND t_stream > 0) / 1000), 6) AS tokens_per_second
 FROM (SELECT *, 'overall' AS dimension, 'all' AS series FROM calls UNION ALL SELECT *, 'model', model || '/' || coalesce(effort, 'unspecified') FROM calls UNION ALL SELECT *, 'upstream', coalesce('account:' || account, 'other') FROM calls) GROUP BY ALL"""


@query("c27_long_term", LONG_TERM.format(width=86400, grain="day"))
def c27(spark, d):
    return R.long_term(calls(spark, d), status.long_term_success(F.col("status"), F.col("error_message")))


@query("c28_long_term_hours", LONG_TERM.format(width=3600, grain="hour"))
def c28(spark, d):
    return R.long_term(calls(spark, d), status.long_term_success(F.col("status"), F.col("error_message")), "hour")


@query("c30_model_performance", f", {SLICES}, w AS (SELECT model, CAST(sum(greatest(b1 - greatest(b0, coalesce(reach, b0)), 0)) AS BIGINT) AS wall_ms, CAST(sum(b1 - b0) AS BIGINT) AS sum_ms FROM (SELECT *, max(b1) OVER (PARTITION BY model, h ORDER BY b0, b1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM slices) GROUP BY 1) SELECT model, wall_ms, sum_ms, round(sum_ms / wall_ms::DOUBLE, 9) AS parallelism FROM w")
def c30(spark, d):
    hours = R.wall_time(R.hour_slices(calls(spark, d)), "model", "bucket")
    return hours.groupBy("model").agg(F.sum("wall_ms").alias("wall_ms"), F.sum("sum_ms").alias("sum_ms")).withColumn("parallelism", F.round(F.col("sum_ms") / F.col("wall_ms"), 9))
