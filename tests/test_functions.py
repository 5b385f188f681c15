"""Rules of expressions and parameters on hand-picked cases."""

import math
import re
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from callscope.functions import cost, histogram, status, timing
from callscope.operators import records, series, upkeep
from callscope.plans import ranges


def one(spark, expression, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "error", "kind", "want"),
    [
        ("success", None, None, (None, "none", False)), ("running", "", None, (None, "none", False)), (None, None, None, (None, "none", False)), ("http_200", " ", None, (None, "none", False)),
        ("http_429", "x", None, ("http_429", "service_failure", True)), ("http_404", "", None, ("http_404", "client_failure", False)), ("http_503", "", None, ("http_503", "service_failure", True)),
        ("failed", "[downstream_closed] gone", None, ("downstream_closed", "client_abort", False)), ("failed", "Downstream closed while streaming upstream response", None, ("downstream_closed", "client_abort", False)),
        ("failed", "Incorrect API key provided", None, ("invalid_api_key", "client_failure", False)), ("failed", "what", None, ("untyped_failure", "service_failure", True)), ("success", "odd", None, ("untyped_failure", "service_failure", True)),
        ("warning_success", "", "downstream_closed", ("downstream_closed", "none", False)), ("failed", "upstream stream error", "mine", ("mine", "service_failure", True)), ("interrupted", "", None, (None, "service_failure", True)),
    ],
)
def test_failure(spark, given, error, kind, want):
    text = lambda v: F.lit(v).cast("string")
    assert tuple(one(spark, status.failure(text(given), text(error), text(kind)))) == want


@pytest.mark.parametrize(
    ("error", "want"),
    [
        ("", "Other"), ("HTTP 502: bad", "HTTP 502"), ("http:429 Too  Many requests", "too_many_requests"), ("HTTP 429", "http_429"), ("HTTP 403 no", "forbidden"), ("HTTP 418 tea", "HTTP 418"),
        ("HTTP 400 usage limit reached", "usage_limit_reached"), ("Request failed: id 123456 at 2024-01-02 03:04:05Z", "request failed id at"), ("HTTP 500 Abcdefghijklm", "http 500"),
        ('{"error": {"type": "rate", "m": "HTTP 429"}}', "rate"), ('{"error": {"type": "rate"}}', "json error: rate"), ("https://a.b/c?d=e fails", "https://a.b/c fails"),
    ],
)
def test_category(spark, error, want):
    assert one(spark, status.category(F.lit(error))) == want


def test_buckets_where_clocks_change(spark):
    zone = "America/New_York"
    stamp = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp())
    at = [stamp(2024, 3, 10, 6, 59), stamp(2024, 3, 10, 7, 1), stamp(2024, 11, 3, 5, 30), stamp(2024, 11, 3, 6, 30)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in at], "epoch long").select(timing.zone_bucket("epoch", 3600, zone)).collect()]
    assert got == [stamp(2024, 3, 10, 6), stamp(2024, 3, 10, 7), stamp(2024, 11, 3, 5), stamp(2024, 11, 3, 6)]
    assert timing.local_midnight(datetime(2024, 3, 10), zone) == stamp(2024, 3, 10, 5)
    # Clocks skip midnight in Beirut; the day begins at one.
    assert timing.local_midnight(datetime(2024, 3, 31), "Asia/Beirut") == stamp(2024, 3, 30, 22)


def test_ranges():
    now = int(datetime(2024, 1, 31, 12, tzinfo=ZoneInfo("Asia/Shanghai")).timestamp())
    day = lambda n: int(datetime(2024, 1, n, tzinfo=ZoneInfo("Asia/Shanghai")).timestamp())
    assert timing.named_range("today", now, "Asia/Shanghai") == (day(31), now)
    assert timing.named_range("yesterday", now, "Asia/Shanghai") == (day(30), day(31))
    assert timing.named_range("thisWeek", now, "Asia/Shanghai") == (day(29), now)
    assert timing.named_range("thisMonth", now, "Asia/Shanghai") == (day(1), now)
    assert timing.named_range("previous7d", now, "Asia/Shanghai") == (day(24), day(31))
    assert timing.named_range("1mo", now, "UTC") == (now - 30 * 86400, now)
    assert [timing.bucket_width(0, x) for x in (3600, 2 * 86400, 30 * 86400, 31 * 86400)] == [60, 1800, 3600, 86400]
    with pytest.raises(ValueError):
        timing.bucket_width(0, 365 * 86400, "1m")
    with pytest.raises(ValueError):
        timing.duration("3 weeks")
    assert timing.whole_hours(now - 86400, now, "Asia/Shanghai") and not timing.whole_hours(now - 86400, now, "Asia/Kolkata")
    assert ranges.split(10, 20) == ((10, 20), (10, 10), (20, 20)) and ranges.split(10, 7300) == ((10, 3600), (3600, 7200), (7200, 7300))
    assert ranges.source_of(3600, 0, 10**6, 10**7, True) == "hours" and ranges.source_of(60, 0, 86400, 0, True) == "minutes"
    with pytest.raises(ValueError):
        ranges.source_of(60, 0, 86400, 5, True)


def test_histogram(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 5, 5.1, 40, 200, 10**6, -1, math.nan)] + [(None,)], "ms double")
    h = rows.select(histogram.place(F.col("ms")).alias("at")).agg(histogram.counted(F.col("at")).alias("h"))
    assert h.select(histogram.total(F.col("h"))).first()[0] == 6
    got = h.select(*(histogram.percentile(F.col("h"), p).alias(f"p{i}") for i, p in enumerate((0.0, 0.5, 0.6, 0.99)))).first()
    assert tuple(got) == (5.0, 10.0, 50.0, 180000.0)
    assert sum(h.select(histogram.subtract(F.col("h"), F.col("h")).alias("d")).first()["d"]) == 0
    assert h.select(histogram.hybrid(F.col("h"), F.lit(7.0), F.lit(6), 0.5), histogram.hybrid(F.col("h"), F.lit(7.0), F.lit(5), 0.5)).first()[:] == (7.0, 10.0)


def test_cost(spark):
    assert one(spark, cost.base_model(F.lit("m-2024-01-02"))) == "m" and one(spark, cost.base_model(F.lit("-2024-01-02"))) == "-2024-01-02"
    assert one(spark, cost.host(F.lit(" A.b "))) == "a.b" and one(spark, cost.host(F.lit(" "))) == "__unknown__"
    assert one(spark, cost.percent_delta(F.lit(3), F.lit(0))) is None and one(spark, cost.percent_delta(F.lit(3), F.lit(2))) == 50.0
    assert tuple(one(spark, cost.saved(F.lit(10), F.lit(4), F.lit(True)))) == (6, 60.0) and one(spark, cost.saved(F.lit(10), F.lit(4), F.lit(False))) is None


def test_costs_are_backfilled(spark):
    prices = spark.createDataFrame([("m", 2.0, 10.0, 0.5, None, None)], "price_model string, input_price double, output_price double, read_price double, write_price double, reasoning_price double")
    given = [(1, "m", 0.5, "v2"), (2, "m", None, None), (3, "m", 0.5, "v1"), (4, "m", 0.5, None), (5, "x", None, "v2"), (6, "x", 0.5, "v1"), (7, "m", None, "v2")]
    calls = spark.createDataFrame([(*r, 1_000_000, 0, 0, 0, "{}") for r in given], "id long, model string, cost double, price_version string, input_tokens long, cache_tokens long, output_tokens long, reasoning_tokens long, payload string")
    out = upkeep.recosted(calls, prices, "v2", threshold=2_000_000)
    got = sorted(tuple(r) for r in out.select("id", "model", "cost", "price_version").collect())
    assert got == [(1, "m", 0.5, "v2"), (2, "m", 2.0, "v2"), (3, "m", 2.0, "v2"), (4, "m", 2.0, "v2"), (5, "x", None, "v2"), (6, "x", 0.5, "v1"), (7, "m", 2.0, "v2")] and out.columns == ["id", *(c for c in calls.columns if c != "id")]


def test_timing_rules(spark):
    assert one(spark, timing.first_byte_total(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(4.0))) is None
    assert one(spark, timing.first_byte_total(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.0))) is None
    assert one(spark, F.unix_seconds(timing.mixed_time(F.lit("2024-01-01T00:00:00+08:00")))) == 1704038400 == one(spark, F.unix_seconds(timing.mixed_time(F.lit("2024-01-01 00:00:00"))))
    assert one(spark, timing.mixed_time(F.lit("never"))) is None


def test_wall_time_is_a_union(spark):
    rows = spark.createDataFrame([("a", 0, 5000.0), ("a", 2, 1000.0), ("a", 5, 1000.0), ("a", 3599, 2000.0), ("b", 0, 0.0), ("b", 3, None)], "k string, epoch long, t_long double")
    got = {(r["k"], r["bucket"]): tuple(r)[2:] for r in series.wall_time(series.hour_slices(rows), "k", "bucket").collect()}
    assert got == {("a", 0): (7000, 8000, 4, 4), ("a", 3600): (1000, 1000, 1, 0), ("b", 0): (0, 0, 1, 1)}


def test_pages_hold_still(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(1, 31)], "id long, epoch long")
    first = [r["id"] for r in records.page(rows, size=10, snapshot=30).collect()]
    more = rows.union(spark.createDataFrame([(i, 99) for i in range(31, 40)], rows.schema))
    second = [r["id"] for r in records.page(more, size=10, number=2, snapshot=30).collect()]
    assert first + second == list(range(30, 10, -1))
    cursor = rows.where(f"id = {first[-1]}").first()
    assert [r["id"] for r in records.after(rows, "epoch", cursor["epoch"], cursor["id"], 10).collect()] == second
    assert records.locate(rows, "epoch", second[0], 10).first()[0] == 2


def plain_reason(error):
    low = error.strip(" ").lower()
    code = re.search(r"\bhttp[ \t\n\x0b\f\r]*([0-9]{3})\b", low)
    out = re.sub(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[ t][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?z?\b", "", low)
    out = re.sub(r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "", out)
    out = re.sub(r"\b[a-z0-9_\-]{10,}\b", "", out)
    out = re.sub(r"(https?://[^ \t\n\x0b\f\r'\"?#]+)[^ \t\n\x0b\f\r'\"]*", r"\1", out)
    out = re.sub(r"\b[0-9]{4,}\b", "", out).replace("request failed:", "request failed").replace("exception recovered:", "exception")
    out = re.sub(r"[ \t\n\x0b\f\r]+", " ", out).strip(" ")
    if code and code[1] not in out:
        out = f"http {code[1]}: {out}"
    return out[:160] or None


def test_normalised_texts_of_all_documents(spark, data):
    import __spark_entry__ as entry

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["reason"] for r in entry.queries()["b9_normalised_text"](spark, data).collect()}
    assert got == {i: plain_reason(f"HTTP 500 at 2024-01-02 03:04:05Z: {t}") for i, t in texts.items()}
