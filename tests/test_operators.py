"""Operators on hand-made frames, and their plans."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from callscope import catalog
from callscope.functions import histogram, timing
from callscope.operators import records, selection, totals, upkeep
from callscope.queries.registry import calls, paid
from callscope.sources import adapter, archive, bodies, ledger


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_bounds_reach_the_scan(spark, data):
    start, end = 1704844800, 1706054400
    for df in (records.scan(calls(spark, data), start, end, "proxy"), totals.totals(timing.within(paid(spark, data), start, end))):
        pushed = next(line for line in plan(df).split("\n") if "PushedFilters" in line)
        assert "GreaterThanOrEqual(ts,2024-01-10" in pushed and "LessThan(ts,2024-01-24" in pushed


def test_only_wanted_columns_are_read(spark, data):
    text = plan(calls(spark, data).groupBy("source").agg(F.sum("total_tokens")))
    assert "props" not in text[text.index("ReadSchema") :].split("\n")[0]


def test_prices_are_joined_once(spark, data):
    physical = plan(paid(spark, data).select("id", "cost")).split("== Physical Plan ==")[1]
    assert physical.count("BroadcastHashJoin") == 2  # states of events, and prices


def test_no_quota_is_a_degraded_row(spark, data):
    none = adapter.quota_snapshots(calls(spark, data)).where("false")
    got = records.latest_quota(none).collect()
    assert len(got) == 1 and got[0]["degraded"] and got[0]["used_amount"] == 0 and got[0]["id"] == 0


def test_record_filters(spark, data):
    found = totals.classified(records.with_payload(paid(spark, data))).cache()
    everything = found.count()
    for given, condition in (
        ({"model": " MODEL-A "}, "request_model = 'model-a'"), ({"model": "model-a-mini", "model_target": "response"}, "response_model = 'model-a-mini'"), ({"rerouted": True}, "response_model <> request_model"),
        ({"models": ["model-a", "model-b"]}, "request_model in ('model-a', 'model-b')"), ({"status": "HTTP_200"}, "status = 'http_200'"), ({"failure_class": "client_abort"}, "class = 'client_abort'"),
        ({"failure_kind": "http_429"}, "kind = 'http_429'"), ({"upstream_scope": "none"}, "account is null"), ({"upstream_account": 3}, "account = 3"), ({"min_total_ms": 100.0, "max_total_ms": 500.0}, "t_total between 100 and 500"),
        ({"min_tokens": 10, "max_tokens": 900}, "total_tokens between 10 and 900"), ({"efforts": ["low"]}, "effort = 'low'"), ({"service_tier": "priority"}, "service_tier = 'priority'"), ({"requester_ip": "10.0.0.1"}, "requester_ip = '10.0.0.1'"),
        ({"sticky_key": "conv-3"}, "sticky_key = 'conv-3'"), ({"prompt_cache_key": "conv-3"}, "conversation = 'conv-3'"), ({"proxy_display_name": "node-2"}, "proxy_name = 'node-2'"), ({"invoke_id": "inv-7"}, "id = 8"),
        ({"keyword": "CANCELLED"}, "error_message like '%cancelled%'"), ({"start": 1704153600, "end": 1704240000}, "epoch >= 1704153600 and epoch < 1704240000"), ({"source": "xy"}, "source = 'xy'"), ({"snapshot": 20}, "id <= 20"), ({"status": None}, "true"),
    ):
        want = [r["id"] for r in found.where(condition).select("id").collect()]
        got = records.record_list(found, size=everything, **given).select("id", "total").collect()
        assert sorted(r["id"] for r in got) == sorted(want) and all(r["total"] == len(want) for r in got), given
        assert want, given
    for sort, column in records.SORTS.items():
        got = [r[0] for r in records.record_list(found, sort, descending=False, size=50).select(column).collect() if r[0] is not None]
        assert got == sorted(got), sort
    with pytest.raises(ValueError):
        records.record_list(found, colour="red")
    found.unpersist()


def test_filters_on_the_payload_parse_it_once(spark, data):
    """Predicates on fields of the payload and on columns: the text is parsed once."""
    rows = totals.classified(records.with_payload(paid(spark, data)))
    met = rows.where(records._all(records.record_filters(endpoint="/v1/responses", requester_ip="10.0.0.1", keyword="conv-1", source="proxy"))).select("id")
    assert met._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


@pytest.mark.parametrize(("held", "accuracy"), [(1 << 18, 10_000), (50, 100), (3, 20)])
def test_percentiles_are_exact_however_large_a_group_is(spark, held, accuracy):
    """Hot and null groups, ties, one value, no value: by one pass, and by rounds of brackets."""
    r = random.Random(1)
    values = [("hot", r.expovariate(0.01)) for _ in range(3000)] + [("ties", float(r.choice([1, 1, 1, 2, 7]))) for _ in range(500)] + [(None, float(i)) for i in range(101)]
    values += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)] + [("wide", 10.0 ** r.randrange(-300, 300)) for _ in range(200)]
    df = spark.createDataFrame(values, "k string, ms double").repartition(5)
    at = (0.0, 0.5, 0.95, 0.999, 1.0)
    found = selection.percentiles(df, ["k"], {"a": F.col("ms"), "b": -F.col("ms")}, at, held, accuracy).collect()
    by = {}
    for k, v in values:
        by.setdefault(k, []).extend([] if v is None else [v])
    assert {x["k"] for x in found} == set(by) and len(found) == len(by)
    for x in found:
        for name, sign in (("a", 1), ("b", -1)):
            own = sorted(sign * v for v in by[x["k"]])
            wanted = [own[math.floor(q)] if q == int(q) else (math.ceil(q) - q) * own[math.floor(q)] + (q - math.floor(q)) * own[math.ceil(q)] for q in (p * (len(own) - 1) for p in at)] if own else None
            assert x[name] == wanted, (x["k"], name)


def test_percentiles_hold_no_group(spark):
    """A million rows of one group go through brackets: no aggregate collects them."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("ms"))
    got = selection.percentiles(df, ["k"], {"p": F.col("ms")}, (0.5, 0.99), held=1000).first()["p"]
    assert got == df.agg(F.percentile("ms", F.array(F.lit(0.5), F.lit(0.99)))).first()[0]


def test_no_group_is_sorted_for_its_cuts(spark):
    """The rows of a large group meet its cuts where they lie: without a shuffle or a sort, also where nothing is broadcast by size."""
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = selection._buckets(df, ["g"], [0.4, 0.6], 100)
        assert "SortMergeJoin" not in plan(found) and found.agg(F.sum("after") - F.sum("before")).first()[0] == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_places_of_durations(spark):
    values = [None, float("nan"), -1.0, 0.0, 5.0, 5.1, 180000.0, 180000.1, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "ms double")
    assert [r[0] for r in df.select(histogram.place(F.col("ms"))).collect()] == [None, None, None, 0, 0, 1, 19, 20, None]


def test_penalties_since_the_last_success(spark):
    seen = [("a", 10, 1, False), ("a", 20, 2, False), ("a", 20, 3, True), ("a", 20, 4, False), ("a", 300, 5, False), ("a", 330, 6, False), ("a", 3599, 7, False), ("a", 3600, 8, False), ("a", 3700, 9, True), ("b", 3600, 10, False)]
    df = spark.createDataFrame([("r", k, e, i, ok, not ok) for k, e, i, ok in seen], "route string, proxy_key string, epoch long, id long, is_success boolean, penalised boolean")
    got = [r[1:] for r in rows(records.failure_penalties(df))]
    assert sorted(got) == [("a", 10, 1), ("a", 20, 1), ("a", 300, 2), ("a", 330, 2), ("a", 3599, 1), ("a", 3600, 2), ("a", 3700, 0), ("b", 3600, 1)]


def test_escapes_after_two_stream_errors(spark):
    bad, good = ("http_502", "HTTP 502 upstream stream error"), ("success", None)
    seen = [(1, 3500, 1, bad), (1, 3700, 2, bad), (2, 100, 3, bad), (2, 150, 4, good), (2, 200, 5, bad), (3, 100, 6, bad), (3, 401, 7, bad), (4, 100, 8, bad), (4, 110, 9, ("running", None)), (4, 120, 10, bad), (None, 1, 11, bad)]
    df = spark.createDataFrame([(a, e, i, s, m) for a, e, i, (s, m) in seen], "account long, epoch long, attempt_id long, status string, error_message string")
    assert rows(upkeep.stream_error_escapes(df)) == [(1, 0, False, None), (1, 3600, True, 4000), (2, 0, False, None), (3, 0, False, None), (4, 0, True, 420)]


def test_archives_may_be_written_twice(spark):
    path = archive.shared_dir(spark, "archive-test")
    df = spark.range(500).select("id", (F.col("id") * 1000).alias("epoch"), F.lit("x").alias("day_name"))
    first = rows(archive.write(df, path, "calls"))
    assert rows(archive.write(df.repartition(3), path, "calls")) == first and sum(r[1] for r in first) == 500
    archive.write(df.where("id < 10"), path, "others")
    got = archive.read(spark, path, "calls", df.schema, 100_000, 200_000)
    assert sorted(r["id"] for r in got.collect()) == list(range(100, 200)) and got.columns == df.columns
    assert "PartitionFilters: [isnotnull(dataset" in plan(got) and "day" in plan(got)
    live, stored = archive.moved(df, archive.shared_dir(spark, "archive-test"), "calls", 250_000)
    assert live.count() == 250 and stored.agg(F.sum("n")).first()[0] == 250


def test_reconciling_refuses_sources_that_changed(spark):
    df = spark.createDataFrame([(s, i, i * 50_000) for s in ("a", "b", "c") for i in range(9)], "source string, id long, epoch long")
    known = archive.manifest(df, "source")
    now = df.where("not (source = 'b' and id = 4)").withColumn("epoch", F.when((F.col("source") == "c") & (F.col("id") == 2), F.col("epoch") + 1).otherwise(F.col("epoch")))
    rollup = lambda x: x.groupBy("source").agg(F.count("*").alias("n"))
    stored = rollup(df).withColumn("n", F.lit(77).cast("long"))
    assert rows(upkeep.reconciled(stored, rollup(now), known, archive.manifest(now, "source"))) == [("a", 9, True), ("b", 77, False), ("c", 77, False)]


def test_stream_bodies(spark):
    line = lambda s: "data: " + s
    bodies = [
        "\r\n".join([line('{"type":"response.created","response":{"service_tier":"flex"}}'), line('{"type":"x","service_tier":"odd"}'), line('{"type":"response.completed","response":{"service_tier":"auto","usage":{"output_tokens":3}}}'), line("[DONE]")]),
        "\n".join([line('{"type":"response.created","service_tier":"auto"}'), line('{"type":"response.in_progress","service_tier":"default"}'), line('{"type":"y","usage":{"output_tokens":1}}'), line("not json {")]), "", None, "no lines",
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "body string").select(records.stream_summary(F.col("body")).alias("s"))
    got = [tuple(r["s"]) for r in df.collect()]
    assert got[0] == ('{"output_tokens":3}', "response.completed", "auto") and got[1] == ('{"output_tokens":1}', None, "default") and got[2:] == [(None, None, None)] * 3


def test_stream_events_are_parsed_once(spark):
    """Odd events, and one parse for each: paths are read only of the two that count."""
    line = lambda *xs: "\n".join("data: " + x for x in xs)
    cases = [
        (line('[{"type":"response.failed","usage":1}]', '\t{"type":"response.completed"}', '{"type":"response.failed"'), (None, "response.completed", None)),
        (line('{"usage": {"a" : 1.50}, "response": "x", "service_tier": 7}', '{"usage":null,"type":3}'), ('{"a":1.5}', None, "7")),
        (line('{"type":"response.failed","response":{"usage":null,"service_tier":null},"usage":{"b":[1, 2]},"service_tier":"auto"}', '{"service_tier":{"x": 1}}'), ('{"b":[1,2]}', "response.failed", "auto")),
        (line("{'type':'response.completed','usage':'s'}", "[DONE]", "5", '"x"', "null", ""), ("s", "response.completed", None)),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i long, body string").select("i", records.stream_summary(F.col("body")).alias("s"))
    assert [tuple(r["s"]) for r in df.orderBy("i").collect()] == [x for _, x in cases]
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert shown.count("from_json(") == 1 and shown.count("get_json_object(") == 4


@pytest.mark.parametrize("bits", [3, 5, 20])
def test_last_value_is_carried_over_cuts(spark, bits):
    """Hot and null keys, ties of place, gaps: the same as one window over each key."""
    r = random.Random(bits)
    values = [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(200), r.choice([None, None, r.randrange(9)])) for i in range(600)]
    df = spark.createDataFrame(values, "id long, k string, at long, v long").repartition(4)
    found = records.last_before(df, ["k"], "at", ["id"], F.col("v"), "before", bits)
    last, wanted = {}, {}
    for i, k, _, v in sorted(values, key=lambda x: (x[2], x[0])):
        wanted[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert {x["id"]: x["before"] for x in found.collect()} == wanted and found.columns == [*df.columns, "before"]


def test_no_window_spans_a_conversation(spark, data):
    """Windows of E8 and C40 lie inside cuts of a conversation."""
    for name in ("e8_retry_after_failure", "c40_open_summary"):
        text = plan(catalog.QUERIES[name](spark, data)).split("== Physical Plan ==")[1]
        windows = [line for line in text.split("\n") if "windowspecdefinition" in line and "conversation" in line]
        assert windows and all("__c" in line.split("windowspecdefinition(")[1] for line in windows), name


PRUNED = {
    "a3_live_and_archive": ("GreaterThanOrEqual", "LessThan"), "a6_rollup_range": ("both",), "b34_kpis": ("both",), "d5b_active_minutes": ("both",), "d13_trailing_windows": ("both",), "d14_node_day": ("both",),
    "e1_rollup_and_tail": ("both", "both"), "e5_active_histories": ("both",), "e6_blocked_conversations": ("both", "both"), "f5_keyset_page": ("LessThan",), "g3_key_union": ("both", "both"),
    "h16_horizon": ("GreaterThanOrEqual",), "i5_expired_archives": ("LessThan",), "i15_last_activity": ("GreaterThanOrEqual", "LessThan"),
}


@pytest.mark.parametrize("name", PRUNED)
def test_ranges_are_pushed(spark, data, name):
    """Each scan of a range has its bounds on the stored time."""
    scans = [line for line in plan(catalog.QUERIES[name](spark, data)).split("== Physical Plan ==")[1].split("\n") if "PushedFilters" in line and "events" in line]
    both = [s for s in scans if "GreaterThanOrEqual(ts," in s and "LessThan(ts," in s]
    for wanted in set(PRUNED[name]):
        found = both if wanted == "both" else [s for s in scans if f"{wanted}(ts," in s]
        assert len(found) >= PRUNED[name].count(wanted), scans


def test_archives_are_materialised_by_file(spark):
    """A second run reads new files alone, a third finds none, a run done again changes nothing, and a changed file is refused."""
    path, root = archive.shared_dir(spark, "ledger-archive"), archive.shared_dir(spark, "ledger")
    df = spark.range(3000).select("id", (F.col("id") * 100).alias("epoch"))
    daily = lambda rows_: rows_.groupBy(F.floor(F.col("epoch") / 86400).alias("day")).agg(F.count("*").alias("n"))
    run = lambda n: ledger.materialise(spark, path, "calls", df.schema, root, n, daily)
    archive.write(df.where("epoch < 100000"), path, "calls")
    first = rows(run(0).select("day", "n"))
    archive.write(df.where("epoch >= 172800"), path, "calls")
    second = rows(run(1).select("day", "n"))
    assert {x[0] for x in first} == {0, 1} and {x[0] for x in second} == {2, 3} and sum(x[1] for x in first) == 1000 and sum(x[1] for x in second) == 3000 - 1728
    assert rows(run(1).select("day", "n")) == second and run(2).count() == 0
    want = daily(df.where("epoch < 100000 or epoch >= 172800"))
    assert rows(ledger.rollups(spark, root).groupBy("day").agg(F.sum("n"))) == rows(want)
    archive.write(df.where("epoch < 86400 and id % 2 = 0"), path, "calls")
    with pytest.raises(ledger.ChangedArchive):
        run(3)


def test_partial_rebuilds_are_refused(spark):
    facts = spark.range(300).select("id", (F.col("id") * 864).alias("epoch"))
    daily = lambda rows_: rows_.groupBy(F.floor(F.col("epoch") / 86400).alias("day")).agg(F.count("*").alias("n"))
    stored = spark.createDataFrame([(0, 100, "kept"), (1, 7, "stale")], "day long, n long, note string")
    compute = lambda rows_: daily(rows_).withColumn("note", F.lit("new"))
    assert rows(upkeep.refreshed(stored, facts, archive.manifest(facts), compute)) == [(0, 100, "kept"), (1, 100, "new"), (2, 100, "new")]
    with pytest.raises(upkeep.PartialFacts):
        upkeep.refreshed(stored, facts.where("id <> 150"), archive.manifest(facts), compute)
    assert rows(upkeep.refreshed(stored.where("day = 0"), facts.where("id < 100 and id <> 50"), archive.manifest(facts.where("id < 100")), compute)) == [(0, 100, "kept")]


def test_ended_calls_take_back_their_row_in_flight(spark):
    """A call that ends in another hour, and one that is withdrawn, leave no trace of what they were."""
    schema = "hour long, source string, flying boolean, total_tokens long, sign int"
    stored = upkeep.signed_totals(spark.createDataFrame([(0, "a", True, 0, 1), (0, "a", False, 5, 1), (3600, "b", True, 0, 1), (0, None, False, None, 1)], schema))
    deltas = upkeep.signed_totals(spark.createDataFrame([(0, "a", True, 0, -1), (7200, "a", False, 9, 1), (3600, "b", True, 0, -1)], schema))
    assert rows(upkeep.overlaid(stored, deltas)) == [(0, "a", 1, 0, 5), (0, None, 1, 0, 0), (7200, "a", 1, 0, 9)]


def test_bindings_overlap_and_end(spark):
    given = [(1, "a", 0, 100, 7), (2, "a", 50, 60, 8), (3, "a", 50, 60, 9), (4, "a", 90, None, 5), (5, "b", 10, 10, 1), (6, None, 0, None, 2)]
    bindings = spark.createDataFrame(given, "id long, k string, start long, end long, v long")
    at = [("a", t) for t in (0, 49, 50, 59, 60, 89, 90, 99, 100, 500)] + [("b", 10), (None, 5), ("c", 1)]
    calls_ = spark.createDataFrame([(i, *x) for i, x in enumerate(at)], "id long, k string, epoch long")
    for width in (7, 86_400):
        got = [r["v"] for r in records.bound_at(calls_, bindings, "k", "v", width).orderBy("id").collect()]
        assert got == [7, 7, 9, 9, 7, 7, 5, 5, 5, 5, None, None, None]


def test_bodies_are_read_as_far_as_they_go(spark, tmp_path):
    """Plain, packed in members, cut anywhere, damaged, empty: what is there comes back, and says whether it is all."""
    whole = 'data: {"a": "é"}\n\n' * 300
    packed = gzip.compress(whole.encode()[:1000]) + gzip.compress(whole.encode()[1000:])
    assert bodies.decoded(whole.encode()) == (whole, False, False) and bodies.decoded(packed) == (whole, True, False) and bodies.decoded(packed + bytes(512)) == (whole, True, False)
    for cut in range(1, len(packed) - 1):
        text, is_packed, truncated = bodies.decoded(packed[:cut])
        assert whole.startswith(text) and is_packed == (cut > 1) or cut == 1
        assert truncated or cut == 1 or len(text.encode()) == 1000
    text, _, truncated = bodies.decoded(packed[:-20] + b"x" * 20)
    assert truncated and text.startswith(whole[:900])
    assert bodies.decoded("é".encode()[:1]) == ("", False, True) and bodies.decoded(b"") == ("", False, False)
    for name, raw in (("a.gz", packed), ("b.gz", packed[:-8]), ("c.json", b' {"x": 1}'), ("d", b"")):
        (tmp_path / name).write_bytes(raw)
    got = {r["file"].rpartition("/")[2]: (r["kind"], r["packed"], r["truncated"], r["body"]) for r in bodies.read(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.gz": ("stream", True, False, whole), "b.gz": ("stream", True, True, whole), "c.json": ("json", False, False, ' {"x": 1}')}
