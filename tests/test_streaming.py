"""Streams against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import series, totals, weights
from callscope.sources import adapter
from callscope.streaming import live

from .conftest import DATA


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Calls as five files, in order of time."""
    from callscope.queries.registry import paid

    path = str(tmp_path_factory.mktemp("calls"))
    rows = paid(spark, DATA).withColumn("at", F.timestamp_seconds("epoch"))
    ids = rows.count()
    for i in range(5):
        rows.where(f"id > {i * ids // 5} and id <= {(i + 1) * ids // 5}").coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def drained(query):
    query.processAllAvailable()
    query.stop()


def memory(spark, df, name, mode):
    drained(df.writeStream.format("memory").queryName(name).outputMode(mode).start())
    return spark.table(name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hourly_rollup(spark, source, tmp_path):
    path, calls = source
    for _ in range(2):  # the second run finds nothing new
        live.hourly_rollup(live.read_calls(spark, path, calls), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = live.read_rollup(spark, f"{tmp_path}/out").select("hour", "source", "n", "success", "failure", "tokens")
    assert rows(got) == rows(totals.totals(calls, totals.hour(), "source").select(got.columns))


def test_wall_time(spark, source, tmp_path):
    path, calls = source
    live.segment_rollup(live.read_calls(spark, path, calls), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = series.wall_time(series.hour_slices(calls), "account", "bucket").select("account", "bucket", "wall_ms", "calls")
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, live.read_wall_time(spark, f"{tmp_path}/out").collect()), key=lambda r: key((r[0] or 0, *r[1:]))) == sorted(map(tuple, want.collect()), key=lambda r: key((r[0] or 0, *r[1:])))


def test_minutes_and_windows(spark, source):
    path, calls = source
    want = calls.groupBy(F.expr("epoch div 60 * 60").alias("minute")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
    got = memory(spark, live.minute_series(live.read_calls(spark, path, calls)), "minutes", "update").groupBy("minute").agg(F.max("n"), F.max("tokens"))
    assert rows(got) == rows(want)
    slid = memory(spark, live.sliding_activity(live.read_calls(spark, path, calls)), "sliding", "update").groupBy("account", "start").agg(F.max("n"), F.max("tokens"))
    twin = calls.where("account is not null").withColumn("start", F.explode(F.expr("array(epoch div 30 * 30, epoch div 30 * 30 - 30)"))).groupBy("account", "start").agg(F.count("*"), F.sum("total_tokens"))
    assert rows(slid) == rows(twin)
    network = memory(spark, live.network_minutes(live.read_calls(spark, path, calls)), "network", "update").where("scope = 'global'").groupBy("minute").agg(F.max("bytes"))
    assert rows(network) == rows(calls.groupBy(F.expr("epoch div 60 * 60")).agg(F.sum("input_tokens") * 4))


def test_in_progress(spark, source):
    path, calls = source
    drained(live.in_progress(live.read_calls(spark, path, calls)).writeStream.format("memory").queryName("progress").outputMode("update").start())
    got = spark.table("progress").groupBy("conversation").agg(F.max("running").alias("running")).where("running > 0")
    want = calls.where("conversation is not null and status = 'running'").groupBy("conversation").agg(F.count("*"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("rule", [1, 2])
def test_node_weights(spark, rule):
    attempts = adapter.node_attempts(adapter.invocations(spark, DATA))
    got = {r["id"]: (r["weight"], r["failures"]) for r in weights.node_weights(attempts, rule).collect()}
    states: dict = {}
    for r in sorted(attempts.collect(), key=lambda r: (r["epoch"], r["id"])):
        states[r["proxy_key"]] = weights.weigh(states.get(r["proxy_key"], weights.START), r["is_success"], r["latency_ms"], r["is_probe"], rule)
        assert got[r["id"]] == pytest.approx(states[r["proxy_key"]][:2], abs=1e-12)  # maps are composed in another order
    low, high = weights.RULES[rule]["low"], weights.RULES[rule]["high"]
    assert all(low <= w <= high for w, _ in got.values())


def test_route_health(spark):
    made = [(i, 1, "m", t, kind) for i, (t, kind) in enumerate([(0, "error"), (1, "error"), (2, "error"), (3, "error"), (4, "error"), (40, "view"), (50, "error"), (85, "error"), (100, "error"), (131, "error")])]
    df = spark.createDataFrame(made, "id long, account long, model string, epoch long, event_type string")
    assert [s for _, s in rows(live.route_health(df))] == ["healthy"] * 4 + ["cooling_down", "healthy", "healthy", "healthy", "healthy", "healthy"]


def test_changed(spark):
    df = spark.createDataFrame([(i, i * 30_000, v) for i, v in enumerate([1, 1, 2, 2, 2, 1, 1, 3])], "id long, captured long, v long")
    assert [r["id"] for r in live.changed(df, "v").orderBy("id").collect()] == [k for k, v in enumerate([1, 1, 2, 2, 2, 1, 1, 3]) if k in (0, 2, 5, 7)]


@pytest.mark.parametrize("seed", range(3))
def test_route_health_is_the_walk(spark, seed):
    """Islands against the rule applied from attempt to attempt, with a route that fails for thousands of attempts."""
    r, walk, wanted = random.Random(seed), [], {}
    for account in (1, 2):
        epoch = 1000
        for i in range(1500):
            epoch += r.choice([0, 0, 1, 5, 14, 29, 30, 31, 90])
            walk.append((len(walk), account, "m", epoch, "error" if r.random() < (0.7 if account == 1 else 0.995) else "view"))
    for account in (1, 2):
        streak = began = last = until = level = 0
        for i, _, _, epoch, kind in sorted((x for x in walk if x[1] == account), key=lambda x: (x[3], x[0])):
            if kind == "error":
                began = epoch if not streak or epoch - last > 30 else began
                streak, last = streak + 1, epoch
                if streak >= 5 or epoch - began >= 30:
                    until, level = epoch + min(15 * 2**level, 60), level + 1
            else:
                streak = until = level = 0
            wanted[i] = "cooling_down" if until > epoch else "degraded" if level else "healthy"
    df = spark.createDataFrame(walk, "id long, account long, model string, epoch long, event_type string").repartition(4)
    found = live.route_health(df)
    assert dict(rows(found)) == wanted and "Python" not in found._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def stateful_session(spark):
    from callscope.streaming import stateful

    return stateful.session(spark)


def replayed(session, folder, like, batches, start):
    """What a stream over `batches` of rows, one file each, has written, and where its checkpoint lies."""
    import os
    import time

    for i, batch in enumerate(batches):
        session.createDataFrame(batch, like).withColumn("at", F.timestamp_seconds("second" if "second" in like else "epoch")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    assert os.path.isdir(f"{folder}/in")
    rows_ = session.read.parquet(f"{folder}/in")
    stream = session.readStream.schema(rows_.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live.by_batch(start(stream), f"{folder}/out", f"{folder}/check", mode="update").awaitTermination()


def test_repeated_rows_rebuild_their_minute(spark, stateful_session, tmp_path):
    """Repeats count once, corrections replace, open minutes are shown, and what the horizon has passed holds no state."""
    from callscope.streaming import stateful

    day = 86_400
    batches = [[(1, day, 5), (2, day + 30, 7), (3, day + 61, 1)], [(2, day + 30, 70), (1, day, 5), (4, day + 59, 1)], [(5, 4 * day, 9)], [(6, 4 * day + 1, 1)]]
    replayed(stateful_session, str(tmp_path), "id long, epoch long, total_tokens long", batches, lambda s: stateful.minutes(s, keep=day))
    got = stateful.read_minutes(live.latest_of(spark, f"{tmp_path}/out", "minute", "shard"))
    assert rows(got) == [(day, 3, 76), (day + 60, 1, 1), (4 * day, 2, 10)]
    held = stateful_session.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "sums").load().select("key.minute").distinct()
    assert rows(held) == [(4 * day,)]


def test_a_stretch_of_minutes_is_one_key(spark, stateful_session, tmp_path):
    """Calls of two hours are two values of the state for each part, however many minutes and calls there are; repeats in one batch and in later ones count once."""
    from callscope.streaming import stateful

    first = [(i, 86_400 + i % 7200, i) for i in range(3000)]
    again = [(i, epoch, 2 * tokens) for i, epoch, tokens in first if i % 9 == 4] + [(4, 86_400 + 3600, 1)]  # the last is another minute's
    replayed(stateful_session, str(tmp_path), "id long, epoch long, total_tokens long", [first + first[:50], again], lambda s: stateful.minutes(s, shards=2))
    got = rows(stateful.read_minutes(live.latest_of(spark, f"{tmp_path}/out", "minute", "shard")))
    want = {}
    for _, (epoch, tokens) in sorted(({(i, e // 60): (e, t) for i, e, t in first + again}).items()):
        n, sum_ = want.get(epoch // 60 * 60, (0, 0))
        want[epoch // 60 * 60] = (n + 1, sum_ + tokens)
    assert got == sorted((m, n, s) for m, (n, s) in want.items())
    held = stateful_session.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "sums").load()
    assert held.count() <= 4
    assert stateful.parts(spark.range(40_000).select(F.expr("id div 20").alias("epoch"))) == 3


def test_retractions_leave_their_window(spark, stateful_session, tmp_path):
    from callscope.streaming import stateful

    batches = [[(1, 599, 5, 1), (1, 600, 7, 1), (1, 658, 1, 1), (2, 600, 2, 1), (None, 600, 2, 1)], [(1, 659, 3, 1), (1, 600, 7, -1)], [(1, 599, 5, 1)]]
    replayed(stateful_session, str(tmp_path), "account long, second long, total_tokens long, sign long", batches, stateful.activity)
    got = stateful.read_activity(live.latest_of(spark, f"{tmp_path}/out", "account", "second"))
    assert rows(got) == [(1, 599, 2, 10), (1, 658, 3, 11), (1, 659, 2, 4), (2, 600, 1, 2)]


@pytest.mark.parametrize(("rule", "segment", "good"), [(1, 7, 0.5), (2, 64, 0.3), (2, 2048, 0.9), (1, 500, 0.12), (2, 1, 0.4)])
def test_node_weights_over_segments(spark, monkeypatch, rule, segment, good):
    """One node with nearly all attempts, over many tasks and segments of any length, against the rule from attempt to attempt."""
    monkeypatch.setattr(weights, "SEGMENT", segment)
    r = random.Random(segment)
    given = [(i, "hot" if i % 40 else f"n{i % 3}", i // 7, r.random() < good, r.choice([None, float("nan"), 0.0, r.expovariate(0.001), 20000.0]), r.random() < 0.3) for i in range(1200)]
    df = spark.createDataFrame(given, "id long, proxy_key string, epoch long, is_success boolean, latency_ms double, is_probe boolean").repartition(5)
    got = {x["id"]: tuple(x[1:]) for x in weights.node_weights(df, rule).collect()}
    states = {}
    for i, node, _, ok, latency, probe in given:
        states[node] = weights.weigh(states.get(node, weights.START), ok, latency, probe, rule)
        weight, failures, rate, mean = states[node]
        key, w, f, x, m = got[i]
        assert key == node and f == failures and w == pytest.approx(weight, abs=1e-9) and x == pytest.approx(rate, abs=1e-12)
        assert m is None if mean is None else m == pytest.approx(mean, rel=1e-12)
    assert len(got) == len(given)


def test_pieces_are_the_walk():
    """A segment's pieces give the weight after it for any weight before it."""
    r = random.Random(3)
    for rule in (1, 2):
        for n in (1, 2, 5, 40, 300):
            ok, probe = [r.random() < 0.5 for _ in range(n)], [r.random() < 0.4 for _ in range(n)]
            own = weights.Segment(ok, [r.expovariate(0.001) for _ in range(n)], probe, rule)
            own.set_seeds(2, 0.5, 800.0)
            pieces = own.pieces()
            for w in [*(r.uniform(-12, 12) for _ in range(20)), -8.0, 0.0, 0.25, 8.0]:
                seen, found = w, own.weights(w)
                for i in range(n):
                    set_ = ok[i] and probe[i] and seen + own.d[i] <= 0
                    seen = own.saved if set_ else min(max(seen + own.d[i], own.low[i]), own.high[i])
                    assert abs(found[i] - seen) < 1e-9
                assert weights._weight_step((w,), {"pieces": pieces})[0] == pytest.approx(seen, abs=1e-9)
