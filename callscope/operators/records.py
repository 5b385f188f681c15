"""Records, conversations, joins, paging, nodes, limits and repair jobs over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from . import selection
from .totals import classified, total


def scan(calls: DataFrame, start: int, end: int, source: str | None = None, ceiling: int | None = None) -> DataFrame:
    """Calls of [start, end), of a source, with ids up to a snapshot. All are plain predicates, pushed to the scan where columns are stored."""
    out = timing.within(calls, start, end)
    out = out.where(F.col("source") == source) if source else out
    return out.where(F.col("id") <= ceiling) if ceiling is not None else out


def with_archive(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Live rows and archived rows that aren't live; columns that an older archive lacks are null."""
    return live.unionByName(archive.join(live.select("id"), "id", "left_anti"), allowMissingColumns=True)


def final_attempt(attempts: DataFrame, value: str) -> DataFrame:
    """The value of the last try of each call (by attempt index, then id)."""
    return attempts.groupBy("id").agg(F.max_by(value, F.struct("attempt_index", "attempt_id")).alias(f"final_{value}"))


#: Fields of the payload, by both of their spellings, and the columns that hold them.
PAYLOAD = {
    "prompt_cache_key": ("promptCacheKey", "string"), "upstream_account_id": ("upstreamAccountId", "long"), "request_model": ("requestModel", "string"), "response_model": ("responseModel", "string"),
    "reasoning_effort": ("reasoningEffort", "string"), "service_tier": ("serviceTier", "string"), "endpoint": ("endpoint", "string"), "sticky_key": ("stickyKey", "string"), "proxy_name": ("proxyDisplayName", "string"),
    "requester_ip": ("requesterIp", "string"), "upstream_host": ("upstreamBaseUrlHost", "string"),
}


def with_payload(calls: DataFrame) -> DataFrame:
    """calls with the fields of PAYLOAD, blank ones null. The text is parsed once, whatever spelling its names have."""
    snake = lambda name: "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
    names = [n for name, _ in PAYLOAD.values() for n in dict.fromkeys((name, snake(name)))]
    # A generator, as predicates on what it makes stay above it; they would take a parse each below.
    parsed = calls.withColumn("__p", F.explode(F.array(F.from_json("payload", ", ".join(f"{n} string" for n in names)))))
    text = lambda name: F.coalesce(*(F.nullif(F.trim(F.col(f"__p.{n}")), F.lit("")) for n in dict.fromkeys((name, snake(name)))))
    return parsed.withColumns({column: text(name).cast(kind) for column, (name, kind) in PAYLOAD.items()}).drop("__p")


def model_of(*columns: str) -> Column:
    """The first of some names that isn't blank, else unknown."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit("unknown"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, without a window: one aggregate with map-side combine."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *(c for c in rows.columns if c not in (*order, key)))).alias("__last")).select(key, "__last.*")


def recent_per_key(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The last n rows of each key by time, then id; partial limits come before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("epoch"), F.desc("id"))
    return rows.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: Bits of a place that one window spans, at each level of cuts.
CUT_BITS = 20


def last_before(rows: DataFrame, keys: list[str], place: str, order: list[str], value: Column, name: str, bits: int = CUT_BITS) -> DataFrame:
    """rows with the last value that isn't null before each row, in the order (place, order...) of its key.

    Keys are cut by the leading bits of place (a whole number from 0 up to 2 ** (3 * bits)): a window lies inside one cut, and what comes before it is carried over
    from the ends of earlier cuts, in the same way over cuts of cuts. So a key of any number of rows is many tasks'.
    """

    def over(*cut: str) -> Window:
        return Window.partitionBy(*keys, *cut[:1]).orderBy(*cut[1:]).rowsBetween(Window.unboundedPreceding, -1)

    cut = [F.shiftright(F.col(place), n * bits) for n in (1, 2, 3)]
    rows = rows.withColumns({"__v": value, "__c1": cut[0]})
    after = F.when(F.col("__v").isNotNull(), F.struct(place, *order))
    ends = rows.groupBy(*keys, "__c1", cut[1].alias("__c2")).agg(F.max_by("__v", after).alias("__e"))
    above = ends.groupBy(*keys, "__c2", F.shiftright("__c2", bits).alias("__c3")).agg(F.max_by("__e", F.when(F.col("__e").isNotNull(), F.col("__c1"))).alias("__e"))
    above = above.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__c2").alias("__a2"), F.last("__e", True).over(over("__c3", "__c2")).alias("__s2"))
    same = lambda right, cut: [F.col(k).eqNullSafe(F.col(f"{right}{i}")) for i, k in enumerate(keys)] + [cut]
    seeds = ends.withColumn("__s1", F.last("__e", True).over(over("__c2", "__c1"))).join(above, same("__k", F.col("__c2") == F.col("__a2")), "left")
    seeds = seeds.select(*(F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)), F.col("__c1").alias("__a1"), F.coalesce("__s1", "__s2").alias("__s"))
    own = rows.withColumn("__own", F.last("__v", True).over(over("__c1", place, *order)))
    met = own.join(seeds, same("__q", F.col("__c1") == F.col("__a1")), "left").withColumn("__last", F.coalesce("__own", "__s"))
    return met.select(*(c for c in rows.columns if c not in ("__v", "__c1")), F.col("__last").alias(name))


def retry_after_failure(calls: DataFrame) -> DataFrame:
    """Whether the last terminal call before this one in its conversation failed."""
    state = F.when(~F.col("flying"), F.col("class") != "none")
    found = last_before(classified(calls.where("conversation is not null")), ["conversation"], "id", [], state, "retry")
    return found.withColumn("retry", F.coalesce("retry", F.lit(False)))


def bound_at(calls: DataFrame, bindings: DataFrame, key: str, value: str, width: int = 86_400) -> DataFrame:
    """calls (key, epoch, ...) with the value of the binding (id, key, start, end, value) that holds at their time: the latest begun, then the largest id.

    A binding holds from start up to, but without, end; a null end is open. Bindings lie in every cut of `width` seconds that they touch, up to the last call, so a call
    meets those of its own key and cut, as one array, and no pairs are made.
    """
    last = calls.agg(F.max("epoch").alias("__last"))  # one row
    stop = F.least(F.coalesce("end", F.col("__last") + 1), F.col("__last") + 1)
    open_ = bindings.join(F.broadcast(last)).withColumn("end", stop).where("start < end")
    dealt = open_.withColumn("__cut", F.explode(F.expr(f"sequence(start div {width}, (end - 1) div {width})")))
    held = dealt.groupBy(F.col(key).alias("__key"), F.col("__cut").alias("__c")).agg(F.collect_list(F.struct("start", "id", "end", value)).alias("__held"))
    met = calls.withColumn("__cut", F.expr(f"epoch div {width}")).join(held, (F.col(key) == F.col("__key")) & (F.col("__cut") == F.col("__c")), "left")
    now = F.array_max(F.filter("__held", lambda b: (b["start"] <= F.col("epoch")) & (b["end"] > F.col("epoch"))))
    return met.select(*(c for c in calls.columns if c != value), now[value].alias(value))


def working_set(calls: DataFrame, now: int, window: int = 300) -> DataFrame:
    """Conversations with a call in flight or activity in the last seconds."""
    rows = classified(timing.within(calls, end=now).where(F.col("conversation").isNotNull())).groupBy("conversation").agg(
        F.count_if("flying").alias("flying"), F.max("epoch").alias("last_seen"), F.max(F.when(~F.col("flying"), F.col("epoch"))).alias("last_terminal"), F.count("*").alias("n")
    )
    return rows.where((F.col("flying") > 0) | (F.col("last_seen") >= now - window))


def page(rows: DataFrame, sort: str = "epoch", descending: bool = True, number: int = 1, size: int = 50, snapshot: int | None = None) -> DataFrame:
    """One page, ties by id; later pages of one snapshot don't move when rows arrive. For deep pages of large tables take `after`."""
    rows = rows.where(F.col("id") <= snapshot) if snapshot is not None else rows
    way = F.desc_nulls_last if descending else F.asc_nulls_last
    return rows.orderBy(way(sort), way("id")).offset((number - 1) * size).limit(size)


#: What records can be sorted by.
SORTS = {"time": "epoch", "tokens": "total_tokens", "cost": "cost", "total": "t_total", "ttfb": "t_ttfb", "status": "status"}


def record_filters(**given) -> list[Column]:
    """Predicates of a record list over classified, priced calls with their payload fields; what isn't given doesn't filter."""
    text = lambda c: lambda v: F.lower(F.trim(F.col(c))) == v.strip().lower()
    model = given.get("model_target") == "response" and "response_model" or "request_model"
    named = F.coalesce(F.col("response_model"), F.col("request_model"), F.col("model"))
    rules = {
        "start": lambda v: F.col("occurred_at") >= timing.instant(v), "end": lambda v: F.col("occurred_at") < timing.instant(v), "snapshot": lambda v: F.col("id") <= v,
        "model": text(model), "models": lambda v: F.col(model).isin(*v), "rerouted": lambda v: (F.col("response_model").isNotNull() & (named != F.col("request_model"))) == F.lit(v),
        "status": text("status"), "endpoint": text("endpoint"), "invoke_id": lambda v: F.col("invoke_id") == v, "failure_class": lambda v: F.col("class") == v, "failure_kind": text("kind"),
        "prompt_cache_key": lambda v: F.col("conversation") == v, "sticky_key": lambda v: F.col("sticky_key") == v, "upstream_account": lambda v: F.col("account") == v,
        "upstream_scope": lambda v: F.col("account").isNull() == F.lit(v == "none"), "proxy_display_name": text("proxy_name"), "service_tier": text("service_tier"),
        "effort": text("effort"), "efforts": lambda v: F.col("effort").isin(*v), "requester_ip": text("requester_ip"), "source": lambda v: F.col("source") == v,
        "min_tokens": lambda v: F.col("total_tokens") >= v, "max_tokens": lambda v: F.col("total_tokens") <= v, "min_total_ms": lambda v: F.col("t_total") >= v, "max_total_ms": lambda v: F.col("t_total") <= v,
        "min_cost": lambda v: F.col("cost") >= v, "max_cost": lambda v: F.col("cost") <= v,
        "keyword": lambda v: _any(F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(v.lower())) for c in ("invoke_id", "model", "conversation", "error_message", "endpoint", "requester_ip")),
    }
    unknown = set(given) - set(rules) - {"model_target"}
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    return [rules[name](value) for name, value in given.items() if name in rules and value is not None]


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def record_list(rows: DataFrame, sort: str = "time", descending: bool = True, number: int = 1, size: int = 50, **filters) -> DataFrame:
    """One page of the records under filters, each with the number of all that match; missing values come last."""
    met = rows.where(_all(record_filters(**filters)))
    shown = page(met, SORTS[sort], descending, number, size)
    return shown.join(F.broadcast(met.agg(F.count("*").alias("total"))))


def after(rows: DataFrame, sort: str, value, last_id: int, size: int = 50) -> DataFrame:
    """The page after a cursor (value, id) in descending order: a filter and a top-k, however deep it is."""
    rows = timing.within(rows, end=value + 1) if sort == "epoch" else rows
    return rows.where((F.col(sort) < value) | ((F.col(sort) == value) & (F.col("id") < last_id))).orderBy(F.desc(sort), F.desc("id")).limit(size)


def locate(rows: DataFrame, sort: str, row_id: int, size: int = 50) -> DataFrame:
    """The page (from 1) that holds a row in descending order."""
    own = rows.where(F.col("id") == row_id).select(F.col(sort).alias("__value"))
    met = rows.join(F.broadcast(own)).where((F.col(sort) > F.col("__value")) | ((F.col(sort) == F.col("__value")) & (F.col("id") > row_id)))
    return met.agg(F.expr(f"cast(count(*) div {size} + 1 as bigint)").alias("page"))


def facets(rows: DataFrame, fields: list[str], filters: dict[str, Column], top: int) -> DataFrame:
    """Values and counts of each field under all filters but its own, most frequent first, and whether the field has more than are shown."""
    keep = {f: [c for name, c in filters.items() if name != f] for f in fields}
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.when(_all(keep[f]), F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))).alias("value")) for f in fields))
    counted = rows.select(F.explode(parts).alias("f")).where("f.value is not null").groupBy("f.field", "f.value").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top + 1)
    more = F.max("rank").over(Window.partitionBy("field")) > top  # at most top + 1 rows of a field
    return ranked.withColumn("has_more", more).where(F.col("rank") <= top)


def _all(filters: list[Column]) -> Column:
    out = F.lit(True)
    for f in filters:
        out = out & f
    return out


def summary(rows: DataFrame) -> DataFrame:
    """Token, latency and exception figures of a set of records."""
    stream = F.when(F.col("t_stream") > 0, F.col("t_stream"))
    found = classified(rows).withColumn("__all", F.lit(0))
    p95 = selection.percentiles(found, ["__all"], {"ttfb_p95": F.col("t_ttfb"), "stream_p95": stream, "total_p95": F.col("t_total")}, (0.95,))
    sums = found.groupBy("__all").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.round(F.avg("total_tokens"), 6).alias("tokens_mean"), F.max("total_tokens").alias("tokens_most"), F.sum("cache_tokens").alias("cache_read"), F.sum("output_tokens").alias("output"),
        total(F.col("cost")).alias("cost"), F.round(F.avg("t_ttfb"), 6).alias("ttfb_mean"), F.count(stream).alias("streamed"),
        F.count_if(F.col("class") == "service_failure").alias("service_failures"), F.count_if(F.col("class") == "client_failure").alias("client_failures"),
    )
    shown = (F.round(F.col(c)[0], 6).alias(c) for c in ("ttfb_p95", "stream_p95", "total_p95"))
    return sums.join(p95, "__all").select(*(c for c in sums.columns if c != "__all"), *shown)


#: Fixed value: the success rate of a node that no attempt has shown.
UNSEEN_RATE = 0.65


def node_profiles(attempts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Success rate, latency percentiles and kinds of failure (kind:count, the most frequent first) of each of `nodes`, without probes."""
    rows = attempts.where("not is_probe")
    rates = rows.groupBy("proxy_key").agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_success").cast("double")), 9).alias("success_rate"))
    p = selection.percentiles(rows, ["proxy_key"], {"ms": F.col("latency_ms")}, (0.5, 0.95)).select("proxy_key", F.round(F.col("ms")[0], 6).alias("p50"), F.round(F.col("ms")[1], 6).alias("p95"))
    kinds = rows.where("not is_success").groupBy("proxy_key", F.coalesce("failure_kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("m"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("less"), "kind")))  # as many as there are kinds
    said = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["kind"], (-x["less"]).cast("string"))), ",")
    found = nodes.select("proxy_key").join(rates, "proxy_key", "left").join(p, "proxy_key", "left").join(kinds.groupBy("proxy_key").agg(said.alias("failures")), "proxy_key", "left")
    return found.select("proxy_key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("success_rate", F.lit(UNSEEN_RATE)).alias("success_rate"), "p50", "p95", F.coalesce("failures", F.lit("")).alias("failures"))


TRAILING = {"1m": 60, "15m": 900, "1h": 3600, "1d": 86400, "7d": 604800}


def trailing_windows(attempts: DataFrame, now: int) -> DataFrame:
    """Node figures over five trailing windows in one pass; a mean only where every success has a latency."""
    rows = timing.within(attempts, now - max(TRAILING.values()), now).withColumn("age", now - F.col("epoch"))
    spans = F.array(*(F.struct(F.lit(n).alias("span"), F.lit(s).alias("seconds")) for n, s in TRAILING.items()))
    rows = rows.withColumn("w", F.explode(F.filter(spans, lambda w: F.col("age") <= w["seconds"])))
    good = F.count_if("is_success")
    return rows.groupBy("proxy_key", F.col("w.span").alias("span")).agg(F.count("*").alias("n"), good.alias("success"), F.when(good == F.count(F.when(F.col("is_success"), F.col("latency_ms"))), F.round(F.avg(F.when(F.col("is_success"), F.col("latency_ms"))), 6)).alias("mean_ms"))


def node_hours(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("proxy_key", timing.floor_to(F.col("epoch"), 3600).alias("hour")).agg(F.count("*").alias("n"), F.count_if("is_success").alias("success"), F.count_if(~F.col("is_success")).alias("failure"), F.count("latency_ms").alias("timed"), total(F.col("latency_ms"), 6).alias("latency_ms"), F.max("latency_ms").alias("latency_most"))


def carried_forward(hours: DataFrame, start: int, end: int, value: str) -> DataFrame:
    """A value per node and hour of [start, end), the last one known carried on; the last row before the range seeds it."""
    seed = hours.where(F.col("hour") < start).groupBy("proxy_key").agg(F.max_by(value, "hour").alias(value)).withColumn("hour", F.lit(start - 1).cast("long"))
    inside = hours.where((F.col("hour") >= start) & (F.col("hour") < end)).select("proxy_key", "hour", value)
    keys = hours.select("proxy_key").distinct()
    grid = keys.join(F.broadcast(timing.spine(hours.sparkSession, start, end, 3600).withColumnRenamed("bucket", "hour")))
    rows = grid.join(inside, ["proxy_key", "hour"], "left").unionByName(seed)
    filled = rows.withColumn(value, F.last(value, True).over(Window.partitionBy("proxy_key").orderBy("hour")))
    return filled.where(F.col("hour") >= start)


def quota_windows(samples: DataFrame, calls: DataFrame, now: int) -> DataFrame:
    """For each account the calls and tokens since its short window began (reset - duration), up to now."""
    last = latest(samples, "account", ["captured", "id"]).select("account", "short_percent", (F.col("resets") - F.col("short_minutes") * 60).alias("start"), F.least("resets", F.lit(now)).alias("end"))
    return calls.join(last, "account").where("epoch >= start and epoch < end").groupBy("account", "start", "end").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


def failure_penalties(attempts: DataFrame, window: int = 300, cut: int = 3600) -> DataFrame:
    """For every second in which a route used a node: its transport failures of the last `window` seconds since its last success.

    attempts: route, proxy_key, epoch, id, is_success, penalised. Seconds are taken by key and cut of time with the window carried over, as what
    is older than the window never counts; so no key is one task.
    """
    key = ["route", "proxy_key"]
    last = attempts.groupBy(*key, "epoch").agg(F.max(F.when(F.col("is_success"), F.col("id"))).alias("__ok"), F.collect_list(F.when(F.col("penalised"), F.col("id"))).alias("__bad"))  # a second of one key
    tail = F.size(F.filter("__bad", lambda i: F.col("__ok").isNull() | (i > F.col("__ok"))))
    seconds = timing.with_margin(last.select(*key, "epoch", tail.alias("failures"), F.col("__ok").isNotNull().alias("ok")), cut, window)
    run = F.count_if("ok").over(Window.partitionBy(*key, "cut").orderBy("epoch"))
    since = Window.partitionBy(*key, "cut", "run").orderBy("epoch").rangeBetween(-window, 0)
    return seconds.withColumn("run", run).select(*key, "epoch", "own", F.sum("failures").over(since).cast("long").alias("penalty")).where("own").drop("own")


def duplicates(accounts: DataFrame) -> DataFrame:
    """Pairs of accounts that share an identity; different seats of a team may."""
    a, b = (accounts.select(F.col("account").alias(x), "identity", *(F.col(c).alias(f"{c}_{x}") for c in ("team", "seat"))) for x in ("first", "second"))
    return a.join(b, "identity").where("first < second and not (team_first and team_second and seat_first <> seat_second)").select("identity", "first", "second")


def audit(rollup: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose totals differ: counts and tokens exactly, costs beyond max(1e-6, 1e-9 * |cost|)."""
    a, b = (x.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("n", "tokens", "cost"))) for x, s in ((rollup, "a"), (facts, "b")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    off = F.abs(zero("cost_a") - zero("cost_b")) > F.greatest(F.lit(1e-6), 1e-9 * F.abs(zero("cost_b")))
    return a.join(b, keys, "full").where((zero("n_a") != zero("n_b")) | (zero("tokens_a") != zero("tokens_b")) | off)


def compacted(snapshots: DataFrame, cutoff: int) -> DataFrame:
    """All snapshots from the cutoff on, and the last of each day before it."""
    day = F.floor(F.col("captured") / 86400)
    old = latest(snapshots.where(F.col("captured") < cutoff).withColumn("day", day), "day", ["captured", "id"]).drop("day")
    return snapshots.where(F.col("captured") >= cutoff).unionByName(old)


def pruned(calls: DataFrame, now: int, full_days: int = 10, kept_days: int = 25) -> DataFrame:
    """Retention: rows older than kept_days go; successes older than full_days keep five attribution fields of their payload."""
    age = (now - F.col("epoch")) / 86400
    fields = ("promptCacheKey", "upstreamAccountId", "requestModel", "reasoningEffort", "serviceTier")
    slim = F.to_json(F.struct(*(F.get_json_object("payload", f"$.{f}").alias(f) for f in fields)))
    cut = (age > full_days) & F.col("ok")
    return classified(calls).where(age <= kept_days).withColumns({"payload": F.when(cut, slim).otherwise(F.col("payload")), "detail": F.when(cut, "structured_only").otherwise("full")})


def usage_of(body: Column) -> Column:
    """struct of token counts in a response body; the total is the sum where it is absent."""
    number = lambda *paths: F.coalesce(*(F.get_json_object(body, p).cast("long") for p in paths))
    inp, out = number("$.usage.input_tokens", "$.usage.prompt_tokens"), number("$.usage.output_tokens", "$.usage.completion_tokens")
    return F.struct(
        inp.alias("input"), out.alias("output"), number("$.usage.input_tokens_details.cached_tokens", "$.usage.prompt_tokens_details.cached_tokens").alias("cached"),
        number("$.usage.output_tokens_details.reasoning_tokens", "$.usage.completion_tokens_details.reasoning_tokens").alias("reasoning"), F.coalesce(number("$.usage.total_tokens"), inp + out).alias("total"),
    )


def _let(value: Column, then) -> Column:
    """then(value), where value is evaluated once, however often it is named."""
    return F.transform(F.array(value), then)[0]


#: What a summary looks at in an event.
EVENT = "type string, service_tier string, usage string, response struct<service_tier: string, usage: string>"


def stream_summary(body: Column) -> Column:
    """struct(usage, kind, tier) of an event stream body: the last usage, the last terminal event, and the service tier of the event that says most.

    Terminal events say more than those of the beginning, these more than all others; among equals the last counts, but auto yields to any other tier.
    Each event is parsed once; only the texts of the two that count are read by path.
    """
    texts = F.transform(F.filter(F.split(body, r"\r?\n"), lambda line: line.startswith("data:")), lambda line: F.trim(F.substring(line, 6, 1 << 30)))
    parsed = F.transform(texts, lambda text, i: F.struct(  # an array has none of the fields
        text.alias("text"), F.from_json(F.when(~text.rlike(r"^\s*\["), text), EVENT, {"allowUnquotedControlChars": "true"}).alias("e"), i.alias("place"),
    ))
    has = lambda x, name: F.coalesce(x["e"]["response"][name], x["e"][name])
    rank = lambda k: F.when(k.isin("response.completed", "response.failed"), 2).when(k.isin("response.created", "response.in_progress"), 1).otherwise(0)
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    of = lambda e, name: _let(e, lambda e: F.coalesce(*(F.get_json_object(e, f"$.{p}") for p in (f"response.{name}", name))))
    best = lambda xs: F.array_max(F.transform(F.filter(xs, lambda x: has(x, "service_tier").isNotNull()), lambda x: F.struct(rank(x["e"]["type"]).alias("rank"), (has(x, "service_tier") != "auto").alias("named"), x["place"].alias("place"), x["text"].alias("text"))))
    return _let(parsed, lambda xs: F.struct(
        of(last(F.filter(xs, lambda x: has(x, "usage").isNotNull()))["text"], "usage").alias("usage"),
        last(F.filter(xs, lambda x: rank(x["e"]["type"]) == 2))["e"]["type"].alias("kind"), of(best(xs)["text"], "service_tier").alias("tier"),
    ))


def latest_quota(snapshots: DataFrame) -> DataFrame:
    """One row: the last snapshot, or where there is none a degraded one of zeros."""
    none = snapshots.sparkSession.range(1).select(F.lit(True).alias("__always"))
    last = snapshots.orderBy(F.desc("captured"), F.desc("id")).limit(1).withColumn("__there", F.lit(True))
    met = none.join(last, F.lit(True), "left")
    zero = lambda f: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
    return met.select(*(zero(f) for f in snapshots.schema.fields), F.col("__there").isNull().alias("degraded"))


def last_activity(live: DataFrame, archived: DataFrame) -> DataFrame:
    """account, first_seen, last_seen: the archives' own summaries (account, first_seen, last_seen) and those of live calls, merged."""
    own = live.where("account is not null").groupBy("account").agg(F.min("epoch").alias("first_seen"), F.max("epoch").alias("last_seen"))
    return own.unionByName(archived).groupBy("account").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def stream_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per data line of an event stream body, with its place."""
    return bodies.select("*", F.posexplode(F.split(body, r"\r?\n")).alias("place", "line")).where(F.col("line").startswith("data:")).withColumn("event", F.trim(F.substring("line", 6, 1 << 30))).drop("line")
