"""Archives, backfills, coverage, account states and other reports over calls and attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cost, status, timing
from ..sources.archive import manifest
from .totals import classified


def reconciled(stored: DataFrame, fresh: DataFrame, known: DataFrame, found: DataFrame, scope: str = "source") -> DataFrame:
    """Rollup rows with `complete`: those computed anew, but where a source lacks days of its manifest, or they hold other rows, the stored ones.

    known and found are manifests by scope and day: what was written, and what the sources hold now.
    """
    keys = [scope, "day"]
    a, b = (m.select(*keys, F.struct("n", "checksum").alias(name)) for m, name in ((known, "known"), (found, "found")))
    refused = a.join(b, keys, "full").where(~F.col("known").eqNullSafe(F.col("found"))).select(scope).distinct()
    return fresh.join(refused, scope, "left_anti").withColumn("complete", F.lit(True)).unionByName(stored.join(refused, scope, "left_semi").withColumn("complete", F.lit(False)))


def billing_tier(explicit: Column, requested: Column, response: Column, api_key: Column) -> Column:
    """The tier that is billed: the explicit one, else what was asked for where a key pays, else what the response says."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(clean(explicit), F.when(api_key, clean(requested)), clean(response))


def display_status(status: Column, label: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("", "success", "running", "pending")
    return F.when((label != "none") & plain, "failed").otherwise(status)


def model_failure(status: Column, error: Column, model: Column) -> Column:
    """unsupported_model, model_not_found or model_rate_limited where the failure is about the requested model itself, else null."""
    low, named = F.lower(F.coalesce(error, F.lit(""))), F.contains(F.lower(F.coalesce(error, F.lit(""))), F.lower(model))
    return (
        F.when(named & low.rlike("unsupported|not supported"), "unsupported_model").when(named & low.rlike("not found|does not exist"), "model_not_found")
        .when((status == "http_429") & named, "model_rate_limited")
    )


#: What an account can or can't do, and the endpoint that shows it.
AXES = {
    "compact": "/v1/responses/compact", "search": "/v1/search", "responses": "/v1/responses", "chat": "/v1/chat/completions", "image_tool": "/v1/responses#image_generation", "image_endpoint": "/v1/images/generations",
}
REFUSALS = r"unsupported (endpoint|path|tool|model)|not supported|does not support|unknown tool|no such endpoint"


def capability(attempts: DataFrame) -> DataFrame:
    """attempts (endpoint, status, error_message) of the endpoints in AXES, with axis and state: supported, unsupported or unknown.

    A success supports. A missing path denies an endpoint of its own; for all, a bad request, or for compaction any failure, denies if its text says so.
    """
    axis = F.coalesce(*(F.when(F.col("endpoint") == path, name) for name, path in AXES.items()))
    fine = F.col("status").isin("success", "completed", "warning_success", "http_200")
    says = F.coalesce(F.lower("error_message").rlike(REFUSALS), F.lit(False))
    missing = F.col("status").isin("http_404", "http_405") & ((F.col("axis") == "search") | (F.col("axis").isin("responses", "chat") & says))
    denied = missing | ((F.col("status") == "http_400") & says) | ((F.col("axis") == "compact") & says)
    return attempts.withColumn("axis", axis).where("axis is not null").withColumn("state", F.when(fine, "supported").when(denied, "unsupported").otherwise("unknown"))


def latest_capability(attempts: DataFrame) -> DataFrame:
    """The last known state of each account and axis, and how many observations told one; unknown ones change nothing."""
    known = capability(attempts).where("state <> 'unknown' and account is not null")
    return known.groupBy("account", "axis").agg(F.max_by("state", F.struct("epoch", "attempt_id")).alias("state"), F.count("*").alias("observations"))


def account_status(calls: DataFrame, accounts: DataFrame, now: int, recent: int = 86400) -> DataFrame:
    """disabled, failing (the last call failed), active (a call in the last seconds) or idle."""
    last = classified(calls.where(F.col("account").isNotNull() & (F.col("epoch") < now))).groupBy("account").agg(F.max("epoch").alias("last_call"), F.max_by("class", F.struct("epoch", "id")).alias("last_class"))
    state = F.when(~F.col("enabled"), "disabled").when(F.col("last_class").isin("service_failure", "client_failure"), "failing").when(F.col("last_call") >= now - recent, "active").otherwise("idle")
    return accounts.join(last, "account", "left").select("account", "last_call", state.alias("state"))


def due_accounts(samples: DataFrame, accounts: DataFrame, now: int, interval: int) -> DataFrame:
    """Enabled accounts whose last sample is old, exhausted or reset, the neediest first."""
    last = samples.groupBy("account").agg(F.max("captured").alias("captured"), F.max_by("short_percent", F.struct("captured", "id")).alias("percent"), F.max_by("resets", F.struct("captured", "id")).alias("resets"))
    rows = accounts.where("enabled").join(last, "account", "left").withColumn("exhausted", F.coalesce(F.col("percent") >= 90, F.lit(False)))
    reason = F.when(F.col("captured").isNull(), "never").when(F.col("exhausted") & (F.col("resets") <= now), "reset").when(F.col("captured") < now - interval, "interval")
    return rows.withColumn("reason", reason).where("reason is not null").select("account", "captured", "exhausted", "reason").orderBy(F.col("reason") != "never", F.col("reason") != "reset", "captured", "account")


def hidden_conversations(calls: DataFrame, limit: int) -> DataFrame:
    """How many conversations lie beyond the newest `limit`, from the cut-off row and two counts; no window over all."""
    born = calls.where("conversation is not null").groupBy("conversation").agg(F.min("epoch").alias("created"))
    shown = born.orderBy(F.desc("created"), "conversation").limit(limit).agg(F.count("*").alias("shown"))
    return born.agg(F.count("*").alias("total")).join(F.broadcast(shown)).select("total", "shown", (F.col("total") - F.col("shown")).alias("hidden"))


def stream_error_escapes(attempts: DataFrame, apart: int = 300, cut: int = 3600) -> DataFrame:
    """account, hour, escaped, until: after the last attempt that ended in each hour, whether the latest two of the account failed in the stream within `apart` seconds.

    A pair that counts lies in an hour and the `apart` seconds before it, so rows are taken by account and hour; no account is one task.
    """
    done = attempts.where("account is not null").where(status.terminal(F.col("status")))
    bad = F.coalesce(status.derived_kind(F.col("status"), F.col("error_message")) == "upstream_stream_error", F.lit(False))
    rows = timing.with_margin(done.select("account", "epoch", "attempt_id", bad.alias("bad")), cut, apart)
    two = rows.withColumn("rank", F.row_number().over(Window.partitionBy("account", "cut").orderBy(F.desc("epoch"), F.desc("attempt_id")))).where("rank <= 2")
    found = two.groupBy("account", "cut").agg(F.max("own").alias("own"), F.count("*").alias("n"), F.every("bad").alias("bad"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    escaped = (F.col("n") == 2) & F.col("bad") & (F.col("last") - F.col("first") <= apart)
    return found.where("own").select("account", (F.col("cut") * cut).alias("hour"), escaped.alias("escaped"), F.when(escaped, F.col("last") + apart).alias("until"))


def task_runs(runs: DataFrame, kind: str | None = None, status: str | None = None, start: int | None = None, end: int | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """One page of runs (id, kind, status, epoch), the newest first, each with the number of all that match; blank filters don't filter."""
    met = timing.within(runs, start, end)
    for column, value in (("kind", kind), ("status", status)):
        met = met.where(F.col(column) == value.strip()) if value and value.strip() else met
    shown = met.orderBy(F.desc("epoch"), F.desc("id")).offset((max(number, 1) - 1) * min(max(size, 1), 100)).limit(min(max(size, 1), 100))
    return shown.join(F.broadcast(met.agg(F.count("*").alias("total"))))


def coverage(calls: DataFrame, ceiling: int) -> DataFrame:
    """Hours and scopes that a rollup up to an id covers, and whether all of the hour's rows are in it."""
    return calls.groupBy(timing.floor_to(F.col("epoch"), 3600).alias("hour"), F.col("source").alias("scope")).agg(F.count("*").alias("n"), F.every(F.col("id") <= ceiling).alias("complete"))


def reconstructable_since(days: DataFrame, first: int, last: int) -> DataFrame:
    """The first day from which on every day to `last` is covered: the day after the latest gap."""
    wanted = days.sparkSession.range(first, last + 1).withColumnRenamed("id", "day")
    return wanted.join(days.select("day").distinct(), "day", "left_anti").agg((F.coalesce(F.max("day"), F.lit(first - 1)) + 1).alias("since"))


def subtracted(total: DataFrame, part: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """A rollup less the rows of another: a signed sum, keys that come to nothing left out."""
    signed = total.select(*keys, *sums).unionByName(part.select(*keys, *(-F.col(c) for c in sums)).toDF(*keys, *sums))
    return signed.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)).where(F.col(sums[0]) != 0)


class PartialFacts(ValueError):
    """Days that can't be computed anew, as some of their rows are missing."""


def refreshed(stored: DataFrame, facts: DataFrame, expected: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Daily rows (day, n, ...): those whose n is that of the facts stay, others are computed from the facts of their days.

    expected: the manifest (day, n) of what the facts should be. If a stale day lacks some of it, nothing is rebuilt: PartialFacts.
    """
    day = F.floor(F.col("epoch") / 86400)
    held = facts.groupBy(day.alias("day")).agg(F.count("*").alias("facts"))
    wanted = expected.groupBy("day").agg(F.sum("n").alias("wanted"))
    good = stored.join(wanted, "day").where("n = wanted").select(stored.columns)
    stale = wanted.join(good.select("day"), "day", "left_anti")
    partial = stale.join(held, "day", "left").where("facts is null or facts <> wanted").select("day").first()
    if partial:
        raise PartialFacts(f"day {partial[0]}")
    anew = compute(facts.withColumn("day", day).join(stale.select("day"), "day", "left_semi").drop("day"))
    return good.unionByName(anew.select(stored.columns))


#: What an hour of a source counts.
HOURLY = ("n", "flying", "tokens")


def signed_totals(rows: DataFrame) -> DataFrame:
    """Hour and source: calls, calls in flight and tokens of rows (hour, source, flying, total_tokens, sign), those with sign -1 taken off."""
    sign = F.col("sign").cast("long")
    return rows.groupBy("hour", "source").agg(F.sum(sign).alias("n"), F.sum(F.when(F.col("flying"), sign).otherwise(0)).alias("flying"), F.coalesce(F.sum(sign * F.col("total_tokens")), F.lit(0)).alias("tokens"))


def overlaid(stored: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored hours with signed deltas added: a call that has ended takes its row in flight back. Hours that come to nothing are left out."""
    both = stored.select("hour", "source", *HOURLY).unionByName(deltas.select("hour", "source", *HOURLY))
    return both.groupBy("hour", "source").agg(*(F.sum(c).alias(c) for c in HOURLY)).where(" or ".join(f"{c} <> 0" for c in HOURLY))


def backfilled(calls: DataFrame, bodies: DataFrame, usage: Column) -> DataFrame:
    """Token counts of calls that have none, from the stored bodies (id, body)."""
    found = bodies.select("id", usage.alias("u"))
    met = calls.join(found, "id", "left")
    return met.withColumns({"input_tokens": F.coalesce("input_tokens", "u.input"), "output_tokens": F.coalesce("output_tokens", "u.output")}).drop("u")


def recosted(calls: DataFrame, prices: DataFrame, version: str, threshold: int = 272_000) -> DataFrame:
    """Every call, its cost and price_version brought to that version of the catalog.

    Only calls without a cost, or priced by another version, are priced; what `prices` can't price stays as it was.
    """
    old = F.col("cost").isNull() | ~F.col("price_version").eqNullSafe(F.lit(version))
    anew = cost.priced(calls.where(old).drop("cost", "price_version"), prices, threshold=threshold).select("id", F.col("cost").alias("new_cost"))
    met = calls.join(anew, "id", "left")
    return met.withColumns({"price_version": F.when(F.col("new_cost").isNotNull(), version).otherwise(F.col("price_version")), "cost": F.coalesce("new_cost", "cost")}).drop("new_cost")
