"""Totals, rollups and reports by groups of calls. Every rollup is a partial aggregate: rows of the same key merge by sum, min and max."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histogram, status, timing
from . import selection

HOUR = timing.HOUR


def classified(calls: DataFrame) -> DataFrame:
    """calls with ok (success-like), flying, kind, class and actionable."""
    return status.with_failure(calls)


def lost() -> Column:
    """Over classified calls: interrupted, or terminal and failed."""
    return (status.norm(F.col("status")) == "interrupted") | (~F.col("flying") & (F.col("class") != "none"))


def total(c: Column, digits: int = 10) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), digits)


def counts() -> list[Column]:
    """Counts and sums over classified, priced calls."""
    return [
        F.count("*").alias("n"), F.count_if(F.col("ok") & (F.col("class") == "none")).alias("success"), F.count_if(~F.col("flying") & (F.col("class") != "none")).alias("failure"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), total(F.col("cost")).alias("cost"), total(F.when(lost(), F.col("cost"))).alias("non_success_cost"),
    ]


def totals(calls: DataFrame, *keys: str | Column) -> DataFrame:
    return classified(calls).groupBy(*keys).agg(*counts())


def recent(calls: DataFrame, n: int) -> DataFrame:
    """The last n calls by time, then id: a top-k, not a sort of all."""
    return calls.orderBy(F.desc("epoch"), F.desc("id")).limit(n)


def hour() -> Column:
    return timing.floor_to(F.col("epoch"), HOUR).alias("hour")


def hourly(calls: DataFrame) -> DataFrame:
    """Hour and source: counts, tokens, cost, latency of calls with a positive first byte, and its histogram."""
    v = F.col("__v")
    rows = classified(calls).withColumn("__v", F.when(F.col("ok") & (F.col("t_ttfb") > 0), F.col("t_ttfb")))
    rows = rows.withColumn("__at", histogram.place(v))
    return rows.groupBy(hour(), "source").agg(*counts(), F.count(v).alias("ttfb_n"), total(v).alias("ttfb_ms"), F.max(v).alias("ttfb_max"), histogram.counted(F.col("__at")).alias("ttfb_hist"))


def failures(calls: DataFrame) -> DataFrame:
    """Hour, source, class, actionable and category of terminal failures."""
    found = classified(calls).where(~F.col("flying") & (F.col("class") != "none")).withColumn("category", status.category(F.coalesce("error_message", F.lit(""))))
    return found.groupBy(hour(), "source", "class", "actionable", "category").agg(F.count("*").alias("n"))


STAGES = {"total": "t_total", "requestRead": "t_read", "requestParse": "t_parse", "upstreamConnect": "t_connect", "upstreamFirstByte": "t_ttfb", "upstreamStream": "t_stream", "responseParse": "t_answer", "persistence": "t_store"}


def stages(calls: DataFrame) -> DataFrame:
    """One row per call and stage that has a valid duration."""
    pairs = ", ".join(f"'{name}', {column}" for name, column in STAGES.items())
    return calls.select("*", F.expr(f"stack({len(STAGES)}, {pairs}) as (stage, ms)")).withColumn("ms", timing.valid_ms(F.col("ms"))).where("ms is not null")


def stage_rollup(calls: DataFrame) -> DataFrame:
    rows = stages(calls.where("source = 'proxy'")).withColumn("__at", histogram.place(F.col("ms")))
    return rows.groupBy(hour(), "stage").agg(F.count("*").alias("n"), total(F.col("ms")).alias("ms"), F.max("ms").alias("most"), histogram.counted(F.col("__at")).alias("hist"))


def stage_report(calls: DataFrame, inside: bool = True) -> DataFrame:
    """Count, mean, percentiles and largest value of each stage.

    Percentiles are exact if the range lies `inside` of what is kept of raw calls, whatever their number; else those of merged histograms. The
    caller knows which: histogram values are upper bounds of buckets.
    """
    rows = stages(calls.where("source = 'proxy'")).select("stage", "ms")
    whole = rows.withColumn("__at", histogram.place(F.col("ms"))) if not inside else rows
    rolled = whole.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean"), F.max("ms").alias("most"), *([] if inside else [histogram.counted(F.col("__at")).alias("h")]))
    if not inside:
        return rolled.select("stage", "n", "mean", *(histogram.percentile(F.col("h"), q / 100).alias(f"p{q}") for q in (50, 90, 99)), "most")
    found = selection.percentiles(rows, ["stage"], {"ms": F.col("ms")}, (0.5, 0.9, 0.99))
    return rolled.join(found, "stage").select("stage", "n", "mean", *(F.round(F.col("ms")[i], 6).alias(f"p{q}") for i, q in enumerate((50, 90, 99))), "most")


def conversation_rollup(calls: DataFrame, *more: str) -> DataFrame:
    """Hour, source and conversation. Everything that is no success counts as failure here, calls in flight, too."""
    good = F.col("ok") & (F.col("class") == "none")
    return classified(calls).where("conversation is not null").groupBy(hour(), "source", "conversation", *more).agg(
        F.count("*").alias("n"), F.count_if(good).alias("success"), F.count_if(~good).alias("failure"), F.sum("total_tokens").alias("tokens"), total(F.col("cost")).alias("cost"), F.min("epoch").alias("first_seen"), F.max("epoch").alias("last_seen")
    )


def account_rollup(calls: DataFrame, width: int = HOUR) -> DataFrame:
    """Bucket and account, -1 for calls of none."""
    usage = [F.sum(f"{c}_tokens").alias(f"{c}_tokens") for c in ("input", "output", "cache", "total")]
    return classified(calls).groupBy(timing.floor_to(F.col("epoch"), width).alias("bucket"), F.coalesce("account", F.lit(-1)).alias("account")).agg(
        F.count("*").alias("n"), F.count_if(F.col("ok") & (F.col("class") == "none")).alias("success"), F.count_if(~F.col("flying") & (F.col("class") != "none")).alias("failure"), F.count_if("flying").alias("flying"), *usage,
        total(F.col("cost")).alias("cost"), total(F.when(lost(), F.col("cost"))).alias("non_success_cost"), F.max_by("t_total", F.when(F.col("t_total").isNotNull(), F.struct("epoch", "id"))).alias("last_ms"),
    )


def usage_breakdown(calls: DataFrame, *keys: Column | str) -> DataFrame:
    """Tokens and the five parts of cost by account, model and effort; what has no price is unknown."""
    parts = [total(F.col(f"cost_{p}")).alias(f"cost_{p}") for p in ("input", "cache_write", "cache_read", "output", "reasoning")]
    return calls.groupBy(*keys, "source", "account", "model", F.coalesce(F.nullif(F.trim("effort"), F.lit("")), F.lit("unspecified")).alias("effort")).agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.col("input_tokens") - F.col("cache_tokens"), F.lit(0))).alias("cache_write_tokens"), F.sum("cache_tokens").alias("cache_read_tokens"), F.sum("output_tokens").alias("output_tokens"), *parts,
        F.count_if(F.col("cost").isNull()).alias("unknown"), total(F.col("cost")).alias("cost"),
    )


def merged(rollups: list[DataFrame], keys: list[str], sums: list[str] = (), lows: list[str] = (), highs: list[str] = (), hists: list[str] = ()) -> DataFrame:
    """Rows of one key of several rollups as one: the additive upsert."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rollups)
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs), *(histogram.merge(F.col(c)).alias(c) for c in hists))


def error_report(calls: DataFrame, scope: str = "service", top: int = 50) -> DataFrame:
    """Categories of failures in a scope, most frequent first."""
    if not 1 <= top <= 50:
        raise ValueError("top is 1 to 50")
    found = classified(calls).where(~F.col("flying")).where(status.scope(F.col("class"), scope))
    return found.groupBy(status.category(F.coalesce("error_message", F.lit(""))).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)


def failure_summary(calls: DataFrame) -> DataFrame:
    found = classified(calls).where("not flying and class <> 'none'")
    return found.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("class") == c).alias(c) for c in ("service_failure", "client_failure", "client_abort")), F.count_if("actionable").alias("actionable"),
        F.round(F.count_if("actionable") / F.nullif(F.count("*"), F.lit(0)), 9).alias("actionable_rate"),
    )
