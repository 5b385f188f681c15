"""Prices and bytes of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("input", "cache_write", "cache_read", "output", "reasoning")
DATED = r"^(.+)-\d{4}-\d{2}-\d{2}$"


def base_model(model: Column) -> Column:
    """The model without a -YYYY-MM-DD at its end."""
    return F.when(model.rlike(DATED), F.regexp_extract(model, DATED, 1)).otherwise(model)


def priced(calls: DataFrame, prices: DataFrame, surcharge: tuple[str, ...] = ("model-a",), threshold: int = 272_000) -> DataFrame:
    """calls with cost_input ... cost_reasoning and cost: null where the model has no price or nothing can be billed.

    The price of the model itself counts before that of the model without its date. `prices` is a dimension of a few rows per model.
    Models in `surcharge` cost twice as much for input and one and a half times for output beyond `threshold` input tokens; the tier priority doubles all.
    What depends on the call alone is settled before the join, so that it is evaluated once.
    """
    tokens = {f"__{c}": F.greatest(F.coalesce(F.col(f"{c}_tokens"), F.lit(0)), F.lit(0)) for c in ("input", "cache", "output", "reasoning")}
    tier = F.when(F.lower(F.trim(F.get_json_object("payload", "$.serviceTier"))) == "priority", 2.0).otherwise(1.0)
    base = base_model(F.col("model"))
    found = calls.withColumns(tokens | {"__tier": tier, "__base": base})
    found = found.withColumns({
        "__long": F.col("__base").isin(*surcharge) & (F.col("__input") > threshold), "__some": F.col("__input") + F.col("__cache") + F.col("__output") + F.col("__reasoning") > 0,
    })
    # One row for each model without its date, with the prices of all its dates.
    own = F.struct(*(c for c in prices.columns if c != "price_model"))
    dated = prices.groupBy(base_model(F.col("price_model")).alias("__base")).agg(F.map_from_entries(F.collect_list(F.struct("price_model", own))).alias("__prices"))
    found = found.join(F.broadcast(dated), "__base", "left")
    found = found.withColumn("__price", F.coalesce(F.try_element_at("__prices", F.col("model")), F.try_element_at("__prices", F.col("__base"))))
    price = lambda c: F.col(f"__price.{c}")
    cached = F.when(price("read_price").isNotNull(), F.col("__cache")).otherwise(0)
    fresh = F.greatest(F.col("__input") - cached, F.lit(0))
    split = price("write_price").isNotNull()
    of = lambda n, p, more: F.coalesce(n / F.lit(1e6) * p, F.lit(0.0)) * F.when(F.col("__long"), more).otherwise(1.0) * F.col("__tier")
    parts = {
        "input": of(F.when(~split, fresh), price("input_price"), 2.0), "cache_write": of(F.when(split, fresh), price("write_price"), 2.0), "cache_read": of(cached, price("read_price"), 2.0),
        "output": of(F.col("__output"), price("output_price"), 1.5), "reasoning": of(F.col("__reasoning"), price("reasoning_price"), 1.5),
    }
    billed = F.col("__price").isNotNull() & F.col("__some")
    out = found.withColumns({f"cost_{c}": F.when(billed, e) for c, e in parts.items()})
    return out.withColumn("cost", sum((F.col(f"cost_{c}") for c in PARTS[1:]), F.col(f"cost_{PARTS[0]}"))).select(*calls.columns, *(f"cost_{c}" for c in PARTS), "cost")


def host(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("__unknown__"))


def bytes_of(*candidates: Column) -> Column:
    """The first number there is, at least 0."""
    return F.greatest(F.coalesce(*candidates, F.lit(0)), F.lit(0))


def saved(before: Column, after: Column, complete: Column) -> Column:
    """struct(bytes, percent) that compression saved, where the transmission is complete."""
    return F.when(complete & (before > 0), F.struct((before - after).alias("bytes"), ((before - after) * 100.0 / before).alias("percent")))


def ratio(a: Column, base: Column) -> Column:
    """a / base, null unless base is above zero."""
    return F.when(base > 0, a / base)


def percent_delta(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) * 100.0 / before)


def scarcity(short: Column, long: Column) -> Column:
    """How much of the usage windows is gone: 0.65 of the short one's share and 0.35 of the long one's."""
    share = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)) / 100.0, F.lit(0.0)), F.lit(1.0))
    return 0.65 * share(short) + 0.35 * share(long)
