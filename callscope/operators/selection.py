"""Exact percentiles of groups of any size: distributed selection by rounds of bracket counting.

A wanted rank is bracketed by approximate percentiles (mergeable sketches of fixed size), the values of each bracket are counted with map-side sums, and
only the bracket that holds the rank goes into the next round, its equal values as one row with a count. The first bracket holds a few ten-thousandths of a group,
each later one about a sixteenth of the one before; rounds end when no bracket has more than `held` different values. So no task holds more than that, and
the value is the same whatever the number of rows. Groups of at most `held` values are taken whole; cuts and brackets of the others, a few rows for each, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import archive

#: Different values that one task holds.
HELD = 1 << 18
#: Ranks of a sketch are right within 1 / ACCURACY of the rows; cuts of a later round.
ACCURACY, CUTS = 10_000, 16


def _buckets(values: DataFrame, keys: list[str], positions: list[float], accuracy: int) -> DataFrame:
    """keys, low, high, before, after: intervals of values between approximate percentiles, and how many rows lie before them and up to their end."""
    cuts = values.groupBy(*keys).agg(F.percentile_approx("v", F.array(*map(F.lit, positions)), accuracy).alias("t"))
    # Values that equal a cut have a bucket of their own.
    number = sum((F.col("v") > F.col("t")[i]).cast("int") + (F.col("v") >= F.col("t")[i]).cast("int") for i in range(len(positions)))
    found = values.join(F.broadcast(cuts), keys).groupBy(*keys, number.alias("bucket")).agg(F.sum("c").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))
    after = F.sum("w").over(Window.partitionBy(*keys).orderBy("bucket"))  # at most twice as many rows as cuts
    return found.withColumn("after", after).withColumn("before", F.col("after") - F.col("w")).select(*keys, "low", "high", "before", "after")


def _wanted(n: Column, at: tuple[float, ...]) -> Column:
    """For each percentile its number j and the ranks between which it lies, from 0."""
    place = lambda p: p * (n - 1)
    return F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.floor(place(p)).alias("k0"), F.ceil(place(p)).alias("k1"), place(p).alias("place")) for j, p in enumerate(at))))


def percentiles(rows: DataFrame, keys: list[str], values: dict[str, Column], at: tuple[float, ...], held: int = HELD, accuracy: int = ACCURACY) -> DataFrame:
    """keys, and for each named value an array of its percentiles `at`, interpolated linearly between ranks; null where a group has no value.

    Null values count for nothing. Groups may have null keys. The derived values are written once, so that rounds read two narrow columns.
    """
    spark, root = rows.sparkSession, archive.shared_dir(rows.sparkSession, "percentiles")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    pairs = F.array(*(F.struct(F.lit(i).alias("i"), v.cast("double").alias("v")) for i, v in enumerate(values.values())))
    flat = keep(rows.select(F.struct(*keys).alias("g"), F.explode(pairs).alias("x")).select("g", "x.i", "x.v"), "values")
    sizes = keep(flat.groupBy("g", "i").agg(F.count("v").alias("n")), "sizes")
    known = flat.where("v is not null")
    whole = lambda rows: rows.groupBy("g", "i").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("p"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= held:
        found = whole(known)
    else:
        # One row for more than `held` values: few, so that what is known of them is broadcast, and no task sorts a group.
        large = sizes.where(F.col("n") > held)
        mark = F.broadcast(large.select("g", "i"))
        found = _selected(known.join(mark, ["g", "i"], "left_semi").withColumn("c", F.lit(1).cast("long")), large, at, held, accuracy, keep).union(whole(known.join(mark, ["g", "i"], "left_anti")))
    named = sizes.join(found, ["g", "i"], "left").groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("p"))).alias(name) for i, name in enumerate(values)))
    return named.select("g.*", *values)


def _selected(values: DataFrame, sizes: DataFrame, at: tuple[float, ...], held: int, accuracy: int, keep) -> DataFrame:
    """g, i, p: the percentiles of each group and value, from (g, i, v, c)."""
    ranks = sizes.select("g", "i", _wanted(F.col("n"), at).alias("w")).select("g", "i", "w.*")
    near = sorted({min(1.0, max(0.0, p + d / accuracy)) for p in at for d in (-2, 2)})
    by, positions, turn = ["g", "i"], near, 0
    while True:
        buckets = keep(_buckets(values, by, positions, accuracy), f"buckets-{turn}")
        hit = ranks.join(buckets, by).where("before <= k1 and after > k0")
        ranks = keep(hit.groupBy("g", "i", "j", "k0", "k1", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("before").alias("before")), f"ranks-{turn}")
        brackets = ranks.select("g", "i", "j", F.col("low").alias("from"), F.col("high").alias("to"))
        inside = values.join(F.broadcast(brackets), by).where("v between `from` and `to`").groupBy("g", "i", "j", "v").agg(F.sum("c").alias("c"))
        values = keep(inside, f"inside-{turn}")
        most = values.groupBy("g", "i", "j").count().agg(F.max("count")).first()[0]
        ranks = ranks.select("g", "i", "j", (F.col("k0") - F.col("before")).alias("k0"), (F.col("k1") - F.col("before")).alias("k1"), (F.col("place") - F.col("before")).alias("place"))
        if most <= held:
            break
        by, positions, turn = ["g", "i", "j"], [(i + 1) / (CUTS + 1) for i in range(CUTS)], turn + 1
    after = F.sum("c").over(Window.partitionBy("g", "i", "j").orderBy("v"))  # at most `held` values
    placed = values.withColumn("after", after).join(F.broadcast(ranks), ["g", "i", "j"])
    value = lambda k: F.max(F.when((F.col("after") - F.col("c") <= F.col(k)) & (F.col("after") > F.col(k)), F.col("v")))
    ends = placed.groupBy("g", "i", "j", "k0", "k1", "place").agg(value("k0").alias("a"), value("k1").alias("b"))
    mixed = F.when(F.col("k0") == F.col("k1"), F.col("a")).otherwise((F.col("k1") - F.col("place")) * F.col("a") + (F.col("place") - F.col("k0")) * F.col("b"))
    return ends.groupBy("g", "i").agg(F.array_sort(F.collect_list(F.struct("j", mixed.alias("p")))).alias("ps")).select("g", "i", F.col("ps.p").alias("p"))
