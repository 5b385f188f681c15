"""Latency histograms of 21 buckets as arrays of longs: build, merge, subtract, percentile; and the exact and hybrid percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timing import valid_ms

#: The upper bounds of the buckets in milliseconds; one more bucket takes all above.
BOUNDS = (5, 10, 20, 50, 100, 150, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000, 10000, 20000, 30000, 60000, 180000)


def place(ms: Column) -> Column:
    """The number of the bucket of a duration, from 0; null for what is no valid duration."""
    v = valid_ms(ms)
    steps = F.when(v <= BOUNDS[0], 0)
    for i, bound in enumerate(BOUNDS[1:], 1):
        steps = steps.when(v <= bound, i)
    return F.when(v.isNotNull(), steps.otherwise(len(BOUNDS)))


def counted(at: Column) -> Column:
    """Aggregate: the histogram of a column of bucket numbers. The number is best a column of its own, so that 21 counts share it."""
    return F.array(*(F.count_if(at == i) for i in range(len(BOUNDS) + 1)))


def merge(h: Column) -> Column:
    """Aggregate: the element-wise sum of histograms; short ones count as padded with zeros."""
    return F.array(*(F.coalesce(F.sum(F.get(h, F.lit(i))), F.lit(0)) for i in range(len(BOUNDS) + 1)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x - F.coalesce(y, F.lit(0)), F.lit(0).cast("long")))


def total(h: Column) -> Column:
    return F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x)


def percentile(h: Column, p: float) -> Column:
    """The upper bound of the first bucket whose running count reaches max(1, ceil(total * p)); the bucket above all reports the last bound. Null if empty."""
    need = F.greatest(F.ceil(total(h) * p), F.lit(1))
    running = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: total(F.slice(h, 1, i)))
    place = F.size(F.filter(running, lambda r: r < need))
    return F.when(total(h) > 0, F.get(F.array(*(F.lit(float(b)) for b in (*BOUNDS, BOUNDS[-1]))), place))


def exact(ms: Column, p: float) -> Column:
    """Aggregate: linear interpolation at p * (n - 1) between the sorted values."""
    return F.percentile(ms, p)


def hybrid(h: Column, exact_value: Column, samples: Column, p: float) -> Column:
    """The exact percentile, unless the histogram has counted more samples than are held."""
    return F.when(total(h) > samples, percentile(h, p)).otherwise(exact_value)
