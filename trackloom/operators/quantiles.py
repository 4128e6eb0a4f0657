"""Exact percentiles of keys of any size, by counts that merge.

The aggregate ``percentile`` holds all distinct values of a key in one buffer.  Here a key's values are counted in bins of
about a two-thousandth of an octave, then the bins that hold a wanted rank in 2^20 bins each between their own ends; what is
left in one of these is at most some two million different doubles, which are counted one by one.  Every step is an
aggregation that combines before its shuffle; ranks are found in running sums over bins, never over rows.  Tables that can't
fill a buffer take the aggregate; both give the same doubles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import nan_to_null
from trackloom.scratch import written

#: Bytes of buffers that are no matter, those that a value takes there, and Spark's estimate below which rows aren't counted: it goes
#: by the bytes of files, which may hold many times as many rows as their bytes suggest.
SMALL, _VALUE, _SURE = 1 << 28, 64, 1 << 23
_FINE = 1 << 20


def estimated(df: DataFrame) -> int:
    """Spark's estimate of a plan's bytes; far too high, rather than too low, where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(rows: DataFrame, size: int | None = None) -> bool:
    """Whether an aggregate may hold all values of ``rows`` at once: by their estimate, or, in doubt, by their count."""
    size = estimated(rows) if size is None else size
    return size <= SMALL and (size <= _SURE or rows.count() * _VALUE <= SMALL)


def _octave(v: Column) -> Column:
    """A whole number that rises with v, about 2,048 to an octave on either side of 0."""
    place = 1 + F.floor((F.least(F.log2(F.abs(v)), F.lit(2000.0)) + 1080) * 2048)
    return F.when(v == 0, 0).when(v < 0, -place).otherwise(place).cast("long")


def _between(v: Column, low: Column, high: Column) -> Column:
    """The bin of v among 2^20 from low to high; halves, so that the width of a range is a double."""
    return F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * _FINE).cast("long")


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names], F.lit(True))


def _matched(rows: DataFrame, found: DataFrame, names: Sequence[str], more: Sequence[str]) -> DataFrame:
    return rows.join(found, _same(rows, found, names)).select(*[rows[c] for c in rows.columns], *[found[c] for c in more])


def _holding(counts: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Of bins (within, order, n, ranks, ...) those that hold some of the ranks, which are numbered from ``before`` on, with
    these and with the rows before the bin."""
    own = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.col("before") + F.sum("n").over(own))
    mine = upto.withColumn("ranks", F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    return mine.where(F.size("ranks") > 0).withColumn("before", F.col("upto") - F.col("n")).drop("upto")


def percentiles(df: DataFrame, keys: Sequence[str], value: Column | str, fractions: Sequence[float], name: str = "p", size: int | None = None) -> DataFrame:
    """(keys, n, name): how many values a key has that are neither NULL nor NaN, and their percentiles, an array of doubles in the
    order of ``fractions``, interpolated as by ``percentile``; NULL for a key without values.

    ``size`` bounds the bytes of the rows, where the caller knows better than Spark's estimate, which multiplies both sides of
    a join.  A larger table is read three times, so it should come from files.  The bins with wanted ranks, few to a key and
    fraction, are written down between the steps."""
    keys, points = list(keys), F.array(*[F.lit(float(f)) for f in fractions])
    v = nan_to_null((F.col(value) if isinstance(value, str) else value).cast("double"))
    rows = df.select(*keys, v.alias("_v"))
    if fits(rows, size):
        return rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile("_v", points).alias(name))
    rows = rows.withColumn("b1", _octave(F.col("_v")))
    ends = [F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")]
    first = rows.groupBy(*keys, "b1").agg(*ends).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    place = lambda f: F.greatest(F.col("total") - 1, F.lit(0)) * f
    ranks = F.array_distinct(F.flatten(F.transform(points, lambda f: F.array(F.floor(place(f)), F.ceil(place(f))))))
    counted = written(first.withColumns({"ranks": ranks, "before": F.lit(0).cast("long")}), "octaves")
    totals = counted.groupBy(*keys).agg(F.first("total").alias("total"))
    top = written(_holding(counted.where("n > 0"), keys, "b1"), "bins")
    wide = _matched(rows, top.where("low < high"), [*keys, "b1"], ["low", "high", "before", "ranks"])
    wide = wide.withColumn("b2", _between(F.col("_v"), F.col("low"), F.col("high")))
    fine = wide.groupBy(*keys, "b1", "b2").agg(*ends, F.first("before").alias("before"), F.first("ranks").alias("ranks"))
    fine = written(_holding(fine, [*keys, "b1"], "b2"), "fine")
    left = _matched(rows, top.where("low < high"), [*keys, "b1"], ["low", "high"])
    left = left.withColumn("b2", _between(F.col("_v"), F.col("low"), F.col("high"))).drop("low", "high")
    left = _matched(left, fine.where("low < high"), [*keys, "b1", "b2"], ["before", "ranks"])
    single = left.groupBy(*keys, "b1", "b2", "_v").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
    single = _holding(single, [*keys, "b1", "b2"], "_v").select(*keys, F.col("_v").alias("low"), "ranks")
    found = single.unionByName(top.where("low = high").select(*keys, "low", "ranks")).unionByName(fine.where("low = high").select(*keys, "low", "ranks"))
    each = found.groupBy(*keys).agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("ranks", lambda r: F.struct(r, F.col("low")))))).alias("at"))
    met = totals.join(each, _same(totals, each, keys), "left").select(*[totals[c] for c in keys], "total", "at")

    def interpolated(f: Column) -> Column:
        p = place(f)
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return met.select(*keys, F.col("total").alias("n"), F.when(F.col("total") > 0, F.transform(points, interpolated)).alias(name))
