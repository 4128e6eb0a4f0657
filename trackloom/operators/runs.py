"""Contiguous runs of rows that pass a test: gaps and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.order import CHUNK


def runs(df: DataFrame, keys: Sequence[str], position: str, passes: Column, bridge: int | Column = 0, chunk: int = CHUNK) -> DataFrame:
    """(keys, first, last, length, n): maximal runs of passing rows whose gaps are at most ``bridge`` rows (a number, or one
    of the keys).  Positions are whole numbers.

    length counts the bridged gaps, n the passing rows only.  Only passing rows are sorted, in chunks of positions; then
    the first and the last run of each chunk meet those of the key's other chunks, and all other runs stay as they are.
    """
    hit = df.where(passes).select(*keys, F.col(position).alias("_p"), F.floor(F.col(position) / chunk).alias("_c"))
    apart = lambda at, before, w: F.coalesce((F.col(at) - F.lag(before).over(w) - 1 > bridge).cast("int"), F.lit(1))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "_c")
    w = whole.orderBy("_p")
    marked = hit.withColumn("_new", apart("_p", "_p", w)).withColumn("_run", F.sum("_new").over(so_far(w)))
    parts = marked.groupBy(*keys, "_c", "_run").agg(F.min("_p").alias("first"), F.max("_p").alias("last"), F.count("*").alias("n"))
    border = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(whole))
    placed = parts.withColumn("_c", F.when(~border, F.col("_c")))
    w = Window.partitionBy(*keys, "_c").orderBy("first")
    joined = placed.withColumn("_new", apart("first", "last", w)).withColumn("_run", F.sum("_new").over(so_far(w)))
    return joined.groupBy(*keys, "_c", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_c", "_run").withColumn("length", F.col("last") - F.col("first") + 1)


def longest_run(df: DataFrame, keys: Sequence[str], position: str, passes: Column, bridge: int | Column = 0, least: int = 1) -> DataFrame:
    """(keys, first, last, length): the longest run of each key; the first wins a tie.  Keys without one give none."""
    best = F.max(F.struct(F.col("length"), (-F.col("first")).alias("f"), F.col("last")))
    return runs(df, keys, position, passes, bridge).where(F.col("length") >= least).groupBy(*keys).agg(best.alias("x")).select(*keys, (-F.col("x.f")).alias("first"), F.col("x.last").alias("last"), F.col("x.length").alias("length"))


def run_through(df: DataFrame, keys: Sequence[str], position: str, passes: Column, seed: str) -> DataFrame:
    """(keys, first, last, length): the run of passing rows through each key's seed position (a column).

    The nearest failing rows on both sides bound it; the seed itself always counts, and a key's ends bound it too.
    """
    p, s = F.col(position), F.col(seed)
    low = F.max(F.when(~F.coalesce(passes, F.lit(False)) & (p < s), p))
    high = F.min(F.when(~F.coalesce(passes, F.lit(False)) & (p > s), p))
    ends = df.groupBy(*keys).agg(F.coalesce(low + 1, F.min(position)).alias("first"), F.coalesce(high - 1, F.max(position)).alias("last"))
    return ends.withColumn("length", F.col("last") - F.col("first") + 1)
