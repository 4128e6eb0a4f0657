"""Robust thresholds and fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.quantiles import estimated, percentiles
from trackloom.scratch import written


def percentile_threshold(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.30, high: float = 0.85, factor: float = 1.0) -> DataFrame:
    """(keys, threshold): half way between two percentiles, times a factor."""
    return percentiles(df, keys, value, [low, high]).select(*keys, (0.5 * (F.get("p", F.lit(0)) + F.get("p", F.lit(1))) * factor).alias("threshold"))


def quiet_threshold(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """(keys, threshold): a level that tells the active part of a signal from its quiet start.

    The larger of the least value plus a fifth of the range, and the start's median plus eight robust deviations; the
    start is the first tenth, five samples at least."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.greatest(F.lit(5), F.floor(F.count("*") / 10)).alias("first"))
    start = df.join(ends, list(keys)).where(F.col(position) < F.col("first"))
    middle = start.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    spread = start.join(middle, list(keys)).groupBy(*keys, "lo", "hi", "med").agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5))).alias("mad"))
    level = F.greatest(F.col("lo") + 0.2 * (F.col("hi") - F.col("lo")), F.col("med") + 8 * F.greatest(F.col("mad"), F.lit(1e-12)))
    return spread.select(*keys, "med", "mad", level.alias("threshold"))


def plane(df: DataFrame, x: str, y: str, z: str) -> tuple[float, float, float] | None:
    """(a, b, c) of the least-squares plane z = a x + b y + c, from one aggregation; None for a degenerate table."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    r = rows.agg(F.var_pop(x), F.var_pop(y), F.covar_pop(x, y), F.covar_pop(x, z), F.covar_pop(y, z), F.avg(x), F.avg(y), F.avg(z)).first()
    if r[0] is None or not (det := r[0] * r[1] - r[2] * r[2]):
        return None
    a, b = (r[3] * r[1] - r[4] * r[2]) / det, (r[4] * r[0] - r[3] * r[2]) / det
    return a, b, r[7] - a * r[5] - b * r[6]


def trimmed_plane(df: DataFrame, x: str, y: str, z: str, rounds: int = 3, low: float = 0.05, high: float = 0.95, least: int = 100) -> tuple[float, float, float] | None:
    """A plane fitted anew, ``rounds`` times, to the rows whose residual of the last fit lies between two percentiles
    of all residuals; fewer than ``least`` such rows end it.  Each round is one pass; the driver holds nine sums."""
    found = plane(df, x, y, z)
    for _ in range(rounds - 1):
        if found is None:
            return None
        residual = F.col(z) - (found[0] * F.col(x) + found[1] * F.col(y) + found[2])
        cut = percentiles(df, [], residual, [low, high]).first().p
        kept = df.where(residual.between(cut[0], cut[1]))
        if kept.count() < least:
            return found
        found = plane(kept, x, y, z)
    return found


def trimmed_planes(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str, rounds: int = 3, low: float = 0.05, high: float = 0.95, least: int = 100, size: int | None = None) -> DataFrame:
    """(keys, a, b, c): the trimmed plane of each key, with the rounds of ``trimmed_plane``; keys whose rows lie on one
    line have NULLs.  Nothing meets on the driver.  ``size`` bounds the bytes of the rows (see ``percentiles``).

    What a round finds, a row a key, is written down, so that Spark sees how small it is: rows then stay where they lie instead
    of meeting it in a task for each key."""
    size = estimated(df) if size is None else size
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*keys, x, y, z)

    def fitted(kept: DataFrame) -> DataFrame:
        s = kept.groupBy(*keys).agg(
            F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"),
            F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"),
        )
        s = s.withColumn("det", F.expr("xx * yy - xy * xy")).withColumn("a", F.expr("try_divide(xz * yy - yz * xy, det)")).withColumn("b", F.expr("try_divide(yz * xx - xz * xy, det)"))
        return s.select(*keys, "n", "a", "b", F.expr("mz - a * mx - b * my").alias("c"))

    found = written(fitted(rows).drop("n"), "planes") if rounds > 1 else fitted(rows).drop("n")
    for _ in range(rounds - 1):
        off = rows.join(found, list(keys)).withColumn("_off", F.col(z) - (F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("c")))
        cut = percentiles(off, keys, "_off", [low, high], "_cut", size).drop("n")
        cut = written(cut, "cuts")
        kept = off.join(cut, list(keys)).where(F.col("_off").between(F.get("_cut", F.lit(0)), F.get("_cut", F.lit(1))))
        again = fitted(kept.drop("a", "b", "c")).where(F.col("n") >= least).select(*keys, F.struct("a", "b", "c").alias("_new"))
        found = written(found.join(again, list(keys), "left").select(*keys, *[F.when(F.col("_new").isNull(), F.col(v)).otherwise(F.col(f"_new.{v}")).alias(v) for v in "abc"]), "planes")
    return found


def line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept): the least-squares line of y on x; NULL where x is constant."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
