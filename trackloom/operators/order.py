"""Numbering and windows over long ordered signals, cut so that one hot key never sits in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 1 << 16


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "rn") -> DataFrame:
    """Rows numbered from 0 within their keys, in ``order``.

    ``bucket`` must not decrease along the order.  Rows are ranked within (keys, bucket), and the counts of earlier
    buckets are added, so a key's rows are spread over its buckets; only one count a bucket meets in the key.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select(*keys, "_bucket", (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return df.withColumn("_place", place).join(before, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_bucket", "_place", "_before")


def windowed(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], chunk: int = CHUNK, prepare: Callable[[WindowSpec], dict[str, Column]] | None = None) -> DataFrame:
    """Columns over a moving window of rows, for gapless integer positions.

    Each key's signal is cut into chunks that overlap by the window's reach, and each chunk is a task group of its
    own.  ``make`` gets the window ordered by position, without a frame, and gives the new columns; those of ``prepare``
    come before and may be used by it, and stay.
    """
    first, last = F.floor((F.col(position) - after) / chunk), F.floor((F.col(position) + before) / chunk)
    cut = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    if prepare:
        cut = cut.withColumns(prepare(w))
    return cut.withColumns(make(w)).where(F.col("_chunk") == F.floor(F.col(position) / chunk)).drop("_chunk")


def moving_sums(df: DataFrame, keys: Sequence[str], position: str, values: dict[str, str], before: int, after: int, finish: Callable[..., Column], chunk: int = CHUNK) -> DataFrame:
    """``finish`` of the sums of columns, (new name: column), over the rows from ``before`` rows before to ``after`` rows after each.

    ``finish`` gets a sum, how many of the window's rows are missing at the start and at the end of the signal, and the
    values at these ends.  A sum is the difference of two running sums of a chunk, so a row costs the same for any
    window; an unknown value counts as 0."""
    known = lambda v: F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0))
    everything = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = list(values)

    def prepare(w: WindowSpec) -> dict[str, Column]:
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        sums = {f"_run{i}": F.sum(known(values[n])).over(run) for i, n in enumerate(names)}
        ends = {f"_{side}{i}": f(known(values[n])).over(everything(w)) for i, n in enumerate(names) for side, f in (("head", F.first), ("tail", F.last))}
        return sums | ends | {"_at": F.row_number().over(w), "_of": F.count(F.lit(1)).over(everything(w))}

    def make(w: WindowSpec) -> dict[str, Column]:
        # only a signal's ends cut a window of a row of the chunk itself
        low, high = F.greatest(F.lit(before) + 1 - F.col("_at"), F.lit(0)), F.greatest(F.lit(after) - (F.col("_of") - F.col("_at")), F.lit(0))
        upto = lambda i: F.coalesce(F.lead(f"_run{i}", after).over(w), F.last(f"_run{i}").over(everything(w)))
        behind = lambda i: F.coalesce(F.lag(f"_run{i}", before + 1).over(w), F.lit(0.0))
        return {n: finish(upto(i) - behind(i), low, high, F.col(f"_head{i}"), F.col(f"_tail{i}")) for i, n in enumerate(names)}

    own = [f"_{c}{i}" for i in range(len(names)) for c in ("run", "head", "tail")]
    return windowed(df, keys, position, before, after, make, chunk, prepare).drop(*own, "_at", "_of")


def rolling(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], reach: int = 5, least: int = 3, reducers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Centred moving reducers (mean and population deviation by default) over +-``reach`` rows, clipped at the ends;
    NULL where fewer than ``least`` values are not NULL.  New columns are value_m5 and value_s5 for a reach of 5."""
    reducers = reducers or {"m": F.avg, "s": F.stddev_pop}

    def make(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-reach, reach)
        return {f"{v}_{k}{reach}": F.when(F.count(v).over(frame) >= least, f(F.col(v)).over(frame)) for v in values for k, f in reducers.items()}

    return windowed(df, keys, position, reach, reach, make)


def lagged(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], n: int = 14) -> DataFrame:
    """Each value of ``n`` rows before (after, for a negative n), as value_lag; rows, not distances, are counted."""
    return windowed(df, keys, position, max(n, 0), max(-n, 0), lambda w: {f"{v}_lag": F.lag(v, n).over(w) for v in values})


def step_size(df: DataFrame, keys: Sequence[str], position: str, value: str, name: str = "step", scale: float = 1.0) -> DataFrame:
    """Absolute difference to the next row, NULL if either value is; the last row repeats the difference that leads to it."""

    def make(w: WindowSpec) -> dict[str, Column]:
        ahead, behind = F.lead(value).over(w) - F.col(value), F.col(value) - F.lag(value).over(w)
        return {name: F.abs(F.when(F.lead(position).over(w).isNull(), behind).otherwise(ahead)) * scale}

    return windowed(df, keys, position, 1, 1, make)


def smoothed(df: DataFrame, keys: Sequence[str], position: str, value: str, taps: int = 51, name: str = "smooth") -> DataFrame:
    """Moving mean that always divides by ``taps``, with zeros beyond the ends and for unknown values."""
    return moving_sums(df, keys, position, {name: value}, taps // 2, taps - 1 - taps // 2, lambda total, _low, _high, _first, _last: total / taps)


def roughness(df: DataFrame, keys: Sequence[str], position: str, value: str, reach: int = 3, name: str = "rough") -> DataFrame:
    """Population deviation of the steps within ``reach`` rows on both sides."""
    stepped = windowed(df, keys, position, 1, 0, lambda w: {"_d": F.col(value) - F.lag(value).over(w)})
    return windowed(stepped, keys, position, reach - 1, reach, lambda w: {name: F.stddev_pop("_d").over(w.rowsBetween(1 - reach, reach))}).drop("_d")


def lag_scan(df: DataFrame, keys: Sequence[str], position: str, a: str, b: str, most: int, least: int = 3) -> DataFrame:
    """(keys, lag, n, r): correlation of ``a`` with ``b`` shifted by each lag of -most .. most.

    All lags come from one overlapping window and one aggregation; nothing is joined."""
    lags = range(-most, most + 1)
    wide = windowed(df.select(*keys, position, a, b), keys, position, most, most, lambda w: {f"_b{i}": F.lag(b, k).over(w) for i, k in enumerate(lags)})
    pair = lambda i: F.col(a).isNotNull() & F.col(f"_b{i}").isNotNull()
    from trackloom.functions import correlation

    sums = wide.groupBy(*keys).agg(*[c for i in range(len(lags)) for c in (F.count_if(pair(i)).alias(f"n{i}"), correlation(a, f"_b{i}").alias(f"r{i}"))])
    each = sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, k in enumerate(lags)])).alias("x"))
    return each.select(*keys, "x.lag", "x.n", F.when(F.col("x.n") >= least, F.col("x.r")).alias("r"))


def best_lag(scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lag, r) of the largest absolute correlation; the smallest lag wins a tie."""
    best = F.max(F.when(F.col("r").isNotNull(), F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("l"), F.col("r").alias("r"))))
    return scan.groupBy(*keys).agg(best.alias("x")).select(*keys, (-F.col("x.l")).alias("lag"), F.col("x.r").alias("r"))


def lag_score(scan: DataFrame, keys: Sequence[str], top: int = 10) -> DataFrame:
    """(lag, score): the mean over keys' ``top`` largest absolute correlations at each lag."""
    rank = F.row_number().over(Window.partitionBy("lag").orderBy(F.abs("r").desc(), *keys))
    return scan.where("r is not null").withColumn("_rank", rank).where(F.col("_rank") <= top).groupBy("lag").agg(F.avg(F.abs("r")).alias("score"))
