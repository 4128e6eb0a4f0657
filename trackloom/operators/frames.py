"""Features of frames (camera images): long tables (keys, x, y, value), or a row a frame with its pixels as an array.

The arrays are for whole cameras: a batch of frames is described by one Arrow kernel, and no pixel becomes a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brightness(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = (0.99, 0.995, 0.999), floor: float = 1000.0, scale: float = 1e4) -> DataFrame:
    """(keys, v_max, p..., soft_sum): maximum, exact percentiles, and the scaled sum of what lies above a floor."""
    p = F.percentile(value, F.array(*[F.lit(s) for s in shares]))
    out = df.groupBy(*keys).agg(F.max(value).alias("v_max"), p.alias("p"), (F.sum(F.greatest(F.col(value) - floor, F.lit(0.0))) / scale).alias("soft_sum"))
    return out.select(*keys, "v_max", *[F.get("p", F.lit(i)).alias("p" + f"{s:g}"[2:]) for i, s in enumerate(shares)], "soft_sum")


def moments(df: DataFrame, keys: Sequence[str], x: str, y: str, value: str, thresholds: Sequence[float], pixel: float = 1.0, least: int = 5) -> DataFrame:
    """(keys, threshold, area, cx, cy, len, wid, ecc, skewx): moments of the pixels above each threshold.

    len and wid are four population deviations, ecc is the ratio of the deviations and skewx the correlation of the
    coordinates (deviations below 1e-9 pixels count as that); all but the area are NULL for fewer than ``least`` pixels.  All thresholds come from one pass.
    """
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    on = lambda c: F.when(F.col(value) > F.col("threshold"), F.col(c).cast("double") * pixel)
    tiny = lambda power: F.lit(1e-9 * pixel**power)
    out = each.groupBy(*keys, "threshold").agg(
        F.count(on(x)).alias("n"), F.avg(on(x)).alias("cx"), F.avg(on(y)).alias("cy"), F.stddev_pop(on(x)).alias("sx"), F.stddev_pop(on(y)).alias("sy"), F.covar_pop(on(x), on(y)).alias("sxy")
    )
    enough = lambda c: F.when(F.col("n") >= least, c)
    return out.select(
        *keys, "threshold", (F.col("n") * pixel * pixel).alias("area"), enough(F.col("cx")).alias("cx"), enough(F.col("cy")).alias("cy"), enough(4 * F.col("sx")).alias("len"), enough(4 * F.col("sy")).alias("wid"),
        enough(F.col("sx") / F.greatest(F.col("sy"), tiny(1))).alias("ecc"), enough(F.col("sxy") / F.greatest(F.col("sx") * F.col("sy"), tiny(2))).alias("skewx"),
    )


def tail(profile: DataFrame, keys: Sequence[str], position: str, value: str, passes: Column, reach: int = 40, least: int = 6) -> DataFrame:
    """(keys, peak, tail_len, tail_grad): the run of passing samples through each profile's first maximum, and the
    slope of the up to ``reach`` samples before it (NULL for fewer than ``least``).

    The peak is an aggregate joined back by key, and both results are aggregates again: no profile is sorted."""
    from trackloom.functions import first_max
    from trackloom.operators.runs import run_through

    peaks = profile.groupBy(*keys).agg(first_max(value, position).alias("peak"))
    with_peak = profile.join(peaks, list(keys))
    run = run_through(with_peak, keys, position, passes, "peak").select(*keys, F.col("length").alias("tail_len"))
    before = with_peak.where(F.col(position).between(F.col("peak") - reach, F.col("peak") - 1))
    slope = before.groupBy(*keys).agg(F.when(F.count(value) >= least, F.regr_slope(value, position)).alias("tail_grad"))
    return peaks.join(run, list(keys)).join(slope, list(keys), "left")


def _each(frames: DataFrame, keys: Sequence[str], names: Sequence[str], describe: Callable[[np.ndarray], list[float]]) -> DataFrame:
    """(keys, names) of every frame (keys, w, pixels: its values row by row): what ``describe`` gives for its rows of pixels, NaN
    where unknown, as NULL.  A frame that is NULL or has no pixels gives NULLs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, width = batch["pixels"], batch["w"].to_pylist()
            out = np.full((batch.num_rows, len(names)), np.nan)
            for i in range(batch.num_rows):
                one = pixels[i].values
                if one is not None and len(one) and width[i]:
                    out[i] = describe(one.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width[i]))
            columns = [pa.array(c, pa.float64(), from_pandas=True) for c in out.T]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], *columns], names=[*keys, *names])

    kinds = dict(frames.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{n} double" for n in names]])
    return frames.select(*keys, "w", "pixels").mapInArrow(run, schema)


def frame_levels(frames: DataFrame, keys: Sequence[str], share: float = 0.995) -> DataFrame:
    """(keys, level): an exact percentile of each frame's known pixels."""

    def describe(v: np.ndarray) -> list[float]:
        v = v[~np.isnan(v)]
        return [np.quantile(v, share) if v.size else np.nan]

    return _each(frames, keys, ["level"], describe)


def _shape(v: np.ndarray, level: float, pixel: float, detailed: bool, least: int) -> list[float]:
    """Area above a level and, if asked for, centre, length, width, ratio of deviations and correlation of coordinates."""
    above = (v > level).astype(np.float64)
    n = above.sum()
    out = [n * pixel * pixel]
    if detailed:
        if n < least:
            return out + [np.nan] * 6
        x, y = np.arange(v.shape[1]) * pixel, np.arange(v.shape[0]) * pixel
        by_x, by_y = above.sum(axis=0), above.sum(axis=1)
        cx, cy = by_x @ x / n, by_y @ y / n
        sx, sy = np.sqrt(by_x @ (x - cx) ** 2 / n), np.sqrt(by_y @ (y - cy) ** 2 / n)
        sxy = (y - cy) @ above @ (x - cx) / n
        out += [cx, cy, 4 * sx, 4 * sy, sx / max(sy, 1e-9 * pixel), sxy / max(sx * sy, 1e-9 * pixel**2)]
    return out


def _tail(profile: np.ndarray, level: float, reach: int, least: int) -> list[float]:
    """Samples of the run above a level through the first maximum, and the slope of those before it."""
    peak = int(np.nanargmax(profile))
    fails = np.flatnonzero(~(profile > level))
    before, behind = fails[fails < peak], fails[fails > peak]
    length = (behind[0] if len(behind) else len(profile)) - (before[-1] if len(before) else -1) - 1
    at = np.arange(max(0, peak - reach), peak)
    at = at[~np.isnan(profile[at])]
    if len(at) < least:
        return [float(length), np.nan]
    x = at - at.mean()
    return [float(length), float(x @ profile[at] / (x @ x))]


def described(frames: DataFrame, keys: Sequence[str], levels: Sequence[float], detailed: Sequence[float], pixel: float, least: int = 5, floor: float = 1000.0, scale: float = 1e4, tail_level: float = 1200.0, reach: int = 40, least_tail: int = 6) -> DataFrame:
    """(keys, t_max, t_p999, t_p99, t_sum_above1000, a..., cx..., ..., tail_len, tail_grad) of every frame (keys, w, pixels).

    What ``brightness``, ``moments`` and ``tail`` give of long tables, from arrays: a pixel that is NULL or NaN counts nowhere, and
    the profile is the maximum of each column of pixels."""
    names = ["t_max", "t_p999", "t_p99", "t_sum_above1000", *[f"a{t}" for t in levels], *[f"{c}{t}" for t in detailed for c in ("cx", "cy", "len", "wid", "ecc", "skewx")], "tail_len", "tail_grad"]

    def describe(v: np.ndarray) -> list[float]:
        known = v[~np.isnan(v)]
        if not known.size:
            return [np.nan] * len(names)
        p999, p99 = np.quantile(known, [0.999, 0.99])
        out = [known.max(), p999, p99, np.maximum(known - floor, 0).sum() / scale]
        shapes = {t: _shape(v, t, pixel, t in detailed, least) for t in levels}
        out += [shapes[t][0] for t in levels]
        out += [x for t in detailed for x in shapes[t][1:]]
        profile = np.where(np.isnan(v).all(axis=0), np.nan, np.where(np.isnan(v), -np.inf, v).max(axis=0))
        length, slope = _tail(profile, tail_level, reach, least_tail)
        return [*out, length * pixel, slope]

    return _each(frames, keys, names, describe)
