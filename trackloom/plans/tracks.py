"""From raw tables of tracks to one modelling table: laser interval, labels, features, and their join by bin.

A track is a key like any other: nothing loops over tracks, and every step is one plan over all of them.  Frames are
(track, frame, w, pixels), height maps (track, ix, iy, x_mm, y_mm, z_mm), mosaics (track, y, x, value).  Missing
values are NULL.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from trackloom.functions import first_min, grid_bin, quality_weight, supported
from trackloom.operators import frames, grid, order, robust, runs
from trackloom.operators.quantiles import estimated
from trackloom.scratch import written

# Fixed values of the data: the grid in mm, pixel sizes in mm, brightness levels, powers in W by track.
START, STOP, STEP, BINS = 20.0, 100.0, 0.2, 400
#: The brightest grey, and the levels of its histogram.
GREY, GREY_LEVELS = 255.0, 32
HEIGHT_PIXEL, FRAME_PIXEL = 0.003982, 0.014
LEVELS = (1400, 1600, 1800, 2000, 2200)
DETAILED = (1400, 1800)
POWER = {8: 400, 10: 350, 14: 300, 21: 200}
VARIANTS = [(0.85, 8), (0.85, 16), (1.0, 8), (1.0, 16), (1.15, 8), (1.15, 16)]
BANDS = {"b0_2": (0.1, 2), "b2_8": (2, 8), "b8_15": (8, 15), "b15_25": (15, 25)}


def bin_centre(b: Column) -> Column:
    return START + (b + 0.5) * STEP


def laser_interval(shots: DataFrame, share: float = 0.995) -> DataFrame:
    """(track, first, stop): the longest run of frames whose brightness lies above the quiet start; stop is exclusive.
    ``shots`` has a row a pixel; of arrays, ``frames.frame_levels`` gives the levels that ``bright_interval`` needs."""
    return bright_interval(shots.groupBy("track", "frame").agg(F.percentile("value", F.lit(share)).alias("level")))


def bright_interval(bright: DataFrame) -> DataFrame:
    """``laser_interval`` from each frame's level (track, frame, level)."""
    limit = robust.quiet_threshold(bright, ["track"], "frame", "level").select("track", "threshold")
    run = runs.longest_run(bright.join(limit, "track"), ["track"], "frame", F.col("level") > F.col("threshold"))
    return run.select("track", "first", (F.col("last") + 1).alias("stop"))


def last_frames(shots: DataFrame, interval: DataFrame, n: int = BINS) -> DataFrame:
    """The ``n`` frames before each track's stop, with x_mm (the last one ends at 100 mm) and their bin."""
    before = F.col("stop") - F.col("frame")
    cut = shots.join(interval.select("track", "stop"), "track").where((before > 0) & (before <= n))
    return cut.withColumn("x_mm", STOP - (before - 0.5) * STEP).withColumn("bin", (n - before).cast("int")).drop("stop")


def label_bins(scored: DataFrame, variants: Sequence[tuple[float, int]] = ((1.0, 12),), least_mm: float = 0.15, least: int = 8) -> DataFrame:
    """(track, variant, bin, valid_frac, width, yl, yr, edge_rough), in mm, from a score map (track, ix, iy, x_mm,
    y_mm, score).

    In each pixel column the longest run above the track's threshold is the melt; a variant is (factor of the
    threshold, gap bridged).  All variants come from one pass: a pixel meets those that it passes.  A bin with fewer
    than ``least`` labelled columns has a valid_frac only; bins without columns give no row.
    """
    each = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(float(f)).alias("factor"), F.lit(b).alias("bridge")) for i, (f, b) in enumerate(variants)])
    level = written(robust.percentile_threshold(scored, ["track"], "score"), "levels")  # a row a track: its pixels stay where they lie
    met = scored.join(level, "track").withColumn("_v", F.explode(F.filter(each, lambda v: F.col("score") > F.col("threshold") * v.factor)))
    keys = ["track", "ix", "variant", "bridge"]
    run = runs.longest_run(met.select("track", "ix", "iy", "_v.variant", "_v.bridge"), keys, "iy", F.lit(True), F.col("bridge"))
    run = run.withColumn("w", F.col("length") * HEIGHT_PIXEL).where(F.col("w") >= least_mm)

    y_mm = scored.groupBy("track", "iy").agg(F.first("y_mm").alias("y_mm"))
    at = lambda c, name: y_mm.select("track", F.col("iy").alias(c), F.col("y_mm").alias(name))
    run = run.join(at("first", "l"), ["track", "first"]).join(at("last", "r"), ["track", "last"]).select("track", "ix", "variant", "w", "l", "r")
    columns = scored.groupBy("track", "ix").agg(F.first("x_mm").alias("x_mm")).select("track", "ix", grid_bin("x_mm").alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(len(variants) - 1))).alias("variant"))
    joined = columns.where("bin is not null").join(run, ["track", "ix", "variant"], "left")
    middle = lambda c: supported(F.percentile(c, F.lit(0.5)), "w", least)
    return joined.groupBy("track", "variant", "bin").agg(
        F.avg(F.col("w").isNotNull().cast("double")).alias("valid_frac"), middle("w").alias("width"), middle("l").alias("yl"), middle("r").alias("yr"),
        supported((F.stddev_pop("l") + F.stddev_pop("r")) / 2, "w", least).alias("edge_rough"),
    )


def label_ensemble(labelled: DataFrame, n_variants: int = len(VARIANTS)) -> DataFrame:
    """(track, bin, w_ens, w_spread, w_v0 ...) in micrometres: median and deviation of the width over the variants."""
    um = F.col("width") * 1e3
    each = [F.max(F.when(F.col("variant") == i, um)).alias(f"w_v{i}") for i in range(n_variants)]
    return labelled.groupBy("track", "bin").agg(F.percentile(um, F.lit(0.5)).alias("w_ens"), F.stddev_pop(um).alias("w_spread"), *each)


def thermal_features(shots: DataFrame, keys: Sequence[str] = ("track", "bin")) -> DataFrame:
    """Brightness, areas and moments above five levels, tail length and gradient of each frame (keys, w, pixels)."""
    return frames.described(shots, list(keys), LEVELS, DETAILED, FRAME_PIXEL)


#: What ``_column_parts`` gives, a field each.
_PARTS = {"n": LongType(), "s": DoubleType(), "ss": DoubleType(), "d": DoubleType(), "nd": LongType(), "v": DoubleType(), "low": DoubleType(), "high": DoubleType(), "one": DoubleType(), "hist": ArrayType(LongType())}


@pandas_udf(StructType([StructField(n, kind) for n, kind in _PARTS.items()]))
def _column_parts(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What each column of pixels adds to a patch: known pixels, their sum and sum of squares, its steps and their number, its
    variance, mean amplitudes of the low and the high part of its spectrum (NULL for a part without frequencies), the pixel of
    a column of one, whose amplitude needs the patch's mean, and counts of grey levels."""
    for batch in values:
        out = []
        for v in batch:
            v = np.asarray(v, float)
            known, steps = v[~np.isnan(v)], np.abs(np.diff(v))
            steps = steps[~np.isnan(steps)]
            a = np.abs(np.fft.rfft(v))
            bands = [p.mean() if p.size else None for p in (a[1 : len(a) // 8], a[len(a) // 2 :] if len(v) > 1 else a[:0])]
            grey = known[(known >= 0) & (known <= GREY)]
            hist = np.bincount(np.minimum((grey / (GREY / GREY_LEVELS)).astype(int), GREY_LEVELS - 1), minlength=GREY_LEVELS)
            out.append([known.size, known.sum(), (known * known).sum(), steps.sum(), steps.size, known.var() if known.size else None, *bands, v[0] if len(v) == 1 else None, hist])
        kinds = {n: "int64" if isinstance(kind, LongType) else "float64" for n, kind in _PARTS.items() if n != "hist"}
        yield pd.DataFrame(out, columns=list(_PARTS)).astype(kinds)


def _melt_rows(image: DataFrame, keys: Sequence[str], taps: int) -> DataFrame:
    """(keys, _c, _last): the smoothest row of each image (keys, y, x, value), by its mean step along x over ``taps`` rows, and the
    image's last column."""
    steps = order.windowed(image, [*keys, "y"], "x", 0, 1, lambda w: {"_d": F.abs(F.lead("value").over(w) - F.col("value"))})
    rough = order.smoothed(steps.groupBy(*keys, "y").agg(F.avg("_d").alias("_g"), F.max("x").alias("_x")), keys, "y", "_g", taps, "_rv")
    return rough.groupBy(*keys).agg(first_min("_rv", "y").alias("_c"), F.max("_x").alias("_last"))


def _flanks(image: DataFrame, half: int) -> DataFrame:
    """The rows of images (_c, y, ...) outside of ``half`` rows around _c, numbered as if both flanks were one."""
    upper = F.col("y") < F.col("_c") - half
    both = image.where(upper | (F.col("y") >= F.col("_c") + half))
    return both.withColumn("y", F.when(upper, F.col("y")).otherwise(F.col("y") - F.col("_c") - half + F.greatest(F.col("_c") - half, F.lit(0))))


def _patch_features(patch: DataFrame, columns: int = 1, rows: int = 1) -> DataFrame:
    """(track, bin, s_...) of patches (track, bin, x, y, value) of so many columns and rows at least; a spectrum takes one pixel
    column, whose length is the image's height.

    Pixels are moved once, to the arrays of their columns, and what these add up to is all that a patch needs.  Unknown pixels
    don't count, but leave their column without a spectrum.  A patch without a grey level has no row."""
    pixels = F.array_sort(F.collect_list(F.struct("y", F.col("value").cast("double").alias("v"))))
    each = patch.groupBy("track", "bin", "x").agg(pixels.alias("_p"))
    each = each.select("track", "bin", _column_parts(F.transform("_p", lambda p: p.v)).alias("_c"), *([F.transform("_p", lambda p: p.y).alias("_y")] if rows > 1 else []))
    total = lambda c: F.sum(f"_c.{c}").alias(f"_{c}")
    known = lambda c: F.nanvl(F.col(f"_c.{c}"), F.lit(None))
    tall = [F.size(F.array_distinct(F.flatten(F.collect_set("_y")))).alias("_rows")] if rows > 1 else []
    summed = each.groupBy("track", "bin").agg(
        *[total(c) for c in ("n", "s", "ss", "d", "nd")], F.count(F.lit(1)).alias("_columns"), F.avg(known("v")).alias("s_locvar"), F.avg(known("low")).alias("s_fftlow"), F.sum(known("high")).alias("_high"), F.count(known("high")).alias("_n_high"),
        F.collect_list(known("one")).alias("_ones"), F.array(*[F.sum(F.get("_c.hist", F.lit(i))) for i in range(GREY_LEVELS)]).alias("_hist"), *tall,
    )
    summed = summed.where((F.col("_columns") >= columns) & (F.col("_rows") >= rows if rows > 1 else F.lit(True)))
    adding = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    mean, greys = F.try_divide("_s", "_n"), F.aggregate("_hist", F.lit(0).cast("long"), lambda s, x: s + x)
    summed = summed.withColumn("s_mean", mean).withColumn("_greys", greys).where("_greys > 0")
    share = lambda c: c / (F.col("_greys") * F.lit(GREY / GREY_LEVELS))
    return summed.select(
        "track", "bin", "s_mean", F.sqrt(F.greatest(F.col("_ss") / F.col("_n") - F.col("s_mean") * F.col("s_mean"), F.lit(0.0))).alias("s_std"), F.try_divide("_d", "_nd").alias("s_grad"), "s_locvar", "s_fftlow",
        F.try_divide(F.coalesce("_high", F.lit(0.0)) + adding("_ones", lambda x: F.abs(x - F.col("s_mean"))), F.col("_n_high") + F.size("_ones")).alias("s_ffthigh"),
        adding(F.filter("_hist", lambda c: c > 0), lambda c: -share(c) * F.log(share(c))).alias("s_entropy"),
    )


def surface_features(mosaic: DataFrame, pixel: float, mask_mm: float = 0.75, taps: int = 51, least: int = 8, whole: bool = False) -> DataFrame:
    """(track, bin, s_mean, s_std, s_grad, s_locvar, s_fftlow, s_ffthigh, s_entropy) of the surface beside the melt.

    The melt is the smoothest row; the rows within ``mask_mm`` of it are left out and the flanks joined.  A bin of fewer than
    ``least`` columns has no row.  If ``whole``, bins go on below 0 where an image begins before the grid does; else what lies there is
    left out."""
    far = (F.col("_last") - F.col("x")) * pixel
    below = F.floor((STOP - START - far) / STEP).cast("int")
    bin_ = F.when(below < BINS, below) if whole else grid_bin(STOP - far)
    placed = mosaic.join(written(_melt_rows(mosaic, ["track"], taps), "melts"), "track").withColumn("bin", bin_)
    return _patch_features(_flanks(placed.where(F.col("bin").isNotNull()), int(mask_mm / pixel)), least)


def tile_features(tiles: DataFrame, width: int, tile_mm: float = 6.41, mask_mm: float = 0.75, taps: int = 51, least: int = 8, least_rows: int = 50) -> DataFrame:
    """The same features without a mosaic, of tiles (track, place from 0, y, x, value) of ``width`` columns.

    Tile k begins k tiles from the far end, 100 mm, and its columns run against x; each has a melt of its own.  A bin takes
    the columns within 0.1 mm of its centre in the tile that holds this, so one at a border is narrower.  Bins of fewer than
    ``least`` columns or ``least_rows`` rows beside the melt have no row."""
    pixel = tile_mm / width
    bins = tiles.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    x0 = bin_centre(F.col("bin"))
    at = F.floor((STOP - x0) / tile_mm)
    centre = (STOP - at * tile_mm - x0) / tile_mm * width
    ends = [F.greatest(F.lit(0), (centre - STEP / 2 / pixel).cast("int")), F.least(F.lit(width), (centre + STEP / 2 / pixel).cast("int"))]
    ranges = bins.select("bin", at.cast("int").alias("place"), ends[0].alias("_from"), ends[1].alias("_to")).where(F.col("_to") - F.col("_from") >= least)
    columns = ranges.select("bin", "place", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("x"))  # 400 bins of some columns each
    found = tiles.join(_melt_rows(tiles, ["track", "place"], taps), ["track", "place"])
    return _patch_features(_flanks(found, int(mask_mm / pixel)).join(F.broadcast(columns), ["place", "x"]), 1, least_rows)


def stitched_features(tiles: DataFrame, width: int, tile_mm: float = 6.41, thin: int = 4, least: float = 0.01, most: float = 0.12, columns: int = 8, **settings) -> DataFrame:
    """``surface_features`` of a mosaic of tiles (track, place, y, x, value), each laid with the overlap, of ``least`` to ``most`` of
    a tile's width, at which its strip fits the next one's best over every ``thin``-th row.  A bin of fewer than ``columns``
    columns has no row."""
    overlaps = range(int(least * width), int(most * width))
    scan = grid.seam_scan(tiles.where(F.col("y") % thin == 0), ["track"], "place", "x", "y", "value", width, overlaps)
    mosaic = grid.stitched(tiles, grid.best_seam(scan, ["track"], width), ["track"], "place", "x", "y", "value", width)
    return surface_features(mosaic, tile_mm / width, least=columns, **settings)


def height_bins(heights: DataFrame, labelled: DataFrame, margin: float = 0.15, least: int = 200, every: tuple[int, int] = (40, 2)) -> DataFrame:
    """(track, bin, z_peak, z_mean, z_valley, z_range) in micrometres over the melt's pixels of each bin, after each
    track's plane is taken off; the plane is fitted beside the melt, to every so manieth column, in order of x, and row.
    ``labelled`` is (track, bin, yl, yr) in mm."""
    labelled = written(labelled.select("track", "bin", "yl", "yr"), "labelled")  # a row a bin, which is needed twice
    sides = written(labelled.groupBy("track").agg(F.percentile("yl", F.lit(0.5)).alias("_l"), F.percentile("yr", F.lit(0.5)).alias("_r")), "sides")
    thin = heights.where(F.col("iy") % every[1] == 0).join(sides, "track")
    if every[0] > 1:
        columns = heights.groupBy("track", "ix").agg(F.first("x_mm").alias("_x"))  # as many as an image is wide
        place = F.row_number().over(Window.partitionBy("track").orderBy("_x", "ix")) - 1
        thin = thin.join(columns.withColumn("_place", place).where(F.col("_place") % every[0] == 0).select("track", "ix"), ["track", "ix"])
    beside = thin.where(~F.coalesce(F.col("y_mm").between(F.col("_l") - margin, F.col("_r") + margin), F.lit(False)))
    planes = robust.trimmed_planes(beside, ["track"], "x_mm", "y_mm", "z_mm", size=estimated(heights))
    flat = heights.where("z_mm is not null").withColumn("bin", grid_bin("x_mm")).join(labelled, ["track", "bin"]).where("y_mm between yl and yr").join(planes, "track")
    um = (F.col("z_mm") - (F.col("a") * F.col("x_mm") + F.col("b") * F.col("y_mm") + F.col("c"))) * 1e3
    out = flat.withColumn("_z", um).groupBy("track", "bin").agg(F.count("_z").alias("_n"), F.avg("_z").alias("z_mean"), F.percentile("_z", F.array(*[F.lit(s) for s in (0.02, 0.05, 0.95, 0.98)])).alias("_p")).where(F.col("_n") >= least)
    p = lambda i: F.get("_p", F.lit(i))
    return out.select("track", "bin", p(3).alias("z_peak"), "z_mean", p(0).alias("z_valley"), (p(2) - p(1)).alias("z_range"))


def dataset(labelled: DataFrame, thermal: DataFrame, surface: DataFrame, power: dict[int, float] = POWER) -> DataFrame:
    """One row per track and bin, all 400 bins: labels in micrometres, frame features th_ with moving means and
    deviations (_m5, _s5), surface features sem_.  All three sides are joined by (track, bin)."""
    keys = ["track", "bin"]
    tracks = labelled.select("track").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    sides = [d.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in d.columns if c not in keys]) for p, d in (("th_", thermal), ("sem_", surface))]
    um = labelled.select(*keys, *[(F.col(c) * 1e3).alias(c) for c in ("width", "yl", "yr", "edge_rough")], "valid_frac").withColumn("center", (F.col("yl") + F.col("yr")) / 2)
    watts = F.create_map(*[F.lit(v) for kv in power.items() for v in kv])
    all_bins = tracks.select(*keys, F.element_at(watts, F.col("track").cast("int")).alias("power"), bin_centre(F.col("bin")).alias("x"))
    for side in (um, *sides):
        all_bins = all_bins.join(side, keys, "left")
    return order.rolling(all_bins, ["track"], "bin", [c for c in all_bins.columns if c.startswith("th_")], 5, 3)


def modelling_table(table: DataFrame, lag: int = 14) -> DataFrame:
    """The labelled rows of ``dataset`` joined with ``label_ensemble``: frame features are those of ``lag`` labelled rows
    before, and weight rates the label's quality."""
    kept = order.numbered(table.where("w_ens is not null and center is not null"), ["track"], ["bin"], F.floor(F.col("bin") / 64), "_rn")
    names = [c for c in table.columns if c.startswith("th_")]
    moved = order.lagged(kept, ["track"], "_rn", names, lag).drop("_rn", *names).withColumnsRenamed({f"{c}_lag": c for c in names})
    return moved.select(*table.columns, quality_weight("valid_frac", "w_spread").alias("weight"))


def pick_lag(table: DataFrame, features: Sequence[str], target: str = "width", most: int = 16, least: int = 100, top: int = 10) -> DataFrame:
    """One row (lag, score): the lag of the features, in rows of a track, at which they follow the target best.

    A lag's score is the mean over tracks of the ``top`` largest absolute correlations among features with ``least``
    pairs; the smallest lag wins a tie.  Give the training tracks only.  All features and lags are one pass each."""
    placed = order.numbered(table, ["track"], ["bin"], F.floor(F.col("bin") / 64), "_rn")
    long = placed.select("track", "_rn", F.col(target).alias("_y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_v")) for f in features])).alias("_f")).select("track", "_rn", "_y", "_f.*")
    scan = order.lag_scan(long, ["track", "feature"], "_rn", "_y", "_v", most, least).where("r is not null")
    rank = F.row_number().over(Window.partitionBy("track", "lag").orderBy(F.abs("r").desc(), "feature"))
    by_track = scan.withColumn("_rank", rank).where(F.col("_rank") <= top).groupBy("track", "lag").agg(F.avg(F.abs("r")).alias("score"))
    return by_track.groupBy("lag").agg(F.avg("score").alias("score")).orderBy(F.desc("score"), "lag").limit(1)


def spectral_windows(df: DataFrame, keys: Sequence[str], position: str, value: str, size: int = 32, rate: float = 50.0) -> DataFrame:
    """(keys, position, b0_2, b2_8, b8_15, b15_25, scent, hfrac, rstd3): the spectrum of the ``size`` samples around each.

    Windows are moved, not shortened, at the ends; missing values take the key's median; each window is detrended and
    weighted before its transform.  Keys with fewer than ``size`` samples have NULLs.  Positions run from 0 without gaps.
    """
    t, freq = np.arange(size), np.fft.rfftfreq(size, 1 / rate)
    base = np.vander(t, 2).astype(float)
    flat = np.eye(size) - base @ np.linalg.pinv(base)
    kernel = np.fft.rfft(np.hanning(size)[:, None] * flat, axis=0).T
    inside = np.stack([(freq >= a) & (freq < b) for a, b in BANDS.values()], axis=1).astype(float)
    names = [*BANDS, "scent", "hfrac"]

    @pandas_udf(", ".join(f"{n} double" for n in names))
    def features(batch: pd.Series) -> pd.DataFrame:
        out = np.full((len(batch), len(names)), np.nan)
        whole = np.array([v is not None and len(v) == size for v in batch], bool)
        if whole.any():
            power = np.abs(np.stack(batch[whole].to_list()).astype(float) @ kernel) ** 2
            total = power[:, 1:].sum(1) + 1e-12
            parts = np.column_stack([power @ inside, (power[:, 1:] * freq[1:]).sum(1), power[:, freq >= 10].sum(1)])
            out[whole] = parts / total[:, None]
        return pd.DataFrame(out, columns=names)

    keys, half = list(keys), size // 2
    stats = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_med"), F.count("*").alias("_n"))
    filled = df.join(stats, keys).select(*keys, position, "_n", F.coalesce(value, "_med").alias("_v"))
    around = order.windowed(filled, keys, position, size, size, lambda w: {"_a": F.collect_list("_v").over(w.rowsBetween(-size, size))})
    p = F.col(position)
    first = F.least(F.greatest(p - half, F.lit(0)), F.col("_n") - size)
    cut = F.when(F.col("_n") >= size, F.slice("_a", (first - F.greatest(p - size, F.lit(0)) + 1).cast("int"), F.lit(size)))
    rough = order.roughness(around.withColumn("_w", cut).drop("_a"), keys, position, "_v", 3, "rstd3")
    return rough.withColumn("_f", features("_w")).select(*keys, position, *[F.nanvl(F.col(f"_f.{n}"), F.lit(None)).alias(n) for n in names], F.when(F.col("_n") >= size, F.col("rstd3")).alias("rstd3"))
