"""Two-dimensional grids as long tables (x, y, value): smoothing, texture, spectra and mosaics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.order import moving_sums, step_size, windowed


def edge_means(df: DataFrame, keys: Sequence[str], position: str, values: dict[str, str], taps: int) -> DataFrame:
    """Moving means of several columns, (new name: column), over an odd number of ``taps``; beyond the ends the last value
    repeats, and an unknown value counts as 0."""
    return moving_sums(df, keys, position, values, taps // 2, taps // 2, lambda total, low, high, first, last: (total + low * first + high * last) / taps)


def box_means(df: DataFrame, keys: Sequence[str], x: str, y: str, values: dict[str, str], taps_y: int = 15, taps_x: int = 51) -> DataFrame:
    """Means over a box around each cell, with the border repeated beyond it: one pass per axis for all columns."""
    tall = edge_means(df, [*keys, x], y, {f"_tall_{name}": v for name, v in values.items()}, taps_y)
    return edge_means(tall, [*keys, y], x, {name: f"_tall_{name}" for name in values}, taps_x).drop(*[f"_tall_{name}" for name in values])


def box_mean(df: DataFrame, keys: Sequence[str], x: str, y: str, value: str, taps_y: int = 15, taps_x: int = 51, name: str = "mean") -> DataFrame:
    return box_means(df, keys, x, y, {name: value}, taps_y, taps_x)


def score_map(df: DataFrame, keys: Sequence[str], x: str, y: str, value: str, taps_y: int = 15, taps_x: int = 51, unknown: float = 8.0, scale: float = 1000.0) -> DataFrame:
    """score: the share of known cells around, dampened by the roughness around (steps along y, each at most ``unknown``)."""
    rough = step_size(df, [*keys, x], y, value, "_step", scale)
    rough = rough.withColumn("_r", F.coalesce(F.least("_step", F.lit(unknown)), F.lit(unknown))).withColumn("_v", F.col(value).isNotNull().cast("double"))
    both = box_means(rough, keys, x, y, {"_vs": "_v", "_rs": "_r"}, taps_y, taps_x)
    return both.withColumn("score", F.col("_vs") * F.exp(-F.col("_rs") / 2)).drop("_step", "_r", "_v", "_vs", "_rs")


def texture(df: DataFrame, keys: Sequence[str], x: str, y: str, value: str) -> DataFrame:
    """(keys, mean, deviation, gradient, local_var): brightness, population deviation, mean step along y and the mean
    over columns of their variance."""
    stepped = windowed(df, [*keys, x], y, 0, 1, lambda w: {"_d": F.abs(F.lead(value).over(w) - F.col(value))})
    columns = stepped.groupBy(*keys, x).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), F.sum("_d").alias("d"), F.count("_d").alias("nd"), F.var_pop(value).alias("v"))
    n = F.sum("n")
    mean = F.sum("s") / n
    return columns.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0))).alias("deviation"), (F.sum("d") / F.sum("nd")).alias("gradient"), F.avg("v").alias("local_var"))


def density_entropy(df: DataFrame, keys: Sequence[str], value: str, bins: int = 32, limits: tuple[float, float] | None = None) -> DataFrame:
    """(keys, entropy): minus the sum of h ln h over a density histogram between the least and the largest value, or
    between two limits, beyond which values are left out."""
    if limits:
        df = df.where(F.col(value).between(*limits))
    lo, hi = (F.lit(float(v)) for v in limits) if limits else (F.min(value), F.max(value))
    ends = df.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"), F.count(value).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    code = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = df.join(ends, list(keys)).where(F.col(value).isNotNull()).groupBy(*keys, "lo", "hi", "n", code.alias("b")).agg(F.count("*").alias("c"))
    h = F.try_divide(F.col("c"), F.col("n") * width)
    return counts.groupBy(*keys).agg(F.sum(-h * F.log(h)).alias("entropy"))


def spectrum(df: DataFrame, keys: Sequence[str], position: str, value: str, n: int) -> DataFrame:
    """(keys, k, amplitude): the discrete Fourier transform's magnitudes for k = 0 .. n/2 of series of ``n`` positions from 0 on; a
    position that is missing, or whose value is unknown, counts as 0.

    A series becomes one row, an array, and is transformed where it lies."""
    cells = df.where(F.col(position).between(0, n - 1)).groupBy(*keys).agg(F.collect_list(F.struct(F.col(position).cast("int").alias("at"), F.col(value).cast("double").alias("v"))).alias("_cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["_cells"]
            flat, rows = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            series = np.zeros((batch.num_rows, n))
            np.add.at(series, (rows, flat.field("at").to_numpy()), np.nan_to_num(flat.field("v").to_numpy(zero_copy_only=False)))
            sizes = np.abs(np.fft.rfft(series, axis=1))
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * sizes.shape[1]), pa.array(sizes.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], made], names=[*keys, "_f"])

    kinds = dict(cells.dtypes)
    found = cells.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_f array<double>"]))
    return found.select(*keys, F.posexplode("_f").alias("k", "amplitude")).withColumn("k", F.col("k").cast("long"))


def band_power(spectra: DataFrame, keys: Sequence[str], n_frequencies: int, n: int) -> DataFrame:
    """(keys, low, high): mean amplitude of frequencies 1 .. n/8 and from n/2 of the spectrum's length on."""
    k, m = F.col("k"), n_frequencies
    return spectra.groupBy(*keys).agg(F.avg(F.when((k >= 1) & (k < m // 8), F.col("amplitude"))).alias("low"), F.avg(F.when(k >= m // 2, F.col("amplitude"))).alias("high"))


def mosaic(tiles: DataFrame, keys: Sequence[str], tile: str, x: str, y: str, value: str, step: int, mirror_width: int | None = None) -> DataFrame:
    """(keys, y, x, value): tiles laid every ``step`` columns, overlaps averaged; mirrored if a width is given."""
    at = F.col(x) + F.col(tile) * step
    at = F.lit(mirror_width - 1) - at if mirror_width else at
    return tiles.groupBy(*keys, F.col(y), at.alias(x)).agg(F.avg(value).alias(value))


def placed(tiles: DataFrame, keys: Sequence[str], tile: str) -> DataFrame:
    """``tiles`` with their number in a row from 0 as ``place``: the numbers of tiles are ordered, gaps don't count."""
    each = tiles.groupBy(*keys, tile).agg(F.count(F.lit(1)).alias("_n"))
    return tiles.join(each.select(*keys, tile, (F.row_number().over(Window.partitionBy(*keys).orderBy(tile)) - 1).alias("place")), [*keys, tile])


def seam_scan(tiles: DataFrame, keys: Sequence[str], tile: str, x: str, y: str, value: str, width: int, overlaps: Sequence[int]) -> DataFrame:
    """(keys, tile, overlap, r): how well a tile's right strip fits the next one's left strip, per overlap, for every two
    neighbours; NULL where the strips have no cell in common.

    Each tile is standardised as a whole; r is the mean product over the strip.  A row of pixels gives its two strips as
    arrays, and one transform of a pair of these gives the sums of all overlaps."""
    keys, widest = list(keys), max(overlaps)
    stats = tiles.groupBy(*keys, tile).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    edge = tiles.where((F.col(x) >= width - widest) | (F.col(x) < widest)).join(stats, [*keys, tile])
    flat = edge.select(*keys, F.col(tile).alias("tile"), F.col(y).alias("_y"), F.col(x).alias("_x"), ((F.col(value) - F.col("_m")) / (F.col("_s") + 1e-9)).alias("_v"))

    def strips(start: int, name: str, step: int) -> DataFrame:
        mine = flat.where((F.col("_x") >= start) & (F.col("_x") < start + widest)).withColumn("tile", F.col("tile") - step)
        return mine.groupBy(*keys, "tile", "_y").agg(F.collect_list(F.struct((F.col("_x") - start).cast("int").alias("at"), "_v")).alias(name))

    both = strips(width - widest, "_a", 0).join(strips(0, "_b", 1), [*keys, "tile", "_y"])
    wanted = list(overlaps)

    def dense(cells: list) -> tuple[np.ndarray, np.ndarray]:
        out, known = np.zeros((len(cells), 2 * widest)), np.zeros((len(cells), 2 * widest))
        for i, row in enumerate(cells):
            for c in row:
                if c["_v"] is not None:
                    out[i, c["at"]], known[i, c["at"]] = c["_v"], 1.0
        return out, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, ka), (b, kb) = dense(batch["_a"].to_pylist()), dense(batch["_b"].to_pylist())
            # an overlap of o columns lays b's first on a's column widest - o
            each = [np.fft.irfft(np.fft.rfft(p, axis=1) * np.conj(np.fft.rfft(q, axis=1)), 2 * widest, axis=1)[:, [widest - o for o in wanted]] for p, q in ((a, b), (ka, kb))]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in [*keys, "tile"]], pa.array(each[0].tolist()), pa.array(np.rint(each[1]).tolist())], names=[*keys, "tile", "s", "n"])

    kinds = dict(both.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in [*keys, "tile"]] + ["s array<double>", "n array<double>"])
    sums = both.mapInArrow(run, schema).groupBy(*keys, "tile").agg(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(len(wanted)) for c in "sn"])
    own = stats.select(*keys, F.col(tile).alias("tile"))
    pairs = own.join(own.withColumn("tile", F.col("tile") - 1), [*keys, "tile"]).join(sums, [*keys, "tile"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("overlap"), F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).alias("r")) for i, o in enumerate(wanted)]))
    return pairs.select(*keys, "tile", each.alias("_e")).select(*keys, "tile", "_e.overlap", "_e.r")


def best_seam(scan: DataFrame, keys: Sequence[str], width: int, share: float = 0.05) -> DataFrame:
    """(keys, tile, overlap, r): the overlap that fits best, the smallest on a tie; where none is known, ``share`` of the
    width with r -1."""
    known = F.when(F.col("r") > -1, F.struct("r", (-F.col("overlap")).alias("o")))
    best = scan.groupBy(*keys, "tile").agg(F.max(known).alias("_b"))
    return best.select(*keys, "tile", F.coalesce(-F.col("_b.o"), F.lit(int(share * width))).alias("overlap"), F.coalesce("_b.r", F.lit(-1.0)).alias("r"))


def stitched(tiles: DataFrame, seams: DataFrame, keys: Sequence[str], tile: str, x: str, y: str, value: str, width: int) -> DataFrame:
    """(keys, y, x, value): tiles laid with the overlap of each seam (keys, tile, overlap), averaged and mirrored."""
    steps = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)
    starts = seams.select(*keys, (F.col("tile") + 1).alias("_tile"), F.sum(F.lit(width) - F.col("overlap")).over(steps).alias("_start"))
    last = starts.groupBy(*keys).agg((F.max("_start") + width - 1).alias("_last"))
    at = tiles.withColumn("_tile", F.col(tile)).join(starts, [*keys, "_tile"], "left").join(last, list(keys), "left")
    place = F.coalesce("_last", F.lit(width - 1)) - (F.col(x) + F.coalesce("_start", F.lit(0)))
    return at.groupBy(*keys, F.col(y), place.cast("int").alias(x)).agg(F.avg(value).alias(value))
