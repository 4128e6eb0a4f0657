"""Analyses beside the main stages: alignment of series, spectra as columns, a blend of line and trees, reports, and the
tables behind plots.  All are plans over every track at once; missing values are NULL and empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import correlation, first_min, rearranged, recentred, widened
from trackloom.operators import learning, order, robust, scoring
from trackloom.plans import tracks
from trackloom.sources.profiles import TILE_MM

SERIES = ("a1400", "a1800", "t_max", "cy1800", "cx1800", "wid1400", "tail_len")
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


def tile_of(x_mm: Column | str, n: Column | int, size: float = TILE_MM, end: float = 100.0) -> Column:
    """Number of the tile, counted from the end of the track, that holds a position; NULL beyond the ``n`` tiles."""
    x_mm = F.col(x_mm) if isinstance(x_mm, str) else x_mm
    k = F.floor((F.lit(end) - x_mm) / size)
    return F.when((k >= 0) & (k < n), k.cast("int"))


def validity_weight(valid: Column | str, floor: float = 0.05) -> Column:
    """A label's share of valid columns, ``floor`` at least."""
    return F.greatest(F.col(valid) if isinstance(valid, str) else valid, F.lit(floor))


def spread_weight(valid: Column | str, spread: Column | str, half: float = 50.0, floor: float = 0.05) -> Column:
    """valid / (1 + spread / half), ``floor`` at least; an unknown spread counts as ``half``."""
    valid, spread = (F.col(c) if isinstance(c, str) else c for c in (valid, spread))
    return F.when(valid.isNotNull(), F.greatest(valid / (1 + F.coalesce(spread, F.lit(half)) / half), F.lit(floor)))


def missing_share(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, n, value ...): the share of NULLs in each column."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(v).isNull().cast("double")).alias(v) for v in values])


def spread_summary(table: DataFrame, keys: Sequence[str] = ("track",), value: str = "w_ens", spread: str = "w_spread") -> DataFrame:
    """(keys, n, width, spread, p90): medians of labels and of their spread, and the spread's 90th percentile; rows
    without a label don't count."""
    known = table.where(F.col(value).isNotNull()).groupBy(*keys)
    return known.agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("width"), F.percentile(spread, F.lit(0.5)).alias("spread"), F.percentile(spread, F.lit(0.9)).alias("p90"))


def decimated(df: DataFrame, steps: dict[str, int]) -> DataFrame:
    """The cells whose coordinates are multiples of their steps."""
    for c, n in steps.items():
        df = df.where(F.col(c) % n == 0)
    return df


def width_by_power(table: DataFrame) -> DataFrame:
    """(power, width): the median width at each power."""
    return table.groupBy("power").agg(F.percentile("width", F.lit(0.5)).alias("width"))


def final_bands(forecasts: DataFrame, card: DataFrame) -> DataFrame:
    """(track, x, y, p, low90, low50, high50, high90, left, right, yl_true, yr_true) of the scored holdouts."""
    wide = widened("q", "pw", F.col("conformal_s"))
    at = lambda i: F.get("_w", F.lit(i))
    made = forecasts.join(card.select("track", "conformal_s"), "track").withColumn("_w", wide)
    return made.select("track", "x", F.col("w_true").alias("y"), F.col("pw").alias("p"), at(0).alias("low90"), at(1).alias("low50"), at(3).alias("high50"), at(4).alias("high90"), (F.col("pc") - F.col("pw") / 2).alias("left"), (F.col("pc") + F.col("pw") / 2).alias("right"), "yl_true", "yr_true")


def aligned(table: DataFrame, a: str, b: str, most: int = 20, least: int = 80, position: str = "bin", keys: Sequence[str] = ("track",)) -> DataFrame:
    """(keys, lag, r): the shift of ``b`` at which it follows ``a`` best, over pairs where both are known; 0 and 0.0 if no
    shift has ``least`` pairs.  Positions run from 0 without gaps."""
    found = order.best_lag(order.lag_scan(table, list(keys), position, a, b, most, least), list(keys))
    return found.select(*keys, F.coalesce("lag", F.lit(0)).cast("int").alias("lag"), F.coalesce("r", F.lit(0.0)).alias("r"))


def self_alignment(table: DataFrame, band: DataFrame, series: str = "th_wid1400_m5", label: str = "width") -> DataFrame:
    """(track, oracle_lag, oracle_r, semreg_lag, semreg_r, sem_vs_label_r): how a frame series lies to the label, to the
    band's width (track, bin, width in mm), which needs no label, and how that width lies to the label."""
    both = table.select("track", "bin", series, label).join(band.select("track", "bin", (F.col("width") * 1e3).alias("_band")), ["track", "bin"], "left")
    parts = [(label, series, 20, "oracle"), ("_band", series, 20, "semreg"), (label, "_band", 5, "sem_vs_label")]
    made = [aligned(both, a, b, most).select("track", F.col("lag").alias(f"{name}_lag"), F.col("r").alias(f"{name}_r")) for a, b, most, name in parts]
    return made[0].join(made[1], "track").join(made[2], "track").drop("sem_vs_label_lag")


def band_profile(tiles: DataFrame, taps: int = 51, fine: int = 31, tile_mm: float = TILE_MM) -> DataFrame:
    """(track, bin, width in mm) of the smooth band in image tiles (track, place, width, x, y, value).

    Roughness is the step to the next pixel of a row, repeated at the end.  A tile's centre is its smoothest row; a block
    of columns 0.2 mm wide has a band where the run of rows through the centre that are smoother than 1.6 times
    the 20th percentile lies.  Of blocks that fall into one bin the last in the order of tiles and columns counts."""
    keys = ["track", "place"]
    rough = order.step_size(tiles, [*keys, "y"], "x", "value", "_g")
    level = order.smoothed(rough.groupBy(*keys, "y").agg(F.avg("_g").alias("_m")), keys, "y", "_m", taps, "_rv")
    tile = level.groupBy(*keys).agg(first_min("_rv", "y").alias("_centre"), (F.percentile("_rv", F.lit(0.2)) * 1.6).alias("_limit"))
    pixel = F.lit(tile_mm) / F.col("width")
    columns = F.greatest(F.lit(1), F.floor(F.lit(0.2) / pixel))
    blocks = rough.withColumn("_n", columns).withColumn("_block", F.floor(F.col("x") / F.col("_n"))).where((F.col("_block") + 1) * F.col("_n") <= F.col("width"))
    mean = blocks.groupBy(*keys, "width", "_n", "_block", "y").agg(F.avg("_g").alias("_m"))
    by = [*keys, "width", "_n", "_block"]
    smooth = order.smoothed(mean, by, "y", "_m", fine, "_s").join(tile, keys)
    runs = smooth.withColumn("_ok", F.col("_s") < F.col("_limit"))
    ends = runs.groupBy(*by).agg(
        F.max(F.when(~F.col("_ok") & (F.col("y") < F.col("_centre")), F.col("y"))).alias("_lo"), F.min(F.when(~F.col("_ok") & (F.col("y") > F.col("_centre")), F.col("y"))).alias("_hi"),
        F.max(F.when(F.col("y") == F.col("_centre"), F.col("_ok"))).alias("_at"), F.max("y").alias("_end"),
    ).where("_at")
    size = (F.coalesce(F.col("_hi"), F.col("_end") + 1) - F.coalesce(F.col("_lo"), F.lit(-1)) - 1) * pixel
    x = F.lit(100.0) - F.col("place") * tile_mm - (F.col("_block") * F.col("_n") + F.col("_n") / 2) * pixel
    placed = ends.select("track", ((x - tracks.START) / tracks.STEP).cast("int").alias("bin"), F.struct("place", "_block", size.alias("w")).alias("_p")).where(F.col("bin").between(0, tracks.BINS - 1))
    return placed.groupBy("track", "bin").agg(F.max("_p").alias("_p")).select("track", "bin", F.col("_p.w").alias("width"))


def spectral_columns(table: DataFrame, series: Sequence[str] = SERIES, keys: Sequence[str] = ("track",), position: str = "bin") -> DataFrame:
    """(keys, position, sp_<series>_<feature> ...): seven features of the spectrum around each position, per series."""
    long = table.select(*keys, position, F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("_v")) for s in series])).alias("_x")).select(*keys, position, "_x.*")
    made = tracks.spectral_windows(long, [*keys, "series"], position, "_v")
    names = [c for c in made.columns if c not in (*keys, "series", position)]
    return made.groupBy(*keys, position).agg(*[F.max(F.when(F.col("series") == s, F.col(n))).alias(f"sp_{s}_{n}") for s in series for n in names])


def local_correlations(df: DataFrame, fold: str, features: Sequence[str], target: str, least: int = 50, top: int | None = 25) -> DataFrame:
    """(feature, r): the mean over folds of the correlation with the target within each, the ``top`` strongest first.  A fold
    counts for a feature with ``least`` pairs or more."""
    pairs = lambda f: F.count_if(F.col(f).isNotNull() & F.col(target).isNotNull())
    by = df.groupBy(fold).agg(*[F.when(pairs(f) >= least, correlation(f, target)).alias(f) for f in features])
    ranked = by.unpivot([fold], list(features), "feature", "r").groupBy("feature").agg(F.avg("r").alias("r")).where("r is not null").orderBy(F.abs("r").desc(), "feature")
    return ranked.limit(top) if top else ranked


def analysis(table: DataFrame, train: Sequence[int], features: Sequence[str], target: str = "width", series: str = "th_a1800_m5", **settings) -> dict[str, DataFrame]:
    """The report on features: importance in trees of the training tracks, correlations within tracks, and each track's lag."""
    known = table.where(F.col(target).isNotNull())
    head = learning.Head("importance", target, None, 200)
    numbered = order.numbered(known, ["track"], ["bin"], F.floor(F.col("bin") / 64), "_rn")
    return {
        "importance": learning.importance(known.where(F.col("track").isin(list(train))).withColumn("_key", F.col("track") * 1000 + F.col("bin")), "_key", features, head, 20, **settings),
        "local_corr": local_correlations(known, "track", [f for f in features if f != "power"], target),
        "lags": aligned(numbered, target, series, 15, 100, "_rn"),
    }


def blended(table: DataFrame, key: str, features: Sequence[str], train: Sequence[int], anchor: str, target: str = "width", weight: str | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """Forecasts (track, key, y, p, q) of all tracks, and the holdouts' scores (track, alpha, factor, mae_gbm, mae_anchor, mae_blend,
    crps, cov90, cov50, r).

    A line on ``anchor`` and boosted trees are mixed by the share that serves the training tracks best, each forecast by the
    others, and intervals grow by the factor that those tracks' misses ask for.  Holdouts choose nothing.  Keep
    ``table`` in a written form: it is read several times."""
    trained = list(train)
    known = table.where(F.col(target).isNotNull())
    heads = [learning.Head("gbm", target, None, 150, weight), *[learning.Head(f"q{i}", target, a, 100) for i, a in enumerate(scoring.QUANTILES)]]
    trees = learning.fold_forecasts(known, "track", key, features, heads, trained, **settings)
    others = known.withColumn("_y", F.when(F.col("track").isin(trained), F.col(target)))  # a holdout's own label is unknown to the line
    line = learning.anchor_forecast(others, "track", key, anchor, "_y").select(key, F.col("forecast").alias("anchor"))
    both = trees.join(line, key).join(known.select(key, F.col(target).alias("y")), key)
    mine, held = F.col("track").isin(trained), ~F.col("track").isin(trained)
    alpha = scoring.best_blend(both.where(mine), "track", "y", "gbm", "anchor", ALPHAS).select("alpha")
    mixed = both.crossJoin(F.broadcast(alpha)).withColumn("p", F.col("alpha") * F.col("gbm") + (1 - F.col("alpha")) * F.col("anchor"))  # one row at most
    mixed = mixed.withColumn("q", recentred(rearranged(F.array(*[f"q{i}" for i in range(5)])), "p"))
    factor = scoring.score_quantile(mixed.where(mine), [], "y", "p", F.get("q", F.lit(0)), F.get("q", F.lit(4)))
    wide = mixed.crossJoin(F.broadcast(factor)).withColumn("q", widened("q", "p", F.col("factor")))
    off = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    y, q = F.col("y"), F.col("q")
    card = wide.where(held).groupBy("track", "alpha", "factor").agg(off("gbm").alias("mae_gbm"), off("anchor").alias("mae_anchor"), off("p").alias("mae_blend"), F.avg(scoring.crps(y, q)).alias("crps"), F.avg(scoring.inside(y, q, 0, 4)).alias("cov90"), F.avg(scoring.inside(y, q, 1, 3)).alias("cov50"), correlation("p", "y").alias("r"))
    return wide.select("track", key, "y", "p", "q"), card


def stacked(table: DataFrame, key: str, features: Sequence[str], train: Sequence[int], holdout: Sequence[int], target: str = "width", weight: str | None = None, power: str = "power", share: float = 0.9, **settings) -> tuple[DataFrame, DataFrame]:
    """Forecasts (track, key, y, line, gbm, knn, p, q), and a row of scores of each track (mae_physics, mae_gbm, mae_knn, mae_ens,
    crps_raw, cov90_raw, factor, crps_cal, cov90_cal, r).

    A track's width is a line in the root of the power, through the medians of the other training tracks, plus what trees and
    neighbours, half and half, forecast of the rest.  Quantiles of the rest are moved to that forecast and grow by the
    factor that covers ``share`` of the training tracks' misses.  The rest depends on the line, so tracks, which are few, are
    forecast one after the other.  Keep ``table`` in a written form: it is read several times."""
    known = table.where(F.col(target).isNotNull())
    made = None
    for track in (*train, *holdout):
        others = [t for t in train if t != track]
        level = known.where(F.col("track").isin(others)).groupBy(power).agg(F.percentile(target, F.lit(0.5)).alias("_w")).withColumn("_root", F.sqrt(power))
        line = F.broadcast(robust.line(level, [], "_root", "_w"))  # one row
        base = known.where(F.col("track").isin([*others, track])).join(line).withColumn("_line", F.col("slope") * F.sqrt(power) + F.col("intercept")).withColumn("_rest", F.col(target) - F.col("_line")).withColumn("_role", (F.col("track") == track).cast("int")).drop("slope", "intercept")
        heads = [learning.Head("_gbm", "_rest", None, 150, weight), *[learning.Head(f"_q{i}", "_rest", a, 100) for i, a in enumerate(scoring.QUANTILES)]]
        own, rest = base.where("_role = 1"), base.where("_role = 0")
        # the track's own rest is hidden, and only its rows are forecast
        trees = learning.fold_forecasts(base, "_role", key, features, heads, [0], **settings).where("_role = 1").drop("_role")
        near = learning.neighbour_forecast(rest, own, key, features, "_rest").withColumnRenamed("forecast", "_knn")
        both = own.select("track", key, F.col(target).alias("y"), "_line").join(trees, key).join(near, key)
        both = both.withColumn("_rest", (F.col("_gbm") + F.col("_knn")) / 2)
        q = F.transform(recentred(rearranged(F.array(*[f"_q{i}" for i in range(5)])), "_rest"), lambda x: x + F.col("_line"))
        part = both.select("track", key, "y", F.col("_line").alias("line"), (F.col("_line") + F.col("_gbm")).alias("gbm"), (F.col("_line") + F.col("_knn")).alias("knn"), (F.col("_line") + F.col("_rest")).alias("p"), q.alias("q"))
        made = part if made is None else made.unionByName(part)
    factor = scoring.score_quantile(made.where(F.col("track").isin(list(train))), [], "y", "p", F.get("q", F.lit(0)), F.get("q", F.lit(4)), share)
    wide = made.crossJoin(F.broadcast(factor)).withColumn("_w", widened("q", "p", F.col("factor")))  # one row
    off = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    y, q, w = F.col("y"), F.col("q"), F.col("_w")
    card = wide.groupBy("track", "factor").agg(
        off("line").alias("mae_physics"), off("gbm").alias("mae_gbm"), off("knn").alias("mae_knn"), off("p").alias("mae_ens"), F.avg(scoring.crps(y, q)).alias("crps_raw"), F.avg(scoring.inside(y, q, 0, 4)).alias("cov90_raw"),
        F.avg(scoring.crps(y, w)).alias("crps_cal"), F.avg(scoring.inside(y, w, 0, 4)).alias("cov90_cal"), correlation("p", "y").alias("r"),
    )
    return made, card
