"""Scores of probabilistic forecasts, their calibration, and small searches over a fixed grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import pinball, widened
from trackloom.operators.quantiles import percentiles

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def crps(y: Column, q: Column, levels: Sequence[float] = QUANTILES) -> Column:
    """Twice the mean pinball loss over the quantiles of one forecast."""
    return 2 * sum((pinball(y, F.get(q, F.lit(i)), a) for i, a in enumerate(levels)), F.lit(0.0)) / len(levels)


def inside(y: Column, q: Column, low: int, high: int) -> Column:
    """1 if y lies in the interval of two quantiles, ends included, else 0."""
    return y.between(F.get(q, F.lit(low)), F.get(q, F.lit(high))).cast("double")


def scores(df: DataFrame, keys: Sequence[str], y: str, point: str, q: str) -> DataFrame:
    """(keys, n, mae, rmse, r2, crps, cov90, cov50)."""
    d = F.col(y) - F.col(point)
    c = F.col(y), F.col(q)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (1 - F.try_divide(F.sum(d * d), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(crps(*c)).alias("crps"), F.avg(inside(*c, 0, 4)).alias("cov90"), F.avg(inside(*c, 1, 3)).alias("cov50"),
    )


def calibration_grid(df: DataFrame, fold: str, y: str, point: str, q: str, scales: Sequence[float]) -> DataFrame:
    """(scale, crps, coverage): means over folds of the scores of intervals widened by each scale.

    A row is cut down to a few numbers (the target, the point and the quantiles' distances from it) before it meets the
    scales of the fixed grid, and is summed up at once where it lies."""
    g = [(F.get(q, F.lit(i)) - F.col(point)).alias(f"_g{i}") for i in range(len(QUANTILES))]
    each = df.select(fold, F.col(y).alias("_y"), F.col(point).alias("_p"), *g).withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    miss = [F.col("_y") - (F.col("_p") + F.col(f"_g{i}") * F.col("scale")) for i in range(len(QUANTILES))]
    loss = 2 * sum((F.greatest(a * m, (a - 1) * m) for a, m in zip(QUANTILES, miss, strict=True)), F.lit(0.0)) / len(QUANTILES)
    within = ((miss[0] >= 0) & (miss[-1] <= 0)).cast("double")
    by_fold = each.groupBy("scale", fold).agg(F.avg(loss).alias("crps"), F.avg(within).alias("coverage"))
    return by_fold.groupBy("scale").agg(F.avg("crps").alias("crps"), F.avg("coverage").alias("coverage"))


def scorecard(df: DataFrame, fold: str, train_folds: Sequence, scales: Sequence[float], least: float = 0.88) -> DataFrame:
    """(fold, conformal_s, width_mae, width_crps, width_cov90, width_cov50, center_mae, yleft_mae, yright_mae, zrange_mae) of
    every fold outside of ``train_folds``, whose intervals are widened by the scale that the training folds choose.

    ``df`` has w_true, c_true, yl_true, yr_true, zr_true, the forecasts pw, pc, zr_pred, and quantiles q about pw.  Where no
    scale covers enough there is no row."""
    best = best_scale(calibration_grid(df.where(F.col(fold).isin(list(train_folds))), fold, "w_true", "pw", "q", scales), least)
    held = df.where(~F.col(fold).isin(list(train_folds))).crossJoin(F.broadcast(best.select(F.col("scale").alias("conformal_s"))))  # one row at most
    held = held.withColumn("q", widened("q", "pw", F.col("conformal_s")))
    off = lambda a, b: F.avg(F.abs(F.col(a) - b))
    c = F.col("w_true"), F.col("q")
    return held.groupBy(fold, "conformal_s").agg(
        off("w_true", F.col("pw")).alias("width_mae"), F.avg(crps(*c)).alias("width_crps"), F.avg(inside(*c, 0, 4)).alias("width_cov90"), F.avg(inside(*c, 1, 3)).alias("width_cov50"), off("c_true", F.col("pc")).alias("center_mae"),
        off("yl_true", F.col("pc") - F.col("pw") / 2).alias("yleft_mae"), off("yr_true", F.col("pc") + F.col("pw") / 2).alias("yright_mae"), off("zr_true", F.col("zr_pred")).alias("zrange_mae"),
    )


def best_scale(grid: DataFrame, least: float = 0.88) -> DataFrame:
    """The scale with the least CRPS among those that cover enough; the smallest wins a tie; no row if none does."""
    return grid.where(F.col("coverage") >= least).orderBy("crps", "scale").limit(1)


def score_quantile(df: DataFrame, keys: Sequence[str], y: str, point: str, low: Column, high: Column, share: float = 0.9) -> DataFrame:
    """(keys, factor): the quantile of misses over half-widths, by which intervals must grow to cover ``share``."""
    half = F.greatest((high - low) / 2, F.lit(1e-9))
    found = percentiles(df, keys, F.abs(F.col(y) - F.col(point)) / half, [share])
    return found.select(*keys, F.get("p", F.lit(0)).alias("factor"))


def best_blend(df: DataFrame, fold: str, y: str, a: str, b: str, alphas: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(alpha, mae): the mix alpha a + (1 - alpha) b with the least mean error over folds; the smallest alpha wins a tie."""
    each = df.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in alphas])))
    error = F.abs(F.col(y) - (F.col("alpha") * F.col(a) + (1 - F.col("alpha")) * F.col(b)))
    return each.groupBy("alpha", fold).agg(F.avg(error).alias("e")).groupBy("alpha").agg(F.avg("e").alias("mae")).orderBy("mae", "alpha").limit(1)
