"""Models: the split search as a query, forecasts of folds by trees, ridge by its normal equations, and forecasts
by neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import bin_code
from trackloom.operators import boosting
from trackloom.operators.neighbours import nearest
from trackloom.operators.quantiles import percentiles
from trackloom.scratch import written


def coded(df: DataFrame, features: Sequence[str], bins: int = 32) -> DataFrame:
    """``df`` with each feature's bin number as feature_bin; the edges are one row, so it is broadcast."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*")
    found = percentiles(long, ["feature"], "v", [i / bins for i in range(1, bins)])
    edges = found.agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.array_distinct("p"))), F.array().cast("array<double>")).alias(f"_e_{f}") for f in features])
    with_edges = df.join(F.broadcast(edges))
    return with_edges.withColumns({f"{f}_bin": bin_code(F.col(f), F.col(f"_e_{f}")) for f in features}).drop(*[f"_e_{f}" for f in features])


def split_gain(df: DataFrame, node: str, features: Sequence[str], target: str, least: int = 25) -> DataFrame:
    """(node, feature, bin, gain): of each node the best cut (rows with bin <= cut go left); the first wins a tie.

    One histogram per node, feature and bin, then running sums over its few bins."""
    long = df.select(node, target, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f"{f}_bin").alias("bin")) for i, f in enumerate(features)])).alias("x"))
    bins = long.groupBy(node, "x.i", "x.feature", "x.bin").agg(F.sum(target).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(node, "feature")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = bins.select(node, "i", "feature", "bin", F.sum("s").over(run).alias("sl"), F.sum("n").over(run).alias("nl"), F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    gain = F.col("sl") ** 2 / F.col("nl") + sr**2 / nr - F.col("s") ** 2 / F.col("n")
    scored = cut.where((F.col("nl") >= least) & (nr >= least)).withColumn("gain", gain).where("gain > 1e-12")
    best = F.max(F.struct("gain", (-F.col("i")).alias("i"), (-F.col("bin")).alias("bin"), "feature"))
    return scored.groupBy(node).agg(best.alias("x")).select(node, "x.feature", (-F.col("x.bin")).cast("int").alias("bin"), "x.gain")


class Head(NamedTuple):
    """One forecast: a mean, or a quantile, of a target, by so many trees; ``weight`` is a column of draw chances."""

    name: str
    target: str
    quantile: float | None = None
    trees: int = 150
    weight: str | None = None


def _models(df: DataFrame, fold: str | None, folds: Sequence, held: Sequence[int], key: str, features: Sequence[str], heads: Sequence[Head], settings: dict) -> dict[tuple[int, int], boosting.Model]:
    """Models by (number of the held fold, number of the head)."""
    one_task, together = settings.pop("one_task", boosting.ONE_TASK), settings.pop("together", 1)
    targets, weights = list(dict.fromkeys(h.target for h in heads)), list(dict.fromkeys(h.weight for h in heads if h.weight))
    rows = boosting.prepared(df, fold, folds, key, features, targets, weights)
    kinds = [(targets.index(h.target), weights.index(h.weight) if h.weight else -1, h.quantile, h.trees) for h in heads]
    return boosting.trained(rows, held, kinds, len(features), len(targets), len(weights), boosting.Settings(**settings), one_task, together)


def fold_forecasts(df: DataFrame, fold: str, key: str, features: Sequence[str], heads: Sequence[Head], train_folds: Sequence | None = None, block: int = 64, only: Sequence | None = None, carried: Sequence[str] = (), **settings) -> DataFrame:
    """(fold, key, a column for each head, and doubles that are ``carried`` along): every row forecast by models that its fold's labels didn't train.

    Models for a fold are trained on all rows of the other folds among ``train_folds`` (all by default) whose target is
    known; folds outside of these are holdouts: they train nothing and share their models.  Settings are those of
    ``boosting.Settings``, and ``one_task``, the rows up to which one task grows a model; beyond, all tasks grow the same
    trees together.  ``block`` folds at a time are held out, and their models broadcast.  A fold without any row to learn from
    gets NULLs; a null fold is a fold, and none of the others' rows are lost.  If ``only`` is given, these folds are
    forecast, and no models trained for others.
    """
    folds = sorted((r[0] for r in df.select(fold).distinct().collect()), key=lambda f: (f is None, f))
    mine = folds if train_folds is None else [f for f in folds if f in list(train_folds)]
    numbers = {f: i for i, f in enumerate(mine)}
    asked_for = [f for f in folds if only is None or f in list(only)]
    held_out = [f for f in mine if f in asked_for]
    groups = [held_out[at : at + block] for at in range(0, len(held_out), block)]
    others = [f for f in asked_for if f not in numbers]
    kinds = dict(df.dtypes)
    schema = f"`{fold}` {kinds[fold]}, `{key}` {kinds[key]}, " + ", ".join(f"`{c}` double" for c in [*[h.name for h in heads], *carried])
    names = [fold, key, *[h.name for h in heads], *carried]
    numbered = [F.col(c).cast("double").alias(f"_{kind}{i}") for kind, cs in (("x", features), ("c", carried)) for i, c in enumerate(cs)]
    made = None
    for some in [*groups, *([others] if others else [])]:
        held = {f: numbers.get(f, -1) for f in some}
        models = _models(df, fold, mine, sorted(set(held.values())), key, features, heads, dict(settings)) if mine else {}
        shared = df.sparkSession.sparkContext.broadcast((held, models))

        def forecast(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, models = shared.value
            known: dict[int, tuple[list[int], boosting.Forecasts]] = {}
            for j in {j for j, _ in models}:
                mine = [h for h in range(len(heads)) if (j, h) in models]
                known[j] = mine, boosting.Forecasts([models[j, h] for h in mine])
            for b in batches:
                own = b["_own"].to_numpy()
                x = np.stack([b[f"_x{i}"].to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
                answers = np.full((len(heads), b.num_rows), np.nan)
                for j in np.unique(own):
                    if int(j) in known:
                        mine, made = known[int(j)]
                        rows = np.flatnonzero(own == j)
                        answers[np.ix_(mine, rows)] = made.of(x[rows]).T
                yield pa.RecordBatch.from_arrays([b["_held"], b["_key"], *map(pa.array, answers), *[b[f"_c{i}"] for i in range(len(carried))]], names=names)

        asked = F.col(fold).isin([f for f in some if f is not None])
        asked = asked | F.col(fold).isNull() if None in some else asked
        own = F.lit(-1)
        for f, j in held.items():
            own = F.when(F.col(fold).eqNullSafe(F.lit(f)), j).otherwise(own)
        part = df.where(asked).select(F.col(fold).alias("_held"), F.col(key).alias("_key"), own.alias("_own"), *numbered).mapInArrow(forecast, schema)
        made = part if made is None else made.unionByName(part)
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    return made.select(fold, key, *[F.nanvl(F.col(h.name), F.lit(None).cast("double")).alias(h.name) for h in heads], *carried)


def booster_forecasts(df: DataFrame, fold: str, key: str, features: Sequence[str], heads: Sequence[Head], train_folds: Sequence | None = None, **settings) -> DataFrame:
    """``fold_forecasts`` by a second-order booster: weights weigh every head's loss, rows are drawn without regard to them, and
    leaves are shrunk by an L2 term of 1 and need a weight of 1.  A quantile's leaf is the quantile of its rows' residuals."""
    return fold_forecasts(df, fold, key, features, heads, train_folds, **{"second": True, "l2": 1.0, "least": 1.0, **settings})


def forest_forecasts(df: DataFrame, fold: str, key: str, features: Sequence[str], target: str, trees: int = 120, depth: int = 7, least: int = 15, columns: float = 0.5, train_folds: Sequence | None = None, carried: Sequence[str] = (), **settings) -> DataFrame:
    """(fold, key, each, carried, forecast, spread): the forecasts of all trees of a random forest, an array, their mean and population
    deviation, for every row by the forest of the other folds.  A tree sees its rows as often as a Poisson count of mean 1 by
    seed, tree and key says, and half of the columns."""
    heads = [Head(f"_t{k}", target, None, 1) for k in range(trees)]
    own = {"bag": True, "rate": 1.0, "rows": 1.0, "depth": depth, "least": least, "columns": columns, "together": 16, **settings}
    made = fold_forecasts(df, fold, key, features, heads, train_folds, carried=carried, **own)
    each = F.array(*[f"_t{k}" for k in range(trees)])
    mean = F.aggregate("each", F.lit(0.0), lambda s, x: s + x) / trees
    out = made.select(fold, key, each.alias("each"), *carried).withColumn("forecast", mean)
    return out.withColumn("spread", F.sqrt(F.aggregate("each", F.lit(0.0), lambda s, x: s + (x - F.col("forecast")) ** 2) / trees))


def out_of_bag(df: DataFrame, key: str, features: Sequence[str], target: str, trees: int = 120, depth: int = 7, least: int = 15, columns: float = 0.5, **settings) -> DataFrame:
    """(key, forecast, n): for each row with a known target the mean forecast of the ``n`` trees of one forest over all rows that
    didn't see it; NULL for a row that all trees saw.  The error of these is the forest's without a held-out fold."""
    heads = [Head(f"_t{k}", target, None, 1) for k in range(trees)]
    own = {"bag": True, "rate": 1.0, "rows": 1.0, "depth": depth, "least": least, "columns": columns, "together": 16, **settings}
    models = _models(df, None, [], [-1], key, features, heads, dict(own))
    shared = df.sparkSession.sparkContext.broadcast([models[-1, h] for h in range(trees)] if models else [])
    seed = own.get("seed", 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, total, n = pdf[list(features)].to_numpy(float), np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
            hashes = pdf["_hash"].to_numpy(np.int64).view(np.uint64)
            for h, model in enumerate(shared.value):
                unseen = boosting.bagged(hashes, seed, h) == 0
                total += np.where(unseen, model.predict(x), 0.0)
                n += unseen
            yield pd.DataFrame({key: pdf["_key"], "forecast": np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0), "n": n})

    known = df.where(F.col(target).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_hash"), *[F.col(f).cast("double").alias(f) for f in features])
    made = known.mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, forecast double, n long")
    return made.withColumn("forecast", F.nanvl("forecast", F.lit(None).cast("double")))


def importance(df: DataFrame, key: str, features: Sequence[str], head: Head, top: int = 20, **settings) -> DataFrame:
    """(feature, share): the share of a model's splits that use each feature, the ``top`` largest first.  The model is
    trained on all rows with a known target; ``key`` tells rows apart."""
    model = _models(df, None, [], [-1], key, features, [head], settings).get((-1, 0))
    used = np.concatenate([t.feature for t in model.trees]) if model else np.empty(0, np.int64)
    counts = np.bincount(used[used >= 0], minlength=len(features))
    made = [(f, float(n / max(1, counts.sum()))) for f, n in zip(features, counts, strict=True)]
    return df.sparkSession.createDataFrame(sorted(made, key=lambda r: (-r[1], r[0]))[:top], "feature string, share double")


def gram(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """One row: n, means, and population covariances of features and target, from which ridge is solved."""
    x = [F.col(f).cast("double") for f in features]
    return df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{f}") for f, c in zip(features, x, strict=True)], F.avg(y).alias("mean_y"), *[F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))], *[F.covar_pop(c, F.col(y)).alias(f"y_{i}") for i, c in enumerate(x)])


def ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 10.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on the features' own scale; standardised inside, the intercept is free."""
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    r = gram(df.fillna(means, list(features)), features, y).first()
    p = len(features)
    c = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    scale = np.sqrt(np.diag(c)) + 1e-9
    w = np.linalg.solve(r["n"] * c / np.outer(scale, scale) + alpha * np.eye(p), r["n"] * np.array([r[f"y_{i}"] for i in range(p)]) / scale) / scale
    return w, float(r["mean_y"] - w @ np.array([r[f"mean_{f}"] for f in features]))


def anchor_forecast(df: DataFrame, fold: str, key: str, x: str, y: str) -> DataFrame:
    """(fold, key, forecast): each fold's rows forecast by the line of y on x through all other folds' rows.

    The other folds' moments are all folds' moments less the own ones, about the means of all rows, so rows are read
    once for the moments and once for the forecasts.  An unknown x takes its fold's median; a line that the other folds
    don't determine gives NULL."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    about = known.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    terms = {"n": F.lit(1.0), "sx": dx, "sy": dy, "sxx": dx * dx, "sxy": dx * dy}
    own = known.join(F.broadcast(about)).groupBy(fold).agg(*[F.sum(c).alias(k) for k, c in terms.items()])
    total = own.agg(*[F.sum(k).alias(f"t_{k}") for k in terms])
    middle = percentiles(df, [fold], x, [0.5]).select(fold, F.get("p", F.lit(0)).alias("_med"))
    rest = middle.join(own, fold, "left").join(F.broadcast(total)).join(F.broadcast(about))
    n, sx, sy, sxx, sxy = (F.col(f"t_{k}") - F.coalesce(k, F.lit(0.0)) for k in terms)
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    lines = rest.select(fold, "_med", slope.alias("_b"), (F.col("_my") + F.try_divide(sy - slope * sx, n) - slope * F.col("_mx")).alias("_a"))
    # a row a fold: once it is written, Spark sees that, and no fold's rows meet in one task
    return df.join(written(lines, "lines"), fold).select(fold, key, (F.col("_a") + F.col("_b") * F.coalesce(x, "_med")).alias("forecast"))


def neighbour_forecast(known: DataFrame, asked: DataFrame, key: str, features: Sequence[str], y: str, k: int = 15) -> DataFrame:
    """(key, forecast): the mean ``y`` of the ``k`` nearest rows of ``known`` for each row of ``asked``.

    Features are standardised by the known rows, and an unknown one takes their mean.  Keys are whole numbers that differ
    within each table."""
    stats = known.agg(*[F.struct(F.avg(f).alias("m"), (F.stddev_pop(f) + 1e-9).alias("s")).alias(f"_{f}") for f in features])
    vec = F.array(*[F.coalesce((F.col(f) - F.col(f"_{f}.m")) / F.col(f"_{f}.s"), F.lit(0.0)) for f in features])
    place = lambda df: df.join(F.broadcast(stats)).select(F.col(key).cast("long").alias("id"), vec.alias("vec"))
    near = nearest(written(place(known), "known"), place(asked), k)
    means = near.join(known.select(F.col(key).cast("long").alias("id"), F.col(y).alias("_y")), "id").groupBy("query").agg(F.avg("_y").alias("forecast"))
    return asked.select(key).join(means, F.col(key).cast("long") == F.col("query")).select(key, "forecast")
