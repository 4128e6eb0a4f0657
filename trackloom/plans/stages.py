"""The pipeline from raw files to the scorecard, as numbered stages that read and write tables.

Every stage is one plan over all tracks and leaves Parquet tables, parted by track, so a run can begin at any stage whose
tables are there.  A run that resumes makes the parts that are missing and no others: tracks that have no part of a
table yet, and forecasts of tracks that no model has been trained for; the lag, the scorecard and which folds are there are
JSON, too.  Raw files lie under ``data`` as thermal/Thermal_<track>.mat, height_maps/Heightmap_<track>.ASC and
sem/SEM_<track>/PlainImages/<name>_<tile>.tif; tables are written under ``out``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import rearranged, recentred
from trackloom.operators import frames, grid, learning, scoring
from trackloom.plans import extras, tracks
from trackloom.sources import matlab, profiles

KEYS = ["track", "bin"]
#: Columns of the modelling table that are labels, not features.
LABELS = ("track", "bin", "x", "width", "yl", "yr", "center", "edge_rough", "valid_frac", "w_ens", "w_spread", "z_peak", "z_mean", "z_valley", "z_range", *[f"w_v{i}" for i in range(len(tracks.VARIANTS))], "weight")
SCALES = tuple(round(0.6 + 0.05 * i, 2) for i in range(49))
HEADS = (
    *[learning.Head(f"q{i}", "w_ens", q, 100) for i, q in enumerate(scoring.QUANTILES)],
    learning.Head("pw", "w_ens", None, 150, "weight"),
    learning.Head("pc", "center", None, 150, "weight"),
    learning.Head("zr_pred", "z_range", None, 150, "weight"),
)


@dataclass(frozen=True)
class Layout:
    """Where raw files and tables lie, which tracks train and which are held out, and each track's power in W."""

    data: str
    out: str
    train: tuple[int, ...] = (8, 10, 14)
    holdout: tuple[int, ...] = (21,)
    power: dict[int, float] = field(default_factory=lambda: dict(tracks.POWER))
    lag: int | None = 14  # None: chosen by the training tracks
    settings: dict = field(default_factory=dict)  # of the boosted trees
    todo: tuple[int, ...] | None = None  # the tracks to make tables of; None: all

    @property
    def tracks(self) -> tuple[int, ...]:
        return (*self.train, *self.holdout)

    def raw(self, track: int) -> list[str]:
        return [f"{self.data}/thermal/Thermal_{track}.mat", f"{self.data}/height_maps/Heightmap_{track}.ASC", f"{self.data}/sem/SEM_{track}/PlainImages"]

    def table(self, name: str) -> str:
        return f"{self.out}/{name}"


def _read(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    """A stage's table, of the tracks to do."""
    found = spark.read.parquet(layout.table(name))
    return found.where(F.col("track").isin(list(layout.todo))) if layout.todo is not None and "track" in found.columns else found


def made_parts(spark: SparkSession, layout: Layout, name: str) -> set[int]:
    """The tracks that a table has a part of."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(layout.table(name))
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [p.getPath().getName() for p in store.listStatus(folder)] if store.exists(folder) else []
    return {int(p.removeprefix("track=")) for p in parts if p.removeprefix("track=").isdigit()}


def _write(made: DataFrame, layout: Layout, name: str) -> None:
    """Replace a table, or, where only some tracks are to do, their parts of it."""
    out = made.write.mode("overwrite")
    if "track" in made.columns:
        out = out.partitionBy("track").option("partitionOverwriteMode", "static" if layout.todo is None else "dynamic")
    out.parquet(layout.table(name))


def _noted(spark: SparkSession, layout: Layout, name: str, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("overwrite").json(layout.table(f"{name}.json"))


def chosen_lag(spark: SparkSession, layout: Layout, table: DataFrame, features: list[str]) -> int:
    """The layout's lag, or the one that the training tracks choose, which is noted as JSON and read from there again."""
    if layout.lag is not None:
        return layout.lag
    if _has(spark, layout, "lag.json"):
        return spark.read.schema("lag int, score double").json(layout.table("lag.json")).first().lag
    best = tracks.pick_lag(table.where(F.col("track").isin(list(layout.train))), features).select(F.col("lag").cast("int").alias("lag"), "score")
    _noted(spark, layout, "lag", best)
    found = spark.read.schema("lag int, score double").json(layout.table("lag.json")).first()
    return found.lag if found else 0


def _has(spark: SparkSession, layout: Layout, name: str) -> bool:
    return not profiles.missing(spark, [layout.table(name)])


def ingest(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """Frames, height maps and mosaics of tiles, and the frames of the laser interval; raises if a track's files are missing.

    Video files are parsed once: all else reads the table of frames, a row a frame."""
    wanted = layout.tracks if layout.todo is None else layout.todo
    if lost := profiles.missing(spark, [p for t in wanted for p in layout.raw(t)]):
        raise FileNotFoundError(", ".join(lost))
    spark.dataSource.register(matlab.MatFrames)
    mine = F.col("track").isin(list(wanted))
    film = matlab.tracked(spark.read.format("matframes").load(f"{layout.data}/thermal")).where(mine)
    heights = profiles.asc_heights(spark, f"{layout.data}/height_maps").where(mine)
    tiles = grid.placed(profiles.tiles(spark, f"{layout.data}/sem/*/PlainImages").where(mine), ["track"], "tile")

    def shots() -> DataFrame:
        film = _read(spark, layout, "frames")
        return tracks.last_frames(film, tracks.bright_interval(frames.frame_levels(film, ["track", "frame"])))

    return {"frames": film, "shots": shots, "heights": heights, "mosaic": mosaics(tiles)}


def mosaics(tiles: DataFrame, overlap: float = profiles.OVERLAP) -> DataFrame:
    """(track, y, x, value, pixel): each track's tiles laid with a fixed overlap, averaged and mirrored; pixel in mm."""
    step = F.round(F.col("width") * (1 - overlap)).cast("int")
    laid = tiles.withColumn("_at", F.col("x") + F.col("place") * step)
    last = laid.groupBy("track").agg(F.max("_at").alias("_last"), (F.lit(profiles.TILE_MM) / F.max("width")).alias("pixel"))
    return laid.groupBy("track", "y", "_at").agg(F.avg("value").alias("value")).join(last, "track").select("track", "y", (F.col("_last") - F.col("_at")).cast("int").alias("x"), "value", "pixel")


def labels(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """The score map of each height map, and the melt's labels by bin."""
    scored = grid.score_map(_read(spark, layout, "heights"), ["track"], "ix", "iy", "z_mm")
    return {"scores": scored, "labels": lambda: tracks.label_bins(_read(spark, layout, "scores"))}


def thermal(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    return {"thermal": tracks.thermal_features(_read(spark, layout, "shots"))}


def surface(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """Features of the mosaics; tracks whose tiles have one pixel size are one plan."""
    mosaic = _read(spark, layout, "mosaic")
    sizes = [r.pixel for r in mosaic.select("pixel").distinct().orderBy("pixel").collect()]
    parts = [tracks.surface_features(mosaic.where(F.col("pixel") == p).drop("pixel"), p) for p in sizes]
    made = parts[0] if parts else tracks.surface_features(mosaic.drop("pixel"), 1.0)
    for part in parts[1:]:
        made = made.unionByName(part)
    return {"surface": made}


def dataset(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    return {"dataset": tracks.dataset(*[_read(spark, layout, t) for t in ("labels", "thermal", "surface")], layout.power).drop("variant")}


def ensemble(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """The dataset with the median and spread of the labels under six variants of the extraction."""
    made = tracks.label_ensemble(tracks.label_bins(_read(spark, layout, "scores"), tracks.VARIANTS))
    return {"dataset_ensemble": _read(spark, layout, "dataset").join(made, KEYS, "left")}


def heights(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """The dataset with the melt's heights over its plane."""
    made = tracks.height_bins(_read(spark, layout, "heights"), _read(spark, layout, "labels").select(*KEYS, "yl", "yr"))
    return {"dataset_with_z": _read(spark, layout, "dataset_ensemble").join(made, KEYS, "left")}


def model(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """Forecasts of the tracks to do by models that their labels didn't train, and the holdouts' scorecard.

    Holdouts train nothing and choose nothing: lag and intervals' scale come from the training tracks.  Without
    the table of heights the one before it is used, and nothing is forecast of heights."""
    everything = replace(layout, todo=None)
    table = _read(spark, everything, "dataset_with_z" if _has(spark, layout, "dataset_with_z") else "dataset_ensemble")
    if "z_range" not in table.columns:
        table = table.withColumn("z_range", F.lit(None).cast("double"))
    lag = chosen_lag(spark, layout, table, [c for c in table.columns if c.startswith("th_")])
    ready = tracks.modelling_table(table, lag).withColumn("key", F.col("track") * 1000 + F.col("bin"))
    features = [c for c in ready.columns if c not in (*LABELS, "key")]

    def forecasts() -> DataFrame:
        rows = _read(spark, everything, "modelling")
        made = learning.fold_forecasts(rows, "track", "key", features, HEADS, layout.train, only=layout.todo, **layout.settings)
        q = recentred(rearranged(F.array(*[f"q{i}" for i in range(len(scoring.QUANTILES))])), "pw")
        truth = rows.select("key", "bin", "x", F.col("w_ens").alias("w_true"), F.col("center").alias("c_true"), F.col("yl").alias("yl_true"), F.col("yr").alias("yr_true"), F.col("z_range").alias("zr_true"))
        return made.select("track", "key", q.alias("q"), "pw", "pc", "zr_pred").join(truth, "key").drop("key")

    return {"modelling": ready, "forecasts": forecasts, "scorecard": lambda: scorecard(spark, layout)}


def scorecard(spark: SparkSession, layout: Layout) -> DataFrame:
    """The holdouts' scores over the forecasts of all folds that are there, also noted as JSON with these folds."""
    found = _read(spark, replace(layout, todo=None), "forecasts").where(F.col("track").isin(list(layout.tracks)))
    card = scoring.scorecard(found, "track", layout.train, SCALES)
    _noted(spark, layout, "final_results", card)
    _noted(spark, layout, "folds", found.groupBy("track").agg(F.count("*").alias("rows")).orderBy("track"))
    return card


def reports(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """Tables to look at: missing shares of heights, width by power, spread of the labels, and what the figures show."""
    everything = replace(layout, todo=None)
    table = _read(spark, everything, "dataset_ensemble")
    scores = _read(spark, everything, "scores")
    return {
        "report_heights": extras.missing_share(_read(spark, everything, "heights"), ["track"], ["z_mm"]),
        "report_width_by_power": extras.width_by_power(table),
        "report_spread": extras.spread_summary(table),
        "plot_scores": extras.decimated(scores.select("track", "ix", "iy", "x_mm", "y_mm", "score"), {"ix": 10}),
        "plot_bands": extras.final_bands(_read(spark, everything, "forecasts"), _read(spark, everything, "scorecard")),
    }


STAGES: dict[int, Callable[[SparkSession, Layout], dict]] = {0: ingest, 1: labels, 2: thermal, 3: surface, 4: dataset, 5: ensemble, 6: heights, 7: model, 9: reports}
#: The last stage of the scorecard, and of all.
LAST, TABLES = 7, {0: ("frames", "shots", "heights", "mosaic"), 1: ("scores", "labels"), 2: ("thermal",), 3: ("surface",), 4: ("dataset",), 5: ("dataset_ensemble",), 6: ("dataset_with_z",), 7: ("forecasts",)}


def run(spark: SparkSession, layout: Layout, start: int = 0, only: int | None = None, resume: bool = False) -> DataFrame | None:
    """Run the stages from ``start`` on, or one ``only``; gives the scorecard if the model's stage ran.

    A stage's tables are written in turn, and one that is a function is made from those written before it.  To resume is
    to do the tracks that some table of a stage has no part of, and the layout's own ``todo``, if it has one."""
    if only is not None and only not in STAGES:
        raise ValueError(f"no stage {only}")
    numbers = [only] if only is not None else [n for n in STAGES if n >= start]
    for n in numbers:
        own = layout
        if resume and n in TABLES:
            lost = [t for t in layout.tracks if any(t not in made_parts(spark, layout, name) for name in TABLES[n])]
            own = replace(layout, todo=tuple(t for t in lost if layout.todo is None or t in layout.todo))
            if not own.todo and n != LAST:
                continue
        for name, made in STAGES[n](spark, own).items():
            if n == LAST and name == "forecasts" and own.todo == ():
                continue
            # what a model learns from, and the scorecard, are of all tracks
            _write(made() if callable(made) else made, replace(own, todo=None) if name in ("modelling", "scorecard") else own, name)
    return _read(spark, replace(layout, todo=None), "scorecard") if LAST in numbers else None
