"""Profilometer text files and image tiles, from any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.scratch import written

#: Fixed values of the data: the pixel size where a file names none, and the shares by which tiles and seams overlap.
PIXEL_MM, TILE_MM, OVERLAP = 0.003982, 6.41, 0.05
#: Missing cells that one task fills in at once.
ROWS = 1 << 20


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number within their part of the file, which a task reads in order."""
    part, n = None, 0
    for batch in batches:
        places = []
        for here in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True):
            part, n = here, n + 1 if here == part else 0
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])


def asc_heights(spark: SparkSession, path: str, crop: tuple[float, float] | None = (20.0, 100.0), end: float = 100.0) -> DataFrame:
    """(track, ix, iy, x_mm, y_mm, z_mm) of the height maps at ``path``: third tab-separated column in nm, 'Bad' is
    NULL, x-major order.

    A file is read by as many tasks as Spark's reader cuts it into.  The first pass counts each part's lines and finds the
    header: X Size, Y Size and Pixel_size, whose values are the third and the last words, and RAW_DATA, behind which the
    heights begin.  The second knows from these which cell a line is.  Blank lines are no lines; a file that ends early gives
    NULL heights for the rest.  x runs against the stage, so x_mm = end - ix * pixel.  The track is the number behind the last
    underscore of the file's name, if any."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = text.where(F.trim(F.translate("value", "\t\r", "  ")) != "").mapInArrow(_placed, "value string, file string, block long, place long")
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    first, second = F.lower(F.get(words, F.lit(0))), F.lower(F.get(words, F.lit(1)))
    head = lambda c, v: F.min(F.when(c, v))
    size = lambda axis: head((first == axis) & (second == "size"), F.struct("place", F.get(words, F.lit(2)).try_cast("double").alias("v")))["v"]
    raw, pixel = first == "raw_data", head(first == "pixel_size", F.struct("place", F.element_at(words, -1).try_cast("double").alias("v")))["v"]
    parts = written(lines.groupBy("file", "block").agg(F.count("*").alias("n"), head(raw, F.col("place")).alias("raw"), size("x").alias("nx"), size("y").alias("ny"), pixel.alias("pixel")), "parts")
    own = Window.partitionBy("file")
    ahead = F.coalesce(F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = parts.withColumn("before", ahead)
    whole = lambda c: F.min(c).over(own)
    begin = whole(F.col("before") + F.col("raw")) + 1
    known = written(known.select("file", "block", (F.col("before") - begin).alias("start"), (F.sum("n").over(own) - begin).alias("held"), whole("nx").cast("long").alias("nx"), whole("ny").cast("long").alias("ny"), F.coalesce(whole("pixel"), F.lit(PIXEL_MM)).alias("pixel")), "heads")
    if bad := known.where("nx IS NULL OR ny IS NULL OR start IS NULL").select("file").first():
        raise ValueError(f"a height map has lines X Size, Y Size and RAW_DATA: {bad.file}")
    met = lines.join(known, ["file", "block"]).withColumn("k", F.col("start") + F.col("place")).where((F.col("k") >= 0) & (F.col("k") < F.col("nx") * F.col("ny")))
    value = F.nanvl(F.trim(F.get(F.split("value", "\t"), F.lit(2))).try_cast("double"), F.lit(None).cast("double"))
    cells = met.select("file", "ny", "pixel", "k", (value.cast("float") * F.lit(1e-6).cast("float")).alias("z_mm"))
    files = known.groupBy("file", "nx", "ny", "pixel", "held").agg(F.lit(0)).withColumn("held", F.greatest("held", F.lit(0)))
    short = files.where("held < nx * ny").select("*", F.explode(F.sequence("held", F.col("nx") * F.col("ny") - 1, F.lit(ROWS).cast("long"))).alias("at"))
    rest = short.select("file", "ny", "pixel", F.explode(F.sequence("at", F.least(F.col("at") + ROWS, F.col("nx") * F.col("ny")) - 1)).alias("k"), F.lit(None).cast("float").alias("z_mm"))

    ix, iy = F.floor(F.col("k") / F.col("ny")).cast("int"), (F.col("k") % F.col("ny")).cast("int")
    every = cells.unionByName(rest).select(F.regexp_extract("file", r"_(\d+)\.[^./]*$", 1).try_cast("int").alias("track"), ix.alias("ix"), iy.alias("iy"), (end - ix * F.col("pixel")).alias("x_mm"), (iy * F.col("pixel")).alias("y_mm"), "z_mm")
    return every.where(F.col("x_mm").between(*crop)) if crop else every


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, track, tile, width, x, y, value) of the grey values of image tiles; the tile's number follows the last
    underscore of the file's name, the track's that of the folder two above it.

    Spark stores rows of blue, green, red (or one grey) bytes; luminance weighs them 0.114, 0.587, 0.299."""
    i = spark.read.format("image").load(path).select("image.*")
    number = F.regexp_extract("origin", r"_(\d+)\.[^._]*$", 1).try_cast("int")
    track = F.regexp_extract("origin", r"_(\d+)/[^/]*/[^/]*$", 1).try_cast("int")
    rows = i.select(F.col("origin").alias("file"), track.alias("track"), number.alias("tile"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    at = (F.col("y") * F.col("width") + F.col("x")) * F.col("nChannels")
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), at + k + 1, F.lit(1))), 16, 10).cast("double")
    grey = F.when(F.col("nChannels") == 1, byte(0)).otherwise(F.round(0.114 * byte(0) + 0.587 * byte(1) + 0.299 * byte(2)))
    return cells.select("file", "track", "tile", "width", "x", "y", grey.alias("value"))


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that Spark's file systems don't have."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if not path(p).getFileSystem(conf).exists(path(p))]
