"""MATLAB version 5 files of numeric arrays: one row per frame of the array that looks like a video.

``spark.dataSource.register(MatFrames)``, then ``spark.read.format("matframes").load("dir_or_file")``.  Every file is
one partition.  Rows: file, variable, frame, h, w, pixels (floats, row by row).
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: numpy types by element type and by array class, and the two container types.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED, HEADER = 14, 15, 128
#: Pixels of a batch of frames.
BATCH = 1 << 21


def elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, content) of each element; compressed ones are opened.  Plain elements are padded to 8 bytes."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:  # a small element: its size shares the tag, its content the rest of the 8 bytes
            kind, size, start, after = kind & 0xFFFF, kind >> 16, at + 4, at + 8
        else:
            start = at + 8
            after = start + size + (0 if kind == COMPRESSED else -size % 8)
        content = data[start : start + size]
        if kind == COMPRESSED:
            yield from elements(zlib.decompress(content))
        else:
            yield kind, content
        at = after


def arrays(blob: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(name, array) of every numeric array of a file."""
    for kind, content in elements(blob[HEADER:]):
        if kind != MATRIX:
            continue
        (_, flags), (_, shape), (_, name), *rest = elements(content)
        cls = flags[0]
        if cls in CLASSES and rest and rest[0][0] in ELEMENTS:
            dims = np.frombuffer(shape, "<i4")
            values = np.frombuffer(rest[0][1], "<" + ELEMENTS[rest[0][0]])[: math.prod(dims)]
            yield name.decode("ascii").strip("\0 "), values.astype(CLASSES[cls]).reshape(dims, order="F")


def video(found: list[tuple[str, np.ndarray]], side: int = 400) -> tuple[str, np.ndarray] | None:
    """The three-dimensional array with most values, those with a side of ``side`` counted tenfold, frames first.

    Sides of one are left out.  Where the first two sides are equal and the third is not, the frames lie along the third;
    where the last two differ, along the longest; else along the first."""
    solid = [(name, np.squeeze(a)) for name, a in found if np.squeeze(a).ndim == 3]
    if not solid:
        return None
    name, a = max(solid, key=lambda x: x[1].size * (10 if side in x[1].shape else 1))
    rows, columns, last = a.shape
    axis = 2 if rows == columns != last else int(np.argmax(a.shape)) if columns != last else 0
    return name, np.moveaxis(a, axis, 0).astype(np.float32)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class MatFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matframes"

    def schema(self) -> str:
        return "file string, variable string, frame int, h int, w int, pixels array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    """Paths are those that the workers' file system shows: local or mounted."""

    def __init__(self, options) -> None:
        self.path, self.side = options["path"].removeprefix("file://"), int(options.get("side", 400))

    def partitions(self) -> list[_File]:
        import glob
        import os

        inside = sorted(glob.glob(f"{self.path}/*.mat")) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not inside:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in inside]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        with open(part.value, "rb") as f:
            found = video(list(arrays(f.read())), self.side)
        if not found:
            return
        name, frames = found
        n, h, w = frames.shape
        each = max(1, BATCH // max(1, h * w))
        for at in range(0, n, each):
            part_ = np.ascontiguousarray(frames[at : at + each])
            k = len(part_)
            pixels = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * (h * w)), pa.array(part_.ravel()))
            same = lambda x, kind: pa.array([x] * k, kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(part.value, pa.string()), same(name, pa.string()), pa.array(np.arange(at, at + k, dtype=np.int32)), same(h, pa.int32()), same(w, pa.int32()), pixels], names=["file", "variable", "frame", "h", "w", "pixels"])


def tracked(frames: DataFrame) -> DataFrame:
    """(track, frame, h, w, pixels) of frames (file, ...); the track is the number behind the last underscore of the file's name."""
    track = F.regexp_extract("file", r"_(\d+)\.[^./]*$", 1).try_cast("int")
    return frames.select(track.alias("track"), "frame", "h", "w", "pixels")


def shots(frames: DataFrame) -> DataFrame:
    """(track, frame, x, y, value), a row a pixel, of frames (file, frame, h, w, pixels, ...)."""
    cells = tracked(frames.withColumn("h", F.lit(None).cast("int"))).select("track", "frame", "w", F.posexplode("pixels").alias("k", "value"))
    return cells.select("track", "frame", (F.col("k") % F.col("w")).alias("x"), F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), F.col("value").cast("double").alias("value"))
