"""The nearest rows to each of many queries, exactly, by a join over cells.

Rows belong to the cell of their nearest pivot, of which there are few.  A query first meets the rows of its own cell; the
distance of the last that it needs then bounds the rest: by the triangle inequality no row of a cell is nearer than the
pivot is, less the cell's radius, and none is nearer than the plane half way between both pivots.  The query goes on
to the cells that these bounds leave.  Within a cell, chunks of rows meet chunks of queries, so a cell of any size, of
copies of one vector even, is spread over tasks; only pivots, and counts and radii by cell, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.scratch import written

#: Rows, or queries, of a chunk; most pivots; differences of coordinates that are held at once.
CHUNK, MOST_PIVOTS, _BLOCK = 4096, 256, 1 << 22
_FOUND = "query long, id long, distance double"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def squared(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of some queries at a time to all rows."""
    step = max(1, _BLOCK // max(1, x.size))
    for k in range(0, len(q), step):
        some = slice(k, k + step)
        yield some, ((q[some, None] - x[None]) ** 2).sum(axis=2)


def _first(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest of each row, the smaller id first on a tie."""
    if d.shape[1] > k:
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        keep = np.flatnonzero((d <= last).any(axis=0))
        return keep[np.lexsort((np.broadcast_to(ids[keep], (len(d), len(keep))), d[:, keep]), axis=1)[:, :k]]
    return np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)


def _cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, vec, cell, far): each row's nearest pivot and its distance."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.concatenate([d for _, d in squared(_matrix(batch["vec"]), shared.value)])
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], pa.array(d.argmin(axis=1), pa.int32()), pa.array(np.sqrt(d.min(axis=1)))], names=["id", "vec", "cell", "far"])

    return df.mapInArrow(run, "id long, vec array<double>, cell int, far double")


def _pairs(rows: DataFrame, asked: DataFrame, k: int, chunk: int) -> DataFrame:
    """(query, id, distance): of each chunk of a cell's rows the ``k`` nearest to each query (id, vec, cell) of the cell."""
    sizes = [{r.cell: -(-r.n // chunk) for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()} for df in (rows, asked)]
    both = sorted(set(sizes[0]) & set(sizes[1]))
    if not both:
        return rows.sparkSession.createDataFrame([], _FOUND)

    def of(side: int) -> Column:
        return F.create_map(*[F.lit(v) for c in both for v in (c, sizes[side][c])])[F.col("cell")]

    def dealt(df: DataFrame, own: int, own_name: str, other_name: str) -> DataFrame:
        known = df.where(F.col("cell").isin(both)).select("id", "vec", "cell")
        part = F.pmod(F.xxhash64("id"), of(own)).cast("int")
        return known.withColumn(own_name, part).withColumn(other_name, F.explode(F.sequence(F.lit(0), of(1 - own) - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, x, names, q = left["id"].to_numpy(), _matrix(left["vec"]), right["id"].to_numpy(), _matrix(right["vec"])
            for some, d in squared(q, x):
                at = _first(d, ids, k)
                out[0].append(np.repeat(names[some], at.shape[1]))
                out[1].append(ids[at].ravel())
                out[2].append(np.take_along_axis(d, at, 1).ravel())
        joined = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query": pa.array(joined[0], pa.int64()), "id": pa.array(joined[1], pa.int64()), "distance": pa.array(joined[2], pa.float64())})

    keys = ["cell", "r", "q"]
    return dealt(rows, 0, "r", "q").groupBy(*keys).cogroup(dealt(asked, 1, "q", "r").groupBy(*keys)).applyInArrow(meet, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query with their rank; a query has as many rows as chunks gave it some."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _others(asked: DataFrame, bounds: DataFrame, pivots: np.ndarray, radius: dict[int, float]) -> DataFrame:
    """(id, vec, cell): queries (id, vec, cell) once for each further cell that may hold a row within their bound (query, most)."""
    shared = asked.sparkSession.sparkContext.broadcast((pivots, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius = shared.value
        cells = np.array(sorted(radius))
        apart = np.sqrt(np.concatenate([d for _, d in squared(pivots, pivots)]))
        for batch in batches:
            if not batch.num_rows:
                continue
            d2 = np.concatenate([d for _, d in squared(_matrix(batch["vec"]), pivots)])
            own, most = batch["cell"].to_numpy(), np.sqrt(batch["most"].to_numpy(zero_copy_only=False))[:, None]
            slack = 1e-9 * (1 + np.where(np.isinf(most), 0.0, most) + np.sqrt(d2.max(axis=1))[:, None])  # of rounded roots
            ball = np.sqrt(d2[:, cells]) - np.array([radius[c] for c in cells])
            plane = (d2[:, cells] - d2[np.arange(len(own)), own][:, None]) / np.maximum(2 * apart[own][:, cells], 1e-300)
            keep = (np.maximum(ball, plane) <= most + slack) & (cells[None] != own[:, None])
            at, which = np.nonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at)), batch["vec"].take(pa.array(at)), pa.array(cells[which], pa.int32())], names=["id", "vec", "cell"])

    met = asked.join(bounds, asked["id"] == bounds["query"], "left").select("id", "vec", "cell", F.coalesce("most", F.lit(float("inf"))).alias("most"))
    return met.mapInArrow(run, "id long, vec array<double>, cell int")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 15, pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(query, id, distance, rank): the ``k`` rows (id, vec) nearest to each query (id, vec) by squared distance, the smaller id
    first on a tie; fewer, if there are fewer rows.  Ids differ within a table, and all vectors have one length.

    ``pivots`` is by default a quarter of the root of the number of rows, and one for up to ``chunk`` rows: then every
    query meets every row, chunk by chunk.  ``rows`` is read several times: keep it in a written form."""
    cast = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows, queries = cast(rows), cast(queries)
    if pivots is None:
        n = rows.count()
        pivots = 1 if n <= chunk else min(MOST_PIVOTS, math.isqrt(n) // 4)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect() if pivots > 1 else []
    if len(chosen) < 2:
        one = lambda df: df.withColumn("cell", F.lit(0))
        return _ranked(_pairs(one(rows), one(queries), k, chunk), k)
    centres = np.array([r.vec for r in chosen])
    placed, asked = written(_cells(rows, centres), "cells"), written(_cells(queries, centres), "queries")
    radius = {r.cell: r.far for r in placed.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    own = written(_ranked(_pairs(placed, asked, k, chunk), k), "own")
    bounds = own.where(F.col("rank") == k).select("query", F.col("distance").alias("most"))
    others = written(_others(asked, bounds, centres, radius), "others")
    return _ranked(own.drop("rank").unionByName(_pairs(placed, others, k, chunk)), k)
