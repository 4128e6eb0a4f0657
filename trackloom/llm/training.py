"""What the trained operators share: the held-out fold, bounded samples of labelled rows, and sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from all learning: crc32 of its id as text, modulo 5, is 0; a null id is kept out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(place, text, label) of at most ``rows`` documents with a label outside the held-out fold.

    Which ones is decided by a hash of doc_id.  Labels that are null are left out; of several for one id the largest
    counts; of several documents with one id one text is used.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    some = known.select(F.xxhash64("doc_id", F.lit(7)).alias("place"), F.col("doc_id").alias("id"), "label").orderBy("place", "id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(some), F.col("doc_id") == F.col("id")).groupBy("place", "id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("place", "text", "label")


def in_one_task(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], list[np.ndarray]], most_bytes: int) -> list[np.ndarray]:
    """Fit a model in one task on a bounded sample (place, text, label), in order of place.

    Reading stops when the texts together exceed ``most_bytes``.  ``fit`` gives arrays of floats, which come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, held = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column(1), batch.column(2), strict=True):
                if held <= most_bytes:
                    texts.append(text.as_py().encode())
                    labels.append(label.as_py())
                    held += len(texts[-1])
        for i, made in enumerate(fit(texts, np.array(labels))):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.asarray(made, np.float64).ravel()], pa.list_(pa.float64()))], names=["i", "made"])

    rows = sample.repartition(1).sortWithinPartitions("place").mapInArrow(run, "i int, made array<double>").collect()
    if not rows:  # Spark leaves out a task that has no input
        return [np.asarray(x, np.float64).ravel() for x in fit([], np.empty(0, np.int64))]
    return [np.array(r.made) for r in sorted(rows, key=lambda r: r.i)]


def totals(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of ``rows`` of a matrix that ``count`` makes of each: (buckets, columns).

    Each task sends one row a bucket that isn't zero; the driver gets the sums, whose size does not depend on the
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = count(batches)
        some = np.flatnonzero(made.any(axis=1))
        shape = np.full(len(some), made.shape[0]), np.full(len(some), made.shape[1])
        for column in range(0, made.shape[1], 8):
            part = made[some, column : column + 8]
            part = np.pad(part, ((0, 0), (0, 8 - part.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), column), pa.int32()), *[pa.array(x, pa.int32()) for x in shape], *[pa.array(np.ascontiguousarray(x), pa.float64()) for x in part.T]], names=["bucket", "at", "rows", "columns", *[f"x{i}" for i in range(8)]])

    sums = rows.mapInArrow(run, "bucket int, at int, rows int, columns int, " + ", ".join(f"x{i} double" for i in range(8))).groupBy("bucket", "at", "rows", "columns").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(8)]).collect()
    if not sums:
        return np.zeros((0, 0))
    out = np.zeros((sums[0]["rows"], -(-sums[0]["columns"] // 8) * 8))
    for r in sums:
        out[r["bucket"], r["at"] : r["at"] + 8] = r[4:]
    return out[:, : sums[0]["columns"]]
