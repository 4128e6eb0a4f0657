"""Compression of vectors to codes of a product quantiser, with codebooks by Lloyd's rounds that filter through kd-trees.

Each vector becomes whole numbers and is cut into parts; every part's position has a codebook of its own.  In a round every
task builds kd-trees over its parts: a node knows the bounding box, the sum and the count of the parts below.  Going down,
an entry of the codebook is dropped at a node if another is at least as near to every point of its box; a node with one
entry left gives it the whole subtree, by its sum and count, and is not split any further.  All of this is in whole numbers,
so codebooks and codes depend neither on the partitioning nor on the order of rows.  Only sums and counts by entry leave
the tasks, and only codebooks, parts x entries x places of a part, go to the driver and to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.store import keep

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors over which a task builds its trees at once, and parts below which a node is not split.
TREE_ROWS, LEAF = 1 << 15, 8
#: Points x entries whose distances are held at once.
_BLOCK = 1 << 18
_SALTS = 32


def most(dims: int) -> int:
    """The largest magnitude of a whole component: with it, squared distances of ``dims`` components fit into a long."""
    return (1 << ((62 - max(dims - 1, 1).bit_length()) // 2 - 1)) - 1


def whole(vector: Column, limit: int, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, at most ``limit`` in magnitude."""
    low, high = F.lit(float(-limit)), F.lit(float(limit))
    return F.transform(vector, lambda x: F.greatest(low, F.least(high, F.floor(x.cast("double") * scale).cast("double"))).cast("long"))


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _left(low: np.ndarray, high: np.ndarray, alive: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which of the entries that are ``alive`` at each node may be nearest to a point of its box; of entries as near as
    each other, the first."""
    far = np.iinfo(np.int64).max
    out = np.empty_like(alive)
    size = (book**2).sum(axis=1)
    step = max(1, _BLOCK // book.size)
    for k in range(0, len(low), step):
        a, b, live = low[k : k + step, None], high[k : k + step, None], alive[k : k + step]
        middle = np.where(live, ((a + b - 2 * book[None]) ** 2).sum(axis=2), far).argmin(axis=1)
        u = book[None] - book[middle][:, None]
        # by how much an entry is farther than the middle's, at the corner where it gains most
        least = size[None] - size[middle][:, None] - 2 * np.maximum(a * u, b * u).sum(axis=2)
        out[k : k + step] = live & ~((least > 0) | ((least == 0) & (np.arange(len(book)) > middle[:, None])))
    return out


class Filtered:
    """The nearest entries of points, by a kd-tree that grows where a node's box still leaves several entries."""

    def __init__(self, points: np.ndarray, book: np.ndarray, leaf: int = LEAF) -> None:
        self.codes = np.zeros(len(points), np.int64)
        self.sums, self.counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        self.whole = 0  # points given away by subtree
        at, starts = np.arange(len(points)), np.zeros(min(1, len(points)), np.int64)
        alive = np.ones((len(starts), len(book)), bool)
        while len(at):
            x = points[at]
            n = np.diff(np.append(starts, len(at)))
            low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            alive = _left(low, high, alive, book)
            single = alive.sum(axis=1) == 1
            self._give(at[np.repeat(single, n)], np.repeat(alive[single].argmax(axis=1), n[single]), alive[single].argmax(axis=1), np.add.reduceat(x, starts)[single], n[single])
            open_rows = np.repeat(~single, n)
            at, x, n, alive, low, high = at[open_rows], x[open_rows], n[~single], alive[~single], low[~single], high[~single]
            if not len(at):
                return
            if n.max() <= leaf:
                self._by_point(at, x, np.repeat(alive, n, axis=0), book)
                return
            node = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((x[np.arange(len(x)), (high - low).argmax(axis=1)[node]], node))
            at = at[order]
            first = np.cumsum(n) - n
            starts, alive = np.stack([first, first + n // 2], axis=1).ravel(), np.repeat(alive, 2, axis=0)
            some = np.diff(np.append(starts, len(at))) > 0
            starts, alive = starts[some], alive[some]

    def _give(self, rows: np.ndarray, codes: np.ndarray, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        self.codes[rows] = codes
        self.whole += len(rows)
        np.add.at(self.sums, entries, sums)
        np.add.at(self.counts, entries, counts)

    def _by_point(self, at: np.ndarray, x: np.ndarray, alive: np.ndarray, book: np.ndarray) -> None:
        step = max(1, _BLOCK // book.size)
        for k in range(0, len(at), step):
            d = ((x[k : k + step, None] - book[None]) ** 2).sum(axis=2)
            code = np.where(alive[k : k + step], d, np.iinfo(np.int64).max).argmin(axis=1)
            self.codes[at[k : k + step]] = code
            np.add.at(self.sums, code, x[k : k + step])
            np.add.at(self.counts, code, 1)


def _held(batches: Iterator[pa.RecordBatch], rows: int = TREE_ROWS) -> Iterator[pa.Table]:
    """The rows of a task in tables of at most ``rows``."""
    run, n = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            if run and n + part.num_rows > rows:
                yield pa.Table.from_batches(run)
                run, n = [], 0
            run.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(run)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of ``dims`` whole numbers as rows."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.int64).reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, entries, width = books.shape
    sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
    for table in _held(batches):
        x = _matrix(table["v"], parts * width)
        for p in range(parts):
            made = Filtered(x[:, p * width : (p + 1) * width], books[p])
            sums[p] += made.sums
            counts[p] += made.counts
    p, e = np.nonzero(counts)
    if len(p):
        place = np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()), pa.array(place, pa.int32()), pa.array(sums[p, e].ravel(), pa.int64()), pa.array(np.repeat(counts[p, e], width), pa.int64())], names=["part", "entry", "place", "total", "n"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for table in _held(batches):
        x = _matrix(table["v"], parts * width)
        codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            own = x[:, p * width : (p + 1) * width]
            codes[:, p] = Filtered(own, books[p]).codes
            error += ((own - books[p][codes[:, p]]) ** 2).sum(axis=1)
        text = codes.tobytes().hex()
        names = [c for c in table.column_names if c != "v"]
        made = table.select(names).append_column("code", pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)])).append_column("error", pa.array(error))
        yield from made.combine_chunks().to_batches()


def _smallest(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (id, v) those of the ``entries`` smallest ids, the smallest vector of each."""
    held: dict = {}
    last = None
    for batch in batches:
        for k, i in enumerate(batch["id"].to_pylist()):
            if len(held) == entries and i > last:
                continue
            v = batch["v"][k].as_py()
            held[i] = min(held[i], v) if i in held else v
            if len(held) > entries:
                del held[max(held)]
            last = max(held)
    if held:
        yield pa.RecordBatch.from_pydict({"id": list(held), "v": list(held.values())}, schema=batch.select(["id", "v"]).schema)


def vectors(df: DataFrame, vector: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``df``'s usable rows with their whole components as v, and how many these are: the commonest length among positive
    multiples of ``parts``, the shorter of two as common.  Rows with null vectors, null or non-finite components or another
    length are dropped.  A table without any usable row has 0 components."""
    size = F.size(vector)
    fit = df.where(usable(F.col(vector)) & (size > 0) & (size % parts == 0))
    lengths = fit.groupBy(size.alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    dims = lengths["n"] if lengths else 0
    return fit.where(size == dims).withColumn("v", whole(F.col(vector), most(max(dims, 1)), scale)), dims


def trained(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, dims / parts) of ``rows`` (id, v).

    They start as the parts of the ``entries`` smallest ids (fewer, if there are fewer; null ids start none; of rows with one
    id the smallest vector).  In each round every row goes to its nearest entry, the first of several, and an entry becomes
    the floor of its rows' mean; one without rows stays."""
    width, spark = dims // parts if parts else 0, rows.sparkSession
    known = rows.where(F.col("id").isNotNull()).select("id", "v")
    kind = known.schema["id"].dataType.simpleString()
    few = known.mapInArrow(lambda b: _smallest(b, entries), f"id {kind}, v array<long>")
    start = few.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    books = np.array([r.v for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        shared = spark.sparkContext.broadcast(books)
        sums = rows.select("v").mapInArrow(lambda b, shared=shared: _sums(b, shared.value), "part int, entry int, place int, total long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r.place] = r.total // r.n
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (v, any others) with, for v, the code, two hex digits a part, and error, the squared distance to what the code
    stands for.  Without codebooks there are no rows to code."""
    if not books.size:
        return rows.drop("v").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).limit(0)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "v")
    return rows.mapInArrow(lambda b: _codes(b, shared.value), f"{schema}, code string, error long")


def restored(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for: each component the middle of the numbers that its entry's floor is of."""
    flat = F.lit([float(x) for x in ((books + 0.5) / scale).ravel()])
    entries, width = books.shape[1:]
    entry = lambda p: F.conv(F.substr(code, p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.slice(flat, (p * entries + entry(p)) * width + 1, F.lit(width))))


def books_digest(books: np.ndarray) -> str:
    """The SHA-256 of all components by part, entry and place, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row.

    Repeated rows are coded each.  A component of more than 2^19 or so in magnitude (``most``) is cut to that.
    An empty table gives an empty one."""
    rows, dims = vectors(embeddings.select("vec_id", "embedding", "label"))
    rows = rows.select(F.col("vec_id").alias("id"), "label", "v")
    books = trained(rows, dims)
    made = keep(coded(rows, books), "codes")
    # labels' sums meet their rows salted, since one label may hold most of them
    sums = made.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(_SALTS)).cast("int"))
    out = salted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
