"""Near-duplicate documents: MinHash bands, odd sketches, and confirmation on full shingle sets.

1. *Sketch* (one scan): each text's five-word shingles become MinHash samples.  Groups of ``rows`` samples make the
   ``bands``; all samples together are folded into an odd sketch, a parity bitmap in which every (position, value)
   pair flips one bit.  The population count of the XOR of two sketches estimates how many samples differ, which is
   precise at high similarity.  Shingles, and with them word sequences, are known by hashes of 64 bits.
2. *Copies*: texts with the same word sequence meet in an aggregation; one of them stands for all.
3. *Candidates*: texts that share a band are compared by their sketches where they lie.  Only a spanning forest of
   the pairs that look similar is written, so a bucket of m texts gives fewer than m rows.  Its components hold
   every pair that may be linked.
4. *Confirm*: within each such cluster the full shingle sets are compared exactly until every link is known to lie
   within one component or to be none.  Again less than one row a text is written.

A bucket or cluster that is larger than a chunk is first compared with one of its texts, and what is linked to that
one is near it; this is repeated with a text that is still open, a few times.  What stays open is compared with
everything in the group, chunk by chunk, each pair of chunks in its own task group.  So are texts near different
centres, unless a text near both links these, or one of the texts is further from the other's centre than two links
reach, by the triangle inequality of both distances.  A group of near copies so costs work in proportion to its size,
a group without such a centre more work, but never a larger task; none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.components import components
from trackloom.llm.store import keep
from trackloom.llm.text import NOT_SPACE, blobs, doc_hashes, grouped, mix, shingles

BANDS, ROWS, BITS, SEED = 42, 7, 512, 20_231
#: Pairs whose sketches differ in more bits are no candidates: that many mean a similarity of 0.70, and an estimate
#: from 294 samples is off by 0.15 less often than once in a million pairs.  For the default threshold; see _most_bits.
MOST_BITS = 128
#: Texts of a bucket, and shingles of a cluster, that one task group compares.
BUCKET_CHUNK, CLUSTER_CHUNK = 1024, 1 << 18
#: How many centres a larger group is compared with at most before its open texts are compared with all.
CENTRES = 4
#: Slots of the filter that spares texts outside all clusters a shuffle; at most 8 MB are broadcast at any size.
FILTER_SLOTS = 1 << 20

SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, odd binary"


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    return (made[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (made[n:] >> np.uint64(32)).astype(np.uint32)


def _samples(sets: list[np.ndarray], mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.full((len(sets), len(mul)), np.iinfo(np.uint32).max, np.uint32)
    for i, s in enumerate(sets):
        low = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(low), 1024):
            np.minimum(out[i], (low[None, at : at + 1024] * mul[:, None] + add[:, None]).min(axis=1), out=out[i])
    return out


def _sketches(samples: np.ndarray, bands: int, bits: int) -> tuple[np.ndarray, list[bytes]]:
    n, k = samples.shape
    wide = samples.astype(np.uint64)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    for part in wide.reshape(n, bands, k // bands).transpose(2, 0, 1):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    at = mix(wide + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    at += np.arange(n, dtype=np.uint64)[:, None] * np.uint64(bits)
    odd = (np.bincount(at.ravel().astype(np.int64), minlength=n * bits) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(n, bits), axis=1)
    return keys.view(np.int64), [x.tobytes() for x in packed]


def _longs(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def sketch(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands, odd) of every row; k1 and k2 name the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _coefficients(bands * rows)
        for batch in batches:
            at = 0
            for texts in grouped(blobs(batch.column(1))):
                words = doc_hashes(texts, NOT_SPACE)
                sets = [shingles(w, width) for w in words]
                keys, odd = _sketches(_samples(sets, mul, add), bands, bits)
                names = np.zeros((len(words), 2), np.uint64)
                for i, w in enumerate(words):
                    if len(w):
                        place = mix(np.arange(len(w), dtype=np.uint64))
                        names[i] = mix(w + place).sum(), mix(w ^ (place * np.uint64(3))).sum()
                names = names.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), _longs(keys), pa.array(odd, pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands", "odd"],
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


class _Forest:
    """Union-find over the rows of one task group."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each task group in turn; batches are sorted by their first ``keys`` long columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and tuple(names[:, at]) != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(at, end - at))
            last = tuple(names[:, at])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _alike(x: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows whose bitmaps differ in at most ``most`` bits, nearest first, block by block."""
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        apart = np.zeros((len(rows), len(right)), np.uint16)
        for w in range(x.shape[1]):
            apart += np.bitwise_count(x[rows, w][:, None] ^ x[right, w][None, :])
        apart[rows[:, None] >= right[None, :]] = most + 1
        i, j = np.nonzero(apart <= most)
        order = np.argsort(apart[i, j], kind="stable")
        yield rows[i[order]], right[j[order]]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    made = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], keys: int, most: int, exact=None) -> Iterator[pa.RecordBatch]:
    """Spanning links within each task group.  Columns: keys, side (0, 1, or 2 for a whole group), rid, odd, ..."""
    found: list[tuple[int, int]] = []
    for group in _runs(batches, keys):
        if group.num_rows < 2:
            continue
        side, rid = (group.column(keys + i).to_numpy(zero_copy_only=False) for i in (0, 1))
        x, forest = _bitmaps(group.column(keys + 2)), _Forest(len(rid))
        sets = [np.frombuffer(v, np.uint64) for v in group.column(keys + 3).to_pylist()] if exact else []
        whole = side[0] == 2
        left, right = (np.arange(len(rid)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        order = np.concatenate([left, right]) if not whole else left
        place = np.empty(len(rid), np.int64)
        place[order] = np.arange(len(rid))
        for i, j in _alike(x[order], place[left], place[right], most):
            for p, q in zip(order[i].tolist(), order[j].tolist(), strict=True):
                if rid[p] != rid[q] and forest.root(p) != forest.root(q) and (exact is None or exact(sets[p], sets[q])):
                    forest.join(p, q)
                    found.append((int(rid[p]), int(rid[q])))
        if len(found) > 10_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _centred(rows: DataFrame, chunk: int, test=None, most: int = MOST_BITS, wide=None) -> tuple[DataFrame, list[DataFrame]]:
    """Groups (key, rid, weight, odd, ...) that weigh more than ``chunk``, each compared with a few centres.

    Gives the rows with ``near`` and ``edge``, a bit for every centre that is linked to them and for every one that
    is no further than two links (``wide`` for the sets), and tables of the links (a, b)."""
    links: list[DataFrame] = []
    data = [c for c in rows.columns if c not in ("key", "rid", "weight")]
    rows = rows.withColumn("near", F.lit(0)).withColumn("edge", F.lit(0))
    schema = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", centre long"

    def run(batches: Iterator[pa.RecordBatch], bit: int) -> Iterator[pa.RecordBatch]:
        width = 3 + len(data)
        for batch in batches:
            near, edge = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            centre = batch.column(width + 2)
            some = np.flatnonzero(centre.is_valid().to_numpy(zero_copy_only=False))
            alike, close = np.zeros(len(centre), bool), np.zeros(len(centre), bool)
            if len(some):
                part = batch.take(pa.array(some))
                apart = np.bitwise_count(_bitmaps(part.column(3)) ^ _bitmaps(part.column(width + 3))).sum(axis=1)
                alike[some], close[some] = apart <= most, apart <= 2 * most
                if test:
                    mine, theirs = part.column(4), part.column(width + 4)
                    for i in np.flatnonzero(apart <= 2 * most).tolist():
                        s, t = (np.frombuffer(x[i].as_py(), np.uint64) for x in (mine, theirs))
                        alike[some[i]] &= test(s, t)
                        close[some[i]] = alike[some[i]] or wide(s, t)
            centre = pa.array(np.where(alike, centre.fill_null(0).to_numpy(zero_copy_only=False), 0), pa.int64(), mask=~alike)
            masks = [pa.array(np.where(x, y | bit, y).astype(np.int32)) for x, y in ((alike, near), (close, edge))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *masks, centre], names=[*batch.schema.names[: width + 2], "centre"])

    for k in range(CENTRES):
        still = keep(rows.where("near = 0").groupBy("key").agg(F.sum("weight").alias("w"), F.min("rid").alias("centre")).where(F.col("w") > chunk).drop("w"), "open")
        if still.isEmpty():
            break
        centres = rows.select("key", F.col("rid").alias("centre"), *[F.col(c).alias(f"centre_{c}") for c in data]).join(still, ["key", "centre"])
        rows = rows.join(centres, "key", "left").select("key", "rid", "weight", *data, "near", "edge", "centre", *[f"centre_{c}" for c in data])
        rows = keep(rows.mapInArrow(lambda b, bit=1 << k: run(b, bit), schema), "centred")
        links.append(rows.where("centre <> rid").select(F.col("rid").alias("a"), F.col("centre").alias("b")))
        rows = rows.drop("centre")
    return rows, links


def _pairs_of_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows (key, rid, weight, ..., near, edge) once for every pair of chunks of their group that their own chunk is
    in: key, ci, cj, side, rid, ...  Chunks of open rows meet each other and all others.  The centres of a group make
    homes, those that rows near several of them link; rows at the edge of another home meet the rows of that one
    that are at theirs."""
    home = F.col("near")
    for _ in range(CENTRES):
        home = F.aggregate("masks", home, lambda h, m: F.when(h.bitwiseAND(m) != 0, h.bitwiseOR(m)).otherwise(h))
    masks = rows.where("near <> 0").groupBy("key").agg(F.collect_set("near").alias("masks"))
    rows = rows.join(masks, "key", "left").withColumn("home", F.when(F.col("near") != 0, home).otherwise(0)).drop("masks")
    at_edge = (F.col("home") != 0) & (F.col("edge").bitwiseAND(F.bitwise_not("home")) != 0)
    # kinds of rows: 0 open, 1 near, 2 and up near and at an edge, one kind for each home by its first centre
    kind = F.when(F.col("home") == 0, 0).when(~at_edge, 1)
    for k in range(CENTRES):
        kind = kind.when(F.col("home").bitwiseAND(F.lit(1 << k)) != 0, 2 + k)
    rows = rows.withColumn("kind", kind)
    kinds = range(2 + CENTRES)
    weigh = lambda k: F.ceil(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0)) / chunk).cast("int")
    mask = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("home"))), F.lit(0))
    counts = rows.groupBy("key").agg(F.array(*[weigh(k) for k in kinds]).alias("n"), F.array(*[mask(k) for k in kinds]).alias("homes"))
    # a chunk's number counts those of the kinds before its own
    first = lambda k: F.aggregate(F.slice("n", 1, k), F.lit(0), lambda s, x: s + x)
    df = rows.join(counts, "key").withColumn("mine", (first(F.col("kind")) + F.pmod(F.xxhash64("rid"), F.greatest(F.get("n", F.col("kind")), F.lit(1)))).cast("int"))
    meets = lambda k: (F.col("kind") == 0) | (F.lit(k) == 0) | (F.col("kind") >= 2) & (F.lit(k) >= 2) & (F.col("kind") != k) & (F.col("edge").bitwiseAND(F.get("homes", F.lit(k))) != 0)
    others = F.concat(*[F.when(meets(k) & (F.get("n", F.lit(k)) > 0), F.sequence(first(F.lit(k)), first(F.lit(k + 1)) - 1)).otherwise(F.array().cast("array<int>")) for k in kinds])
    made = F.transform(
        others,
        lambda o: F.struct(F.least(o, F.col("mine")).alias("ci"), F.greatest(o, F.col("mine")).alias("cj"), F.when(o == F.col("mine"), 2).when(F.col("mine") < o, 0).otherwise(1).alias("side")),
    )
    own = ("key", "weight", "near", "edge", "home", "kind")
    return df.withColumn("p", F.explode(made)).select("key", F.col("p.ci").cast("long").alias("ci"), F.col("p.cj").cast("long").alias("cj"), F.col("p.side").cast("int").alias("side"), *[c for c in rows.columns if c not in own])


def _linked_within(rows: DataFrame, chunk: int, exact=None, most: int = MOST_BITS, wide=None) -> DataFrame:
    """(a, b): links that span the components of each group's linked rows (key, size, rid, weight, odd, ...); size is
    the weight of the whole group.  ``exact`` tests the sets of a link, ``wide`` whether two links can join them."""
    columns = [c for c in rows.columns if c != "size"]
    small, large = rows.where(F.col("size") <= chunk).select(*columns), rows.where(F.col("size") > chunk).select(*columns)
    large, links = _centred(large, chunk, exact, most, wide)
    one = small.select("key", F.lit(0).cast("long").alias("ci"), F.lit(0).cast("long").alias("cj"), F.lit(2).alias("side"), *[c for c in columns if c not in ("key", "weight")])
    groups = one.unionByName(_pairs_of_chunks(large, chunk))
    found = _by_group(groups).mapInArrow(lambda b: _compare(b, 3, most, exact), "a long, b long")
    for x in links:
        found = found.unionByName(x)
    return found


def _by_group(df: DataFrame) -> DataFrame:
    keys = df.columns[:3]
    return df.repartition(*keys).sortWithinPartitions(*keys)


def candidate_links(reps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b): links whose components hold every pair of texts (rid, bands, odd) that share a band and look alike."""
    banded = reps.select("rid", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = banded.join(full, "key").join(reps.select("rid", "odd"), "rid").select("key", "size", "rid", F.lit(1).cast("long").alias("weight"), "odd")
    return _linked_within(shared, BUCKET_CHUNK, None, most)


def _exact(threshold: tuple[int, int]):
    most, of = threshold

    def linked(s: np.ndarray, t: np.ndarray) -> bool:
        if len(s) > len(t):
            s, t = t, s
        if of * len(s) < most * len(t):
            return False
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        both = int((t[at] == s).sum())
        return of * both >= most * (len(s) + len(t) - both)

    return linked


def _most_bits(threshold: tuple[int, int], samples: int, bits: int = BITS, slack: float = 0.15) -> int:
    """The bits in which sketches of a similarity of ``slack`` below the threshold differ in the mean."""
    flips = 2 * samples * (1 - threshold[0] / threshold[1] + slack)
    return round(bits / 2 * (1 - (1 - 2 / bits) ** flips))


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_SLOTS)).cast("int")


def confirmed_links(docs: DataFrame, clusters: DataFrame, reps: DataFrame, width: int, threshold: tuple[int, int], most: int = MOST_BITS) -> DataFrame:
    """(a, b): links between texts whose full sets are similar enough, spanning every component of such links."""
    members = clusters.select(F.col("id").alias("rid"), F.col("component").alias("key")).join(reps.select("rid", "odd", F.col("n_shingles").alias("weight")), "rid")
    sizes = members.groupBy("key").agg(F.sum("weight").alias("size"))
    members = keep(members.join(sizes, "key").select("key", "size", "rid", "weight", "odd"), "members")
    slots = members.select(_slot("rid").alias("slot")).distinct()
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = wanted.withColumn("slot", _slot("doc_id")).join(F.broadcast(slots), "slot", "left_semi").drop("slot")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for texts in grouped(blobs(batch.column(5))):
                made += [shingles(w, width).tobytes() for w in doc_hashes(texts, NOT_SPACE)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary())], names=["key", "size", "rid", "weight", "odd", "set"])

    texts = members.join(wanted, members["rid"] == wanted["doc_id"]).select("key", "size", "rid", "weight", "odd", "text")
    held = texts.mapInArrow(sets, "key long, size long, rid long, weight long, odd binary, set binary").where(F.length("set") == 8 * F.col("weight"))
    return _linked_within(keep(held, "sets"), CLUSTER_CHUNK, _exact(threshold), most, _exact((2 * threshold[0] - threshold[1], threshold[1])))


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (85, 100), width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Two texts are linked when the intersection of their sets of distinct five-word shingles is at least
    ``threshold[0] / threshold[1]`` of the union.  A text of one to four words has one shingle, its whole sequence.
    A null or blank text has none and is its own component.  ``component_id`` is the smallest doc_id reachable over
    links, ``kept`` whether it is the row's own.  Repeated rows each give a row.  Rows with a null doc_id give rows,
    take part in no link between different texts and fall to the smallest doc_id with the same words, if any.
    Other columns of ``docs`` are not looked at.  A lower threshold needs shorter bands (fewer ``rows``).
    """
    most = _most_bits(threshold, bands * rows)
    made = keep(sketch(docs, width, bands, rows), "sketches")
    copies = keep(made.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rid")), "copies")
    named = copies.where("rid is not null")
    reps = keep(made.join(named, (made["doc_id"] == named["rid"]) & (made["k1"] == named["k1"]) & (made["k2"] == named["k2"])).select("rid", "n_shingles", made["k1"], made["k2"], "bands", "odd").dropDuplicates(["rid"]), "texts")
    clusters = components(keep(candidate_links(reps, most), "candidates"))
    found = components(keep(confirmed_links(docs, clusters, reps, width, threshold, most), "links"))
    classes = copies.join(found.withColumnRenamed("id", "rid"), "rid", "left").select("k1", "k2", F.coalesce("component", "rid").alias("component"))
    light = made.select("doc_id", "n_shingles", "k1", "k2")
    placed = light.where("n_shingles > 0").join(classes, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    blank = light.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, threshold: tuple[int, int] = (85, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of ``docs``, with all its columns, for each class of near-duplicates: that of the smallest doc_id.

    Rows equal in doc_id and text are one.  Blank texts are in no class, and all their rows stay; so do rows with a
    null doc_id, but for those equal in text.
    """
    kept = near_duplicates(docs, threshold, bands=bands, rows=rows).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    columns = docs.columns
    texts = docs.select(F.struct(*columns).alias("r"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(docs["text"]).alias("mark"), F.coalesce(F.length(F.trim(docs["text"])) > 0, F.lit(False)).alias("full"))
    own, lost = texts.where("own_id is not null"), texts.where("own_id is null")
    repeats = own.where("full").groupBy("own_id", "mark").count().where("count > 1")
    if not repeats.isEmpty():  # the first of each, with part of the work before the shuffle
        own = own.where("full").dropDuplicates(["own_id", "mark"]).unionByName(own.where("not full"))
    lost = lost.where("full").dropDuplicates(["mark"]).unionByName(lost.where("not full"))
    return own.join(kept, F.col("own_id") == F.col("kept_id"), "left_semi").unionByName(lost).select("r.*")
