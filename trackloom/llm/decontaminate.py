"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a run of documents of one task.  All of its suffixes, as sequences of words, are sorted by doubling: ranks
by the first word, then by the first two, four and eight give the order by a window's words.  Every test suffix (each
window of a benchmark text) is found in each of these orders by binary search, and the shard is refined only while some
test suffix is still in it.  Where a window is found, the array gives all its verbatim occurrences; those that can't be
extended to the left are extended to the right as far as both texts agree, which gives the longest matches and their
locations.  All else is read off these: the words that windows hit are those of the matches, the items theirs.  Nothing
that knows the test set chooses which suffixes are sorted.

Benchmark texts are dealt into slices of at most ``slice_bytes`` by their place in a running sum (a longer single text
is a slice of its own).  Documents are read once and never shuffled; a task holds one slice at a time and takes all of
them over each batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.store import keep, summed_before
from trackloom.llm.text import ALNUM, blobs, doc_hashes, grouped

WINDOW, SLICE_BYTES = 10, 16 << 20
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 19
#: Pairs of a shard's place and a benchmark's that are looked at together; one place's pairs stay together.
PAIRS = 1 << 18

#: Stands between texts; no word has this hash, but for one chance in 2^64.
_GAP = np.zeros(1, np.uint64)

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_at", T.LongType()), T.StructField("doc_at", T.LongType()), T.StructField("n_words", T.LongType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH))])


class Found(NamedTuple):
    """Suffixes in the order of their first ``length`` words: how many different ones there are, the rank of each
    suffix of the shard, and that of each test suffix, -1 if the shard doesn't have it."""

    length: int
    n: int
    ranks: np.ndarray
    test: np.ndarray


def _looked_up(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in ``ordered`` by binary search, -1 where it doesn't have the value."""
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == x, at, -1).astype(np.int32) if len(ordered) else np.full(len(x), -1, np.int32)


def _first(words: np.ndarray, test: np.ndarray) -> Found:
    values, ranks = np.unique(words, return_inverse=True)
    return Found(1, len(values), ranks, np.where(test == _GAP, np.int32(-1), _looked_up(values, test)))


def _longer(a: Found, b: Found) -> Found:
    """The order by the words of ``a`` and behind them those of ``b``."""
    join = lambda x, y: x.astype(np.uint64) * np.uint64(b.n) + y.astype(np.uint64)
    pair = lambda x, y: (x[: max(0, len(y) - a.length)], y[a.length :][: len(x)])
    left, right = pair(a.ranks, b.ranks)
    values, ranks = np.unique(join(left, right), return_inverse=True)
    left, right = pair(a.test, b.test)
    some = np.flatnonzero((left >= 0) & (right >= 0))
    test = np.full(len(left), -1, np.int32)
    test[some] = _looked_up(values, join(left[some], right[some]))
    return Found(a.length + b.length, len(values), ranks, test)


class _Orders:
    """Orders of a shard's suffixes, made as they are asked for."""

    def __init__(self, words: np.ndarray, test: np.ndarray) -> None:
        self.doubled = [_first(words, test)]

    def by(self, length: int) -> Found | None:
        """The order by ``length`` words, or nothing if the shard has no test suffix that long."""
        out = None
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                while len(self.doubled) <= k:
                    if not (self.doubled[-1].test >= 0).any():
                        return None
                    self.doubled.append(_longer(self.doubled[-1], self.doubled[-1]))
                out = self.doubled[k] if out is None else _longer(out, self.doubled[k])
                if not (out.test >= 0).any():
                    return None
        return out


class Windows(NamedTuple):
    """The distinct windows of one length: a place of each, and all places of each in a row, from ``first`` on."""

    length: int
    some: np.ndarray
    first: np.ndarray
    places: np.ndarray


class Index:
    """One slice of the benchmark: its words with a gap before and behind each item, item names, and the windows."""

    def __init__(self, items: list[str], texts: list[bytes], window: int) -> None:
        each = [w for run in grouped(texts) for w in doc_hashes(run, ALNUM)]
        self.items = items
        self.words = np.concatenate([_GAP, *[x for w in each for x in (w, _GAP)]])
        sizes = np.array([len(w) for w in each], np.int64)
        starts = np.cumsum(sizes + 1) - sizes
        self.owner = np.repeat(np.arange(len(each) + 1), np.concatenate([sizes + 1, [1]]))  # of a word, behind its item's gap
        self.windows: list[Windows] = []
        orders = _Orders(self.words, self.words)
        lengths = np.minimum(sizes, window)
        for n in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == n)
            places = np.concatenate([starts[i] + np.arange(sizes[i] - n + 1) for i in own])
            order = orders.by(n).ranks[places]
            places = places[np.argsort(order, kind="stable")]
            _, first = np.unique(np.sort(order), return_index=True)
            self.windows.append(Windows(n, places[first], np.append(first, len(places)), places))

    def items_of(self, places: np.ndarray) -> np.ndarray:
        return self.owner[places]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [low, high), and which range each is of."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which], which


class _Shard:
    """The words of some documents, and what the benchmark has in common with them."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.docs: list[int] = []
        self.rows: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int, words: np.ndarray, out: dict) -> None:
        if self.held and self.held + len(words) > SHARD_WORDS:
            self.search(out)
        self.docs.append(doc)
        self.rows.append(words)
        self.held += len(words)

    def search(self, out: dict) -> None:
        """Adds each document's longest matches to its list in ``out``, and lets the documents go."""
        if self.held:
            words = np.concatenate([_GAP, *[x for w in self.rows for x in (w, _GAP)]])
            orders = _Orders(words, self.index.words)
            for w in self.index.windows:
                found = orders.by(w.length)
                ranks = found.test[w.some] if found else np.empty(0, np.int32)
                seen = np.flatnonzero(ranks >= 0)
                if not len(seen):
                    continue
                array = np.argsort(found.ranks, kind="stable")
                ordered = found.ranks[array]
                at, which = _ranges(*(np.searchsorted(ordered, ranks[seen], side) for side in ("left", "right")))
                self._longest(out, words, w, array[at], seen[which])
        self.docs, self.rows, self.held = [], [], 0

    def _longest(self, out: dict, words: np.ndarray, w: Windows, at: np.ndarray, window: np.ndarray) -> None:
        """The matches of windows at places of the shard that can be extended to neither side, in blocks of pairs of places."""
        test, index = self.index.words, self.index
        sizes = np.array([len(x) for x in self.rows])
        starts = np.cumsum(sizes + 1) - sizes
        owner = np.repeat(np.arange(len(sizes) + 1), np.concatenate([sizes + 1, [1]]))
        first = np.searchsorted(index.owner, np.arange(len(index.items))) + 1
        pairs = np.cumsum(w.first[window + 1] - w.first[window])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(pairs, np.arange(PAIRS, pairs[-1], PAIRS)), [len(at)]])) if len(pairs) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            place, which = _ranges(w.first[window[a:b]], w.first[window[a:b] + 1])
            i, j = at[a:b][which], w.places[place]
            left = (words[i - 1] != test[j - 1]) | (words[i - 1] == 0)
            i, j = i[left], j[left]
            n = np.full(len(i), w.length)
            more = np.arange(len(i))
            while len(more):
                x, y = words[i[more] + n[more]], test[j[more] + n[more]]
                more = more[(x == y) & (x != 0)]
                n[more] += 1
            d, item = owner[i], index.owner[j]
            for row in zip(d.tolist(), item.tolist(), (j - first[item]).tolist(), (i - starts[d]).tolist(), n.tolist(), strict=True):
                out.setdefault(self.docs[row[0]], []).append((index.items[row[1]], *row[2:]))


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan(batches: Iterator[pa.RecordBatch], slices: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """Columns: text, and what to pass on ..."""
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64()), ("n_words", pa.int64())])))])
    for batch in batches:
        sizes: list[int] = []
        found: dict[int, list] = {}
        for k, one in enumerate(slices):
            index, doc = one.value, 0
            shard = _Shard(index)
            for texts in grouped(blobs(batch.column(0))):
                for words in doc_hashes(texts, ALNUM):
                    shard.add(doc, words, found)
                    doc += 1
                    if not k:
                        sizes.append(len(words))
            shard.search(found)
            if len(slices) > 1:  # a worker holds one slice at a time, and reads it again from its disk
                one.__dict__.pop("_value", None)
        out = []
        for i, n in enumerate(sizes):
            matches = sorted({(at, item, item_at, length) for item, item_at, at, length in found.get(i, ())})
            out.append({"n_words": n, "hits": _union([[at, at + length] for at, _, _, length in matches]), "items": sorted({m[1] for m in matches}), "matches": [{"item_id": item, "item_at": item_at, "doc_at": at, "n_words": length} for at, item, item_at, length in matches]})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[f"c{i}" for i in range(batch.num_columns + 1)])


def _sliced(items: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """``items`` in parts of about ``slice_bytes``, by a running sum of their sizes, so that ids play no part."""
    size = (F.octet_length("text") + F.octet_length("item_id") + 32).cast("long")
    if (items.agg(F.sum(size)).first()[0] or 0) <= slice_bytes:
        return [items]
    sized = keep(items.withColumn("size", size).withColumn("nth", F.monotonically_increasing_id()), "benchmark")
    dealt = keep(summed_before(sized, [], "nth", "size", "before").withColumn("slice", F.floor(F.col("before") / slice_bytes)), "slices")
    return [dealt.where(F.col("slice") == r["slice"]).select(*items.columns) for r in dealt.select("slice").distinct().orderBy("slice").collect()]


def matched(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``columns`` of every row of ``docs`` (all by default) and a struct ``found`` with

    n_words; matches, the longest verbatim matches (item_id, item_at, doc_at, n_words) in order of doc_at; hits, the disjoint
    [start, end) word ranges that they cover; items, the sorted ids of their items.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.  A match holds at least one window: ``window``
    words of an item in a row, or the whole item if it is shorter.  Null and wordless texts have nothing; a null item_id
    is ''.  Repeated rows give a row each, items of one id and text one match a place; no rows give no rows, and an empty
    benchmark has no matches.  If ``docs`` has a column ``found``, underscores are put behind the new one's name.
    """
    columns = docs.columns if columns is None else columns
    name = "found"
    while name in columns:
        name += "_"
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slices = []
    for part in _sliced(items, slice_bytes):
        rows = part.collect()
        slices.append(docs.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text.encode() for r in rows], window)))
    work = docs.select(F.col("text").cast("string").alias("c0"), *[docs[c].alias(f"c{i + 1}") for i, c in enumerate(columns)])
    fields = work.schema.fields
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(f"c{len(fields)}", FOUND)])
    made = work.mapInArrow(lambda b: _scan(b, slices), schema)
    return made.select(*[F.col(f"c{i + 1}").alias(c) for i, c in enumerate(columns)], F.col(f"c{len(fields)}").alias(name))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at, longest_item) of every row of ``docs``; the
    last three are the words of its longest match, its place and its item (of several the first place, then the smallest
    id), or 0 and nulls.  Odd and repeated rows are as in ``matched``."""
    found = matched(docs, benchmark, ["doc_id"], window)
    hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    best = F.array_min(F.transform("found.matches", lambda m: F.struct((-m["n_words"]).alias("less"), m["doc_at"].alias("at"), m["item_id"].alias("item"))))
    return found.withColumn("best", best).select(
        "doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.matches") > 0).alias("contaminated"),
        F.coalesce(-F.col("best.less"), F.lit(0)).cast("long").alias("longest"), F.col("best.at").alias("longest_at"), F.col("best.item").alias("longest_item"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any match of the benchmark, with all their columns."""
    found = matched(docs, benchmark, None, window)
    return found.where(F.size(found[found.columns[-1]]["matches"]) == 0).select(*found.columns[:-1])
