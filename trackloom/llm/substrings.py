"""Passages that occur more than once, in other texts or in the same: seeds that are extended both ways.

Winnowing picks anchors, runs of ``SEED`` words, so that every run of ``least`` words has one of its own, picked from its own
words alone: two places with the same ``least`` words have the same anchor at the same place in them.  Anchors that occur
once can't be in a repeat.  The places of the others are matched in two steps, and in neither do pairs meet:

* A place's reach is what windows of ``least`` words around its anchor can cover.  Places that agree in all of it, both
  ways, are a class, counted before the shuffle; a class of several is a repeat as far as it reaches.
* Where an anchor has several classes, a repeat ends, or begins, within the reach.  One place of each class is extended
  step by step: one more word to the left and one less to the right, which are the windows around the anchor.  Windows that
  several classes have are repeats.

Runs of repeated windows are laid together to the maximal repeats of a text.  Anchors, classes and windows are told apart by
hashes of 64 bits each, windows and classes by two of these.  Texts are moved by a hash of id and text, twice, and never
meet those that they share a passage with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.store import keep
from trackloom.llm.text import NOT_SPACE, SAME, blobs, mix, pieces, power_tables, spans, word_hashes

LEAST, SEED = 35, 8
#: Rows with one key above which its rows are dealt over tasks, and keys up to which these are broadcast.
HOT_ROWS, MOST_BROADCAST = 100_000, 50_000
_SALTS = 64
_BLOCK = 1 << 16


def _runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words in [start, end)."""
    up, down = power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix(mix((total[ends] - total[starts]) * down[starts]) + (ends - starts).astype(np.uint64))


def picked(words: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``seed`` words from each place on, and for each window of ``least`` words the place of its anchor:
    the last of those with the smallest hash."""
    at = np.arange(max(0, len(words) - seed + 1))
    grams, wide = _runs(words, at, at + seed), least - seed + 1
    if len(grams) < wide:
        return grams, at[:0]
    out = []
    for k in range(0, len(grams) - wide + 1, _BLOCK):
        each = np.lib.stride_tricks.sliding_window_view(grams[k : k + _BLOCK + wide - 1], wide)
        out.append(k + np.arange(len(each)) + wide - 1 - each[:, ::-1].argmin(axis=1))
    return grams, np.concatenate(out)


def _seeds(batches: Iterator[pa.RecordBatch], least: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(anchor, reach, a, b, at) of the anchors of texts (text, a, b)."""
    far = least - seed
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for k, blob in enumerate(blobs(batch["text"])):
            words = word_hashes(blob, NOT_SPACE, SAME)
            if len(words) < least:
                continue
            grams, anchors = picked(words, least, seed)
            at = np.unique(anchors)
            low, high = np.maximum(at - far, 0), np.minimum(at + least, len(words))
            # how far a place reaches belongs to it: a text may end there
            reach = mix(_runs(words, low, high) + mix((at - low).astype(np.uint64)))
            for x, y in zip(out, (grams[at], reach, np.full(len(at), k), at), strict=True):
                x.append(y)
        if out[0]:
            anchor, reach, row, at = map(np.concatenate, out)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(reach.view(np.int64)), batch["a"].take(rows), batch["b"].take(rows), pa.array(at, pa.int32())], names=["anchor", "reach", "a", "b", "at"])


def _windows(batches: Iterator[pa.RecordBatch], least: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(anchor, window, a, b, at, alone) of the windows whose anchor is one of ``places`` (at, alone)."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        places = batch["places"].to_pylist()
        for k, blob in enumerate(blobs(batch["text"])):
            words = word_hashes(blob, NOT_SPACE, SAME)
            grams, anchors = picked(words, least, seed)
            own = np.zeros(len(words), np.int8)
            for p in places[k]:
                own[p["at"]] = 1 + p["alone"]
            at = np.flatnonzero(own[anchors] > 0)
            for x, y in zip(out, (grams[anchors[at]], _runs(words, at, at + least), np.full(len(at), k), at, own[anchors[at]] > 1), strict=True):
                x.append(y)
        if out[0]:
            anchor, window, row, at, alone = map(np.concatenate, out)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(window.view(np.int64)), batch["a"].take(rows), batch["b"].take(rows), pa.array(at, pa.int32()), pa.array(alone)], names=["anchor", "window", "a", "b", "at", "alone"])


def _united(ranges: list[list[int]], n: int) -> list[list[int]]:
    """Ranges [from, to) laid together where they touch, within [0, n)."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a), min(b, n)) for a, b in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without(blob: bytes, ranges: Sequence[Sequence[int]]) -> Iterator[bytes]:
    """The words of a text outside of ``ranges`` of word numbers, with a space behind each but the last, in pieces."""
    before, begun = 0, False
    for _, piece in pieces(blob, NOT_SPACE):
        starts, ends = spans(piece, NOT_SPACE)
        edges = np.zeros(len(starts) + 1, np.int64)
        for a, b in ranges:
            a, b = max(a - before, 0), min(b - before, len(starts))
            if a < b:
                edges[a] += 1
                edges[b] -= 1
        left = np.cumsum(edges)[:-1] == 0
        before += len(starts)
        if not left.any():
            continue
        marks = np.zeros(len(piece) + 2, np.int64)
        np.add.at(marks, starts[left], 1)
        np.add.at(marks, ends[left] + 1, -1)  # with the byte behind the word, which is white space or nothing
        line = np.append(np.where(NOT_SPACE[piece], piece, 0x20).astype(np.uint8), np.uint8(0x20))
        text = line[np.cumsum(marks)[: len(line)] > 0].tobytes()[:-1]
        yield b" " + text if begun else text
        begun = True


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], text: bool) -> Iterator[pa.RecordBatch]:
    """Columns ``names``, and n_words, repeats and what is left: its hash, or the text."""
    for batch in batches:
        n_words, repeats, left = [], [], []
        found = batch["found"].to_pylist()
        for k, blob in enumerate(blobs(batch["text"])):
            n = sum(len(spans(piece, NOT_SPACE)[0]) for _, piece in pieces(blob, NOT_SPACE))
            ranges = _united([[r["from"], r["to"]] for r in found[k] or []], n)
            n_words.append(n)
            repeats.append([{"from": a, "to": b} for a, b in ranges])
            if text:
                left.append(b"".join(without(blob, ranges)).decode())
            else:
                digest = hashlib.sha256()
                for x in without(blob, ranges):
                    digest.update(x)
                left.append(digest.hexdigest())
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(n_words, pa.int64()), pa.array(repeats, kind), pa.array(left, pa.string())], names=[*names, "n_words", "repeats", "left"])


def met(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``left`` and the row of ``right`` with the same keys.  ``right`` has a row a key, with the count of rows of left in the
    column ``n``; keys with many are joined apart, broadcast while they are few, else with left's rows dealt over salts."""
    hot = right.where(F.col(n) > HOT_ROWS)
    many = hot.count()
    if not many:
        return left.join(right, keys)
    cold = left.join(right.where(F.col(n) <= HOT_ROWS), keys)
    if many <= MOST_BROADCAST:
        return cold.unionByName(left.join(F.broadcast(hot), keys))
    salted = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return cold.unionByName(left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(_SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt"))


def repeated(texts: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(a, b, found: array of (from, to)) of texts (text, a, b) with windows of ``least`` words that start anywhere else, too.

    The ranges cover all words of such windows and no others; they may overlap, and go past a text's ends.  Rows equal in
    a and b are rows of one text, each a place of its own."""
    seeds = keep(texts.mapInArrow(lambda b: _seeds(b, least, seed), "anchor long, reach long, a long, b long, at int"), "seeds")
    classes = keep(seeds.groupBy("anchor", "reach").agg(F.count("*").alias("n")), "classes")
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.count_if(F.col("n") == 1).alias("alone"))
    # anchors of several classes, with places that agree with no other in all of their reach
    split = keep(anchors.where("classes > 1 AND alone > 0").select("anchor", "classes"), "split")
    opened = met(classes, split, ["anchor"], "classes").select("anchor", "reach", "n", F.lit(True).alias("split"))
    # classes that are neither repeats nor split are a single place each, and go
    several = classes.where("n > 1").select("anchor", "reach", "n", F.lit(False).alias("split"))
    asked = keep(opened.unionByName(several).groupBy("anchor", "reach").agg(F.max("n").alias("n"), F.max("split").alias("split")), "asked")
    places = keep(met(seeds, asked, ["anchor", "reach"], "n"), "places")
    whole = places.where("n > 1").select("a", "b", (F.col("at") - (least - seed)).alias("from"), (F.col("at") + least).alias("to"))
    first = places.where("split AND n > 1").groupBy("anchor", "reach").agg(F.min(F.struct("a", "b", "at")).alias("p")).select("p.*", F.lit(False).alias("alone"))
    some = first.unionByName(places.where("split AND n = 1").select("a", "b", "at", F.lit(True).alias("alone")))
    ends = some.groupBy("a", "b").agg(F.collect_list(F.struct("at", "alone")).alias("places"))
    made = texts.join(ends, ["a", "b"]).select("text", "a", "b", "places")
    windows = keep(made.mapInArrow(lambda b: _windows(b, least, seed), "anchor long, window long, a long, b long, at int, alone boolean"), "windows")
    shared = windows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.max("alone").alias("some")).where("n > 1 AND some").select("anchor", "window", "n")
    edges = met(windows.where("alone"), keep(shared, "shared"), ["anchor", "window"], "n").select("a", "b", F.col("at").alias("from"), (F.col("at") + least).alias("to"))
    return keep(whole.unionByName(edges).groupBy("a", "b").agg(F.collect_list(F.struct("from", "to")).alias("found")), "found")


def _addressed(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(text, a, b, c0, ...): texts with an address of 128 bits, from id and text, that scans agree on, and ``columns``."""
    text = docs["text"].cast("string")
    return docs.select(text.alias("text"), F.xxhash64(docs["doc_id"], text).alias("a"), F.xxhash64(text, F.lit(1), docs["doc_id"]).alias("b"), *[docs[c].alias(f"c{i}") for i, c in enumerate(columns)])


def _deduplicated(docs: DataFrame, columns: Sequence[str], least: int, seed: int, text: bool) -> DataFrame:
    rows = _addressed(docs, columns)
    found = repeated(rows.select("text", "a", "b"), least, seed)
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    both = rows.join(found, ["a", "b"], "left").select("text", "found", *names)
    return both.mapInArrow(lambda b: _cut(b, names, text), schema + ", n_words long, repeats array<struct<from: long, to: long>>, left string")


def report(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: words within a repeated window of ``least`` words go.

    Null and empty texts have no words; repeated rows and equal texts of ``least`` words or more repeat each other and go
    whole; texts of fewer words stay.  No rows give no rows."""
    made = _deduplicated(docs, ["doc_id"], least, seed, False)
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return made.select(F.col("c0").alias("doc_id"), "n_words", removed.alias("n_removed"), F.col("left").alias("kept_sha256"))


def deduplicated(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, with text less its repeats and, in a column repeats (with underscores behind a name that
    ``docs`` has), the maximal runs [from, to) of words that went.  A text that keeps all its words stays as it is; else
    what is left has single spaces.  A null text stays null."""
    made = _deduplicated(docs, docs.columns, least, seed, True)
    name = "repeats"
    while name in docs.columns:
        name += "_"
    own = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    cut = F.when(F.size("repeats") > 0, F.col("left")).otherwise(own["text"])
    return made.select(*[(cut if c == "text" else x).alias(c) for c, x in own.items()], F.col("repeats").alias(name))
