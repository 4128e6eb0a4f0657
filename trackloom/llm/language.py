"""Language identification by nearest centroid.

A text's vector counts its letter n-grams (one to three bytes of UTF-8, hashed), dampened, weighted by inverse
document frequency and normalised.  Each language has several centroids, from spherical k-means over a bounded
sample of its texts.  The nearest centroid by cosine gives the language; a text that is further from it than nearly
all of the texts it was made of is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.store import keep
from trackloom.llm.text import LOWER, PIECE, blobs, grouped, mix
from trackloom.llm.training import held_out, totals

#: Bounds of the sample per language, n-gram buckets, centroids per language, and the share rejected in training.
SAMPLE_ROWS, SAMPLE_BYTES, BUCKETS, CENTROIDS, ROUNDS, REJECTED = 800, 16 << 20, 4096, 4, 12, 0.01
UNKNOWN = "und"
#: Rows (language, place, doc_id) of the sample that are broadcast; with more, the join is a shuffle.
MOST_BROADCAST = 100_000

#: a-z and bytes of non-ASCII characters; all else becomes a space
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def _grams(data: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram at each place, -1 where it is blank, begins with a second blank, or is longer than what is
    ``left`` of the place's text, for n = 1, 2, 3."""
    x = _LETTERS[LOWER[data]].astype(np.uint64)
    code = np.zeros(len(x), np.uint64)
    for n in (1, 2, 3):
        code = code[: len(x) - n + 1] * np.uint64(256) + x[n - 1 :] if len(x) >= n else code[:0]
        made = (mix(code + np.uint64(n << 32)) % np.uint64(BUCKETS)).astype(np.int64)
        first = x[: len(made)]
        blank = (first == 0x20) if n == 1 else (first == 0x20) & (x[1 : len(made) + 1] == 0x20)
        made[blank | (left[: len(made)] < n)] = -1
        yield made


def counts(texts: list[bytes]) -> np.ndarray:
    """(texts, buckets): n-gram counts of each text, from its own bytes alone."""
    out = np.zeros((len(texts), BUCKETS))
    if len(texts) > 1:
        sizes = np.array([len(x) for x in texts])
        ends = np.cumsum(sizes)
        data, cuts = np.frombuffer(b"".join(texts), np.uint8), ends[:-1]
        parts = ((i, part) for made in _grams(data, np.repeat(ends, sizes) - np.arange(len(data))) for i, part in enumerate(np.split(made, np.minimum(cuts, len(made)))))
    else:
        data = np.frombuffer(texts[0], np.uint8)
        # a piece holds the two bytes behind it, so that no n-gram is lost where the text is cut
        held = ((data[at : at + PIECE + 2], len(data) - at) for at in range(0, len(data), PIECE))
        parts = ((0, made[:PIECE]) for piece, left in held for made in _grams(piece, left - np.arange(len(piece))))
    for i, made in parts:
        out[i] += np.bincount(made + 1, minlength=BUCKETS + 1)[1:]
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """(buckets + 1, 1): in how many texts each n-gram is, and the number of texts."""
    out = np.zeros((BUCKETS + 1, 1))
    for batch in batches:
        for texts in grouped(blobs(batch.column(0))):
            out[:-1, 0] += (counts(texts) > 0).sum(axis=0)
            out[-1, 0] += len(texts)
    return out


def inverse_frequencies(learn: DataFrame) -> np.ndarray:
    sums = totals(learn.select(F.col("text").cast("string")), _frequencies)
    if not sums.size:
        return np.ones(BUCKETS)
    return np.log((1 + sums[-1, 0]) / (1 + sums[:-1, 0])) + 0.1


def clusters(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from mutually far starts: unit centroids, and per centroid the cosine of rejection."""
    chosen = [x.sum(axis=0)]
    chosen[0] /= max(np.linalg.norm(chosen[0]), 1e-12)
    for _ in range(min(k, len(x)) - 1):
        chosen.append(x[np.argmin(np.max(x @ np.stack(chosen).T, axis=1))])
    c = np.stack(chosen)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ c.T
    own = np.argmax(near, axis=1)
    least = np.array([np.quantile(near[own == i, i], REJECTED) if (own == i).any() else 1.0 for i in range(len(c))])
    return c, least


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], centroids: np.ndarray, least: np.ndarray) -> None:
        self.idf, self.names, self.centroids, self.least = idf, names, centroids, least

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        near = vectors(texts, self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        cosine = near[np.arange(len(best)), best]
        return [self.names[i] for i in best], np.clip(cosine, 0, 1), cosine < self.least[best]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from documents with a language outside the held-out fold: frequencies from all of them, centroids
    from at most ``rows`` of each language, in order of a hash of doc_id, and ``most_bytes`` of their text.

    Of rows with one doc_id and language one text is in the sample, the smallest; empty tables, and tables without a
    language, give a model that knows none."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    idf = inverse_frequencies(learn)
    # a uniform number of each id, and the bound below which there are somewhat more than ``rows`` ids of a language:
    # only those are ranked
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 11) / F.lit(float(1 << 53))
    bounds = keep(learn.groupBy(F.col("lang").alias("known")).agg((F.lit(1.5 * rows + 30) / F.approx_count_distinct("doc_id")).alias("bound")), "bounds")
    low = learn.select("doc_id", F.col("lang").alias("known"), place.alias("place")).join(bounds, "known").where(F.col("place") < F.col("bound")).groupBy("known", F.col("doc_id").alias("id")).agg(F.first("place").alias("place"))
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("known").orderBy("place", "id")))
    some = keep(ranked.where(F.col("rank") <= rows).drop("rank"), "sample")
    few = F.broadcast(some) if some.count() <= MOST_BROADCAST else some
    texts = learn.join(few, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("known"))).groupBy("known", "place", "id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate([vectors(run_, idf) for run_ in grouped(held)])
            c, least = clusters(x)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(list(c), pa.list_(pa.float64())), pa.array(least)], names=["lang", "centroid", "least"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and lang != name:
                    yield out()
                    held, size = [], 0
                name = lang
                if size <= most_bytes:
                    held.append(text.encode())
                    size += len(held[-1])
        if held:
            yield out()

    made = texts.repartition("known").sortWithinPartitions("known", "place").select("known", "text").mapInArrow(run, "lang string, centroid array<double>, least double").collect()
    made.sort(key=lambda r: (r.lang, r.centroid))
    return Model(idf, [r.lang for r in made], np.array([r.centroid for r in made]).reshape(-1, BUCKETS), np.array([r.least for r in made]))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of ``docs``.

    score is the cosine to the nearest centroid.  A null text, and one without a letter, is ``und`` with score 0 and
    rejected; so is every text if no language was learned.  A row's values depend on its own text alone, whole however
    long; repeated rows give a row each; of languages that are equally near the first in code-point order is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for texts in grouped(blobs(batch.column(1))):
                if model.names:
                    a, b, c = model.predict(texts)
                else:
                    a, b, c = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                for i, x in enumerate(texts):
                    if not has_letter(x.decode("utf-8", "replace")):
                        a[i], b[i], c[i] = UNKNOWN, 0.0, True
                langs += a
                scores.append(b)
                rejected.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate([np.empty(0), *scores])), pa.array(np.concatenate([np.empty(0, bool), *rejected]))], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs``."""
    out = identified(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
