"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Every token (run of letters and digits, or run of punctuation, case kept) is hashed into one of ``BUCKETS``, which has a
sparse random index vector; words that share a bucket share a vector, so more buckets tell more rare words apart.
A token's word vector is the sum of the index vectors of its neighbours within two places, over all documents.  A
document's features are the mean of its tokens' normalised word vectors and their spread.  A two-layer network in
numpy is trained on a bounded labelled sample, and one temperature, fitted on a part that training didn't see,
calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.text import ALNUM, NOT_SPACE, blobs, grouped, hashed, pieces, spans
from trackloom.llm.training import held_out, in_one_task, labelled, totals

SAMPLE_ROWS, SAMPLE_BYTES = 6000, 48 << 20
BUCKETS, DIMENSIONS, NONZERO, REACH = 16384, 32, 4, 2
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 32, 60, 3e-3, 1e-3, 128
THRESHOLD = 0.3

_LETTER = ALNUM.copy()
_LETTER[0x41:0x5B] = True
_MARK = NOT_SPACE & ~_LETTER


def index_vectors(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 3) -> np.ndarray:
    """Sparse random vectors: a few places of +1 and -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dimensions))
    for row in out:
        row[rng.choice(dimensions, NONZERO, replace=False)] = np.resize([1.0, -1.0], NONZERO)
    return out


def _tokens(texts: list[bytes]) -> list[np.ndarray]:
    """Token numbers of each text."""
    if len(texts) > 1:
        found = _numbers(np.frombuffer(b"\n".join(texts), np.uint8))
        return np.split(found[0], np.searchsorted(found[1], np.cumsum([len(x) + 1 for x in texts])[:-1]))
    return [np.concatenate([np.empty(0, np.int64), *[_numbers(p)[0] for _, p in pieces(texts[0], NOT_SPACE)]])]


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (s1, e1), (s2, e2) = spans(data, _LETTER), spans(data, _MARK)
    starts, ends = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(starts, kind="stable")
    return (hashed(data, starts[order], ends[order]) % np.uint64(BUCKETS)).astype(np.int64), starts[order]


def _contexts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """(buckets, dimensions + 1): sums of neighbours' index vectors, and counts."""
    index = index_vectors().astype(np.float32)
    out = np.zeros((BUCKETS, DIMENSIONS + 1))
    for batch in batches:
        for texts in grouped(blobs(batch.column(0))):
            for tokens, inner in _merged(_tokens(texts)):
                near = np.zeros((len(tokens), DIMENSIONS), np.float32)
                vectors = index[np.maximum(tokens, 0)] * (tokens >= 0)[:, None]
                for d in range(1, REACH + 1):
                    near[d:] += vectors[:-d]
                    near[:-d] += vectors[d:]
                tokens, near = tokens[inner], near[inner]
                real = tokens >= 0
                own = tokens[real]
                near = near[real]
                for k in range(DIMENSIONS):
                    out[:, k] += np.bincount(own, weights=near[:, k], minlength=BUCKETS)
                out[:, -1] += np.bincount(own, minlength=BUCKETS)
    return out


def _merged(each: list[np.ndarray], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, slice]]:
    """Rows of tokens and which of them to count, ``size`` at most; the others are their neighbours.  Texts are kept
    apart by places that hold no token."""
    gap = np.full(REACH, -1)
    run = np.concatenate([gap, *[x for tokens in each for x in (tokens, gap)]])
    for at in range(REACH, len(run) - REACH, size):
        yield run[at - REACH : at + size + REACH], slice(REACH, REACH + min(size, len(run) - REACH - at))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(buckets, dimensions): unit word vectors from all of ``docs``, less their common direction."""
    sums = totals(docs.select(F.col("text").cast("string")).where("text is not null"), _contexts)
    if not sums.size:
        return np.zeros((BUCKETS, DIMENSIONS))
    vectors, counts = sums[:, :-1], sums[:, -1]
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    unit -= (unit * counts[:, None]).sum(axis=0) / max(1.0, counts.sum())
    return unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9) * (counts > 0)[:, None]


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Per text: the mean of its tokens' vectors and their root mean square; zeros without tokens."""
    each = _tokens(texts)
    some, places = np.unique(np.concatenate(each), return_inverse=True)
    parts = np.split(places, np.cumsum([len(t) for t in each])[:-1])
    bags, own = np.stack([np.bincount(t, minlength=len(some)) for t in parts]).astype(np.float64), vectors[some]
    n = np.maximum(bags.sum(axis=1, keepdims=True), 1)
    return np.hstack([bags @ own / n, np.sqrt(bags @ own**2 / n)])


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty((0, 2 * vectors.shape[1])), *[pooled(run, vectors) for run in grouped(texts)]])


class Network:
    """tanh(x W1 + b1) W2 + b2 over a temperature."""

    SHAPES = ((2 * DIMENSIONS, HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,), (2 * DIMENSIONS,), (2 * DIMENSIONS,), (1,))

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.w1, self.b1, self.w2, self.b2, self.mean, self.scale, self.temperature = (p.reshape(s) for p, s in zip(parts, self.SHAPES, strict=True))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2)[:, 0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Weights, standardisation and temperature.  With one label or none, the share of label 1 alone speaks."""
    rng = np.random.default_rng(seed)
    share = min(1 - 1e-4, max(1e-4, y.mean())) if len(y) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.array([np.log(share / (1 - share))])]
    x = (x - mean) / scale
    own = rng.permutation(len(x))
    check, train = own[: len(x) // 5], own[len(x) // 5 :]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
    step = 0
    for _ in range(EPOCHS if 0 < y.sum() < len(y) else 0):
        train = rng.permutation(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            step += 1
            h = np.tanh(x[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3])[:, 0])) - y[rows])[:, None] / len(rows)
            back = g @ p[2].T * (1 - h**2)
            grads = [x[rows].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ g + DECAY * p[2], g.sum(axis=0)]
            for a, d, (m, v) in zip(p, grads, moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d**2 - v)
                a -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    temperature = 1.0
    if len(check):
        logits = (np.tanh(x[check] @ p[0] + p[1]) @ p[2] + p[3])[:, 0]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        temperature = float(grid[np.argmin([_loss(logits / t, y[check]) for t in grid])])
    return [*p, mean, scale, np.array([temperature])]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, and a network from at most ``rows`` labelled ones outside the held-out fold.

    Sums of index vectors are whole numbers, so neither the partitioning nor the order of rows changes a vector."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    parts = in_one_task(labelled(docs, labels, "quality", rows), lambda texts, y: fit_network(features(texts, shared.value), (y > 0).astype(float)), most_bytes)
    return vectors, Network(parts)


def scored(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of every row of ``docs``: the calibrated probability of good quality.

    A null text is empty, and an empty one has zeros for features.  A row's score depends on its own text alone, whole
    however long, and on the model; repeated rows give a row each.  No rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            made = [network.predict(pooled(texts, vectors)) for texts in grouped(blobs(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.empty(0), *made]))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    out = scored(docs, *train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
