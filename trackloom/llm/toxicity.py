"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of the words in it.  A document's is the noisy-or of its sentences': one
minus the product of what each leaves.  Only documents have labels; the gradient of the document's likelihood tells
each sentence its part.  A leak term (labels that no sentence explains) takes up label noise while learning and is
left out of the score, so that long clean documents stay clean.  Offending sentences are those with a high score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.text import ALNUM, LOWER, blobs, grouped, hashed, mix, pieces, spans
from trackloom.llm.training import held_out, in_one_task, labelled

#: Bounds of the labelled sample, words with a weight, and documents that a word must be in.
SAMPLE_ROWS, SAMPLE_BYTES, WORDS, LEAST_DOCS = 6000, 48 << 20, 2048, 3
MARGIN = 1.0
STEPS, RATE, DECAY = 200, 0.1, 2e-4

ENDS = np.zeros(256, bool)
ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


def _words(blob: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a text: its offset, word hashes, the sentence of each word, and ends of sentences."""
    for at, data in pieces(blob, ~ENDS):
        low = LOWER[data]
        starts, ends = spans(low, ALNUM)
        stops = np.flatnonzero(ENDS[data])
        yield at, hashed(low, starts, ends), np.searchsorted(stops, starts), stops


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their sentence (numbered through all texts), their text, and each sentence's text."""
    words, sentence, text, owner, n = [], [], [], [], 0
    for i, x in enumerate(texts):
        for _, w, s, _ in _words(x):
            own, s = np.unique(s, return_inverse=True)
            words.append(w)
            sentence.append(s + n)
            text.append(np.full(len(w), i))
            owner.append(np.full(len(own), i))
            n += len(own)
    cat = lambda x: np.concatenate([np.empty(0, np.int64), *x])
    return np.concatenate([np.empty(0, np.uint64), *words]), cat(sentence), cat(text), cat(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, words_kept: int = WORDS) -> list[np.ndarray]:
    """[bias], high and low halves of the words' hashes, weights.  Without both labels the bias alone tells the rarer from the commoner."""
    words, sentence, text, owner = _bags(texts)
    n, positive = len(texts), labels > 0
    base = positive.mean() if n else 0.0
    if not 0 < base < 1:
        return [np.array([30.0 if base else -30.0]), *[np.empty(0)] * 3]
    vocabulary, words = np.unique(words, return_inverse=True)
    # a sentence that copies repeat tells once, or the words of a copied text would seem to tell by themselves
    named = np.zeros(len(owner), np.uint64)
    np.add.at(named, sentence, mix(vocabulary)[words])
    first = np.zeros(len(owner), bool)
    first[np.unique(named, return_index=True)[1]] = True
    fresh = first[sentence]
    pairs = np.unique(words[fresh] * n + text[fresh])
    seen, told = np.bincount(pairs // n, minlength=len(vocabulary)), np.bincount(pairs // n, weights=positive[pairs % n], minlength=len(vocabulary))
    # the chance that a word which tells nothing is in that many toxic texts is at most exp(-evidence); a word is taken
    # where that is unlikely even for the best of all words
    share = np.clip(told / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    evidence = seen * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    evidence[(seen < LEAST_DOCS) | (share <= base)] = 0
    least = np.log(max(2, np.count_nonzero(seen >= LEAST_DOCS))) + MARGIN
    chosen = np.argsort(-evidence, kind="stable")[:words_kept]
    chosen = np.sort(chosen[evidence[chosen] >= least])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    some = place[words] >= 0
    feature, where = place[words[some]], sentence[some]
    weights, bias, leak = np.ones(len(chosen)), -6.0, np.log(base / (1 - base)) - 0.7
    x = np.concatenate([weights, [bias, leak]])
    first, second = np.zeros_like(x), np.zeros_like(x)
    balance = np.where(positive, 0.5 / base, 0.5 / (1 - base)) ** 0.5
    for step in range(1, STEPS + 1):
        p = _sigmoid(np.bincount(where, weights=x[:-2][feature], minlength=len(owner)) + x[-2])
        left = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        noise = _sigmoid(x[-1])
        clean = np.clip((1 - noise) * np.exp(left), 1e-12, 1 - 1e-12)
        # d log-likelihood / d log(clean)
        g = balance * np.where(positive, -clean / (1 - clean), 1.0)
        gs = g[owner] * -p
        grad = np.concatenate([np.bincount(feature, weights=gs[where], minlength=len(chosen)), [gs.sum(), (g * -noise).sum()]]) / n
        grad[:-2] -= DECAY * np.sign(x[:-2])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        x += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    kept = np.abs(x[:-2]) > 0.05
    names = vocabulary[chosen[kept]]
    return [x[-2:-1], names >> np.uint64(32), names & np.uint64(0xFFFFFFFF), x[:-2][kept]]


class Model:
    """The trained weights; also scores texts."""

    def __init__(self, bias: float, high: np.ndarray, low: np.ndarray, weights: np.ndarray) -> None:
        names = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        order = np.argsort(names)
        self.bias, self.names, self.weights = float(bias), names[order], weights[order].astype(np.float64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[names & np.uint64(0xFFFF)] = True

    def weight(self, words: np.ndarray) -> np.ndarray:
        """The weight of each word; a small table spares most words the search."""
        out = np.zeros(len(words))
        some = np.flatnonzero(self.maybe[words & np.uint64(0xFFFF)])
        if len(some):
            at = np.searchsorted(self.names, words[some])
            at[at == len(self.names)] = 0
            out[some] = np.where(self.names[at] == words[some], self.weights[at], 0)
        return out

    def score(self, blob: bytes, most: float) -> tuple[float, list[dict]]:
        """The noisy-or of the text's sentences, and the sentences that score at least ``most``."""
        left, found = 0.0, []
        for at, words, sentence, stops in _words(blob):
            if not len(words):
                continue
            own, s = np.unique(sentence, return_inverse=True)
            p = _sigmoid(np.bincount(s, weights=self.weight(words)) + self.bias)
            left += float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            for k in np.flatnonzero(p >= most):
                start = at + (int(stops[own[k] - 1]) + 1 if own[k] else 0)
                end = at + (int(stops[own[k]]) + 1 if own[k] < len(stops) else len(blob) - at)
                found.append({"sentence": blob[start:end].decode("utf-8", "replace").strip(), "score": float(p[k])})
        return min(1.0, max(0.0, -float(np.expm1(left)))), found


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, words_kept: int = WORDS) -> Model:
    """A model from at most ``rows`` labelled documents and ``most_bytes`` of text outside the held-out fold.

    At most ``words_kept`` words get a weight, those with the most evidence.  Null labels are left out, several labels
    of one id count as the largest; without both labels the model tells the commoner one."""
    bias, *words = in_one_task(labelled(docs, labels, "toxic", rows), lambda texts, y: fit(texts, y, words_kept), most_bytes)
    return Model(bias[0], *words)


def scored(docs: DataFrame, model: Model, columns: list[str] | None = None, most: float = 0.5) -> DataFrame:
    """``columns`` of every row of ``docs`` (all by default) and a struct ``toxicity`` (score, offending: array of
    (sentence, score)).  Null and wordless texts score 0.  A name that ``docs`` has gets underscores."""
    columns = docs.columns if columns is None else columns
    name = "toxicity"
    while name in columns:
        name += "_"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for run_ in grouped(blobs(batch.column(0))):
                made += [dict(zip(("score", "offending"), shared.value.score(x, most), strict=True)) for x in run_]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, kind)], names=[*batch.schema.names[1:], "made"])

    work = docs.select(F.col("text").cast("string").alias("t"), *[docs[c].alias(f"c{i}") for i, c in enumerate(columns)])
    from_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields[1:])
    out = work.mapInArrow(run, f"{from_ddl}, made struct<score: double, offending: array<struct<sentence: string, score: double>>>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("made").alias(name))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_offending) of every row of ``docs``; see ``scored``.

    Repeated rows give a row each, with equal scores; texts of any length are read whole, in pieces; no rows give no rows, and
    without labels every score is 0."""
    out = scored(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.offending").alias("n_offending"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns, as often as they repeat.

    Rows with a null or wordless text score 0 and stay, whatever their other columns hold; a null doc_id is never
    learned from.  No rows give no rows; without labels no row is rejected."""
    out = scored(docs, train(docs, labels))
    return out.where(out[out.columns[-1]]["score"] < 0.5).select(*out.columns[:-1])
