"""Additive trees over all rows of a table, by histograms that merge.

A model is grown level by level.  Each partition adds up its rows by node, feature and bin, the sums of all partitions are
added, and the best cut of a node is chosen from its merged histogram; only chosen cuts reach the driver.  Leaves of
quantile models take an exact order statistic: the leaf's residuals are counted in bins, and the bins that hold the rank are
counted anew, until what is left is short enough to be ranked.  Rows live in a written table; every few trees it is written
again with the forecasts so far, so that a pass follows few trees, and a lost executor costs no more than its tasks.

Where all rows fall into few combinations of bins, a tree is a matter of these: forecasts belong to combinations, one pass adds
up a tree's rows by them, and all levels are chosen from the sums.  There the rows of a combination lie together, in the order of
their target: which of them lie above a forecast or within a range is found by bisection, for all models of a draw.  A leaf's
order statistic is first bounded by counts of the target in each combination, so that two passes find it.

Everything that decides is a whole number: gradients and weights are cut to a fixed unit before they are added, and a row's
part in a tree comes from a hash of its key.  So the trees depend neither on the partitioning nor on who grows them: tables
of few rows are grown by one task a model, with the same functions and to the same trees.

The variants differ in settings alone: gradient boosting with rows drawn by weight; a second-order booster, which has the
weights in its loss and shrinks leaves; and forests, whose trees are models of one tree each.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.quantiles import percentiles
from trackloom.scratch import dropped, written

#: Rows of a table up to which one task grows a model; trees after which forecasts are written; residuals ranked at once.
ONE_TASK, WRITE_EVERY, RANKED = 200_000, 8, 1 << 14
#: Cells of the histograms that one task holds in a pass.
CELLS = 1 << 22
#: Combinations of bins up to which trees are grown by these; counts of targets by them that the driver holds.
COMBINED, COUNTED = 1 << 16, 1 << 20
#: Different values of a feature up to which its quantiles come from counts of values.
VALUES = 1 << 18
_BLOCK, _BITS, _RESIDUAL_BINS = 1 << 16, 30, 256
#: Rows that a task puts in order at once; values in an array of these; rows that a pass takes at once.
ORDERED, _ARRAY, _PASS = 1 << 20, 512, 1 << 16


class Settings(NamedTuple):
    """``second``: weights weigh the loss instead of the draws.  ``bag``: rows are drawn with replacement, and every tree is
    of the target itself, as in a forest.  ``l2`` is added to the weight of a leaf."""

    rate: float = 0.08
    depth: int = 3
    least: float = 25
    bins: int = 32
    rows: float = 0.9
    columns: float = 0.9
    seed: int = 0
    l2: float = 0.0
    second: bool = False
    bag: bool = False


class Job(NamedTuple):
    """One model: the fold whose rows it must not see (by number), its target, weight and quantile, how many trees, a number
    for its draws, and what is known of its rows: their count, their weights' sum, and bounds of target and weight."""

    held: int
    target: int
    weight: int
    quantile: float | None
    trees: int
    draw: int
    n: int
    total: int
    low: float
    high: float
    shift: int


class Tree(NamedTuple):
    """Feature (-1: a leaf), cut and value of each node of a full binary tree in heap order."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    edges: list[np.ndarray]
    start: float
    rate: float
    trees: list[Tree]

    def coded(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.start)
        for tree in self.trees:
            out += self.rate * tree.value[leaves(codes, tree)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.coded(coded_values(x, self.edges))


class Forecasts:
    """Forecasts (row, model) of the models of a fold, whose bins are the same.  Where there are at most ``COMBINED`` combinations
    of bins, each is forecast once."""

    def __init__(self, models: Sequence[Model]) -> None:
        self.models, radix = models, [len(e) + 1 for e in models[0].edges]
        self.steps = np.cumprod([1, *radix[:-1]]) if math.prod(radix) <= COMBINED else None
        self.known = np.full((math.prod(radix) if self.steps is not None else 0, len(models)), np.nan)

    def of(self, x: np.ndarray) -> np.ndarray:
        codes = coded_values(x, self.models[0].edges)
        if self.steps is None:
            return np.stack([m.coded(codes) for m in self.models], axis=1)
        at = codes.astype(np.int64) @ self.steps
        fresh, first = np.unique(at, return_index=True) if np.isnan(self.known[at, 0]).any() else ([], [])
        if len(fresh):
            self.known[fresh] = np.stack([m.coded(codes[first]) for m in self.models], axis=1)
        return self.known[at]


def coded_values(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of features by their edges; a missing value is in bin 0."""
    out = np.empty(x.shape, np.int16)
    for f, (e, c) in enumerate(zip(edges, x.T, strict=True)):
        out[:, f] = np.searchsorted(e, c, side="right")
        out[np.isnan(c), f] = 0
    return out


def leaves(codes: np.ndarray, tree: Tree) -> np.ndarray:
    at = np.zeros(len(codes), np.int64)
    while True:
        moving = np.flatnonzero(tree.feature[at] >= 0)
        if not len(moving):
            return at
        node = at[moving]
        at[moving] = 2 * node + 1 + (codes[moving, tree.feature[node]] > tree.cut[node])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each number, by multiplications and shifts."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def salted(keys: np.ndarray, *salt: int) -> np.ndarray:
    for s in salt:
        keys = _mixed(keys ^ np.uint64((s * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))
    return keys


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) by keys (unsigned long) and salt."""
    return (_mixed(salted(keys, *salt)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Counts of a Poisson distribution at the probabilities ``u``."""
    out = np.zeros(len(u), np.int64)
    chance = np.exp(-mean)
    upto = chance.copy()
    while (more := (u >= upto) & (out < 63)).any():
        out += more
        chance = chance * mean / np.maximum(out, 1)
        upto = np.where(more, upto + chance, upto)
    return out


def whole_weight(w: np.ndarray, shift: int) -> np.ndarray:
    return np.floor(np.where(np.isnan(w), 0.0, w) * 2.0**shift).astype(np.int64)


def bagged(keys: np.ndarray, seed: int, draw: int, mean: float = 1.0) -> np.ndarray:
    """How often each row is in the bag of a forest's tree."""
    u = uniform(keys, seed, draw, 0)
    return poisson(u, np.full(len(u), mean))


def drawn(job: Job, settings: Settings, keys: np.ndarray, weight: np.ndarray | None, tree: int) -> np.ndarray:
    """How often each row takes part in a tree."""
    if settings.bag:
        return bagged(keys, settings.seed, job.draw, settings.rows)
    return drawn_by(job, settings, uniform(keys, settings.seed, job.draw, tree), weight)


def drawn_by(job: Job, settings: Settings, u: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """The same without a bag, by each row's number in [0, 1)."""
    if weight is None or settings.second:
        return (u < chance_of(job, settings)).astype(np.int64)
    return poisson(u, max(50.0, settings.rows * job.n) * whole_weight(weight, job.shift) / max(job.total, 1))


def chance_of(job: Job, settings: Settings) -> float:
    """Of a row whose weight doesn't matter: the same for all folds, but for small ones."""
    return max(settings.rows, 50.0 / max(job.n, 1))


def columns_of(job: Job, settings: Settings, features: int, tree: int) -> np.ndarray:
    random = np.random.default_rng([settings.seed, job.draw, tree])
    return np.sort(random.choice(features, min(features, max(3, int(settings.columns * features))), replace=False))


def unit_of(job: Job) -> float:
    """What a gradient of 1 is cut to: sums over all rows fit into a long."""
    bits = min(_BITS, 56 - job.n.bit_length())
    wide = max(job.high - job.low, 1e-30) if job.quantile is None else 1.0
    return 2.0 ** (math.ceil(math.log2(wide)) - bits)


def scales(job: Job, settings: Settings) -> tuple[float, float]:
    """What 1 in a cell's sum and in its weight stand for.  Weights in the loss have 20 bits."""
    if not settings.second:
        return unit_of(job), 1.0
    one = 2.0 ** (10 - job.shift) if job.weight >= 0 else 2.0**-20
    return unit_of(job) * 2.0**20 * one, one


class Batch(NamedTuple):
    """Rows as arrays: number of the fold, hash of the key, targets, weights, features, and forecasts so far, if any; and
    bins by held fold, if they are to be kept."""

    own: np.ndarray
    key: np.ndarray
    y: np.ndarray
    w: np.ndarray
    x: np.ndarray
    f: np.ndarray | None
    codes: dict[int, np.ndarray] | None = None

    def coded(self, g: Growing, held: int) -> np.ndarray:
        if self.codes is None:
            return coded_values(self.x, g.edges[held])
        if held not in self.codes:
            self.codes[held] = coded_values(self.x, g.edges[held])
        return self.codes[held]


class Growing(NamedTuple):
    """What a pass needs to know: the models, their edges by fold, starts, trees not yet in ``f``, and the tree that grows."""

    jobs: list[Job]
    settings: Settings
    edges: dict[int, list[np.ndarray]]
    starts: dict[int, float]
    since: dict[int, list[Tree]]
    now: dict[int, Tree]
    columns: dict[int, np.ndarray]
    tree: int
    level: int


class Rows(NamedTuple):
    """A model's training rows in a batch."""

    codes: np.ndarray
    y: np.ndarray
    f: np.ndarray
    key: np.ndarray
    weight: np.ndarray | None


def _rows(batch: Batch, g: Growing, models: Sequence[int]) -> Iterator[tuple[int, Rows]]:
    codes, held = None, None
    for m in models:
        job = g.jobs[m]
        own = (batch.own != job.held) & ~np.isnan(batch.y[:, job.target])
        own = slice(None) if own.all() else own
        if codes is None or held != job.held:  # models of a fold follow one another
            codes, held = batch.coded(g, job.held), job.held
        c = codes[own]
        f = np.full(len(c), g.starts.get(m, 0.0)) if batch.f is None else batch.f[own, m].copy()
        for tree in g.since.get(m, []):
            f += g.settings.rate * tree.value[leaves(c, tree)]
        yield m, Rows(c, batch.y[own, job.target], f, batch.key[own], batch.w[own, job.weight] if job.weight >= 0 else None)


def _parts(job: Job, settings: Settings, y: np.ndarray, f: np.ndarray, count: np.ndarray, share: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """What each row, drawn so often, adds to a cell's sum and weight; see ``_share``."""
    gradient = y - f if job.quantile is None else np.where(y > f, job.quantile, job.quantile - 1.0)
    if not settings.second:
        return np.rint(gradient / unit_of(job)) * count, count
    return np.rint(gradient * (share * 2.0**-20) / unit_of(job)) * count, count * share


def _share(job: Job, settings: Settings, weight: np.ndarray | None, rows: int) -> np.ndarray | None:
    """Weights in the loss, if they belong there."""
    if not settings.second:
        return None
    return whole_weight(weight, job.shift) >> 10 if weight is not None else np.full(rows, 1 << 20)


def _histograms(batch: Batch, g: Growing, models: Sequence[int], out: dict[int, np.ndarray]) -> None:
    """Adds to ``out`` each model's (node of the level, drawn feature, bin, sum or weight) over a batch."""
    first, nodes, width = 2**g.level - 1, 2**g.level, g.settings.bins
    for m, r in _rows(batch, g, models):
        job, columns = g.jobs[m], g.columns[m]
        at = leaves(r.codes, g.now[m]) - first
        weight = drawn(job, g.settings, r.key, r.weight, g.tree)
        some = np.flatnonzero((at >= 0) & (weight > 0))
        whole, weight = _parts(job, g.settings, r.y, r.f, weight, _share(job, g.settings, r.weight, len(r.y)))
        shape = (nodes, len(columns), width)
        held = out.setdefault(m, np.zeros((*shape, 2), np.int64))
        step = max(1, _BLOCK // len(columns))
        for k in range(0, len(some), step):
            rows = some[k : k + step]
            cell = (at[rows, None] * len(columns) + np.arange(len(columns))) * width + r.codes[rows][:, columns]
            for side, value in enumerate((whole, weight)):
                # a block's sums are exact in a double
                sums = np.bincount(cell.ravel(), np.repeat(value[rows].astype(np.float64), len(columns)), held[..., 0].size)
                held[..., side] += np.rint(sums).astype(np.int64).reshape(shape)


def chosen(cells: np.ndarray, columns: np.ndarray, job: Job, settings: Settings) -> tuple[int, int, list[int]]:
    """(feature or -1, cut, sums and weights of the left and right side, or of all) from a node's merged histogram
    (feature, bin, sum or weight); the first feature and bin of the largest gain."""
    unit, scale = scales(job, settings)
    sums, weights = np.cumsum(cells[:, :, 0], axis=1), np.cumsum(cells[:, :, 1], axis=1)
    s, n = int(sums[0, -1]), int(weights[0, -1])
    score = lambda a, b: (a * unit) ** 2 / np.maximum(b * scale + settings.l2, 1e-300)
    left, nl = sums[:, :-1], weights[:, :-1]
    fit = (nl * scale >= settings.least) & ((n - nl) * scale >= settings.least)
    gain = np.where(fit, score(left, nl) + score(s - left, n - nl), -np.inf)
    best = int(gain.argmax())
    if not fit.any() or gain.ravel()[best] <= score(s, n) + 1e-12:
        return -1, 0, [s, n]
    f, cut = divmod(best, gain.shape[1])
    sl, wl = int(left[f, cut]), int(nl[f, cut])
    return int(columns[f]), cut, [sl, wl, s - sl, n - wl]


def _value(job: Job, settings: Settings, s: int, n: int) -> float:
    unit, scale = scales(job, settings)
    return s * unit / (n * scale + settings.l2) if n else 0.0


def _residuals(batch: Batch, g: Growing, models: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for m, r in _rows(batch, g, models):
        yield m, leaves(r.codes, g.now[m]), r.y - r.f


def ranks(n: int, q: float) -> tuple[int, int, float]:
    """The two places among ``n`` sorted values that a quantile lies between, and how far from the first."""
    p = (n - 1) * q
    return math.floor(p), math.ceil(p), p - math.floor(p)


def between(low: float, high: float, part: float) -> float:
    return low + (high - low) * part


class Local:
    """All rows of one model, in one task."""

    def __init__(self, batch: Batch) -> None:
        self.batch = batch._replace(codes={})

    def splits(self, g: Growing, models: Sequence[int]) -> dict[tuple[int, int], tuple]:
        out: dict[int, np.ndarray] = {}
        _histograms(self.batch, g, models, out)
        return {(m, node): chosen(cells, g.columns[m], g.jobs[m], g.settings) for m, held in out.items() for node, cells in enumerate(held) if held[node, 0, :, 1].any()}

    def quantiles(self, g: Growing, models: Sequence[int]) -> dict[tuple[int, int], float]:
        out = {}
        for m, leaf, rest in _residuals(self.batch, g, models):
            for node in np.unique(leaf):
                v = rest[leaf == node]
                a, b, part = ranks(len(v), g.jobs[m].quantile)
                v = np.partition(v, [a, b])
                out[m, int(node)] = between(float(v[a]), float(v[b]), part)
        return out

    def grown(self, g: Growing) -> Growing:
        f = np.full((len(self.batch.own), len(g.jobs)), np.nan)
        for m, job in enumerate(g.jobs):
            f[:, m] = g.starts[m] if self.batch.f is None else self.batch.f[:, m]
            for tree in g.since.get(m, []):
                f[:, m] += g.settings.rate * tree.value[leaves(self.batch.coded(g, job.held), tree)]
        self.batch = self.batch._replace(f=f)
        return g._replace(since={})

    def close(self) -> None:
        pass


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for b in batches:
        if b.num_rows:
            flat = lambda c: b[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)  # noqa: E731, B023
            yield Batch(b["own"].to_numpy(), b["k"].to_numpy().view(np.uint64), flat("y"), flat("w"), flat("x"), flat("f") if "f" in b.schema.names else None)


def _cells(batches: Iterator[pa.RecordBatch], g: Growing, models: Sequence[int]) -> Iterator[pa.RecordBatch]:
    out: dict[int, np.ndarray] = {}
    for batch in _batches(batches):
        _histograms(batch, g, models, out)
    for m, held in out.items():
        node, feature, bins = np.nonzero(held[..., 1])
        if len(node):
            s, n = held[node, feature, bins].T
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), m), pa.int32()), *[pa.array(v, pa.int32()) for v in (node, feature, bins)], pa.array(np.ascontiguousarray(s)), pa.array(np.ascontiguousarray(n))], names=["m", "node", "feature", "bin", "s", "n"])


def _counts(batches: Iterator[pa.RecordBatch], g: Growing, models: Sequence[int], ranges: dict, single: bool) -> Iterator[pa.RecordBatch]:
    """Residuals within each leaf's range: counts and ends by bin, or, for a range that is ``single``, themselves."""
    for batch in _batches(batches):
        for m, leaf, rest in _residuals(batch, g, models):
            for node in np.unique(leaf):
                if (m, int(node)) not in ranges:
                    continue
                low, high = ranges[m, int(node)]
                v = rest[(leaf == node) & (rest >= low) & (rest <= high)]
                if single:
                    cut = (v, v, np.ones(len(v), np.int64), np.zeros(len(v), np.int64))
                else:
                    bins = np.minimum(((v - low) / max(high - low, 1e-300) * _RESIDUAL_BINS).astype(np.int64), _RESIDUAL_BINS - 1)
                    some, at, n = np.unique(bins, return_inverse=True, return_counts=True)
                    lows, highs = np.full(len(some), np.inf), np.full(len(some), -np.inf)
                    np.minimum.at(lows, at, v)
                    np.maximum.at(highs, at, v)
                    cut = (lows, highs, n, some)
                if len(cut[0]):
                    size = len(cut[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, m), pa.int32()), pa.array(np.full(size, node), pa.int32()), pa.array(cut[3], pa.int32()), pa.array(cut[0]), pa.array(cut[1]), pa.array(cut[2].astype(np.int64))], names=["m", "node", "bin", "low", "high", "n"])


_COUNTS = "m int, node int, bin int, low double, high double, n long"


class Spread:
    """Rows of all models, in a written table (own, k, y, w, x and, after some trees, f)."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def _sent(self, g: Growing):
        return self.rows.sparkSession.sparkContext.broadcast(g)

    def splits(self, g: Growing, models: Sequence[int]) -> dict[tuple[int, int], tuple]:
        """In passes of so many models that a task's histograms stay within ``CELLS``."""
        sent, out = self._sent(g), {}
        each = max(1, CELLS // max(2**g.level * len(g.columns[m]) * g.settings.bins for m in models))
        for k in range(0, len(models), each):
            out |= self._pass(sent, models[k : k + each])
        sent.unpersist()
        return out

    def _pass(self, sent, models: Sequence[int]) -> dict[tuple[int, int], tuple]:
        cells = self.rows.mapInArrow(lambda b: _cells(b, sent.value, models), "m int, node int, feature int, bin int, s long, n long")
        merged = cells.groupBy("m", "node", "feature", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

        def choose(key: tuple, t: pa.Table) -> pa.Table:
            g, m = sent.value, key[0].as_py()
            held = np.zeros((len(g.columns[m]), g.settings.bins, 2), np.int64)
            held[t["feature"].to_numpy(), t["bin"].to_numpy()] = np.stack([t["s"].to_numpy(), t["n"].to_numpy()], axis=1)
            feature, cut, sides = chosen(held, g.columns[m], g.jobs[m], g.settings)
            return pa.table({"m": pa.array([m], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "feature": pa.array([feature], pa.int32()), "cut": pa.array([cut], pa.int32()), "sides": pa.array([sides], pa.list_(pa.int64()))})

        best = merged.groupBy("m", "node").applyInArrow(choose, "m int, node int, feature int, cut int, sides array<long>")
        return {(r.m, r.node): (r.feature, r.cut, list(r.sides)) for r in best.collect()}

    def quantiles(self, g: Growing, models: Sequence[int]) -> dict[tuple[int, int], float]:
        sent, out, before = self._sent(g), {}, {}
        ranges, sizes = self._ranges(g, models)
        while ranges:
            counted = self._counted(sent, models, ranges, False)
            found = counted.groupBy("m", "node", "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow().to_pandas()
            below, found = found[found.bin < 0], found[found.bin >= 0]
            before |= {(int(m), int(node)): int(n) for m, node, n in zip(below.m, below.node, below.n, strict=True)}
            short, again = {}, {}
            for (m, node), part in found.groupby(["m", "node"]):
                part = part.sort_values("bin")
                sizes.setdefault((m, node), int(part.n.sum()))
                a, b, share = ranks(sizes[m, node], g.jobs[m].quantile)
                upto = before.get((m, node), 0) + part.n.cumsum().to_numpy()
                i, j = np.searchsorted(upto, [a, b], side="right")
                low, high, held = part.low.iloc[i], part.high.iloc[j], int(upto[j] - (upto[i] - part.n.iloc[i]))
                before[m, node] = int(upto[i] - part.n.iloc[i])
                if i == j and low == high:
                    out[m, node] = float(low)
                elif i != j and part.low.iloc[i] == part.high.iloc[i] and part.low.iloc[j] == part.high.iloc[j]:
                    out[m, node] = between(float(low), float(high), share)
                elif held <= RANKED:
                    short[m, node] = (low, high)
                else:
                    again[m, node] = (low, high)
            if short:
                values = self._counted(sent, models, short, True).select("m", "node", "low").toArrow().to_pandas()
                for (m, node), part in values.groupby(["m", "node"]):
                    a, b, share = ranks(sizes[m, node], g.jobs[m].quantile)
                    v = np.sort(part.low.to_numpy())
                    out[m, node] = between(float(v[a - before[m, node]]), float(v[b - before[m, node]]), share)
            ranges = again
        sent.unpersist()
        return out

    def _ranges(self, g: Growing, models: Sequence[int]) -> tuple[dict, dict]:
        """Ends that the asked residuals of each leaf lie between, and the leaves' sizes where they are known."""
        wide = {m: g.jobs[m].high - g.jobs[m].low for m in models}
        reach = {m: 4 * wide[m] + abs(g.jobs[m].high) + abs(g.jobs[m].low) + 1 for m in models}
        return {(m, node): (-reach[m], reach[m]) for m in models for node in range(len(g.now[m].feature)) if g.now[m].feature[node] < 0}, {}

    def _counted(self, sent, models: Sequence[int], ranges: dict, single: bool) -> DataFrame:
        return self.rows.mapInArrow(lambda b: _counts(b, sent.value, models, ranges, single), _COUNTS)

    def grown(self, g: Growing) -> Growing:
        """The rows with the forecasts of all trees so far, every ``WRITE_EVERY`` trees."""
        if (g.tree + 1) % WRITE_EVERY:
            return g
        sent, fields = self._sent(g), self.rows.schema.fields

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    local = Local(next(_batches(iter([b]))))
                    local.grown(sent.value)
                    f = pa.FixedSizeListArray.from_arrays(pa.array(local.batch.f.ravel()), local.batch.f.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*[b[x.name] for x in fields if x.name != "f"], f], names=[*[x.name for x in fields if x.name != "f"], "f"])

        schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in fields if x.name != "f") + ", f array<double>"
        old, self.rows = self.rows, written(self.rows.mapInArrow(add, schema), "forecasts")
        dropped(old)
        sent.unpersist()
        return g._replace(since={})

    def close(self) -> None:
        dropped(self.rows)


class Block(NamedTuple):
    """Rows of combinations of bins, each combination's in the order of the target: number of the target, fold and combination of
    each array, its first row and the one after its last; and by row the target, hash of the key, and weights."""

    target: np.ndarray
    own: np.ndarray
    cell: np.ndarray
    first: np.ndarray
    last: np.ndarray
    y: np.ndarray
    key: np.ndarray | None
    w: np.ndarray | None

    def of(self, job: Job) -> np.ndarray:
        """The arrays of a model's training rows."""
        return np.flatnonzero((self.target == job.target) & (self.own != job.held))


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Arrays of 8 bytes a value from each start on, as binary: moved whole, not by value."""
    offsets = (np.append(starts, len(values)) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(arrays: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another, and the arrays' lengths."""
    _, offsets, data = arrays.buffers()
    at = np.frombuffer(offsets, np.int32, len(arrays) + 1, arrays.offset * 4)
    n = int(at[-1] - at[0]) // 8
    return np.frombuffer(data, kind, n, int(at[0])) if n else np.empty(0, kind), np.diff(at) // 8


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Batches put together to ``_BLOCK`` rows or more, and cut to about ``_PASS`` rows."""

    def cut(some: list[pa.RecordBatch]) -> Iterator[Block]:
        t = pa.Table.from_batches(some).combine_chunks()
        plain = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        (y, size), has = _unpacked(t["y"].combine_chunks(), np.float64), t.schema.names
        target, own, cell, ends = plain("target"), plain("own"), plain("cell").astype(np.int64), np.cumsum(size, dtype=np.int64)
        key = _unpacked(t["k"].combine_chunks(), np.uint64)[0] if "k" in has else None
        w = _unpacked(t["w"].combine_chunks(), np.float64)[0].reshape(len(y), -1) if "w" in has else None
        at = 0
        while at < len(size):
            start = int(ends[at]) - int(size[at])
            to = max(at + 1, int(np.searchsorted(ends, start + _PASS, side="right")))
            rows = slice(start, int(ends[to - 1]))
            last = ends[at:to] - start
            yield Block(target[at:to], own[at:to], cell[at:to], last - size[at:to], last, y[rows], key[rows] if key is not None else None, w[rows] if w is not None else None)
            at = to

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b["y"].nbytes // 8
        if n >= _BLOCK:
            yield from cut(held)
            held, n = [], 0
    if held:
        yield from cut(held)


def _first(y: np.ndarray, first: np.ndarray, last: np.ndarray, passed) -> np.ndarray:
    """The first row of each range of rising ``y`` that has ``passed``, or the range's end."""
    at = first - 1
    for bit in reversed(range(int((last - first).max(initial=0)).bit_length())):
        to = at + (1 << bit)
        at = np.where((to < last) & ~passed(y[np.minimum(to, len(y) - 1)]), to, at)
    return at + 1


def _upto(values: np.ndarray) -> np.ndarray:
    """Sums of whole numbers before each place, and of all."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values.astype(np.int64, copy=False), out=out[1:])
    return out


def _cell_sums(batches: Iterator[pa.RecordBatch], jobs: list[Job], settings: Settings, tree: int, models: Sequence[int], forecasts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each model's (combination, sum, weight) over the rows drawn for a tree.  A draw serves all folds, and what its rows add on
    either side of a quantile is added up once for all of them."""
    size = len(next(iter(forecasts.values())))
    out = {m: np.zeros((size, 2), np.int64) for m in models}
    by_draw = sorted(models, key=lambda m: jobs[m].draw)
    means, asked = [m for m in by_draw if jobs[m].quantile is None], [m for m in by_draw if jobs[m].quantile is not None]
    alike = not any(jobs[m].weight >= 0 for m in models) or settings.second
    for b in _blocks(batches):
        seeded, kept, shares = salted(b.key, settings.seed), {}, {}

        def once(name: tuple, make):
            """Kept until the next draw."""
            if name not in kept:
                if kept and next(iter(kept))[0] != name[0]:
                    kept.clear()
                kept[name] = make()
            return kept[name]

        def count(job: Job) -> np.ndarray:
            if settings.bag:
                return once((job.draw,), lambda: bagged(b.key, settings.seed, job.draw, settings.rows))
            u = once((job.draw,), lambda: uniform(seeded, job.draw, tree))
            weight = b.w[:, job.weight] if job.weight >= 0 else None
            return once((job.draw, *((chance_of(job, settings),) if alike else job)), lambda: drawn_by(job, settings, u, weight))

        def share(job: Job) -> np.ndarray | None:
            if (job.weight, job.shift) not in shares:
                shares[job.weight, job.shift] = _share(job, settings, b.w[:, job.weight] if job.weight >= 0 else None, len(b.y))
            return shares[job.weight, job.shift]

        def sides(job: Job) -> list[np.ndarray]:
            """Sums up to each row, if it and those before were below or above the forecast, and of weights."""
            one = np.ones(1)
            below, n = _parts(job, settings, 0 * one, one, count(job), share(job))
            above, _ = _parts(job, settings, one, 0 * one, count(job), share(job))
            return [_upto(below), _upto(above), _upto(n)]

        for m in means:
            job, some = jobs[m], b.of(jobs[m])
            if len(some):
                f = np.repeat(forecasts[m][b.cell], b.last - b.first)
                parts = _parts(job, settings, b.y, f, count(job), share(job))
                for side, value in enumerate(parts):
                    np.add.at(out[m][:, side], b.cell[some], np.add.reduceat(value.astype(np.int64), b.first)[some])
        if asked:
            of = [b.of(jobs[m]) for m in asked]
            every, ends = np.concatenate(of), np.cumsum([0, *map(len, of)])
            f = np.concatenate([forecasts[m][b.cell[some]] for m, some in zip(asked, of, strict=True)])
            first, last = b.first[every], b.last[every]
            at = _first(b.y, first, last, lambda y: y > f)  # noqa: B023
            for m, some, i, j in zip(asked, of, ends[:-1], ends[1:], strict=True):
                if len(some):
                    job = jobs[m]
                    below, above, n = once((job.draw, job.quantile, unit_of(job), *((chance_of(job, settings),) if alike else job)), lambda job=job: sides(job))
                    p, a, z = at[i:j], first[i:j], last[i:j]
                    np.add.at(out[m][:, 0], b.cell[some], below[p] - below[a] + above[z] - above[p])
                    np.add.at(out[m][:, 1], b.cell[some], n[z] - n[a])
    for m, sums in out.items():
        some = np.flatnonzero(sums[:, 1])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), m), pa.int32()), pa.array(some, pa.int32()), pa.array(sums[some, 0]), pa.array(sums[some, 1])], names=["m", "cell", "s", "n"])


def _target_counts(batches: Iterator[pa.RecordBatch], low: np.ndarray, high: np.ndarray, bins: int) -> Iterator[pa.RecordBatch]:
    """Counts and ends of each target by fold, combination and bin between the combination's ends; ``at`` is their place in the
    array (target, fold, combination, bin)."""
    n, lows, highs = np.zeros(low.size * bins, np.int64), np.full(low.size * bins, np.inf), np.full(low.size * bins, -np.inf)
    for b in _blocks(batches):
        place = np.ravel_multi_index((b.target, b.own, b.cell), low.shape)
        group = np.repeat(place, b.last - b.first)
        a, z = low.ravel()[group], high.ravel()[group]
        at = group * bins + np.clip(np.nan_to_num((b.y - a) / np.maximum(z - a, 1e-300) * bins), 0, bins - 1).astype(np.int64)
        fresh = np.diff(at, prepend=-1) != 0
        fresh[b.first] = True
        first = np.flatnonzero(fresh)  # values rise within an array, and bins with them
        last = np.append(first[1:], len(at)) - 1
        np.add.at(n, at[first], last - first + 1)
        np.minimum.at(lows, at[first], b.y[first])
        np.maximum.at(highs, at[first], b.y[last])
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(lows[some]), pa.array(highs[some]), pa.array(n[some])], names=["at", "low", "high", "n"])


def _cell_counts(batches: Iterator[pa.RecordBatch], jobs: list[Job], models: Sequence[int], forecasts: dict[int, np.ndarray], leaf: dict[int, np.ndarray], ranges: dict, bins: int, single: bool) -> Iterator[pa.RecordBatch]:
    """As ``_counts``, with the residuals below a leaf's range counted as bin -1.  Leaves are numbered through the models."""
    nodes = max(int(x.max()) for x in leaf.values()) + 1
    numbers = {m: i for i, m in enumerate(models)}
    low, high = np.full(len(models) * nodes, -np.inf), np.full(len(models) * nodes, -np.inf)
    for (m, node), (a, b) in ranges.items():
        if m in numbers and node < nodes:
            low[numbers[m] * nodes + node], high[numbers[m] * nodes + node] = a, b
    n, below = np.zeros(len(low) * bins, np.int64), np.zeros(len(low), np.int64)
    lows, highs = np.full(len(n), np.inf), np.full(len(n), -np.inf)

    def made(at: np.ndarray, bin: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(models)[at // nodes], pa.int32()), pa.array(at % nodes, pa.int32()), pa.array(bin, pa.int32()), pa.array(a), pa.array(b), pa.array(k)], names=["m", "node", "bin", "low", "high", "n"])

    for b in _blocks(batches):
        of = [b.of(jobs[m]) for m in models]
        every = np.concatenate(of)
        node = np.concatenate([i * nodes + leaf[m][b.cell[some]] for (i, m), some in zip(enumerate(models), of, strict=True)])
        f = np.concatenate([forecasts[m][b.cell[some]] for m, some in zip(models, of, strict=True)])
        first, last, least, most = b.first[every], b.last[every], low[node], high[node]
        start = _first(b.y, first, last, lambda y: y - f >= least)  # noqa: B023
        end = _first(b.y, start, last, lambda y: y - f > most)  # noqa: B023
        if not single:
            np.add.at(below, node, start - first)
        size = end - start
        rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        if not len(rows):
            continue
        v, at = b.y[rows] - np.repeat(f, size), np.repeat(node, size)
        if single:
            yield made(at, np.zeros(len(v), np.int64), v, v, np.ones(len(v), np.int64))
            continue
        at = at * bins + np.minimum(((v - low[at]) / np.maximum(high[at] - low[at], 1e-300) * bins).astype(np.int64), bins - 1)
        n += np.bincount(at, minlength=len(n))
        np.minimum.at(lows, at, v)
        np.maximum.at(highs, at, v)
    if not single:
        some, under = np.flatnonzero(n), np.flatnonzero(below)
        yield made(some // bins, some % bins, lows[some], highs[some], n[some])
        yield made(under, np.full(len(under), -1), np.zeros(len(under)), np.zeros(len(under)), below[under])


def ranked(v: np.ndarray, n: np.ndarray, rank: int) -> float:
    """The value at a rank among values that stand for ``n`` each: those of the bin that holds it are put in order."""
    low, high = float(v.min()), float(v.max())
    if 0 < high - low < np.inf:
        at = np.minimum((v - low) * (1024 / (high - low)), 1023).astype(np.int64)
        upto = np.cumsum(np.bincount(at, n, 1024).astype(np.int64))
        k = int(np.searchsorted(upto, rank, side="right"))
        v, n, rank = v[at == k], n[at == k], rank - (int(upto[k - 1]) if k else 0)
    order = np.argsort(v)
    return float(v[order[np.searchsorted(np.cumsum(n[order]), rank, side="right")]])


class Cells(Spread):
    """Rows of all models by combination of bins, in a written table (target, own, cell, low, high, and packed arrays y, k, w of rows
    whose targets rise from low to high).  The driver holds what combinations add up to, never rows."""

    def __init__(self, rows: DataFrame, jobs: list[Job], codes: dict[int, np.ndarray], folds: int, targets: int) -> None:
        super().__init__(rows)
        self.codes, self.size = codes, len(next(iter(codes.values())))
        self.forecasts: dict[int, np.ndarray] = {}
        self.sums: dict[int, tuple[np.ndarray, ...]] = {}
        self.entries: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        self.shared = None
        bins = min(64, COUNTED // (self.size * folds * targets))
        if bins and any(j.quantile is not None for j in jobs):
            groups = rows.select("target", "own", "cell", "y")
            ends = rows.groupBy("target", "own", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
            place = tuple(ends[c].to_numpy() for c in ("target", "own", "cell"))
            tops = np.zeros((2, targets, folds, self.size))
            tops[0][place], tops[1][place] = ends["low"].to_numpy(), ends["high"].to_numpy()
            sent = rows.sparkSession.sparkContext.broadcast(tops)
            counted = groups.mapInArrow(lambda b: _target_counts(b, *sent.value, bins), "at long, low double, high double, n long")
            found = counted.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
            sent.unpersist()
            at, low, high, n = (found[c].to_numpy() for c in ("at", "low", "high", "n"))
            t, own, cell, _ = np.unravel_index(at, (targets, folds, self.size, bins))
            for j in jobs:
                if (j.held, j.target) not in self.entries:
                    mine = (t == j.target) & (own != j.held)
                    self.entries[j.held, j.target] = cell[mine], low[mine], high[mine], n[mine]

    def _forecast(self, g: Growing, m: int) -> np.ndarray:
        return self.forecasts[m] if m in self.forecasts else np.full(self.size, g.starts.get(m, 0.0))

    def splits(self, g: Growing, models: Sequence[int]) -> dict[tuple[int, int], tuple]:
        if not g.level:
            self.sums = {}
            each = max(1, CELLS // 2 // self.size)
            for k in range(0, len(models), each):
                self._summed(g, list(models[k : k + each]))
        first, nodes, width, out = 2**g.level - 1, 2**g.level, g.settings.bins, {}
        for m in models:
            if m not in self.sums:
                continue
            cell, s, n = self.sums[m]
            codes, columns = self.codes[g.jobs[m].held][cell], g.columns[m]
            at = leaves(codes, g.now[m]) - first
            some = at >= 0
            place = ((at[some, None] * len(columns) + np.arange(len(columns))) * width + codes[some][:, columns]).ravel()
            held = np.zeros((nodes * len(columns) * width, 2), np.int64)
            for side, value in enumerate((s, n)):
                np.add.at(held[:, side], place, np.repeat(value[some], len(columns)))
            held = held.reshape(nodes, len(columns), width, 2)
            out |= {(m, node): chosen(cells, columns, g.jobs[m], g.settings) for node, cells in enumerate(held) if cells[0, :, 1].any()}
        return out

    def _summed(self, g: Growing, models: list[int]) -> None:
        jobs, settings, tree = g.jobs, g.settings, g.tree
        sent = self.rows.sparkSession.sparkContext.broadcast({m: self._forecast(g, m) for m in models})
        cells = self.rows.mapInArrow(lambda b: _cell_sums(b, jobs, settings, tree, models, sent.value), "m int, cell int, s long, n long")
        found = cells.groupBy("m", "cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
        sent.unpersist()
        of, *parts = (found[c].to_numpy() for c in ("m", "cell", "s", "n"))
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], [*models, models[-1] + 1])
        for m, a, b in zip(models, ends[:-1], ends[1:], strict=True):
            if b > a:
                self.sums[m] = tuple(p[order[a:b]] for p in parts)

    def _leaf(self, g: Growing, m: int) -> np.ndarray:
        return leaves(self.codes[g.jobs[m].held], g.now[m])

    def _ranges(self, g: Growing, models: Sequence[int]) -> tuple[dict, dict]:
        """A rank lies between those of the least and of the largest values that its residuals may have by the counts of targets."""
        if not self.entries:
            return super()._ranges(g, models)
        ranges, sizes = {}, {}
        for m in models:
            job = g.jobs[m]
            cell, low, high, n = self.entries[job.held, job.target]
            leaf, f = self._leaf(g, m)[cell], self._forecast(g, m)[cell]
            for node in np.unique(leaf):
                mine = np.flatnonzero(leaf == node)
                total = int(n[mine].sum())
                a, b, _ = ranks(total, job.quantile)
                ranges[m, int(node)], sizes[m, int(node)] = (ranked(low[mine] - f[mine], n[mine], a), ranked(high[mine] - f[mine], n[mine], b)), total
        return ranges, sizes

    def _counted(self, sent, models: Sequence[int], ranges: dict, single: bool) -> DataFrame:
        g, asked = sent.value, sorted({m for m, _ in ranges})
        jobs, bins = g.jobs, max(_RESIDUAL_BINS, min(512, (1 << 19) // max(1, len(asked) * len(g.now[asked[0]].feature))))
        if self.shared:
            self.shared.unpersist()
        shared = self.shared = self.rows.sparkSession.sparkContext.broadcast(({m: self._forecast(g, m) for m in asked}, {m: self._leaf(g, m) for m in asked}))
        return self.rows.select("target", "own", "cell", "y").mapInArrow(lambda b: _cell_counts(b, jobs, asked, *shared.value, ranges, bins, single), _COUNTS)

    def grown(self, g: Growing) -> Growing:
        for m, job in enumerate(g.jobs):
            f = self._forecast(g, m)
            for tree in g.since.get(m, []):
                f = f + g.settings.rate * tree.value[leaves(self.codes[job.held], tree)]
            self.forecasts[m] = f
        return g._replace(since={})


def combined(rows: DataFrame, jobs: list[Job], cuts: dict[int, list[np.ndarray]], folds: int, targets: int) -> Cells | None:
    """``rows`` by their combinations of bins of all folds, if these are at most ``COMBINED``."""
    edges = [np.unique(np.concatenate(e)) for e in zip(*cuts.values(), strict=True)]
    radix = [len(e) + 1 for e in edges]
    if math.prod(radix) >= 1 << 62 or COMBINED <= 0:
        return None
    steps = np.array([math.prod(radix[:i]) for i in range(len(radix))], np.int64)

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        x = np.stack([b[f"x{f}"].to_numpy(zero_copy_only=False) for f in range(len(edges))], axis=1)
        return coded_values(x, edges).astype(np.int64) @ steps

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.empty(0, np.int64)
        for b in batches:
            if b.num_rows and len(found) <= COMBINED:  # beyond, it is settled
                found = np.union1d(found, numbers(b))
        yield pa.RecordBatch.from_arrays([pa.array(found)], names=["cell"])

    if math.prod(radix) <= COMBINED:
        ids = np.arange(math.prod(radix))
    else:
        found = rows.select([f"x{f}" for f in range(len(edges))]).mapInArrow(different, "cell long").distinct().limit(COMBINED + 1).toArrow()
        if found.num_rows > COMBINED:
            return None
        ids = np.sort(found["cell"].to_numpy())

    weights = sum(c.startswith("w") for c in rows.columns)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                cell = np.searchsorted(ids, numbers(b))
                held.append([cell, *[b[c].to_numpy(zero_copy_only=False) for c in ("own", "k", *[f"y{t}" for t in range(targets)], *[f"w{i}" for i in range(weights)])]])
                n += b.num_rows
            if n >= ORDERED:
                yield from ordered([np.concatenate(c) for c in zip(*held, strict=True)])
                held, n = [], 0
        if held:
            yield from ordered([np.concatenate(c) for c in zip(*held, strict=True)])

    def ordered(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, own, key, *rest = columns
        group = own.astype(np.int64) * len(ids) + cell
        if folds * len(ids) <= 1 << 16:
            group = group.astype(np.uint16)  # put in order in one pass
        for t in range(targets):
            y = rest[t]
            order = np.argsort(y)
            order = order[: len(y) - int(np.isnan(y).sum())]  # unknown ones come last
            if not len(order):
                continue
            order = order[np.argsort(group[order], kind="stable")]
            g, first = group[order], np.zeros(len(order), bool)
            first[:1], first[1:] = True, g[1:] != g[:-1]
            start = np.flatnonzero(first)
            length = np.diff(np.append(start, len(order)))
            pieces = -(-length // _ARRAY)
            starts = np.repeat(start, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _ARRAY
            at, y, ends = order[starts], y[order], np.append(starts[1:], len(order)) - 1
            w = np.stack([rest[targets + i][order] for i in range(weights)], axis=1).astype(np.float64).ravel() if weights else np.empty(0)
            places = [pa.array(v, pa.int32()) for v in (np.full(len(at), t), own[at], cell[at])]
            arrays = [*places, pa.array(y[starts]), pa.array(y[ends]), _packed(y, starts), _packed(key[order], starts), _packed(w, starts * weights)]
            yield from pa.Table.from_arrays(arrays, names=["target", "own", "cell", "low", "high", "y", "k", "w"]).to_batches(max_chunksize=4096)

    made = written(rows.mapInArrow(placed, "target int, own int, cell int, low double, high double, y binary, k binary, w binary"), "combined")
    dropped(rows)
    parts = [ids // s % r for s, r in zip(steps, radix, strict=True)]
    # a bin of all edges lies above its lower edge, and so above as many edges of a fold as this
    code = lambda own, e, u: np.where(u > 0, np.searchsorted(own, e[np.maximum(u, 1) - 1], side="right") if len(e) else 0, 0)
    codes = {j: np.stack([code(own, e, u) for own, e, u in zip(cuts[j], edges, parts, strict=True)], axis=1).astype(np.int16) for j in cuts}
    return Cells(made, jobs, codes, folds, targets)


def grow(source: Local | Spread, jobs: list[Job], settings: Settings, edges: dict[int, list[np.ndarray]]) -> list[Model]:
    """The models of some jobs over a source of rows."""
    features = len(next(iter(edges.values()))) if edges else 0
    size = 2 ** (settings.depth + 1) - 1
    blank = lambda: Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
    g = Growing(jobs, settings, edges, {}, {}, {m: blank() for m in range(len(jobs))}, {}, -1, 0)
    asked = [m for m, j in enumerate(jobs) if j.quantile is not None]
    starts = {m: v for (m, _), v in source.quantiles(g, asked).items()} if asked else {}
    means = [m for m, j in enumerate(jobs) if j.quantile is None]
    middle = {m: (jobs[m].low + jobs[m].high) / 2 for m in means}
    starts |= middle
    if means and not settings.bag:  # the mean of all rows, without draws
        plain = settings._replace(rows=1.0, second=False, least=math.inf, l2=0.0)
        every = [j._replace(weight=-1, n=max(j.n, 50)) for j in jobs]
        found = source.splits(g._replace(jobs=every, settings=plain, starts=middle, columns={m: np.arange(1) for m in means}), means)
        starts |= {m: middle[m] + _value(every[m], plain, *sides) for (m, _), (_, _, sides) in found.items()}
    g = g._replace(starts={m: starts.get(m, 0.0) for m in range(len(jobs))})
    trees: list[list[Tree]] = [[] for _ in jobs]
    for t in range(max((j.trees for j in jobs), default=0)):
        live = [m for m, j in enumerate(jobs) if j.trees > t]
        now = {m: blank() for m in live}
        g = g._replace(now=now, tree=t, columns={m: columns_of(jobs[m], settings, features, t) for m in live})
        growing = live
        for level in range(settings.depth):
            found = source.splits(g._replace(level=level), growing)
            split = set()
            for (m, node), (feature, cut, sides) in found.items():
                at = 2**level - 1 + node
                if feature >= 0:
                    now[m].feature[at], now[m].cut[at] = feature, cut
                    now[m].value[2 * at + 1], now[m].value[2 * at + 2] = _value(jobs[m], settings, *sides[:2]), _value(jobs[m], settings, *sides[2:])
                    split.add(m)
                elif not at:
                    now[m].value[0] = _value(jobs[m], settings, *sides)
            growing = [m for m in growing if m in split]
            if not growing:
                break
        asked = [m for m in live if jobs[m].quantile is not None]
        for m in asked:
            now[m].value[:] = 0.0
        for (m, node), value in (source.quantiles(g, asked) if asked else {}).items():
            now[m].value[node] = value
        for m in live:
            trees[m].append(now[m])
        g = source.grown(g._replace(since={m: [*g.since.get(m, []), *([now[m]] if m in now else [])] for m in range(len(jobs))}))
    return [Model(edges[j.held], g.starts[m], settings.rate, trees[m]) for m, j in enumerate(jobs)]


def prepared(df: DataFrame, fold: str | None, folds: Sequence, key: str, features: Sequence[str], targets: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """(own, k, y0, .., w0, .., x0, ..) of the rows of the numbered ``folds``, written."""
    spark = df.sparkSession
    if fold is None:
        own = df.withColumn("own", F.lit(0))
    else:
        numbers = spark.createDataFrame([(f, i) for i, f in enumerate(folds)], f"_fold {dict(df.dtypes)[fold]}, own int")
        own = df.join(F.broadcast(numbers), df[fold].eqNullSafe(numbers["_fold"]))  # one row a fold of the driver's list
    numbered = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"{name}{i}") for name, cs in (("y", targets), ("w", weights), ("x", features)) for i, c in enumerate(cs)]
    return written(own.select(F.col("own").cast("int").alias("own"), F.xxhash64(key).alias("k"), *numbered), "rows")


def _as_arrays(rows: DataFrame) -> DataFrame:
    """(own, k, y, w, x) of ``prepared`` rows, numbered columns as arrays."""
    return rows.select("own", "k", *[F.array(*[c for c in rows.columns if c[0] == name]).cast("array<double>").alias(name) for name in "ywx"])


def trained(rows: DataFrame, held: Sequence[int], heads: Sequence[tuple], n_features: int, targets: int, weights: int, settings: Settings, one_task: int = ONE_TASK, together: int = 1) -> dict[tuple[int, int], Model]:
    """Models by (held fold, number of the head), each grown on all rows of ``rows`` (see ``prepared``) that are not of its
    held fold and whose target is known; none where there are no such rows.  A head is (target, weight or -1, quantile, trees).
    Tables of at most ``one_task`` rows are grown by a task for each ``together`` models of a fold."""
    y, w = [F.col(f"y{t}") for t in range(targets)], [F.col(f"w{i}") for i in range(weights)]
    seen = rows.groupBy("own").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}{t}") for t, c in enumerate(y) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))], *[F.max(c).alias(f"w{i}") for i, c in enumerate(w)]).collect()
    ends = lambda name, f, none: f([r[name] for r in seen if r[name] is not None], default=none)
    tops = [ends(f"w{i}", max, 1.0) for i in range(weights)]
    shift = [30 - math.ceil(math.log2(min(max(w, 1e-60), 1e60) if w > 0 else 1.0)) for w in tops]
    pairs = sorted({(t, i) for t, i, _, _ in heads if i >= 0})
    totals = {}
    if pairs:
        for r in rows.groupBy("own").agg(*[F.sum(F.when(y[t].isNotNull(), F.floor(F.coalesce(w[i], F.lit(0.0)) * 2.0 ** shift[i]))).alias(f"s{t}_{i}") for t, i in pairs]).collect():
            totals[r.own] = r
    jobs, which = [], []
    for j in held:
        for h, (t, i, q, trees) in enumerate(heads):
            others = [r for r in seen if r.own != j]
            if n := sum(r[f"n{t}"] for r in others):
                total = sum(totals[r.own][f"s{t}_{i}"] or 0 for r in others) if i >= 0 else 0
                jobs.append(Job(j, t, i, q, trees, h, n, total, ends(f"low{t}", min, 0.0), ends(f"high{t}", max, 0.0), shift[i] if i >= 0 else 0))
                which.append((j, h))
    if not jobs:
        return {}
    needed = sorted({j.held for j in jobs})
    cuts = edges_of(rows, needed, settings.bins, n_features)
    if sum(r.rows for r in seen) > one_task:
        folds = max(r.own for r in seen) + 1
        source = combined(rows, jobs, cuts, folds, targets) or Spread(_as_arrays(rows))
        models = grow(source, jobs, settings, cuts)
        source.close()
        return dict(zip(which, models, strict=True))
    sent = rows.sparkSession.sparkContext.broadcast((jobs, settings, cuts))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        jobs, settings, cuts = sent.value
        own = pdf["ms"].iloc[0]
        stack = lambda c: np.stack([np.asarray(v, np.float64) for v in pdf[c]]) if len(pdf[c].iloc[0]) else np.zeros((len(pdf), 0))
        batch = Batch(pdf["own"].to_numpy(), pdf["k"].to_numpy(np.int64).view(np.uint64), stack("y"), stack("w"), stack("x"), None)
        models = grow(Local(batch), [jobs[m] for m in own], settings, {jobs[own[0]].held: cuts[jobs[own[0]].held]})
        return pd.DataFrame({"m": own, "model": [pickle.dumps(x) for x in models]})

    tasks = [[m for m, (x, h) in enumerate(which) if x == j and h // together == c] for j in dict.fromkeys(x for x, _ in which) for c in sorted({h // together for x, h in which if x == j})]
    each = F.explode(F.array(*[F.struct(F.array(*map(F.lit, ms)).alias("ms"), F.lit(jobs[ms[0]].held).alias("held")) for ms in tasks])).alias("job")
    met = _as_arrays(rows).select("*", each).where(F.col("own") != F.col("job.held")).select("own", "k", "y", "w", "x", "job.ms")
    made = {which[r.m]: pickle.loads(r.model) for r in met.groupBy("ms").applyInPandas(train, "m int, model binary").collect()}
    dropped(rows)
    return made


def edges_of(rows: DataFrame, held: Sequence[int], bins: int, n_features: int) -> dict[int, list[np.ndarray]]:
    """The inner quantiles of each feature over the rows that are not of a held fold, each once.  Features of few values are counted
    by value, once for all folds."""
    inner, out = [i / bins for i in range(1, bins)], {}
    x = [f"x{f}" for f in range(n_features)]
    long = rows.select("own", F.posexplode(F.array(*x).cast("array<double>")).alias("feature", "v"))
    several = rows.agg(*[F.approx_count_distinct(c) for c in x]).first() if x else []
    counted = None
    if x and max(several) <= VALUES:
        counts = [rows.where(F.col(c).isNotNull()).groupBy("own", c).agg(F.count("*").alias("n")).select("own", F.lit(f).alias("feature"), F.col(c).alias("v"), "n") for f, c in enumerate(x)]
        counted = written(reduce(DataFrame.unionAll, counts), "values")
    for j in held:
        if counted is None:
            made = percentiles(long.where(F.col("own") != j), ["feature"], "v", inner)
        else:
            made = counted.where(F.col("own") != j).groupBy("feature").agg(F.percentile("v", F.array(*map(F.lit, inner)), F.col("n")).alias("p"))
        found = {r.feature: r.p for r in made.collect()}
        out[j] = [np.unique(np.array(found.get(f) or [], np.float64)) for f in range(n_features)]
    if counted is not None:
        dropped(counted)
    return out
