"""Trees over all rows: the same from one task and from all, by their definition where that is short, and held-out errors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import boosting, learning

FEATURES = ["a", "b", "c"]
HEADS = [learning.Head("mean", "y", None, 10, "w"), learning.Head("q9", "y", 0.9, 9), learning.Head("other", "z", None, 4)]


def rows(n, seed=3):
    r = np.random.default_rng(seed)
    a, b, c = r.uniform(size=(3, n))
    y, z = 10 * (a > 0.5) + 3 * b + r.normal(0, 0.3, n), 5 * (c > 0.3) + r.normal(0, 0.1, n)
    some = lambda v, k: [None if i % k == 0 else float(x) for i, x in enumerate(v)]
    return list(zip([None if i % 4 == 3 else i % 4 for i in range(n)], range(n), some(a, 50), b.tolist(), np.round(c, 1).tolist(), some(y, 31), some(z, 7), r.uniform(0.1, 2, n).tolist(), strict=True))


def frame(spark, made, parts=4):
    return spark.createDataFrame(made, "f int, id long, a double, b double, c double, y double, z double, w double").repartition(parts)


def answers(made, names):
    return {r.id: tuple(r[n] for n in names) for r in made.collect()}


@pytest.fixture(scope="module")
def table():
    return rows(1500)


@pytest.mark.parametrize("settings", [{}, {"second": True, "l2": 1.0, "least": 1.0}], ids=["first order", "second order"])
def test_all_tasks_grow_the_trees_that_one_would(spark, monkeypatch, table, settings):
    """Also where forecasts are written between trees, and leaves are too long to be ranked at once."""
    monkeypatch.setattr(boosting, "WRITE_EVERY", 4)
    monkeypatch.setattr(boosting, "RANKED", 8)
    monkeypatch.setattr(boosting, "CELLS", 700)
    names = [h.name for h in HEADS]
    alone = answers(learning.fold_forecasts(frame(spark, table), "f", "id", FEATURES, HEADS, **settings), names)
    together = answers(learning.fold_forecasts(frame(spark, table, 7), "f", "id", FEATURES, HEADS, one_task=0, **settings), names)
    assert len(alone) == len(table) and alone == together
    held = [(alone[i][0] - 10 * (a > 0.5) - 3 * b) for _, i, a, b, *_ in table if a is not None]
    assert np.mean(np.abs(held)) < 3 and 0.85 < np.mean([y <= alone[i][1] for _, i, _, _, _, y, _, _ in table if y is not None]) < 0.97


@pytest.mark.parametrize("settings, counted", [({}, 1 << 20), ({}, 0), ({"second": True, "l2": 1.0, "least": 1.0}, 20_000), ({"bag": True, "rate": 1.0, "depth": 5}, 1 << 20)], ids=["first order", "no counts", "second order", "forest"])
def test_trees_by_combinations_are_those_of_rows(spark, monkeypatch, table, settings, counted):
    """A tree's rows are added up once, whatever its depth, and a quantile's leaf takes two passes; the trees are the same."""
    passes, names, heads = [], [h.name for h in HEADS], [h._replace(trees=4) for h in HEADS]
    monkeypatch.setattr(boosting, "COUNTED", counted)
    monkeypatch.setattr(boosting.Cells, "_summed", lambda self, g, models, f=boosting.Cells._summed: (passes.append(g.tree), f(self, g, models))[1])
    got = answers(learning.fold_forecasts(frame(spark, table, 7), "f", "id", FEATURES, heads, one_task=0, **settings), names)
    assert passes == [*([] if settings.get("bag") else [-1]), *range(4)]
    assert got == answers(learning.fold_forecasts(frame(spark, table), "f", "id", FEATURES, heads, **settings), names)


@pytest.mark.parametrize("second", [False, True])
def test_a_draw_is_added_up_once_for_all_folds(monkeypatch, second):
    """Rows of 3 folds and 5 combinations, some longer than an array; sums and counts are those of single rows."""
    r, n, size = np.random.default_rng(5), 4000, 5
    own, cell, y, w = r.integers(0, 3, n), r.integers(0, size, n), np.round(r.normal(size=n), 1), r.uniform(0.1, 1, n)
    key = boosting._mixed(np.arange(n, dtype=np.uint64))
    order = np.lexsort((y, cell, own))
    starts = np.unique(np.concatenate([np.flatnonzero(np.diff(own[order] * size + cell[order], prepend=-1)), np.arange(0, n, 100)]))
    ints, at = lambda v: boosting.pa.array(v, boosting.pa.int32()), order[starts]
    batch = boosting.pa.RecordBatch.from_arrays([ints(np.zeros(len(at))), ints(own[at]), ints(cell[at]), *[boosting._packed(v[order], starts) for v in (y, key, w)]], names=["target", "own", "cell", "y", "k", "w"])
    jobs = [boosting.Job(j, 0, 0 if second else -1, q, 1, h, int((own != j).sum()), 1 << 30, -4.0, 4.0, 30) for j in range(3) for h, q in enumerate([0.1, 0.9])]
    settings, models = boosting.Settings(second=second), list(range(6))
    f = {m: r.normal(size=size) for m in models}
    parts, f_parts = [], boosting._parts
    monkeypatch.setattr(boosting, "_parts", lambda *a: (parts.append(1), f_parts(*a))[1])
    got = {}
    for b in boosting._cell_sums(iter([batch.slice(0, 7), batch.slice(7)]), jobs, settings, 2, models, f):
        got |= {(x["m"], x["cell"]): (x["s"], x["n"]) for x in b.to_pylist()}
    assert len(parts) == 2 * 2  # two sides of two heads, whatever the folds
    leaf, ranges = {m: np.array([1, 2, 1, 2, 1]) for m in models}, {(m, k): (-0.5, 0.7) for m in models for k in (1, 2)}
    held = {}
    for b in boosting._cell_counts(iter([batch.select(["target", "own", "cell", "y"])]), jobs, models, f, leaf, ranges, 16, False):
        for x in b.to_pylist():
            held[x["m"], x["node"], x["bin"] < 0] = held.get((x["m"], x["node"], x["bin"] < 0), 0) + x["n"]
    for m, job in enumerate(jobs):
        mine = own != job.held
        count = boosting.drawn(job, settings, key, w if second else None, 2)
        whole, weight = f_parts(job, settings, y, f[m][cell], count, boosting._share(job, settings, w if second else None, n))
        for c in range(size):
            assert got[m, c] == (whole[mine & (cell == c)].sum(), weight[mine & (cell == c)].sum())
        v = y - f[m][cell]
        for k in (1, 2):
            rows = mine & (leaf[m][cell] == k)
            assert held[m, k, True] == (v[rows] < -0.5).sum() and held[m, k, False] == ((v[rows] >= -0.5) & (v[rows] <= 0.7)).sum()


def test_columns_carried_along_are_those_of_the_rows(spark, table):
    made = learning.fold_forecasts(frame(spark, table), "f", "id", FEATURES, [HEADS[0]._replace(trees=1)], carried=["y"])
    assert {r.id: r.y for r in made.collect()} == {r[1]: r[5] for r in table}


def test_tables_of_many_combinations_are_grown_from_rows(spark, monkeypatch, table):
    monkeypatch.setattr(boosting, "COMBINED", 500)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 4)
    monkeypatch.setattr(boosting, "RANKED", 8)
    monkeypatch.setattr(boosting, "VALUES", 100)
    monkeypatch.setattr(boosting.Cells, "_summed", lambda *_: 1 / 0)
    heads = [HEADS[0]._replace(trees=6), HEADS[1]._replace(trees=5)]
    got = answers(learning.fold_forecasts(frame(spark, table, 7), "f", "id", FEATURES, heads, one_task=0), ["mean", "q9"])
    assert got == answers(learning.fold_forecasts(frame(spark, table), "f", "id", FEATURES, heads), ["mean", "q9"])


def test_trees_do_not_depend_on_the_partitioning(spark, table):
    got = [answers(learning.fold_forecasts(frame(spark, table[:600], n), "f", "id", FEATURES, HEADS[1:], one_task=0, depth=2), ["q9", "other"]) for n in (1, 6)]
    assert got[0] == got[1]


def test_one_tree_by_its_definition(spark, table):
    """All rows and columns, one level: the cut of least squares over the bins, and the means on its sides."""
    known = [r for r in table if r[5] is not None and r[0] != 1]
    df = frame(spark, table)
    got = answers(learning.fold_forecasts(df.where("f = 1 OR y IS NOT NULL"), "f", "id", FEATURES, [learning.Head("m", "y", None, 1)], rows=1.0, columns=1.0, depth=1, rate=1.0, one_task=0), ["m"])
    y, best = np.array([r[5] for r in known]), None
    for k in (2, 3, 4):
        v = np.array([np.nan if r[k] is None else r[k] for r in known])
        edges = np.unique(np.quantile(v[~np.isnan(v)], np.arange(1, 32) / 32))
        code = np.where(np.isnan(v), 0, np.searchsorted(edges, v, side="right"))
        for cut in range(len(edges)):
            left = code <= cut
            if left.sum() >= 25 and (~left).sum() >= 25:
                loss = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, k, edges, cut, y[left].mean(), y[~left].mean())
    _, k, edges, cut, low, high = best
    for r in table:
        if r[0] == 1:
            side = r[k] is None or np.searchsorted(edges, r[k], side="right") <= cut
            assert got[r[1]][0] == pytest.approx(low if side else high, abs=1e-6)


def test_the_first_cut_is_that_of_the_split_search(spark, table):
    """Whole rows of three folds as nodes of the query, and as training rows of a model."""
    df = frame(spark, [r for r in table if r[5] is not None]).withColumn("node", F.lit(0))
    asked = learning.split_gain(learning.coded(df, FEATURES), "node", FEATURES, "y").first()
    models = learning._models(df, None, [], [-1], "id", FEATURES, [learning.Head("m", "y", None, 1)], {"rows": 1.0, "columns": 1.0, "one_task": 0})
    tree = models[-1, 0].trees[0]
    assert (FEATURES[tree.feature[0]], tree.cut[0]) == (asked.feature, asked.bin)


def test_weights_are_chances_in_one_and_loss_in_the_other(spark):
    """Half of the rows say 0, half say 1, with weights of 1 and 3."""
    made = [(0 if i < 400 else 1, i, float(i % 2), 0.0, 0.0, float(i % 3 == 0), None, 3.0 if i % 3 == 0 else 1.0) for i in range(800)]
    df = frame(spark, made)
    head = [learning.Head("m", "y", None, 1, "w")]
    lossy = answers(learning.booster_forecasts(df, "f", "id", FEATURES, head, rate=1.0, rows=1.0, l2=0.0, one_task=0), ["m"])
    drawn = answers(learning.fold_forecasts(df, "f", "id", FEATURES, head, rate=1.0, one_task=0), ["m"])
    share = sum(1.0 for i in range(400) if i % 3 == 0) * 3
    want = share / (share + sum(1 for i in range(400) if i % 3))
    assert lossy[500][0] == pytest.approx(want, abs=0.02) and drawn[500][0] == pytest.approx(want, abs=0.12)
    small = answers(learning.booster_forecasts(df, "f", "id", FEATURES, head, rate=1.0, l2=1e9, one_task=0), ["m"])
    assert abs(small[500][0] - 1 / 3) < 0.01  # leaves shrink to nothing, the start is the plain mean


def test_a_forest_spreads_and_errs_as_its_bags_say(spark, table):
    df = frame(spark, table)
    made = learning.forest_forecasts(df, "f", "id", FEATURES, "y", trees=24, one_task=0)
    alone = answers(learning.forest_forecasts(df, "f", "id", FEATURES, "y", trees=24), ["forecast", "spread"])
    got = {r.id: r for r in made.collect()}
    assert {i: (r.forecast, r.spread) for i, r in got.items()} == alone
    for r in list(got.values())[:50]:
        assert len(r.each) == 24 and r.forecast == pytest.approx(np.mean(r.each)) and r.spread == pytest.approx(np.std(r.each))
    truth = {r[1]: 10 * (r[2] > 0.5) + 3 * r[3] for r in table if r[2] is not None}
    error = np.mean([abs(got[i].forecast - t) for i, t in truth.items()])
    boosted = answers(learning.fold_forecasts(df, "f", "id", FEATURES, [learning.Head("m", "y", None, 60)]), ["m"])
    assert error < 1.2 and error < 3 * np.mean([abs(boosted[i][0] - t) for i, t in truth.items()]) + 0.5
    bags = {r.id: r for r in learning.out_of_bag(df, "id", FEATURES, "y", trees=24).collect()}
    assert len(bags) == sum(r[5] is not None for r in table)
    assert 24 * 0.3 < np.mean([r.n for r in bags.values()]) < 24 * 0.44
    assert np.mean([abs(bags[i].forecast - t) for i, t in truth.items() if i in bags and bags[i].n]) == pytest.approx(error, abs=0.5)


def test_draws_are_by_key(spark):
    keys = np.arange(20_000, dtype=np.uint64)
    u = boosting.uniform(keys, 1, 2, 3)
    assert 0.49 < u.mean() < 0.51 and (np.histogram(u, 20, (0, 1))[0] > 850).all()
    assert abs(np.corrcoef(u, boosting.uniform(keys, 1, 2, 4))[0, 1]) < 0.03
    counts = boosting.poisson(u, np.full(len(u), 2.5))
    assert abs(counts.mean() - 2.5) < 0.05 and abs(counts.var() - 2.5) < 0.1
    assert boosting.poisson(u[:5], np.zeros(5)).sum() == 0


def test_folds_without_rows_to_learn_from(spark):
    df = frame(spark, rows(40)).where("f = 0")
    assert all(r.m is None for r in learning.fold_forecasts(df, "f", "id", FEATURES, [learning.Head("m", "y", None, 2)], one_task=0).collect())
    constant = frame(spark, [(i % 2, i, 1.0, None, 2.0, 7.0, None, 0.0) for i in range(100)])
    got = learning.fold_forecasts(constant, "f", "id", FEATURES, [learning.Head("m", "y", None, 2, "w"), learning.Head("q", "y", 0.5, 2), learning.Head("z", "z", None, 2)], one_task=0).collect()
    assert all((r.m, r.q, r.z) == (7.0, 7.0, None) for r in got)


def test_scores_of_a_forecast_are_those_of_its_rearranged_quantiles(spark):
    from trackloom.functions import rearranged, recentred
    from trackloom.operators import scoring
    from trackloom.plans import queries

    r = np.random.default_rng(1)
    q = [f"q{i}" for i in range(5)]
    made = spark.createDataFrame([("a" if i % 3 else "b", *map(float, r.normal(size=7))) for i in range(200)] + [("c", 1.0, *[None] * 6)], "fold string, y double, point double, " + ", ".join(f"{c} double" for c in q))
    got = queries._scored(made)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = scoring.scores(made.withColumn("q", recentred(rearranged(F.array(*q)), "point")), ["fold"], "y", "point", "q")
    assert sorted(got.collect()) == sorted(want.collect())
