"""Operators on small hand-made tables with answers worked out by hand or by numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom import functions as fn
from trackloom.operators import grid, learning, order, robust, runs, scoring
from trackloom.sources import matlab, profiles


def signal(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, i long, v double")


@pytest.mark.parametrize(("bridge", "want"), [(2, (0, 6, 7)), (1, (0, 2, 3)), (0, (0, 2, 3))])
def test_longest_run(spark, bridge, want):
    d = signal(spark, [1, 1, 1, 0, 0, 1, 1])
    assert tuple(runs.longest_run(d, ["k"], "i", F.col("v") > 0, bridge).first())[1:] == want


def test_equal_runs_first_wins_and_no_run_gives_no_row(spark):
    assert runs.longest_run(signal(spark, [0, 1, 1, 0, 1, 1]), ["k"], "i", F.col("v") > 0).first()["first"] == 1
    assert runs.longest_run(signal(spark, [0, None]), ["k"], "i", F.col("v") > 0).count() == 0


def test_rolling_needs_three_values(spark):
    assert [r.v_m5 for r in order.rolling(signal(spark, [1, None, 3]), ["k"], "i", ["v"]).collect()] == [None] * 3


@pytest.mark.parametrize("chunk", [2, 5, 1 << 16])
def test_chunks_do_not_change_a_window(spark, chunk):
    x = np.random.default_rng(0).normal(size=40)
    got = order.windowed(signal(spark, x), ["k"], "i", 3, 3, lambda w: {"m": F.avg("v").over(w.rowsBetween(-3, 3))}, chunk).orderBy("i").collect()
    assert [r.m for r in got] == pytest.approx([x[max(0, i - 3) : i + 4].mean() for i in range(40)])


def test_zero_padding_at_both_ends(spark):
    got = [r.smooth for r in order.smoothed(signal(spark, [1] * 120), ["k"], "i", "v").orderBy("i").collect()]
    assert got[0] == got[-1] == pytest.approx(26 / 51) and got[60] == pytest.approx(1)


def test_box_mean_of_a_constant_and_of_noise(spark):
    z = np.random.default_rng(1).normal(size=(9, 20))
    cells = [(x, y, float(z[y, x])) for y in range(9) for x in range(20)]
    d = spark.createDataFrame(cells, "x long, y long, v double")
    got = {(r.x, r.y): r.mean for r in grid.box_mean(d, [], "x", "y", "v", 5, 7).collect()}
    wide = np.pad(z, ((2, 2), (3, 3)), mode="edge")
    assert all(got[x, y] == pytest.approx(wide[y : y + 5, x : x + 7].mean()) for y in range(9) for x in range(20))
    flat = grid.box_mean(d.withColumn("v", F.lit(2.5)), [], "x", "y", "v", 5, 7)
    assert {round(r.mean, 9) for r in flat.collect()} == {2.5}


def test_grid_bins_are_half_open(spark):
    edges = np.arange(20, 100 + 1e-9, 0.2)
    x = [20.0, 100.0, 19.999, *edges[:-1].tolist(), 63.33]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(fn.grid_bin("x")).collect()]
    assert got[:3] == [0, None, None] and got[3:-1] == list(range(400)) and got[-1] == np.digitize(63.33, edges) - 1


def test_plane_survives_gross_outliers(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 10, (2, 1000))
    z = 0.5 * x - 2 * y + 3
    z[:30] += 50
    a, b, c = robust.trimmed_plane(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), z.tolist(), strict=True)), "x double, y double, z double"), "x", "y", "z")
    assert (a, b, c) == pytest.approx((0.5, -2, 3), abs=0.02)
    assert robust.plane(spark.createDataFrame([], "x double, y double, z double"), "x", "y", "z") is None


def test_pinball_coverage_and_constant_groups(spark):
    one = spark.range(1)
    assert one.select(fn.pinball(F.lit(1.0), F.lit(0.0), 0.9), fn.pinball(F.lit(0.0), F.lit(1.0), 0.9)).first()[:] == pytest.approx((0.9, 0.1))
    assert one.select(scoring.inside(F.lit(1.0), F.array(F.lit(0.0), F.lit(1.0)), 0, 1)).first()[0] == 1
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(fn.correlation("a", "b")).first()[0] is None
    none = scoring.best_scale(spark.createDataFrame([(1.0, 2.0, 0.5)], "scale double, crps double, coverage double"))
    assert none.count() == 0


def test_quantile_edges_of_a_constant(spark):
    d = spark.createDataFrame([(1.0,)] * 9 + [(None,)], "x double")
    got = learning.coded(d, ["x"]).groupBy("x", "x_bin").count().collect()
    assert {(r.x, r.x_bin) for r in got} == {(1.0, 1), (None, 0)}


def test_ridge_and_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    d = spark.createDataFrame([(float(a), float(b), float(2 * a - b + 1)) for a, b in x], "a double, b double, y double")
    w, c = learning.ridge(d, ["a", "b"], "y", alpha=1e-6)
    assert w == pytest.approx([2, -1], abs=1e-4) and c == pytest.approx(1, abs=1e-4)
    rows = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, vec array<double>")
    got = learning.nearest(rows, rows.where("id < 5"), k=4, chunk=2)
    for q in range(5):
        want = np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:4]
        assert [r.id for r in got.where(F.col("query") == q).orderBy("rank").collect()] == want.tolist()
    assert learning.nearest(rows, rows.where("id < 0")).count() == 0


def element(kind, content):
    return struct.pack("<II", kind, len(content)) + content + b"\0" * (-len(content) % 8)


def matrix(name, a):
    body = element(6, struct.pack("<II", 7, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode()) + element(7, a.astype("<f4").tobytes(order="F"))
    return element(14, body)


def test_mat_frames(spark, tmp_path):
    a = np.arange(5 * 4 * 4, dtype=np.float32).reshape(4, 4, 5)
    small = element(14, element(6, struct.pack("<II", 7, 0)) + element(5, np.array([1, 1], "<i4").tobytes()) + struct.pack("<I", 1 << 16 | 1) + b"s\0\0\0" + element(7, struct.pack("<f", 3.5)))
    packed = lambda x: struct.pack("<II", 15, len(z := zlib.compress(x))) + z
    (tmp_path / "one.mat").write_bytes(b" " * 128 + small + matrix("video", a))
    (tmp_path / "two.mat").write_bytes(b" " * 128 + packed(small) + packed(matrix("video", a)))
    spark.dataSource.register(matlab.MatFrames)
    rows = spark.read.format("matframes").load(str(tmp_path)).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.variable == "video" and r.pixels == a[:, :, r.frame].ravel().tolist()


@pytest.mark.parametrize(("shape", "axis"), [((30, 40, 95), 2), ((95, 30, 40), 0), ((1, 6, 6, 9), 2), ((9, 6, 6), 0), ((7, 7, 7), 0), ((30, 95, 40), 1)])
def test_the_frame_axis(shape, axis):
    a = np.arange(np.prod(shape), dtype=np.float32).reshape(shape)
    name, frames = matlab.video([("small", np.zeros((2, 2, 3))), ("v", a), ("flat", np.zeros((500, 500)))])
    assert name == "v" and (frames == np.moveaxis(a.squeeze(), axis, 0)).all()


def test_pixels_of_frames(spark):
    d = spark.createDataFrame([("/a/Thermal_14.mat", 3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "file string, frame int, w int, pixels array<float>")
    assert sorted(tuple(r) for r in matlab.shots(d).collect()) == [(14, 3, x, y, float(1 + y * 2 + x)) for x in range(2) for y in range(3)]


def test_headers_of_height_maps(spark, tmp_path):
    head = "Wyko\n" + "Comment line\n" * 500 + "x size\t3\nY Size 1\nPixel_size\t7\t4\t0.5\nRAW_DATA\t3\n"
    (tmp_path / "Heightmap_8.ASC").write_text(head + "0\t0\t1e6\n1\t0\tBad\n2\t0\t3e6\n9\t9\t9\n")
    (tmp_path / "Heightmap_10.ASC").write_text("X Size 1\nY Size 1\nRAW_DATA\n")
    got = {(r.track, r.ix): (r.x_mm, r.z_mm) for r in profiles.asc_heights(spark, str(tmp_path), (99.2, 100.0)).collect()}
    assert got == {(8, 0): (100.0, 1.0), (8, 1): (99.5, None), (10, 0): (100.0, None)}
    with pytest.raises(ValueError):
        (tmp_path / "bad.ASC").write_text("X Size 3\nRAW_DATA\n")
        profiles.asc_heights(spark, str(tmp_path / "bad.ASC"))


@pytest.mark.parametrize("size", [1 << 27, 1000, 97, 41])
def test_height_maps_are_cut_anywhere(spark, tmp_path, size):
    """Two maps, one with blank lines and carriage returns, one too short, in parts that end inside of lines and headers."""
    rng = np.random.default_rng(6)
    want = {}
    for track, (nx, ny, lost, end) in {8: (23, 9, 0, "\n"), 21: (10, 31, 47, "\r\n")}.items():
        z = [None if rng.random() < 0.3 else round(float(rng.normal(0, 1e5)), 3) for _ in range(nx * ny - lost)]
        body = [f"{k // ny}\t{k % ny}\t{'Bad' if v is None else v}" + ("\tmore" if k % 5 == 0 else "") for k, v in enumerate(z)]
        body = [x for k, line in enumerate(body) for x in ([line, ""] if track == 21 and k % 7 == 0 else [line])]
        (tmp_path / f"Heightmap_{track}.ASC").write_bytes(end.join(["Some Software 1.0", "", f"X Size\t{nx}", f"Y Size\t{ny}", "Pixel_size\t7\t4\t0.5", "RAW_DATA", *body]).encode())
        for k in range(nx * ny):
            v = z[k] if k < len(z) else None
            want[track, k // ny, k % ny] = (100 - k // ny * 0.5, k % ny * 0.5, None if v is None else float(np.float32(v) * np.float32(1e-6)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        made = profiles.asc_heights(spark, str(tmp_path), None)
        got = {(r.track, r.ix, r.iy): (r.x_mm, r.y_mm, r.z_mm) for r in made.collect()}
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == want and made.count() == len(want)
    assert parts > 20 or size > 200


def test_moving_sums_of_any_window(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.normal())) for k, n in ((1, 200), (2, 3), (3, 1)) for i in range(n)]
    d = spark.createDataFrame(rows, "k int, i long, v double").repartition(3)
    for before, after, chunk in ((3, 5, 1 << 16), (0, 2, 7), (60, 60, 40), (2, 0, 1)):
        made = order.moving_sums(d, ["k"], "i", {"s": "v"}, before, after, lambda s, low, high, first, last: F.struct(s, low, high, first, last), chunk)
        assert made.columns == ["k", "i", "v", "s"]
        own = {k: [v or 0.0 for kk, _, v in rows if kk == k] for k in (1, 2, 3)}
        for r in made.collect():
            x, i = own[r.k], r.i
            want = [sum(x[max(0, i - before) : i + after + 1]), max(0, before - i), max(0, after - (len(x) - 1 - i)), x[0], x[-1]]
            assert list(r.s)[:3] == pytest.approx(want[:3])
            assert not want[1] or r.s[3] == want[3]
            assert not want[2] or r.s[4] == want[4]


def test_seams_by_transform(spark):
    """All overlaps of neighbours against sums of products, with gaps, a tile without a neighbour, and one that shares no row."""
    rng = np.random.default_rng(9)
    w, h = 12, 5
    tiles = {(k, t): np.where(rng.random((h, w)) < 0.15, np.nan, rng.normal(size=(h, w))) for k, t in ((1, 0), (1, 1), (1, 2), (1, 4), (2, 0))}
    rows = [(k, t, x, y + (100 if (k, t) == (1, 2) else 0), float(v[y, x])) for (k, t), v in tiles.items() for y in range(h) for x in range(w) if not np.isnan(v[y, x])]
    d = spark.createDataFrame(rows, "k int, t int, x int, y int, v double").repartition(4)
    scan = grid.seam_scan(d, ["k"], "t", "x", "y", "v", w, range(2, 8))
    got = {(r.k, r.tile, r.overlap): r.r for r in scan.collect()}
    flat = lambda v: (v - np.nanmean(v)) / (np.nanstd(v) + 1e-9)
    a, b = flat(tiles[1, 0]), flat(tiles[1, 1])
    assert set(got) == {(1, t, o) for t in (0, 1) for o in range(2, 8)}
    for o in range(2, 8):
        assert got[1, 0, o] == pytest.approx(np.nanmean(a[:, w - o :] * b[:, :o])) and got[1, 1, o] is None
    best = {(r.k, r.tile): r.overlap for r in grid.best_seam(scan, ["k"], w, 0.25).collect()}
    assert best[1, 1] == 3 and best[1, 0] == max(range(2, 8), key=lambda o: got[1, 0, o])


def tiff(a):
    """A grey image without compression."""
    h, w = a.shape
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, w * h)]
    entries = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, n, v in tags)
    pixels = a.astype(np.uint8).tobytes() + b"\0" * (w * h % 2)
    return b"II*\0" + struct.pack("<I", 8 + len(pixels)) + pixels + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def test_image_tiles(spark, tmp_path):
    folder = tmp_path / "SEM_21" / "PlainImages"
    folder.mkdir(parents=True)
    images = {2: np.arange(12).reshape(3, 4), 10: np.arange(12).reshape(3, 4) * 20}
    for n, a in images.items():
        (folder / f"T_x_{n}.tif").write_bytes(tiff(a))
    got = profiles.tiles(spark, str(folder)).collect()
    assert len(got) == 24 and {(r.track, r.width) for r in got} == {(21, 4)}
    assert all(r.value == images[r.tile][r.y, r.x] for r in got)
    assert {(r.tile, r.place) for r in grid.placed(profiles.tiles(spark, str(folder)), ["track"], "tile").collect()} == {(2, 0), (10, 1)}


def test_seams_without_a_fit(spark):
    scan = spark.createDataFrame([(1, 0, 3, 0.5), (1, 0, 4, 0.5), (1, 1, 3, None)], "k int, tile int, overlap int, r double")
    assert sorted(tuple(r) for r in grid.best_seam(scan, ["k"], 100).collect()) == [(1, 0, 3, 0.5), (1, 1, 5, -1.0)]


def test_height_maps(spark, tmp_path):
    f = tmp_path / "h.asc"
    f.write_text("X Size 3\nY Size 2\nRAW_DATA\n" + "\n".join(f"0\t0\t{v}" for v in ("1000000", "Bad", "3000000", "4000000")))
    got = profiles.asc_heights(spark, str(f), crop=None).orderBy("ix", "iy").collect()
    assert [(r.ix, r.iy, r.z_mm) for r in got] == [(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0), (2, 0, None), (2, 1, None)]
    assert got[2].x_mm == pytest.approx(100 - 0.003982)
    assert profiles.missing(spark, [str(f), f"{f}.no"]) == [f"{f}.no"]


def test_empty_tables(spark):
    d = signal(spark, []).withColumn("w", F.col("v"))
    assert order.rolling(d, ["k"], "i", ["v"]).count() == order.lag_scan(d, ["k"], "i", "v", "w", 2).count() == runs.runs(d, ["k"], "i", F.col("v") > 0).count() == 0
    assert grid.density_entropy(d, ["k"], "v").count() == 0


def folds(spark, n=3, rows=80):
    rng = np.random.default_rng(8)
    made = [(f"f{k:04d}" if k else None, k * rows + i, *map(float, rng.uniform(0, 1, 2))) for k in range(n) for i in range(rows)]
    d = pd.DataFrame(made, columns=["f", "id", "a", "b"])
    d["y"], d["z"] = 10 * (d.a > 0.5) + rng.normal(0, 0.1, len(d)), 5 * (d.b > 0.5) + rng.normal(0, 0.1, len(d))
    d["w"] = 1.0
    return d


HEADS = [learning.Head("mean", "y", None, 30, "w"), learning.Head("q9", "y", 0.9, 20), learning.Head("other", "z", None, 10)]


def forecasts(spark, d, **more):
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in d.itertuples(index=False)], "f string, id long, a double, b double, y double, z double, w double")
    out = learning.fold_forecasts(df, "f", "id", ["a", "b"], HEADS, least=5, **more)
    assert out.columns == ["f", "id", "mean", "q9", "other"]
    return {r.id: r for r in out.collect()}


def test_heads_have_their_own_targets(spark):
    d = folds(spark)
    d.loc[::5, "z"] = np.nan
    got = forecasts(spark, d)
    assert len(got) == len(d)
    assert all(got[r.id].f == r.f for r in d.itertuples())
    assert np.mean([abs(got[r.id].mean - 10 * (r.a > 0.5)) for r in d.itertuples()]) < 1.5
    assert np.mean([abs(got[r.id].other - 5 * (r.b > 0.5)) for r in d.itertuples()]) < 3


def test_a_holdout_trains_nothing(spark):
    d = folds(spark)
    first = forecasts(spark, d, train_folds=["f0001", "f0002"])
    d.loc[d.f.isna(), "y"] = 1e6
    again = forecasts(spark, d, train_folds=["f0001", "f0002"])
    assert [tuple(first[i]) for i in sorted(first)] == [tuple(again[i]) for i in sorted(again)]
    assert all(abs(first[i].mean) < 20 for i in first)


def test_no_fold_is_dropped(spark):
    rows = spark.createDataFrame([(i, i, float(i), float(i)) for i in range(1001)], "f int, id long, a double, y double")
    out = learning.fold_forecasts(rows, "f", "id", ["a"], [learning.Head("m", "y", None, 1)], train_folds=[0, 1], block=600)
    got = {r.f: r.m for r in out.collect()}
    assert len(got) == 1001 and got[0] == 1.0 and got[1] == 0.0 and got[1000] == 0.5
    alone = learning.fold_forecasts(rows.where("f = 0"), "f", "id", ["a"], [learning.Head("m", "y", None, 1)])
    assert [tuple(r) for r in alone.collect()] == [(0, 0, None)]
    assert learning.fold_forecasts(rows.where("f < 0"), "f", "id", ["a"], [learning.Head("m", "y", None, 1)]).count() == 0


def test_scorecard_of_the_holdout(spark):
    rng = np.random.default_rng(9)
    rows = []
    for f in (8, 10, 21):
        for _ in range(200):
            w = float(rng.normal(500, 20))
            rows.append((f, w, 10.0, 10 - w / 2, 10 + w / 2, 3.0, 500.0, 12.0, 2.0, [480.0, 490.0, 500.0, 510.0, 520.0]))
    d = spark.createDataFrame(rows, "track int, w_true double, c_true double, yl_true double, yr_true double, zr_true double, pw double, pc double, zr_pred double, q array<double>")
    scales = [1.0, 1.5, 2.0, 2.5]
    got = scoring.scorecard(d, "track", [8, 10], scales).collect()
    assert len(got) == 1 and got[0].track == 21
    w = {f: np.array([r[1] for r in rows if r[0] == f]) for f in (8, 10, 21)}
    q = np.array(rows[0][-1])

    def crps(y, s):
        wide = 500 + (q - 500) * s
        e = y[:, None] - wide[None]
        return 2 * np.mean([np.where(e[:, i] > 0, a * e[:, i], (a - 1) * e[:, i]).mean() for i, a in enumerate(scoring.QUANTILES)]), ((y >= wide[0]) & (y <= wide[-1])).mean()

    fit = [(np.mean([crps(w[f], s)[0] for f in (8, 10)]), s) for s in scales if np.mean([crps(w[f], s)[1] for f in (8, 10)]) >= 0.88]
    r = got[0]
    assert r.conformal_s == min(fit)[1] and r.width_crps == pytest.approx(crps(w[21], r.conformal_s)[0]) and r.width_cov90 == pytest.approx(crps(w[21], r.conformal_s)[1])
    assert r.center_mae == 2.0 and r.zrange_mae == 1.0 and r.width_mae == pytest.approx(np.abs(w[21] - 500).mean())
    assert scoring.scorecard(d, "track", [8, 10], [0.1]).count() == 0


def test_importance_of_features(spark):
    d = folds(spark).drop(columns="f").assign(f="x")
    df = spark.createDataFrame(d)
    got = learning.importance(df, "id", ["a", "b"], learning.Head("m", "y", None, 20), least=5).collect()
    assert got[0].feature == "a" and sum(r.share for r in got) == pytest.approx(1.0) and len(learning.importance(df, "id", ["a", "b"], HEADS[0], top=1, least=5).collect()) == 1


@pytest.mark.parametrize("bridge", [0, 1, 3])
def test_runs_over_many_chunks(spark, bridge):
    rng = np.random.default_rng(12)
    rows = [(k, i, bool(v)) for k in (1, 2) for i, v in enumerate(rng.random(400) < (0.6, 0.97)[k - 1])] + [(3, i, False) for i in range(5)]
    want = set()
    for k in (1, 2):
        found = []
        for _, i, v in (r for r in rows if r[0] == k):
            if v and found and i - found[-1][1] - 1 <= bridge:
                found[-1][1:] = [i, found[-1][2] + 1]
            elif v:
                found.append([i, i, 1])
        want |= {(k, a, b, n, b - a + 1) for a, b, n in found}
    d = spark.createDataFrame(rows, "k int, i long, v boolean")
    for chunk in (1, 7, 64, 1 << 16):
        got = runs.runs(d, ["k"], "i", F.col("v"), bridge, chunk).select("k", "first", "last", "n", "length").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want), chunk


def test_rows_of_a_few_keys_stay_where_they_lie(spark):
    """What is found for a key is so small that it is broadcast; joined by key, all rows of a key would meet in one task."""
    from trackloom.operators import learning, robust

    n = F.col("id")
    df = spark.range(2_000_000).select("id", (n % 3).alias("fold"), (n % 50).cast("double").alias("x"), (n % 7).cast("double").alias("y"), (n % 101).cast("double").alias("z"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    line = plan(learning.anchor_forecast(df, "fold", "id", "x", "z"))
    assert "BroadcastHashJoin" in line and "SortMergeJoin" not in line
    made = robust.trimmed_planes(df, ["fold"], "x", "y", "z", rounds=2)
    assert "Range" not in plan(made) and made.count() == 3


def test_height_maps_are_not_moved_by_track(spark):
    """One track, whose pixels would all meet in one task."""
    from trackloom.plans import tracks

    n = F.col("id")
    heights = spark.range(1_000_000).select(F.lit(8).alias("track"), F.floor(n / 100).alias("ix"), (n % 100).alias("iy"), (20 + F.floor(n / 100) * 0.004).alias("x_mm"), (n % 100 * 0.01).alias("y_mm"), (n % 89 * 0.001).alias("z_mm"))
    labelled = spark.range(200).select(F.lit(8).alias("track"), n.cast("int").alias("bin"), F.lit(0.4).alias("yl"), F.lit(0.6).alias("yr"))
    made = tracks.height_bins(heights, labelled, 0.02, 20, (1, 1))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and made.count() == 200


def test_images_wider_than_the_grid_are_whole(spark):
    """120 columns of 1 mm, the last at 100 mm, which is outside; 40 of them lie before the grid."""
    from trackloom.plans import tracks

    n = F.col("id")
    image = spark.range(120 * 40).select(F.lit(8).alias("track"), F.floor(n / 40).alias("x"), (n % 40).alias("y"), (n * 37 % 251).cast("double").alias("value"))
    bins = lambda **how: sorted(r.bin for r in tracks.surface_features(image, 1.0, 3.0, 5, 1, **how).collect())
    assert bins(whole=True) == [400 - 5 * k for k in range(119, 0, -1)] and bins() == [400 - 5 * k for k in range(80, 0, -1)]
