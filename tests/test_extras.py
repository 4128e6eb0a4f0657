"""Analyses beside the main stages, against plain loops and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from trackloom.plans import extras


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def moving(values, taps):
    """A mean over ``taps`` values, with zeros beyond the ends."""
    half = taps // 2
    return [sum(values[i] for i in range(max(0, k - half), min(len(values), k + half + 1))) / taps for k in range(len(values))]


def test_band_profile(spark):
    rng = np.random.default_rng(21)
    h, w, size, taps, fine = 40, 50, 2.0, 5, 3  # 0.04 mm a pixel: blocks of 5 columns
    images = {k: rng.integers(0, 256, (h, w)).astype(float) for k in range(2)}
    for k, image in images.items():
        image[15 + k : 27 + k] = 100 + rng.random((12, w)) * 40
    rows = [(8, k, w, x, y, float(a[y, x])) for k, a in images.items() for y in range(h) for x in range(w)]
    got = by(extras.band_profile(spark.createDataFrame(rows, "track int, place int, width int, x int, y int, value double"), taps, fine, size), "bin")
    want = {}
    for k, a in images.items():
        step = [[abs(a[y, min(x, w - 2) + 1] - a[y, min(x, w - 2)]) for x in range(w)] for y in range(h)]
        level = moving([sum(row) / w for row in step], taps)
        centre, limit = level.index(min(level)), np.percentile(level, 20) * 1.6
        for block in range(w // 5):
            ok = [v < limit for v in moving([sum(row[block * 5 : block * 5 + 5]) / 5 for row in step], fine)]
            if ok[centre]:
                lo = hi = centre
                while lo > 0 and ok[lo - 1]:
                    lo -= 1
                while hi < h - 1 and ok[hi + 1]:
                    hi += 1
                x = 100 - k * size - (block * 5 + 2.5) * size / w
                want[int((x - 20) / 0.2)] = (hi - lo + 1) * size / w
    assert {b: r.width for (b,), r in got.items()} == pytest.approx(want) and len(want) > 10


def test_series_are_aligned(spark):
    rng = np.random.default_rng(22)
    rows = []
    for track, shift in ((8, 3), (10, -2)):
        base = rng.normal(size=140)
        for b in range(100):
            rows.append((track, b, float(base[b + 20]), float(base[b + 20 + shift] + rng.normal(0, 0.05)), float(base[b + 20] / 1e3) if b % 9 else None))
    rows += [(14, b, 1.0, 2.0, None) for b in range(5)]
    table = spark.createDataFrame(rows, "track int, bin int, width double, th double, band double")
    got = by(extras.self_alignment(table, table.select("track", "bin", table["band"].alias("width")), "th"), "track")
    assert (got[(8,)].oracle_lag, got[(10,)].oracle_lag) == (3, -2) and got[(8,)].oracle_r > 0.9
    assert (got[(8,)].semreg_lag, got[(10,)].semreg_lag) == (-3, 2) or (got[(8,)].semreg_lag, got[(10,)].semreg_lag) == (3, -2)
    assert got[(8,)].sem_vs_label_r == pytest.approx(1.0) and (got[(14,)].oracle_lag, got[(14,)].oracle_r) == (0, 0.0)


def test_spectral_columns(spark):
    rng = np.random.default_rng(23)
    rows = [(8, b, *map(float, rng.normal(size=7))) for b in range(60)]
    table = spark.createDataFrame(rows, "track int, bin int, " + ", ".join(f"{s} double" for s in extras.SERIES))
    got = extras.spectral_columns(table)
    assert len(got.columns) == 2 + 49 and got.count() == 60
    from trackloom.plans import tracks

    one = by(tracks.spectral_windows(table, ["track"], "bin", "t_max"), "bin")
    for (b,), r in by(got, "bin").items():
        assert [r[f"sp_t_max_{c}"] for c in ("b0_2", "b15_25", "scent", "rstd3")] == pytest.approx([one[(b,)][c] for c in ("b0_2", "b15_25", "scent", "rstd3")])


def table_of(spark, seed=24):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame([(t, b) for t in (8, 10, 14, 21) for b in range(120)], columns=["track", "bin"])
    d["key"] = d.track * 1000 + d.bin
    d["a"], d["b"], d["flat"] = rng.normal(size=480), rng.normal(size=480), 1.0
    d["width"] = 500 + 20 * d.a + 30 * (d.b > 0) + rng.normal(0, 5, 480)
    return d


def test_blend_of_line_and_trees(spark):
    d = table_of(spark)
    made, card = extras.blended(spark.createDataFrame(d), "key", ["a", "b"], (8, 10, 14), "a", least=5)
    assert made.count() == 480
    (r,) = card.collect()
    assert r.track == 21 and r.alpha in extras.ALPHAS and r.mae_blend <= max(r.mae_gbm, r.mae_anchor) < 20 and r.cov90 > 0.7 and r.r > 0.8
    moved = d.assign(width=np.where(d.track == 21, d.width + 1e4, d.width))
    again = by(extras.blended(spark.createDataFrame(moved), "key", ["a", "b"], (8, 10, 14), "a", least=5)[0], "key")
    assert all(again[(x.key,)].p == pytest.approx(x.p) and list(again[(x.key,)].q) == pytest.approx(list(x.q)) for x in made.collect())


def test_report_on_features(spark):
    d = table_of(spark).rename(columns={"a": "th_a1800_m5"})
    got = extras.analysis(spark.createDataFrame(d), (8, 10, 14), ["th_a1800_m5", "b", "flat"], least=5)
    assert {r.feature for r in got["importance"].collect()[:2]} == {"th_a1800_m5", "b"}
    local = by(got["local_corr"], "feature")
    want = np.mean([np.corrcoef(g.b, g.width)[0, 1] for _, g in d.groupby("track")])
    assert local[("b",)].r == pytest.approx(want) and ("flat",) not in local
    assert {r.lag for r in got["lags"].collect()} == {0}


def test_tables_behind_plots(spark):
    d = spark.createDataFrame(table_of(spark).assign(power=400))
    assert by(extras.width_by_power(d), "power")[(400,)].width > 400
    forecasts = spark.createDataFrame([(21, 20.1, 5.0, 6.0, 1.0, [4.0, 5.0, 6.0, 7.0, 8.0], 0.0, 2.0)], "track int, x double, w_true double, pw double, pc double, q array<double>, yl_true double, yr_true double")
    r = extras.final_bands(forecasts, spark.createDataFrame([(21, 2.0)], "track int, conformal_s double")).first()
    assert (r.low90, r.low50, r.high50, r.high90, r.left, r.right) == (2.0, 4.0, 8.0, 10.0, -2.0, 4.0)
    none = d.where("false")
    assert extras.spread_summary(none, ["track"], "width", "a").count() == extras.missing_share(none, ["track"], ["a"]).count() == extras.local_correlations(none, "track", ["a"], "width").count() == 0


def test_stack_of_root_law_trees_and_neighbours(spark, tmp_path):
    d = table_of(spark).query("bin < 60")
    d["power"] = d.track.map({8: 400, 10: 350, 14: 300, 21: 200})
    d["width"] = 40 * np.sqrt(d.power) + d.width - 500
    spark.createDataFrame(d).write.parquet(str(tmp_path / "t"))
    made, card = extras.stacked(spark.read.parquet(str(tmp_path / "t")), "key", ["a", "b"], (8, 10, 14), (21,), least=5)
    rows, scores = by(made, "key"), by(card, "track")
    assert len(rows) == len(d) and set(scores) == {(8,), (10,), (14,), (21,)}
    medians = d[d.track != 21].groupby("power").width.median()
    slope, level = np.polyfit(np.sqrt(medians.index), medians.values, 1)
    train = d[d.track != 21]
    mu, sd = train[["a", "b"]].mean().to_numpy(), train[["a", "b"]].std(ddof=0).to_numpy() + 1e-9
    x = (train[["a", "b"]].to_numpy() - mu) / sd
    rest = train.width.to_numpy() - slope * np.sqrt(train.power.to_numpy()) - level
    for r in d[d.track == 21].head(10).itertuples():
        nearest = np.argsort((((np.array([r.a, r.b]) - mu) / sd - x) ** 2).sum(1))[:15]
        got = rows[(r.key,)]
        assert got.line == pytest.approx(slope * np.sqrt(200) + level) and got.knn == pytest.approx(got.line + rest[nearest].mean()) and got.p == pytest.approx((got.gbm + got.knn) / 2)
    assert scores[(21,)].mae_ens < 20 and scores[(21,)].cov90_cal >= scores[(21,)].cov90_raw or scores[(21,)].factor < 1
