"""From small raw files of four tracks to the scorecard."""

from __future__ import annotations

import shutil
from dataclasses import replace

import numpy as np
import pytest
from test_operators import matrix, tiff

from trackloom.operators import learning
from trackloom.plans import stages, tracks

SETTINGS = {"least": 5}


def write(folder):
    rng = np.random.default_rng(11)
    for t in (8, 10, 14, 21):
        for sub in ("thermal", "height_maps", f"sem/SEM_{t}/PlainImages"):
            (folder / sub).mkdir(parents=True, exist_ok=True)
        frames = rng.uniform(900, 1000, (70, 8, 9))
        frames[20:65] = rng.uniform(1200, 2500, (45, 8, 9))
        (folder / f"thermal/Thermal_{t}.mat").write_bytes(b" " * 128 + matrix("film", frames.astype(np.float32)))
        nx, ny = 1600, 130
        z = rng.normal(0, 4000, (nx, ny))
        z[rng.random((nx, ny)) < 0.7] = np.nan
        for i in range(nx):
            a, b = 40 + (i // 60 + t) % 7, 95 + (i // 90 + t) % 5
            z[i, a:b] = rng.normal(0, 300, b - a)
        body = "\n".join(f"{i}\t{j}\t{'Bad' if np.isnan(v) else v}" for i, row in enumerate(z) for j, v in enumerate(row))
        (folder / f"height_maps/Heightmap_{t}.ASC").write_text(f"X Size {nx}\nY Size {ny}\nPixel_size 0.003982\nRAW_DATA\n{body}\n")
        for k in (1, 2):
            image = rng.integers(0, 256, (90, 320))
            image[40:50] = 120
            (folder / f"sem/SEM_{t}/PlainImages/T_{k}.tif").write_bytes(tiff(image))


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tracks")
    write(root / "data")
    made = stages.Layout(str(root / "data"), str(root / "out"), settings=SETTINGS)
    card = stages.run(spark, made)
    assert card is not None
    return made


def test_the_whole_run(spark, layout):
    read = lambda name: spark.read.parquet(layout.table(name))
    shots = read("shots").groupBy("track").agg({"frame": "min", "bin": "max"}).collect()
    assert {(r.track, r["min(frame)"], r["max(bin)"]) for r in shots} == {(t, 20 - 20, 399) for t in layout.tracks}
    table = read("dataset_with_z")
    assert len(table.columns) == 98 and table.count() == 1600  # 97, and the bin's number
    assert len(read("dataset").columns) == 86 and len(read("dataset_ensemble").columns) == 94
    some = table.where("track = 8 and bin between 370 and 395").collect()
    assert all(0.15 < r.width / 1e3 < 0.3 and r.w_ens is not None and r.z_range > 0 and r.th_t_max > 1200 and r.sem_s_std > 10 for r in some)
    forecasts = read("forecasts").collect()
    assert {r.track for r in forecasts} == set(layout.tracks) and all(list(r.q) == sorted(r.q) for r in forecasts)
    card = read("scorecard").collect()
    assert [r.track for r in card] in ([21], []) and all(r.width_mae < 200 for r in card)


def test_single_stages_and_missing_files(spark, layout, tmp_path):
    before = spark.read.parquet(layout.table("thermal")).count()
    assert stages.run(spark, layout, only=2) is None and spark.read.parquet(layout.table("thermal")).count() == before
    with pytest.raises(ValueError):
        stages.run(spark, layout, only=8)
    with pytest.raises(FileNotFoundError, match="Thermal_8.mat"):
        stages.run(spark, stages.Layout(str(tmp_path), str(tmp_path / "out")))


def test_the_command_line(layout, capsys):
    from trackloom.__main__ import main

    main([layout.data, layout.out, "--only", "4"])
    assert capsys.readouterr().out == ""
    main([layout.data, layout.out, "--only", "9", "--power", "8=400", "10=350", "14=300", "21=200", "--lag", "auto", "--trees", "least=5", "rate=0.1"])
    out = capsys.readouterr().out
    assert "report_width_by_power" in out and "report_spread" in out


def test_results_as_json(spark, layout):
    card, noted = spark.read.parquet(layout.table("scorecard")).collect(), spark.read.json(layout.table("final_results.json")).collect()
    assert len(card) == len(noted) and all(n["width_mae"] == pytest.approx(c["width_mae"]) for n, c in zip(noted, card, strict=True))
    assert {r.track for r in spark.read.json(layout.table("folds.json")).collect()} == set(layout.tracks)


def test_a_killed_run_goes_on(spark, layout, tmp_path, monkeypatch):
    """The tables of one track, and the forecasts of two, are lost; what is there is not made again."""
    out = tmp_path / "out"
    shutil.copytree(layout.out, out)
    mine = replace(layout, out=str(out))
    for name in ("surface", "dataset"):
        shutil.rmtree(out / name / "track=10")
    for t in (14, 21):
        shutil.rmtree(out / "forecasts" / f"track={t}")
    before = {t: sorted((r.bin, r.pw, tuple(r.q)) for r in spark.read.parquet(str(out / "forecasts")).where(f"track = {t}").collect()) for t in (8, 10)}
    kept = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet") if "track=8" in str(p)}
    held = []
    trained = learning.boosting.trained
    monkeypatch.setattr(learning.boosting, "trained", lambda rows, which, *more, **named: held.append(list(which)) or trained(rows, which, *more, **named))
    card = stages.run(spark, mine, resume=True)
    assert held == [[2], [-1]]  # the third training track, and the models that all holdouts share
    assert stages.made_parts(spark, mine, "dataset") == {8, 10, 14, 21} == stages.made_parts(spark, mine, "forecasts")
    assert all(p.exists() and p.stat().st_mtime_ns == at for p, at in kept.items() if not {"modelling", "plot_scores", "plot_bands", "report_heights", "report_spread"} & set(p.parts))
    read = lambda where, name: sorted(map(str, spark.read.parquet(f"{where}/{name}").select("track", "bin").collect()))
    assert all(read(out, n) == read(layout.out, n) for n in ("dataset", "surface", "forecasts"))
    after = {t: sorted((r.bin, r.pw, tuple(r.q)) for r in spark.read.parquet(str(out / "forecasts")).where(f"track = {t}").collect()) for t in (8, 10)}
    assert before == after and len(card.collect()) == spark.read.parquet(layout.table("scorecard")).count()
    held.clear()
    stages.run(spark, mine, start=7, resume=True)
    assert held == []


def test_the_lag_is_chosen_once(spark, layout, tmp_path, monkeypatch):
    """Features lead the label by 5 bins on the training tracks, and by 9 on the holdout, which has no say."""
    rng = np.random.default_rng(1)
    mine, rows = replace(layout, out=str(tmp_path), lag=None), []
    for t in layout.tracks:
        v = rng.normal(size=220)
        rows += [(t, b, float(v[b - (9 if t == 21 else 5)]) if b > 9 else None, float(v[b]), float(rng.normal())) for b in range(220)]
    table = spark.createDataFrame(rows, "track int, bin int, width double, th_a double, th_b double")
    assert stages.chosen_lag(spark, mine, table, ["th_a", "th_b"]) == 5
    monkeypatch.setattr(tracks, "pick_lag", None)
    assert stages.chosen_lag(spark, mine, table, ["th_a"]) == 5 and stages.chosen_lag(spark, replace(mine, lag=3), table, []) == 3


def test_a_mosaic_of_two_tiles(spark):
    tiles = [(8, k, 20, x, y, float(100 * k + x)) for k in range(2) for x in range(20) for y in range(2)]
    got = {(r.x, r.y): r.value for r in stages.mosaics(spark.createDataFrame(tiles, "track int, place int, width int, x int, y int, value double")).collect()}
    assert len(got) == 39 * 2 and got[38, 0] == 0.0 and got[0, 1] == 119.0 and got[19, 0] == (19 + 100) / 2
    assert set(stages.LABELS) >= {"w_v5", "z_range"} and len(tracks.VARIANTS) == 6
