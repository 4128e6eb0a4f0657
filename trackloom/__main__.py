"""python -m trackloom DATA OUT [--from N | --only N] [--resume] ...: the stages of trackloom.plans.stages."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trackloom", description="Stages from raw tracks to the holdout's scorecard.")
    parser.add_argument("data", help="folder of thermal, height_maps and sem")
    parser.add_argument("out", help="folder of the tables")
    parser.add_argument("--from", dest="start", type=int, default=0, help="the first stage to run")
    parser.add_argument("--only", type=int, help="the only stage to run")
    parser.add_argument("--resume", action="store_true", help="make only what is not there yet")
    parser.add_argument("--tracks", type=int, nargs="+", help="the tracks to make tables and forecasts of (default: all)")
    parser.add_argument("--train", type=int, nargs="+", default=[8, 10, 14], help="the tracks that train")
    parser.add_argument("--holdout", type=int, nargs="+", default=[21], help="the tracks that are scored")
    parser.add_argument("--power", nargs="+", metavar="TRACK=WATTS", help="the power of each track")
    parser.add_argument("--lag", default="14", help="rows by which the frames' features lag, or auto")
    parser.add_argument("--trees", nargs="+", metavar="NAME=VALUE", default=[], help="settings of the trees: rate, depth, least, bins, rows, columns, seed")
    given = parser.parse_args(args)
    pairs = lambda given: dict(x.split("=", 1) for x in given)

    from pyspark.sql import SparkSession

    from trackloom.operators.boosting import Settings
    from trackloom.plans import stages, tracks

    kinds = {name: type(value) for name, value in Settings()._asdict().items()}
    settings = {k: float(v) if kinds[k] is float else int(v) for k, v in pairs(given.trees).items()}
    power = {int(k): float(v) for k, v in pairs(given.power).items()} if given.power else dict(tracks.POWER)
    lag = None if given.lag == "auto" else int(given.lag)
    layout = stages.Layout(given.data, given.out, tuple(given.train), tuple(given.holdout), power, lag, settings, tuple(given.tracks) if given.tracks else None)
    spark = SparkSession.builder.appName("trackloom").getOrCreate()
    found = stages.run(spark, layout, given.start, given.only, given.resume)
    for row in found.collect() if found is not None else []:
        for name, value in row.asDict().items():
            print(f"{name:14s} {value:.2f}" if value is not None else f"{name:14s} -")
    if given.only == 9 or given.only is None:
        for name in ("report_heights", "report_width_by_power", "report_spread"):
            print(name)
            spark.read.parquet(layout.table(name)).show()


if __name__ == "__main__":
    main()
