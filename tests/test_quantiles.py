"""Exact percentiles by counts that merge, against the aggregate that holds all values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators.quantiles import percentiles

#: Whatever the table, it is not small.
BIG = 1 << 60
FRACTIONS = [0.0, 0.05, 0.3, 0.5, 0.85, 0.999, 1.0]


def both(df, keys, value="v", fractions=FRACTIONS):
    clean = df.withColumn(value, F.nanvl(value, F.lit(None).cast("double")))
    want = clean.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(*[F.lit(f) for f in fractions])).alias("p"))
    sort = lambda rows: sorted((tuple((x is None, x) for x in r[:-2]), r.n, None if r.p is None else [round(x, 9) if abs(x) < 1e6 else x for x in r.p]) for r in rows)
    return sort(percentiles(df, keys, value, fractions, size=BIG).collect()), sort(want.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_values(spark, parts):
    r = np.random.default_rng(1)
    odd = [0.0, -0.0, float("inf"), float("-inf"), 1e308, -1e308, 5e-324, -5e-324, None, float("nan"), 1e-300]
    values = [*r.normal(size=400).tolist(), *odd, *[3.5] * 200, *(1e9 + r.random(300)).tolist(), *(-(10.0 ** r.uniform(-30, 30, 300))).tolist()]
    rows = [(None if i % 7 == 0 else i % 3, "x" if i % 2 else None, v) for i, v in enumerate(values)] + [(9, "x", None), (10, "x", 4.0), (11, "x", float("nan"))]
    df = spark.createDataFrame(rows, "k int, l string, v double").repartition(parts)
    got, want = both(df, ["k", "l"])
    assert got == want and len(want) > 8
    got, want = both(df, [])
    assert got == want


def test_many_values_of_one_key(spark):
    """Two million different values, most of them within a ten-thousandth of each other, and a few far away."""
    n = 2_000_000
    v = F.when(F.col("id") % 1000 == 0, F.col("id") * 1e6).otherwise(1000 + F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 44)))
    df = spark.range(n, numPartitions=8).select((F.col("id") * 0).alias("k"), v.alias("v"))
    got = percentiles(df, ["k"], "v", FRACTIONS, size=BIG).first()
    values = np.sort(df.select("v").toPandas().v.to_numpy())
    assert got.n == n and np.allclose(got.p, np.quantile(values, FRACTIONS), rtol=0, atol=1e-9)


def test_few_values_and_no_rows(spark):
    df = spark.createDataFrame([(i % 2, float(i % 5)) for i in range(1000)], "k int, v double")
    got, want = both(df, ["k"])
    assert got == want
    assert percentiles(df.where("k > 5"), ["k"], "v", [0.5], size=BIG).collect() == []
    assert percentiles(df, ["k"], F.col("v") * 2, [0.5]).columns == ["k", "n", "p"]


def test_rows_that_files_hold_are_counted(spark, tmp_path, monkeypatch):
    """40,000 values in a file so small that its bytes don't tell."""
    from trackloom.operators import quantiles

    path = str(tmp_path / "t")
    spark.range(40_000, numPartitions=1).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 1000).cast("double").alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(quantiles, "SMALL", 1 << 20)
    monkeypatch.setattr(quantiles, "_SURE", 1 << 8)
    assert quantiles.estimated(df) <= 1 << 20 and not quantiles.fits(df) and quantiles.fits(df.limit(10))
