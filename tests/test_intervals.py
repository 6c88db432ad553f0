"""Interval joins against nested loops in Python, on odd bounds, at size, and by plan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.operators import intervals

INF, NAN = math.inf, math.nan


def holds(v, low, high, closed):
    if v is None or v != v or low != low:
        return False
    above = low is None or (v >= low if closed in ("left", "both") else v > low)
    below = high is None or high != high or (v <= high if closed in ("right", "both") else v < high)
    return above and below


def rows_of(seed):
    rng = np.random.default_rng(seed)
    values = [float(v) for v in np.round(rng.normal(size=60) * 50, 1)] + [10.0] * 20 + [0.0, -0.0, 1e300, -1e300, 5e-324, INF, -INF, NAN, None]
    lows = np.round(rng.normal(size=50) * 60, 1)
    bands = [(float(a), float(a + w)) for a, w in zip(lows, rng.choice([0, 0.1, 1, 7, 100, 1e6], 50))]
    bands += [(None, 5.0), (5.0, None), (None, None), (10.0, 10.0), (20.0, -20.0), (-INF, INF), (0.0, INF), (1e299, 1e301), (NAN, 3.0), (3.0, NAN), (-1e308, 1e308)]
    return values, bands


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
def test_join(spark, closed):
    values, bands = rows_of(len(closed))
    for extreme in (True, False):
        own = values if extreme else [v for v in values if v is not None and abs(v) < 1e6]
        points = spark.createDataFrame(list(enumerate(own)), "id long, v double")
        ranges = spark.createDataFrame([(i, *b) for i, b in enumerate(bands)], "band long, low double, high double")
        got = intervals.join(points, ranges, "v", "low", "high", closed)
        assert got.columns == ["id", "v", "band", "low", "high"]
        want = [(i, j) for i, v in enumerate(own) for j, b in enumerate(bands) if holds(v, *b, closed)]
        assert sorted((r["id"], r["band"]) for r in got.collect()) == sorted(want)


def test_keys_and_other_types(spark):
    points = spark.sql("SELECT id, id % 3 AS k, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS at FROM range(100)")
    points = points.withColumn("at", F.unix_micros("at"))
    ranges = points.filter("id % 10 = 0").select("k", F.col("at").alias("low"), (F.col("at") + 5 * 3_600_000_000).alias("high"), F.col("id").alias("band"))
    got = intervals.join(points, ranges, "at", "low", "high", on=["k"])
    want = [(i, b) for b in range(0, 100, 10) for i in range(b, min(b + 5, 100)) if i % 3 == b % 3]
    assert sorted((r["id"], r["band"]) for r in got.collect()) == sorted(want)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, v double")
    bands = spark.createDataFrame([(1, 0.0, 5.0)], "band long, low double, high double")
    assert intervals.join(none, bands, "v", "low", "high").count() == 0
    assert intervals.join(spark.createDataFrame([(1, 2.0)], none.schema), bands.limit(0), "v", "low", "high").count() == 0


def test_a_million_bands(spark):
    """An equi-join whatever the number of bands; wide ones cost a few rows and no comparisons that fail."""
    points = spark.range(20_000).select("id", (F.col("id") * 50.0 + 0.5).alias("v"))
    bands = spark.range(1_000_000).select(F.col("id").alias("band"), F.col("id").cast("double").alias("low"), (F.col("id") + 1.0).alias("high"))
    wide = spark.range(1_000_000, 1_000_050).select(F.col("id").alias("band"), (F.col("id") - 1e6).alias("low"), F.lit(9e5).alias("high"))
    got = intervals.join(points, bands.unionByName(wide), "v", "low", "high")
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.filter("band < 1000000").agg(F.count(F.lit(1)), F.count_if(F.col("band") == F.col("id") * 50)).first() == (20_000, 20_000)
    first = (np.arange(20_000) * 50 + 0.5)[:, None]
    assert got.filter("band >= 1000000").count() == int(((first >= np.arange(50)) & (first < 9e5)).sum())
