"""Series analysis on small known series, short ones included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.operators import anomalies, cluster, forecast, ordered, series


def make(spark, **lists):
    rows = [(name, i, 1_700_000_000 + i, float(v)) for name, values in lists.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, id long, s long, value double")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


@pytest.fixture(scope="module")
def known(spark):
    rng = np.random.default_rng(2)
    return make(spark, rising=[100 + 2 * i for i in range(10)], flat=[5.0] * 12, one=[3.0], wild=rng.normal(50, 10, 300))


def by_series(df):
    return {r["series"]: r for r in df.collect()}


def test_rising_series_has_slope_two(known):
    got = by_series(series.trend(known))
    assert got["rising"]["direction"] == "Increasing"
    assert got["rising"]["slope"] == pytest.approx(2.0)
    assert got["flat"]["direction"] == "Stable"
    assert "one" not in got


def test_profile(known):
    got = by_series(series.profile(known))
    assert got["one"]["trend"] == "Unknown"
    assert got["flat"]["anomaly_score"] == 0.0 and not got["flat"]["is_anomaly"]
    assert got["rising"]["last"] == 118.0


def test_moving_average_needs_a_full_window(known):
    rows = series.moving_average(known, 12).groupBy("series").count().collect()
    assert {r["series"]: r["count"] for r in rows} == {"flat": 1, "wild": 289}


def test_lag_products_over_small_blocks(spark):
    v = np.random.default_rng(4).normal(0, 1, 700)
    df = make(spark, s=v)
    got = {r["lag"]: r["autocorrelation"] for r in series.lag_products(df, block=128).collect()}
    assert len(got) == 100
    for lag in (1, 7, 64, 100):
        assert got[lag] == pytest.approx(np.mean(v[:-lag] * v[lag:]))


def test_seasonality_needs_ten_points(spark):
    df = make(spark, short=[9.0] * 9, long=[9.0] * 10)
    assert list(by_series(series.seasonality(df))) == ["long"]


def test_constant_series_has_no_zscore_anomaly(known):
    found = {r["series"] for r in anomalies.zscore(series.index(known), 0.1).collect()}
    assert "flat" not in found and "one" not in found


def test_zero_mean_moving_average_does_not_divide_by_zero(spark):
    df = make(spark, zero=[0.0] * 12 + [4.0])
    got = anomalies.moving_average(series.index(df), 10, 3.0).collect()
    assert [r["i"] for r in got] == [12]


def test_seasonal_and_trend_detectors(spark):
    v = [float(i % 5) + 1 for i in range(60)]
    v[33] = 50.0
    df = series.index(make(spark, s=v))
    assert 33 in {r["i"] for r in anomalies.seasonal(df, 5, 2.0).collect()}
    assert 33 in {r["i"] for r in anomalies.trend(df, 10, 2.0).collect()}


def reference_decomposition(v, horizon):
    n = len(v)
    if n < 4:
        return [v[-1] * h for h in range(1, horizon + 1)]
    p = max(n // 4, 2)
    trend = [np.mean(v[i : i + p]) for i in range(n - p + 1)]
    season = np.zeros(p)
    for i in range(n):
        season[i % p] += v[i] - (trend[i] if i < len(trend) else v[i])
    season /= n // p
    return [trend[-1] * h + season[h % p] for h in range(1, horizon + 1)]


@pytest.mark.parametrize("n", [3, 4, 9, 50, 101])
def test_decomposition(spark, n):
    v = np.random.default_rng(n).normal(20, 5, n)
    got = forecast.decomposition(make(spark, s=v), 9).orderBy("step").collect()
    assert np.allclose([r["predicted"] for r in got], reference_decomposition(list(v), 9))


def test_smoothing_and_differences(spark):
    v = np.random.default_rng(8).normal(20, 5, 40)

    def smooth(values):
        level = values[0]
        for x in values[1:]:
            level = 0.3 * x + 0.7 * level
        return level

    df = make(spark, s=v)
    assert forecast.smoothing(df, 1).first()["predicted"] == pytest.approx(smooth(v))
    for d in (1, 2, 3):
        got = forecast.differenced(df, 2, d).collect()
        assert [r["predicted"] for r in got] == pytest.approx([smooth(np.diff(v, d))] * 2)


def test_short_series_fall_back(spark):
    df = make(spark, s=[4.0, 6.0])
    assert forecast.moving_average(df, 1).first()["predicted"] == 6.0
    assert forecast.model_mean(df, 1).count() == 0


def test_window_features_over_blocks(spark):
    v = np.random.default_rng(9).normal(0, 3, 640)
    df = make(spark, s=v, tiny=[1.0, 2.0])
    got = cluster.window_features(df, block=100).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(640 - 50 + 1))
    w = v[200:250]
    assert got[200]["mean"] == pytest.approx(w.mean())
    assert got[200]["std_dev"] == pytest.approx(w.std(ddof=1))
    assert got[200]["trend"] == pytest.approx(np.polyfit(np.arange(50), w, 1)[0])


def test_hot_series_spreads_over_partitions(spark):
    df = make(spark, hot=range(4000), cold=range(10))
    placed = ordered._placed(df, ["series"], ["ts", "id"], 8)
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("_g", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
