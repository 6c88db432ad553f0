"""Positions and frames over many partitions, with a hot key and ties, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkscope.operators import ordered, relational


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    return pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c", None], n)),
            "id": np.arange(n),
            "t": rng.integers(0, 40, n),
            "value": rng.integers(0, 25, n).astype(float),
        }
    )


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame.astype({"key": object}).where(frame.notna(), None)).repartition(5)


def sorted_frame(frame):
    return frame.assign(key=frame["key"].fillna("~")).sort_values(["key", "t", "id"])


@pytest.mark.parametrize("parts", [None, 1, 7, 16])
def test_indexed(df, frame, parts):
    got = ordered.indexed(df, ["key"], ["t", "id"], "i", "n", parts).toPandas().sort_values("id")
    want = sorted_frame(frame)
    want["i"] = want.groupby("key").cumcount()
    want["n"] = want.groupby("key")["id"].transform("size")
    want = want.sort_values("id")
    assert (got["i"].to_numpy() == want["i"].to_numpy()).all()
    assert (got["n"].to_numpy() == want["n"].to_numpy()).all()


def test_indexed_without_keys(df, frame):
    got = ordered.indexed(df, [], ["t", "id"], parts=6).toPandas().sort_values(["t", "id"])
    assert (got["i"].to_numpy() == np.arange(len(frame))).all()


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_cumulative(df, frame, parts):
    got = ordered.cumulative(df, ["key"], ["t", "id"], "value", parts=parts).toPandas().sort_values("id")
    want = sorted_frame(frame)
    want["before"] = want.groupby("key")["value"].cumsum() - want["value"]
    assert np.allclose(got["before"], want.sort_values("id")["before"])


@pytest.mark.parametrize("size", [8, 50, 10_000])
def test_framed_crosses_blocks(df, frame, size):
    placed = ordered.indexed(df, ["key"], ["t", "id"], parts=5)
    columns = {
        "mean": lambda w: F.avg("value").over(w.rowsBetween(-5, 0)),
        "next": lambda w: F.lead("value", 3).over(w),
    }
    got = ordered.framed(placed, ["key"], columns, before=5, after=3, size=size).toPandas().sort_values("id")
    want = sorted_frame(frame)
    by = want.groupby("key")["value"]
    want["mean"] = by.transform(lambda s: s.rolling(6, min_periods=1).mean())
    want["next"] = by.shift(-3)
    want = want.sort_values("id")
    assert len(got) == len(frame)
    assert np.allclose(got["mean"], want["mean"])
    assert np.allclose(got["next"].astype(float), want["next"], equal_nan=True)


@pytest.mark.parametrize("parts", [None, 1, 6])
def test_values_at(df, frame, parts):
    ranks = {"low": lambda n: F.floor(n / 4), "top": lambda n: n - 1}
    got = ordered.values_at(df, ["key"], "value", ranks, "n", parts).toPandas()
    for _, row in got.iterrows():
        mine = frame[frame["key"].isna() if row["key"] is None or pd.isna(row["key"]) else frame["key"] == row["key"]]
        values = np.sort(mine["value"].to_numpy())
        assert row["n"] == len(values)
        assert row["low"] == values[len(values) // 4]
        assert row["top"] == values[-1]


def test_ranked(df, frame):
    got = ordered.ranked(df, ["key"], "value", "rank", "dense", parts=5).toPandas().sort_values("id")
    by = frame.assign(key=frame["key"].fillna("~")).groupby("key")["value"]
    assert (got["rank"].to_numpy() == by.rank("min").to_numpy()).all()
    assert (got["dense"].to_numpy() == by.rank("dense").to_numpy()).all()


def test_one_value_for_most_rows(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    got = ordered.values_at(df, ["key"], "v", {"mid": lambda n: F.floor(n / 2)}, parts=8).first()
    assert got["mid"] == 7.0


def test_every_size_is_placed(df):
    for one in (df, df.filter("id < 90"), df.limit(0)):
        placed = ordered.indexed(one, ["key"], ["t", "id"], "i", "n")
        assert all("placed-" in f for f in placed.inputFiles())
        assert "Exchange SinglePartition" not in placed._jdf.queryExecution().toString()


def test_range_sum_with_one_crowded_moment(spark):
    rows = [("k", i, 1_000 if i < 50 else 1_000 + i, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, id int, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["x"] for r in relational.range_sum(df, ["key"], "ts", "v", 10, "x").collect()}
    for i, (_, _, s, _) in enumerate(rows):
        assert got[i] == sum(1 for r in rows if s - 10 <= r[2] <= s)
