"""Plans: filters and columns reach the scan, and no operator gathers a key or pairs everything."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkscope.plans import tquery

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = formatted(QUERIES["select_where"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "LessThanOrEqual(l_discount,0.05)" in pushed
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01" in pushed
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_tax" not in read and "l_extendedprice" not in read


def test_time_ranges_of_telemetry_queries_reach_the_scan(spark, sf_dir):
    text = formatted(QUERIES["tq_traces"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-02" in re.search(r"PushedFilters: \[(.*)\]", text).group(1)


def test_top_k_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k"](spark, sf_dir))


def test_batch_cap_limits_groups_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["batch_cap"](spark, sf_dir))


KEYED = ["agg_core", "agg_summary", "win_row_number", "win_lag", "win_running_sum", "ts_trend", "ts_profile",
         "anom_ensemble", "fc_ensemble", "alert_lifecycle", "flagship", "ten_autoscale", "sink_upsert_latest"]


@pytest.mark.parametrize("name", KEYED)
def test_no_single_partition_window_and_no_cartesian_product(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    lines = text.splitlines()
    for at, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            assert not any("SinglePartition" in below for below in lines[at : at + 4])


def test_windows_over_rows_are_cut_into_blocks(spark, sf_dir):
    text = plan(QUERIES["win_lag"](spark, sf_dir))
    assert "_block" in text


def test_postings_shuffle_texts_not_tokens(spark, sf_dir):
    text = plan(QUERIES["idx_postings"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning(") == 1


def test_rows_are_not_gathered_by_their_few_flags(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table of any size
    try:
        text = formatted(QUERIES["agg_pct_approx"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("page", [0, 10_000])
def test_pages_are_the_same_by_position_and_by_top_n(spark, monkeypatch, page):
    monkeypatch.setattr(tquery, "PAGE", page)
    rows = [(f"i{i % 90:02}", f"2024-01-{i % 7 + 1:02}", "Log", None if i % 5 else "Info") for i in range(90)]
    df = spark.createDataFrame(rows, "id string, timestamp string, record_type string, level string").withColumn("timestamp", F.to_timestamp("timestamp")).repartition(5)
    got = tquery.run(tquery.TelemetryQuery("Logs", select={"level": "level"}, limit=20, offset=10), df)
    assert [(r["id"], r["level"]) for r in got.collect()] == [(a, d) for a, _, _, d in sorted(rows, key=lambda r: (r[1], r[0]))[10:30]]
    assert ("TakeOrderedAndProject" in plan(got)) == (page > 0)
