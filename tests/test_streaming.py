"""Streams drained in several micro-batches give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from sparkscope.catalog.alert_queries import RULES, hourly
from sparkscope.catalog.stream_queries import slices
from sparkscope.model import records, table
from sparkscope.operators import alerts
from sparkscope.plans import ingest
from sparkscope.session import scratch, stage
from sparkscope.sources.files import stream_files
from sparkscope.streaming import jobs, state, windows


def rows(df):
    return sorted(map(str, df.collect()))


def stream(spark, sf_dir):
    path, schema, files = slices(spark, sf_dir)
    return stream_files(spark, path, schema, files_per_trigger=files)


def test_windows_match_their_batch_form(spark, sf_dir):
    aggs = [F.count(F.lit(1)).alias("n"), F.max("value").alias("top")]
    made = lambda df: windows.tumbling(df, "ts", "2 hours", ["event_type"], aggs, "1 hour")
    live = jobs.latest(jobs.drain_batches(made(stream(spark, sf_dir)), "t"), ["window_start", "window_end", "event_type"])
    cols = ["window_start", "window_end", "event_type", "n", "top"]
    assert rows(live.select(cols)) == rows(made(table(spark, sf_dir, "events")).select(cols))


def test_a_windowed_stream_needs_a_watermark(spark, sf_dir):
    with pytest.raises(ValueError):
        windows.tumbling(stream(spark, sf_dir), "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")])


def test_alert_states_match_the_batch_episodes(spark, sf_dir):
    judged = alerts.judge(hourly(spark, sf_dir), RULES)
    keyed = judged.select(F.concat_ws("/", "rule_id", "event_type").alias("key"), "ts", "seq", "hit", "cooldown_seconds")
    source = stage(keyed.repartitionByRange(3, "ts"))
    path = scratch(spark, "judged")
    for n, cut in enumerate(("2024-01-11", "2024-01-21", "2024-02-11")):
        low = "2023-01-01" if n == 0 else ("2024-01-11", "2024-01-21")[n - 1]
        part = source.filter((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(cut).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(path)
    live = jobs.drain(state.alert_changes(stream_files(spark, path, source.schema, files_per_trigger=1)), "alerts")
    episodes = alerts.episodes(judged, ["rule_id", "event_type"], "ts", "seq")
    key = F.concat_ws("/", "rule_id", "event_type")
    batch = episodes.select(key.alias("key"), F.col("active_at").alias("ts"), F.lit("Active").alias("status")).unionByName(
        episodes.filter("resolved_at IS NOT NULL").select(
            key.alias("key"), F.col("resolved_at").alias("ts"), F.lit("Resolved").alias("status")
        )
    )
    assert rows(live.select("key", "ts", "status")) == rows(batch)
    cold = episodes.filter("in_cooldown").select(key.alias("key"), F.col("active_at").alias("ts"))
    assert rows(live.filter("in_cooldown").select("key", "ts")) == rows(cold)


def test_late_rows_split_the_same_way_when_a_batch_repeats(spark, sf_dir):
    path, schema, files = slices(spark, sf_dir, last=F.col("event_id") % 10 == 0)
    out = scratch(spark, "late")
    for n in range(2):
        live = stream_files(spark, path, schema, files_per_trigger=files).select("event_id", "ts")
        jobs.split_late(live, "ts", 86_400, out, scratch(spark, f"checkpoint-{n}")).awaitTermination()
    read = lambda part: spark.read.parquet(f"{out}/{part}/batch=*").count()
    assert read("rows") + read("late") == table(spark, sf_dir, "events").count()


def test_ingest_on_a_stream_matches_the_batch(spark, sf_dir):
    landing = stage(records(spark, sf_dir).repartition(3))
    path = landing.inputFiles()[0].rsplit("/", 1)[0]
    clock = F.lit("2024-01-31").cast("timestamp")
    live = stream_files(spark, path, landing.schema, files_per_trigger=1)
    out = scratch(spark, "ingest")
    ingest.write_stream(ingest.flow(live, clock), out, scratch(spark, "checkpoint")).awaitTermination()
    cols = ["id", "table", "reject_reason"]
    assert rows(spark.read.parquet(out).select(cols)) == rows(ingest.flow(landing, clock).select(cols))


def test_a_broken_stage_is_counted_and_skipped(spark):
    chain = jobs.Chain([("bad", lambda d: d.select("nope")), ("good", lambda d: d.withColumn("x", F.lit(1)))])
    assert chain.build(spark.range(2)).columns == ["id", "x"]
    assert list(chain.skipped) == ["bad"]


def test_idle_keys_leave_the_state(spark):
    """When the watermark passes a key by its idle time, its window closes as it is, its alert is resolved, and it is no state any more."""
    path = scratch(spark, "idle")
    for hour, rows_ in enumerate([[("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5)], [("b", 6)], [("b", 7)], [("b", 8)]]):
        made = spark.createDataFrame([(k, seq, float(seq), True, 0) for k, seq in rows_], "key string, seq bigint, value double, hit boolean, cooldown_seconds bigint")
        made = made.withColumn("ts", F.lit(f"2024-01-01 {hour * 2:02d}:00:00").cast("timestamp")).select("key", "ts", "seq", "value", "hit", "cooldown_seconds")
        made.coalesce(1).write.mode("append").parquet(path)

    def live():
        return stream_files(spark, path, made.schema, files_per_trigger=1)

    out, checkpoint = scratch(spark, "idle-out"), scratch(spark, "idle-checkpoint")
    query = jobs.start(state.count_windows(live(), 2, idle_seconds=3 * 3600), out, checkpoint)
    query.awaitTermination()
    got = sorted((r["key"], r["window_no"], r["rows"], r["total"]) for r in spark.read.parquet(out).collect())
    # a and c were closed when they were full; nothing of them is left to give, and b goes on.
    assert got == [("a", 0, 2, 3.0), ("b", 0, 2, 9.0), ("b", 1, 2, 15.0), ("c", 0, 2, 9.0)]
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 1
    odd = sorted((r["key"], r["window_no"], r["rows"], r["total"]) for r in jobs.drain(state.count_windows(live(), 4, idle_seconds=3 * 3600), "odd").collect())
    assert odd == [("a", 0, 2, 3.0), ("b", 0, 4, 24.0), ("c", 0, 2, 9.0)]
    alerts_ = jobs.drain(state.alert_changes(live(), idle_seconds=3 * 3600), "idle-alerts")
    assert sorted((r["key"], r["status"]) for r in alerts_.collect()) == [("a", "Active"), ("a", "Resolved"), ("b", "Active"), ("c", "Active"), ("c", "Resolved")]
