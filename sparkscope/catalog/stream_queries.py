"""Streams over slices of events, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import table
from sparkscope.session import scratch
from sparkscope.sources.files import stream_files
from sparkscope.streaming import jobs, state, windows

SLICES = 4
END = "(SELECT max(ts) FROM events)"


SLICE_FILE_BYTES = 64 << 20


def slices(spark, d, number=SLICES, last=None):
    """Write events in ``number`` slices in time order, each of equally many files, and return that number.

    Rows that match ``last`` come in one more slice at the end. The events are scanned once and
    written by slice; each slice is then added by several tasks, more for larger tables.
    """
    path, apart = scratch(spark, "slices"), scratch(spark, "apart")
    e = table(spark, d, "events")
    sizes = e.select("_metadata.file_path", "_metadata.file_size").distinct()
    files = max(4, -(-(sizes.agg(F.sum("file_size")).first()[0] or 0) // (number * SLICE_FILE_BYTES)))
    bounds = e.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    width = (bounds["hi"] - bounds["lo"]) // number + 1
    part = F.call_function("div", F.unix_micros("ts") - bounds["lo"], F.lit(width))
    marked = e.withColumn("_part", part if last is None else F.when(last, number).otherwise(part))
    marked.write.partitionBy("_part").parquet(apart)
    for n in range(number + (last is not None)):
        spark.read.schema(e.schema).parquet(f"{apart}/_part={n}").repartition(files).write.mode("append").parquet(path)
    return path, e.schema, files


def stream(spark, d, **options):
    path, schema, files = slices(spark, d, **options)
    return stream_files(spark, path, schema, files_per_trigger=files)


@query("src_file_stream", "SELECT event_id, ts, event_type, value FROM events")
def src_file_stream(spark, d):
    return jobs.drain(stream(spark, d).select("event_id", "ts", "event_type", "value"), "file-stream")


def totals():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


def _bucketed(size, sql_size):
    return f"""SELECT time_bucket(INTERVAL {sql_size}, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL {sql_size}, ts, TIMESTAMP '1970-01-01') + INTERVAL {sql_size} AS window_end,
    event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""


@query("st_tumbling", f"SELECT * FROM ({_bucketed(None, '30 MINUTE')}) WHERE window_end <= {END} - INTERVAL 1 HOUR")
def st_tumbling(spark, d):
    return jobs.drain(windows.tumbling(stream(spark, d), "ts", "30 minutes", ["event_type"], totals(), "1 hour"), "tumbling")


@query(
    "st_sliding",
    f"""SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM
    (SELECT *, unnest([time_bucket(INTERVAL 20 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(20 * s) for s in [0, 1, 2]]) AS w FROM events) GROUP BY ALL HAVING window_end <= {END} - INTERVAL 1 HOUR""",
)
def st_sliding(spark, d):
    out = windows.sliding(stream(spark, d), "ts", "1 hour", "20 minutes", ["event_type"], totals(), "1 hour")
    return jobs.drain(out, "sliding")


@query(
    "st_session",
    f"""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 4 HOUR <= {END} - INTERVAL 1 HOUR""",
)
def st_session(spark, d):
    return jobs.drain(windows.session(stream(spark, d), "ts", "4 hours", ["user_id"], totals(), "1 hour"), "session")


@query(
    "st_count_window",
    """SELECT event_type, i // 50 AS window_no, count(*) AS rows, round(sum(value), 4) AS total, count(*) = 50 AS closed FROM
    (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1, 2""",
)
def st_count_window(spark, d):
    e = table(spark, d, "events")
    return windows.by_count(e, ["event_type"], ["ts", "event_id"], 50, [F.round(F.sum("value"), 4).alias("total")])


@query(
    "st_count_window_stream",
    """SELECT 'u' || CAST(user_id AS VARCHAR) AS key, i // 10 AS window_no, count(*) AS rows, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1, 2 HAVING count(*) = 10""",
)
def st_count_window_stream(spark, d):
    rows = stream(spark, d).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), "value"
    )
    out = jobs.drain(state.count_windows(rows, 10), "count-window")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4)})


@query("st_watermark", f"SELECT * FROM ({_bucketed(None, '1 HOUR')}) WHERE window_end <= {END} - INTERVAL 6 HOUR")
def st_watermark(spark, d):
    return jobs.drain(windows.tumbling(stream(spark, d), "ts", "1 hour", ["event_type"], totals(), "6 hours"), "watermark")


@query(
    "st_late",
    """WITH m AS (SELECT max(ts) AS m FROM events WHERE event_id % 50 <> 0)
    SELECT event_id, event_type, event_id % 50 = 0 AND epoch_us(ts) < epoch_us(m) - CAST(432000000000 AS BIGINT) AS late FROM events, m""",
)
def st_late(spark, d):
    out, checkpoint = scratch(spark, "late"), scratch(spark, "late-checkpoint")
    rows = stream(spark, d, last=F.col("event_id") % 50 == 0).select("event_id", "event_type", "ts")
    jobs.split_late(rows, "ts", 5 * 86_400, out, checkpoint).awaitTermination()
    read = lambda part: spark.read.schema("event_id bigint, event_type string").parquet(f"{out}/{part}/batch=*")
    return read("rows").withColumn("late", F.lit(False)).unionByName(read("late").withColumn("late", F.lit(True)))


@query("st_intermediate", _bucketed(None, "1 DAY"))
def st_intermediate(spark, d):
    out = windows.tumbling(stream(spark, d), "ts", "1 day", ["event_type"], totals(), "1 hour")
    return jobs.latest(jobs.drain_batches(out, "intermediate"), ["window_start", "window_end", "event_type"])


@query(
    "st_window_aggs",
    """WITH e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_start, event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY window_start, event_type) AS c FROM e)
    SELECT window_start, event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(coalesce(stddev_samp(value), 0), 6) AS std_dev,
      round(median(value), 6) AS median, max(CASE WHEN i = CAST(floor(0.9 * (c - 1) + 0.5) AS BIGINT) THEN value END) AS p90, max(CASE WHEN i = CAST(floor(0.99 * (c - 1) + 0.5) AS BIGINT) THEN value END) AS p99 FROM r GROUP BY 1, 2""",
)
def st_window_aggs(spark, d):
    return windows.exact_stats(table(spark, d, "events"), "ts", "6 hours", ["event_type"], "value", (90, 99))


@query(
    "st_hourly_count",
    f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY 1, 2 HAVING window_end <= {END} - INTERVAL 10 MINUTE",
)
def st_hourly_count(spark, d):
    out = windows.tumbling(stream(spark, d), "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")], "10 minutes")
    return jobs.drain(out, "hourly")


@query(
    "st_chain",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS window_end, kind, count(*) AS n, round(sum(scaled), 4) AS total,
    'broken' AS skipped FROM (SELECT ts, upper(event_type) AS kind, value * 2 AS scaled FROM events WHERE event_type <> 'view') GROUP BY 1, 2, 3 HAVING window_end <= {END} - INTERVAL 1 HOUR""",
)
def st_chain(spark, d):
    total = [F.count(F.lit(1)).alias("n"), F.round(F.sum("scaled"), 4).alias("total")]
    chain = jobs.Chain(
        [
            ("keep", lambda x: x.filter("event_type <> 'view'")),
            ("broken", lambda x: x.select("no_such_column")),
            ("scale", lambda x: x.select("ts", F.upper("event_type").alias("kind"), (F.col("value") * 2).alias("scaled"))),
            ("total", lambda x: windows.tumbling(x, "ts", "1 hour", ["kind"], total, "1 hour")),
        ]
    )
    out = chain.build(stream(spark, d))
    return jobs.drain(out, "chain").withColumn("skipped", F.lit(",".join(sorted(chain.skipped))))


@query("st_continuous_query", "SELECT event_id, event_type, value FROM events WHERE value > 100 AND event_type IN ('error', 'click')")
def st_continuous_query(spark, d):
    sql = "SELECT event_id, event_type, value FROM scope_live WHERE value > 100 AND event_type IN ('error', 'click')"
    return jobs.drain(jobs.continuous(spark, "scope_live", stream(spark, d), sql), "continuous")


@query(
    "st_keyed_state",
    """WITH c AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'get' WHEN 'signup' THEN 'exists' ELSE 'set' END AS op, value FROM events),
    g AS (SELECT *, max(CASE WHEN op IN ('set', 'delete') THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS change FROM c)
    SELECT g.key, g.seq, g.op, coalesce(b.op = 'set', false) AS found, CASE WHEN g.op = 'set' THEN g.value WHEN b.op = 'set' THEN b.value END AS value FROM g LEFT JOIN c b ON b.seq = g.change""",
)
def st_keyed_state(spark, d):
    op = (
        F.when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "view", "get")
        .when(F.col("event_type") == "signup", "exists")
        .otherwise("set")
    )
    commands = stream(spark, d).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value"
    )
    return jobs.drain(state.store(commands), "keyed-state")


@query("st_dedup", "SELECT event_id // 2 AS id, count(*) > 0 AS seen FROM events GROUP BY 1")
def st_dedup(spark, d):
    rows = stream(spark, d).withColumn("id", F.expr("event_id div 2"))
    once = rows.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["id"])
    return jobs.drain(once.select("id", F.lit(True).alias("seen")), "dedup")


@query(
    "st_stream_static_join",
    """SELECT e.event_id, e.event_type, round(e.value - h.m, 6) AS deviation FROM events e JOIN (SELECT event_type, avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) h ON e.event_type = h.event_type""",
)
def st_stream_static_join(spark, d):
    from sparkscope.operators.relational import deviation

    history = table(spark, d, "events").filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    out = deviation(stream(spark, d), history, ["event_type"], "value")
    return jobs.drain(out.select("event_id", "event_type", F.round("deviation", 6).alias("deviation")), "static-join")


@query(
    "st_micro_batching",
    f"""WITH b AS (SELECT epoch_us(min(ts)) AS lo, (epoch_us(max(ts)) - epoch_us(min(ts))) // {SLICES} + 1 AS w FROM events)
    SELECT CAST((epoch_us(ts) - lo) // w AS INTEGER) AS batch, count(*) AS n FROM events, b GROUP BY 1""",
)
def st_micro_batching(spark, d):
    rows = jobs.drain_batches(stream(spark, d).select("event_id"), "micro-batches", "append")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st_alert_changes",
    """WITH e AS (SELECT event_type AS key, ts, event_id AS seq, value > 60 AS hit FROM events),
    c AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY key ORDER BY ts, seq), false) AS was FROM e),
    x AS (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS ended FROM c WHERE hit <> was)
    SELECT key, ts, seq, CASE WHEN hit THEN 'Active' ELSE 'Resolved' END AS status, hit AND coalesce(epoch_us(ts) - epoch_us(ended) < 3600 * 1000000::BIGINT, false) AS in_cooldown FROM x""",
)
def st_alert_changes(spark, d):
    rows = stream(spark, d).select(
        F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("value") > 60).alias("hit"), F.lit(3600).alias("cooldown_seconds")
    )
    return jobs.drain(state.alert_changes(rows), "alert-changes")
