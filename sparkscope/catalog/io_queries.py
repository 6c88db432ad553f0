"""Sources, layouts, sinks and schemas. File inputs are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from sparkscope.catalog import query
from sparkscope.model import FLAT_SQL, flat, newest, nest, records, table
from sparkscope.operators import flatten, schemas
from sparkscope.operators import transforms as tr
from sparkscope.session import scratch
from sparkscope.sources import bodies, files, kafka, otlp, sinks, snapshots

REC = f"WITH rec AS ({FLAT_SQL}) "
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _file_records(rec):
    """Records in the shape JSON files hold; some lack a time or a type."""
    data = bodies.payload(F.col("metric"), F.col("trace"), F.col("log"), F.col("event"), F.col("timestamp"))
    k = F.col("attributes")["k"].cast("int")
    return F.struct(
        "id",
        F.when(k % 10 != 0, F.col("timestamp")).alias("timestamp"),
        F.when((F.col("record_type") != "Metric") | (k % 4 != 1), F.col("record_type")).alias("record_type"),
        data.alias("data"),
        "attributes",
        "tags",
    )


def _batches(rec, size):
    """One JSON batch document per ``size`` consecutive ids."""
    rows = rec.select(F.expr(f"cast(id as bigint) div {size}").alias("b"), _file_records(rec).alias("r"))
    doc = F.struct(
        F.concat(F.lit("batch-"), F.col("b").cast("string")).alias("id"), F.lit("files").alias("source"), F.col("records")
    )
    return rows.groupBy("b").agg(F.collect_list("r").alias("records")).select(F.to_json(doc, MICROS).alias("value"), "b")


JSON_ROWS = """SELECT id, CASE WHEN k % 10 <> 0 THEN ts ELSE (SELECT max(ts) FROM rec) END AS timestamp, record_type, {batch} AS batch_id,
    metric_name, metric_value, log_message AS message, duration_ns, event_name, a_k AS k, t_region AS region FROM rec"""


def _shown(df):
    return df.select(
        "id",
        "timestamp",
        "record_type",
        "batch_id",
        F.col("metric.name").alias("metric_name"),
        F.col("metric.value").alias("metric_value"),
        F.col("log.message").alias("message"),
        F.col("trace.duration_ns").alias("duration_ns"),
        F.col("event.name").alias("event_name"),
        F.col("attributes")["k"].alias("k"),
        F.col("tags")["region"].alias("region"),
    )


@query("src_json_batch", REC + JSON_ROWS.format(batch="'batch-' || CAST(event_id // 2000 AS VARCHAR)"))
def src_json_batch(spark, d):
    rec = records(spark, d)
    path = scratch(spark, "json-batches")
    _batches(rec, 2000).write.partitionBy("b").text(path)
    return _shown(files.json_batches(spark, path, newest(rec)))


@query(
    "src_jsonl",
    REC
    + """SELECT 'record' AS outcome, CASE WHEN k % 10 <> 1 THEN ts ELSE (SELECT max(ts) FROM rec) END AS timestamp,
       CASE WHEN event_type = 'error' THEN 'Log' WHEN event_type = 'view' THEN 'Trace' ELSE 'Metric' END AS record_type,
       CASE WHEN event_type = 'click' THEN 'unknown' WHEN event_type NOT IN ('error', 'view') THEN event_type END AS metric_name,
       CASE WHEN event_type IN ('error', 'view') THEN NULL WHEN k % 7 = 0 THEN 0.0 ELSE value END AS metric_value,
       log_message AS message, a_k AS k FROM rec WHERE k % 20 <> 0
    UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, 'not json ' || id, NULL FROM rec WHERE k % 20 = 0""",
)
def src_jsonl(spark, d):
    f = flat(spark, d)
    line = F.to_json(
        F.struct(
            F.when(F.col("k") % 10 != 1, tr.rfc3339(F.col("ts"))).alias("timestamp"),
            F.expr("CASE event_type WHEN 'error' THEN 'log' WHEN 'view' THEN 'trace' WHEN 'click' THEN 'metric' ELSE 'other' END").alias("type"),
            F.when(F.col("event_type") != "click", F.col("event_type")).alias("name"),
            F.when(F.col("k") % 7 != 0, F.col("value")).alias("value"),
            F.col("log_message").alias("message"),
            F.create_map(F.lit("k"), F.col("a_k")).alias("attributes"),
        )
    )
    text = F.when(F.col("k") % 20 == 0, F.concat(F.lit("not json "), F.col("id"))).otherwise(line)
    path = scratch(spark, "json-lines")
    f.select(text.alias("value")).write.text(path)
    good, bad = files.json_lines(spark, path, newest(f, "ts"))
    null = F.lit(None)
    return good.select(
        F.lit("record").alias("outcome"),
        "timestamp",
        "record_type",
        F.col("metric.name").alias("metric_name"),
        F.col("metric.value").alias("metric_value"),
        F.col("log.message").alias("message"),
        F.col("attributes")["k"].alias("k"),
    ).unionByName(
        bad.select(
            F.lit("rejected").alias("outcome"),
            null.cast("timestamp").alias("timestamp"),
            null.cast("string").alias("record_type"),
            null.cast("string").alias("metric_name"),
            null.cast("double").alias("metric_value"),
            F.col("line").alias("message"),
            null.cast("string").alias("k"),
        )
    )


@query(
    "src_csv",
    REC
    + """SELECT 'record' AS outcome, CASE WHEN k % 9 = 0 THEN (SELECT max(ts) FROM rec) ELSE ts END AS timestamp, event_type || '-' || id AS text,
       CASE WHEN k % 7 = 0 THEN 0.0 ELSE value END AS metric_value FROM rec WHERE k % 20 <> 0
    UNION ALL SELECT 'rejected', NULL, 'short,' || id, NULL FROM rec WHERE k % 20 = 0""",
)
def src_csv(spark, d):
    f = flat(spark, d)
    when = F.when(F.col("k") % 9 == 0, F.lit("soon")).otherwise(tr.rfc3339(F.col("ts")))
    number = F.when(F.col("k") % 7 == 0, F.lit("none")).otherwise(F.col("value").cast("string"))
    extra = F.when(F.col("k") % 2 == 0, F.lit(",more")).otherwise(F.lit(""))
    line = F.concat(when, F.lit(", "), "event_type", F.lit("-"), "id", F.lit(" , "), number, extra)
    text = F.when(F.col("k") % 20 == 0, F.concat(F.lit("short,"), F.col("id"))).otherwise(line)
    path = scratch(spark, "csv-lines")
    f.select(text.alias("value")).write.text(path)
    good, bad = files.csv_lines(spark, path, newest(f, "ts"))
    return good.select(
        F.lit("record").alias("outcome"), "timestamp", F.col("metric.name").alias("text"), F.col("metric.value").alias("metric_value")
    ).unionByName(
        bad.select(
            F.lit("rejected").alias("outcome"),
            F.lit(None).cast("timestamp").alias("timestamp"),
            F.col("line").alias("text"),
            F.lit(None).cast("double").alias("metric_value"),
        )
    )


WIDE_ROWS = """SELECT id, ts AS timestamp, record_type, batch_id, metric_name, metric_value, log_message AS message, duration_ns, event_name, a_k AS k, t_region AS region FROM rec"""


@query("src_parquet", REC + WIDE_ROWS)
def src_parquet(spark, d):
    path = scratch(spark, "wide")
    flatten.wide(records(spark, d)).write.parquet(path)
    return _shown(files.parquet_rows(spark, path))


DISCOVERED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("src_prefix_discovery", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in DISCOVERED))
def src_prefix_discovery(spark, d):
    """Copies of the tables below one prefix, found again by their files, with the rows of each."""
    prefix = scratch(spark, "prefix")
    for name in DISCOVERED:
        table(spark, d, name).write.parquet(f"{prefix}/{name}.parquet")
    return files.discovered_rows(spark, prefix)


@query(
    "src_register_table",
    "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus",
)
def src_register_table(spark, d):
    path = scratch(spark, "customer-csv")
    sinks.write_csv(table(spark, d, "customer"), path)
    files.register_files(spark, "scope_orders", f"{d}/orders.parquet")
    files.register_files(spark, "scope_customer", path, "csv")
    return spark.sql(
        """SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT c_mktsegment) AS segments
        FROM scope_orders JOIN scope_customer ON o_custkey = c_custkey GROUP BY o_orderstatus"""
    )


@query(
    "src_register_batch",
    REC + "SELECT record_type, count(*) AS n, min(ts) AS first_ts FROM rec WHERE event_id > 1 GROUP BY record_type",
)
def src_register_batch(spark, d):
    flatten.sql_rows(records(spark, d)).createOrReplaceTempView("scope_batch")
    return spark.sql(
        "SELECT record_type, count(*) AS n, min(timestamp) AS first_ts FROM scope_batch WHERE CAST(id AS BIGINT) > 1 GROUP BY record_type"
    )




@query(
    "src_kafka_json",
    REC
    + """, r AS (SELECT *, event_id % 5 AS c, (SELECT max(ts) FROM rec) AS clock FROM rec)
    SELECT 'record' AS outcome, id, CASE WHEN k % 10 <> 0 THEN ts ELSE clock END AS timestamp, record_type, metric_name, metric_value, log_message AS message FROM r WHERE c IN (0, 1)
    UNION ALL SELECT 'record', 'bus-' || CAST(event_id % 3 AS VARCHAR) || '-' || id, clock, 'Metric', CASE WHEN k % 2 = 0 THEN event_type ELSE 'unknown_metric' END, CASE WHEN k % 3 = 0 THEN 0.0 ELSE value END, NULL FROM r WHERE c = 2
    UNION ALL SELECT 'rejected', id, NULL, NULL, NULL, NULL, CASE WHEN c = 3 THEN 'broken {' || id ELSE '[' || id || ']' END FROM r WHERE c IN (3, 4)""",
)
def src_kafka_json(spark, d):
    f = flat(spark, d)
    rec = nest(f)
    one = _file_records(rec)
    case = F.col("id").cast("bigint") % 5
    k = F.col("attributes")["k"].cast("int")
    value = F.col("v")
    gauge = F.struct(F.when(k % 2 == 0, F.col("t")).alias("name"), F.when(k % 3 != 0, value).alias("value"))
    body = (
        F.when(case == 0, F.to_json(F.struct(F.lit("b").alias("id"), F.array(one).alias("records")), MICROS))
        .when(case == 1, F.to_json(F.struct("id", F.when(k % 10 != 0, F.col("timestamp")).alias("timestamp"), "record_type", one["data"].alias("data"), "attributes", "tags"), MICROS))
        .when(case == 2, F.to_json(gauge))
        .when(case == 3, F.concat(F.lit("broken {"), F.col("id")))
        .otherwise(F.concat(F.lit("["), F.col("id"), F.lit("]")))
    )
    extra = f.select(F.col("id"), F.col("event_type").alias("t"), F.col("value").alias("v"))
    messages = rec.join(extra, "id").select(
        F.col("id").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.lit("bus").alias("topic"),
        (F.col("id").cast("bigint") % 3).cast("int").alias("partition"),
        F.col("id").cast("bigint").alias("offset"),
        "timestamp",
    )
    good, bad = kafka.json_records(messages, newest(f, "ts"))
    null = F.lit(None)
    return good.select(
        F.lit("record").alias("outcome"),
        "id",
        "timestamp",
        "record_type",
        F.col("metric.name").alias("metric_name"),
        F.col("metric.value").alias("metric_value"),
        F.col("log.message").alias("message"),
    ).unionByName(
        bad.select(
            F.lit("rejected").alias("outcome"),
            F.col("offset").cast("string").alias("id"),
            null.cast("timestamp").alias("timestamp"),
            null.cast("string").alias("record_type"),
            null.cast("string").alias("metric_name"),
            null.cast("double").alias("metric_value"),
            F.col("payload").alias("message"),
        )
    )


# -- OTLP documents, 500 events each ------------------------------------------------


def _pair(key, kind, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))


def _pairs(*entries):
    """Key/value pairs of one array; each value struct has all four kinds, most of them null."""
    full = []
    for key, kind, value in entries:
        types = {"stringValue": "string", "intValue": "string", "doubleValue": "double", "boolValue": "boolean"}
        fields = [(value if n == kind else F.lit(None)).cast(t).alias(n) for n, t in types.items()]
        full.append(F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value")))
    return F.array(*full)


def nano():
    return F.unix_micros("ts") * 1000


def _documents(spark, f, item, outer, scope, items, label):
    """Write one OTLP document per 500 events and return the path."""
    rows = f.select(F.expr("event_id div 500").alias("b"), item.alias("x"))
    docs = rows.groupBy("b").agg(F.collect_list("x").alias("xs"))
    resource = F.struct(
        _pairs(
            ("service.name", "stringValue", F.concat(F.lit("svc"), (F.col("b") % 3).cast("string"))),
            ("shard", "intValue", F.col("b").cast("string")),
        ).alias("attributes")
    )
    inner = F.array(F.struct(F.col("xs").alias(items)))
    doc = F.struct(F.array(F.struct(resource.alias("resource"), inner.alias(scope))).alias(outer))
    path = scratch(spark, label)
    docs.select(F.to_json(doc).alias("value")).write.text(path, compression="gzip")
    return path


def metric_records(spark, d):
    """The events as OTLP metrics, written and read back."""
    f = flat(spark, d)
    kind = F.col("event_type")
    point = F.struct(
        F.when(F.col("k") != 0, nano().cast("string")).otherwise("0").alias("timeUnixNano"),
        F.when(kind.isin("click", "signup"), F.col("value")).alias("asDouble"),
        F.when(kind == "purchase", F.floor("value").cast("string")).alias("asInt"),
        F.when(kind == "view", F.col("k").cast("string")).alias("count"),
        _pairs(("user", "intValue", F.col("user_id").cast("string")), ("even", "boolValue", F.col("k") % 2 == 0)).alias("attributes"),
    )
    points = F.array(point)
    item = F.struct(
        F.concat(F.lit("m."), kind).alias("name"),
        F.col("metric_unit").alias("unit"),
        F.when(kind.isin("click", "error"), F.struct(points.alias("dataPoints"))).alias("gauge"),
        F.when(kind.isin("purchase", "signup"), F.struct(points.alias("dataPoints"), (kind == "purchase").alias("isMonotonic"))).alias("sum"),
        F.when(kind == "view", F.struct(points.alias("dataPoints"))).alias("histogram"),
    )
    path = _documents(spark, f, item, "resourceMetrics", "scopeMetrics", "metrics", "otlp-metrics")
    return otlp.metrics(otlp.read_documents(spark, path, otlp.METRICS), newest(f, "ts"))


@query(
    "src_otlp_metrics",
    REC
    + """SELECT CASE WHEN k = 0 THEN (SELECT max(ts) FROM rec) ELSE ts END AS timestamp, 'm.' || event_type AS name, CASE WHEN event_type = 'click' THEN 'Gauge' WHEN event_type = 'purchase' THEN 'Counter' WHEN event_type = 'signup' THEN 'Gauge' ELSE 'Histogram' END AS metric_type,
       CASE WHEN event_type = 'view' THEN k WHEN event_type = 'purchase' THEN CAST(floor(value) AS DOUBLE) ELSE value END AS value, a_user AS user_label, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
       'svc' || CAST(event_id // 500 % 3 AS VARCHAR) AS service, CAST(event_id // 500 AS VARCHAR) AS shard FROM rec WHERE event_type <> 'error'""",
)
def src_otlp_metrics(spark, d):
    out = metric_records(spark, d)
    return out.select(
        "timestamp",
        "metric.name",
        "metric.metric_type",
        "metric.value",
        F.col("metric.labels")["user"].alias("user_label"),
        F.col("metric.labels")["even"].alias("flag"),
        F.col("attributes")["service.name"].alias("service"),
        F.col("attributes")["shard"].alias("shard"),
    )


def log_records(spark, d):
    """The events as OTLP logs, written and read back."""
    f = flat(spark, d)
    body = F.struct(
        F.when(F.col("k") % 3 == 0, F.concat("event_type", F.lit(" done"))).alias("stringValue"),
        F.when(F.col("k") % 3 == 1, F.col("event_id").cast("string")).alias("intValue"),
    )
    item = F.struct(
        nano().cast("string").alias("timeUnixNano"),
        (F.col("k") % 27).alias("severityNumber"),
        F.concat(F.lit("S"), "a_k").alias("severityText"),
        body.alias("body"),
        _pairs(("region", "stringValue", F.col("t_region"))).alias("attributes"),
    )
    path = _documents(spark, f, item, "resourceLogs", "scopeLogs", "logRecords", "otlp-logs")
    return otlp.logs(otlp.read_documents(spark, path, otlp.LOGS), newest(f, "ts"))


@query(
    "src_otlp_logs",
    REC
    + """SELECT ts AS timestamp, CASE WHEN k % 27 BETWEEN 1 AND 4 THEN 'Trace' WHEN k % 27 BETWEEN 5 AND 8 THEN 'Debug' WHEN k % 27 BETWEEN 13 AND 16 THEN 'Warn'
       WHEN k % 27 BETWEEN 17 AND 20 THEN 'Error' WHEN k % 27 BETWEEN 21 AND 24 THEN 'Fatal' ELSE 'Info' END AS level,
       CASE k % 3 WHEN 0 THEN event_type || ' done' WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE '' END AS message, CAST(k % 27 AS INTEGER) AS severity_number,
       'S' || a_k AS severity_text, t_region AS region, 'svc' || CAST(event_id // 500 % 3 AS VARCHAR) AS service FROM rec""",
)
def src_otlp_logs(spark, d):
    out = log_records(spark, d)
    return out.select(
        "timestamp",
        "log.level",
        "log.message",
        "log.severity_number",
        "log.severity_text",
        F.col("tags")["region"].alias("region"),
        F.col("attributes")["service.name"].alias("service"),
    )


def span_records(spark, d):
    """The events as OTLP spans, written and read back."""
    f = flat(spark, d)
    b64 = lambda text, size=32: F.base64(F.unhex(F.left(F.md5(text), F.lit(size))))
    took = F.round(F.col("value") * 1_000_000).cast("bigint")
    item = F.struct(
        b64(F.col("a_user")).alias("traceId"),
        b64(F.col("id"), 16).alias("spanId"),
        F.when(F.col("k") % 2 == 0, b64(F.col("a_k"), 16)).alias("parentSpanId"),
        F.col("event_type").alias("name"),
        (F.col("k") % 7).alias("kind"),
        nano().cast("string").alias("startTimeUnixNano"),
        F.when(F.col("k") % 5 != 0, (nano() + took).cast("string")).alias("endTimeUnixNano"),
        F.struct((F.col("k") % 3).alias("code")).alias("status"),
        _pairs(("region", "stringValue", F.col("t_region"))).alias("attributes"),
        F.array(
            F.struct(
                nano().cast("string").alias("timeUnixNano"),
                F.lit("started").alias("name"),
                _pairs(("k", "intValue", F.col("a_k"))).alias("attributes"),
            )
        ).alias("events"),
        F.array(F.struct(b64(F.col("a_k")).alias("traceId"), b64(F.col("id"), 16).alias("spanId"))).alias("links"),
    )
    path = _documents(spark, f, item, "resourceSpans", "scopeSpans", "spans", "otlp-spans")
    return otlp.spans(otlp.read_documents(spark, path, otlp.SPANS), newest(f, "ts"))


@query(
    "src_otlp_spans",
    REC
    + """SELECT ts AS timestamp, md5(a_user) AS trace_id, left(md5(id), 16) AS span_id, CASE WHEN k % 2 = 0 THEN left(md5(a_k), 16) ELSE '' END AS parent_span_id, event_type AS name,
       CASE k % 7 WHEN 2 THEN 'Server' WHEN 3 THEN 'Client' WHEN 4 THEN 'Producer' WHEN 5 THEN 'Consumer' ELSE 'Internal' END AS kind,
       CASE k % 3 WHEN 1 THEN 'Ok' WHEN 2 THEN 'Error' ELSE 'Unset' END AS status_code, CASE WHEN k % 5 <> 0 THEN CAST(round(value * 1000000) AS BIGINT) END AS duration_ns,
       CASE WHEN k % 5 <> 0 THEN make_timestamp(epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) // 1000) END AS end_time,
       'started' AS event_0, ts AS event_0_at, a_k AS event_0_k, md5(a_k) AS link_0, t_region AS region FROM rec""",
)
def src_otlp_spans(spark, d):
    out = span_records(spark, d)
    t = F.col("trace")
    return out.select(
        "timestamp",
        *[t[n].alias(n) for n in ("trace_id", "span_id", "parent_span_id", "name", "kind", "status_code", "duration_ns", "end_time")],
        t["events"][0]["name"].alias("event_0"),
        t["events"][0]["timestamp"].alias("event_0_at"),
        t["events"][0]["attributes"]["k"].alias("event_0_k"),
        t["links"][0]["trace_id"].alias("link_0"),
        F.col("tags")["region"].alias("region"),
    )


@query(
    "src_record_ids",
    """SELECT 'otlp_metrics' AS source, count(*) AS n, count(*) AS ids FROM events WHERE event_type <> 'error' UNION ALL SELECT 'otlp_logs', count(*), count(*) FROM events
    UNION ALL SELECT 'otlp_spans', count(*), count(*) FROM events UNION ALL SELECT 'lines', 3 * count(*), 3 * count(*) FROM events UNION ALL SELECT 'csv', 3 * count(*), 3 * count(*) FROM events""",
)
def src_record_ids(spark, d):
    """Rows and distinct ids of every source that makes ids, with each line three times."""
    e = table(spark, d, "events")
    three = e.select("event_type", "value", F.explode(F.array(*[F.lit(0)] * 3)))
    clock = newest(e, "ts")
    lines, csv = scratch(spark, "same-lines"), scratch(spark, "same-csv")
    three.select(F.to_json(F.struct(F.col("event_type").alias("name"), "value")).alias("value")).write.text(lines)
    three.select(F.concat_ws(",", F.lit("now"), "event_type", F.col("value").cast("string")).alias("value")).write.text(csv)
    found = {
        "otlp_metrics": metric_records(spark, d),
        "otlp_logs": log_records(spark, d),
        "otlp_spans": span_records(spark, d),
        "lines": files.json_lines(spark, lines, clock)[0],
        "csv": files.csv_lines(spark, csv, clock)[0],
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


# -- layouts -------------------------------------------------------------------------


@query(
    "flat_wide14",
    REC
    + """SELECT id, ts AS timestamp, record_type, 'events' AS source, batch_id, metric_name, metric_value, metric_unit, log_message, log_level, duration_ns AS trace_duration_ns,
       event_name, a_url AS attributes_url, t_region AS tags_region FROM rec""",
)
def flat_wide14(spark, d):
    return flatten.wide(records(spark, d)).select(
        "*",
        F.get_json_object("attributes", "$.url").alias("attributes_url"),
        F.get_json_object("tags", "$.region").alias("tags_region"),
    ).drop("attributes", "tags")


@query(
    "flat_sql6",
    REC
    + "SELECT id, ts AS timestamp, record_type, CASE record_type WHEN 'Metric' THEN CAST(metric_value AS VARCHAR) WHEN 'Trace' THEN CAST(duration_ns AS VARCHAR) WHEN 'Log' THEN log_message ELSE event_name END AS value, 'events' AS source, batch_id FROM rec",
)
def flat_sql6(spark, d):
    return flatten.sql_rows(records(spark, d))


@query(
    "flat_spans9",
    REC
    + """SELECT id, ts AS timestamp, record_type, coalesce(CASE WHEN k % 6 = 2 THEN concat('own-', t_region) END, a_service, 'unknown') AS service_name, coalesce(span_name, 'unknown') AS operation_name,
       coalesce(duration_ns / 1e6, 0.0) AS duration_ms, coalesce(span_status, 'unknown') AS status_code, a_k AS attributes_k, t_region AS tags_region FROM rec""",
)
def flat_spans9(spark, d):
    return flatten.span_rows(records(spark, d)).select(
        "*", F.get_json_object("attributes", "$.k").alias("attributes_k"), F.get_json_object("tags", "$.region").alias("tags_region")
    ).drop("attributes", "tags")


@query("unflatten", REC + WIDE_ROWS)
def unflatten(spark, d):
    return _shown(flatten.from_wide(flatten.wide(records(spark, d))))


@query(
    "flat_dynamic_keys",
    REC
    + "SELECT id, a_env AS attr_env, a_k AS attr_k, a_service AS attr_service_name, a_status AS attr_status_code, a_url AS attr_url, a_user AS attr_user, t_region AS tag_region, t_service AS tag_service FROM rec",
)
def flat_dynamic_keys(spark, d):
    rec = records(spark, d).select("id", "attributes", "tags")
    named = flatten.spread_keys(rec, "attributes", "attr_", ["env", "k", "service.name", "status_code", "url", "user"])
    return flatten.spread_keys(named, "tags", "tag_", ["region", "service"])


@query(
    "flat_long_keys",
    REC
    + """SELECT * FROM (SELECT id, unnest(['env', 'k', 'service.name', 'status_code', 'url', 'user']) AS key, unnest([a_env, a_k, a_service, a_status, a_url, a_user]) AS value FROM rec) WHERE value IS NOT NULL
""",
)
def flat_long_keys(spark, d):
    return flatten.long_keys(records(spark, d).select("id", "attributes"), "attributes").filter("value is not null")


# -- sinks ---------------------------------------------------------------------------


@query("sink_json", "SELECT event_id AS id, event_type, value FROM events")
def sink_json(spark, d):
    path = scratch(spark, "out-json")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("sink_jsonl", REC + "SELECT id, record_type, metric_name, log_message AS message, a_k AS k FROM rec")
def sink_jsonl(spark, d):
    path = scratch(spark, "out-jsonl")
    rec = records(spark, d)
    sinks.write_json(rec, path)
    return spark.read.schema(rec.schema).json(path).select(
        "id", "record_type", F.col("metric.name").alias("metric_name"), F.col("log.message").alias("message"), F.col("attributes")["k"].alias("k")
    )


@query("sink_csv", REC + "SELECT id, record_type, 'events' AS source, a_url AS url FROM rec")
def sink_csv(spark, d):
    path = scratch(spark, "out-csv")
    sinks.write_csv(records(spark, d).select("id", "timestamp", "record_type", "source", "attributes"), path)
    back = spark.read.csv(path, header=True, escape='"')
    return back.select("id", "record_type", "source", F.get_json_object("attributes", "$.url").alias("url"))


@query("sink_parquet", "SELECT 'zstd' AS codec, count(*) AS n, round(sum(value), 6) AS total FROM events UNION ALL SELECT 'snappy', count(*), round(sum(value), 6) FROM events")
def sink_parquet(spark, d):
    out = None
    for codec in ("zstd", "snappy"):
        path = scratch(spark, f"out-{codec}")
        sinks.write_parquet(table(spark, d, "events"), path, codec)
        one = spark.read.parquet(path).agg(
            F.lit(codec).alias("codec"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "sink_modes",
    """SELECT 'append' AS mode, 2 * count(*) AS n, true AS many_files FROM events
    UNION ALL SELECT 'overwrite', count(*), true FROM events UNION ALL SELECT 'rotate', count(*), count(*) > 500 FROM events""",
)
def sink_modes(spark, d):
    rows = table(spark, d, "events")
    paths = {m: scratch(spark, f"out-{m}") for m in ("append", "overwrite", "rotate")}
    for mode in ("append", "overwrite"):
        for _ in range(2):
            sinks.write_parquet(rows, paths[mode], mode=mode)
    sinks.write_parquet(rows, paths["rotate"], rows_per_file=500)
    out = None
    for mode, path in paths.items():
        read = spark.read.parquet(path)
        several = F.countDistinct("_metadata.file_path") > 1 if mode == "rotate" else F.lit(True)
        one = read.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), several.alias("many_files"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "sink_partitioned",
    REC
    + """SELECT id, CASE record_type WHEN 'Metric' THEN 'telemetry_metrics' WHEN 'Trace' THEN 'telemetry_traces' WHEN 'Log' THEN 'telemetry_logs' ELSE 'telemetry_events' END AS "table",
       CAST(day(ts) AS INTEGER) AS day FROM rec WHERE record_type IN ('Log', 'Trace') AND day(ts) BETWEEN 3 AND 9""",
)
def sink_partitioned(spark, d):
    path = scratch(spark, "telemetry")
    sinks.write_partitioned(records(spark, d), path)
    back = spark.read.parquet(path)
    return back.filter(F.col("table").isin("telemetry_logs", "telemetry_traces") & F.col("day").between(3, 9)).select(
        "id", "table", "day"
    )


@query(
    "sink_fanout",
    REC
    + """SELECT id, 'monitoring' AS destination FROM rec UNION ALL SELECT id, 'alerting' FROM rec WHERE span_status = 'Error' OR log_level IN ('Error', 'Fatal')
    UNION ALL SELECT id, 'analytics' FROM rec WHERE metric_name LIKE '%business%'""",
)
def sink_fanout(spark, d):
    return sinks.fan_out(records(spark, d)).select("id", "destination")


@query("sink_compact", "SELECT count(*) AS before, count(*) AS after, true AS fewer_files FROM lineitem")
def sink_compact(spark, d):
    small, large = scratch(spark, "small"), scratch(spark, "large")
    table(spark, d, "lineitem").repartition(32).write.parquet(small)
    before, after = sinks.compact(spark, small, large)
    return spark.read.parquet(large).agg(
        F.lit(before).cast("bigint").alias("before"),
        F.count(F.lit(1)).alias("after"),
        (F.countDistinct("_metadata.file_path") < 32).alias("fewer_files"),
    )


@query(
    "sink_upsert_latest",
    """WITH a AS (SELECT user_id, event_type, ts, event_id, value, 0 AS new FROM events WHERE event_id % 3 <> 0
      UNION ALL SELECT user_id, event_type, ts, event_id, value * 2, 1 FROM events WHERE event_id % 3 = 0)
    SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, new DESC) AS rn FROM a) WHERE rn = 1""",
)
def sink_upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    changes = e.filter("event_id % 3 = 0").withColumn("value", F.col("value") * 2)
    return sinks.upsert_latest(e.filter("event_id % 3 <> 0"), changes, ["user_id", "event_type"], "ts")

@query(
    "sink_upsert_files",
    """WITH a AS (SELECT user_id, event_type, ts, event_id, value, 0 AS new FROM events WHERE event_id % 3 <> 0
      UNION ALL SELECT user_id, event_type, ts, event_id, value * 2, 1 FROM events WHERE event_id % 3 = 0 AND user_id <= (SELECT max(user_id) / 10 FROM events)),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, new DESC) AS rn FROM a)
    SELECT user_id, event_type, ts, event_id, value, true AS few FROM r WHERE rn = 1""",
)
def sink_upsert_files(spark, d):
    """Newest rows per user and type in files by user; changes of a tenth of the users rewrite few of them."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    keys, path = ["user_id", "event_type"], scratch(spark, "upserts")
    order = F.struct("ts", "event_id")
    first = sinks.upsert_latest(e.filter("event_id % 3 <> 0").withColumn("at", order), e.limit(0).withColumn("at", order), keys, "at")
    snapshots.create(first.repartitionByRange(16, "user_id"), path)
    tenth = e.agg(F.max("user_id") / 10).first()[0]
    changes = e.filter((F.col("event_id") % 3 == 0) & (F.col("user_id") <= tenth)).withColumn("value", F.col("value") * 2)
    rewritten, kept = snapshots.upsert(spark, path, changes.withColumn("at", order), keys, "at")
    return snapshots.read(spark, path).drop("at").withColumn("few", F.lit(0 < rewritten < kept))


@query(
    "sink_cluster",
    """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, (SELECT count(*) FROM lineitem WHERE l_partkey < 100 AND l_quantity < 10) AS picked, true AS fewer FROM lineitem""",
)
def sink_cluster(spark, d):
    """Compaction along a curve: all rows stay, and a filter on two columns needs fewer files."""
    path = scratch(spark, "clustered")
    rows = table(spark, d, "lineitem")
    before = snapshots.create(rows.repartition(16), path)
    size = snapshots.files(spark, path).agg(F.sum("bytes")).first()[0]
    after = snapshots.cluster(spark, path, ["l_partkey", "l_quantity"], file_bytes=-(-size // 16))
    wanted = (F.col("l_partkey") < 100) & (F.col("l_quantity") < 10)

    def needed(version):
        held = snapshots.read(spark, path, version).select("l_partkey", "l_quantity", F.col("_metadata.file_path").alias("file"))
        low = held.groupBy("file").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
        return low.filter(wanted).count()

    now = snapshots.read(spark, path)
    out = now.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count_if(wanted).alias("picked"))
    return out.withColumn("fewer", F.lit(needed(after) < needed(before)))


@query(
    "schema_evolve",
    """SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region, CAST(NULL AS VARCHAR) AS comment FROM nation
    UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS DOUBLE), 'supplier' FROM supplier""",
)
def schema_evolve(spark, d):
    old = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")
    )
    new = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("region", T.DoubleType()),
            T.StructField("comment", T.StringType()),
        ]
    )
    added = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("region"),
        F.lit("supplier").alias("comment"),
    )
    return schemas.evolve(old, new).unionByName(schemas.evolve(added, new))


@query(
    "schema_compat",
    """WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Backward' WHEN 2 THEN 'Forward' ELSE 'Full' END AS mode,
       c_custkey % 3 = 0 AS drops, c_custkey % 5 < 2 AS demands FROM customer)
    SELECT id, mode, CASE WHEN drops THEN 'name' ELSE '' END AS missing, CASE WHEN demands THEN 'extra' ELSE '' END AS demanding,
       CASE mode WHEN 'Backward' THEN NOT drops WHEN 'Forward' THEN NOT demands WHEN 'Full' THEN NOT drops AND NOT demands ELSE true END AS compatible FROM p""",
)
def schema_compat(spark, d):
    key = F.col("c_custkey")
    modes = F.array(*[F.lit(m) for m in ("None", "Backward", "Forward", "Full")])
    name = F.when(key % 3 == 0, "").otherwise('"name": {"type": "string"}, ')
    extra = F.when(key % 5 < 2, ', "extra": {"type": "string", "required": true}').otherwise(', "note": {"type": "string"}')
    pairs = table(spark, d, "customer").select(
        key.alias("id"),
        F.get(modes, (key % 4).cast("int")).alias("mode"),
        F.lit('{"properties": {"id": {"type": "string"}, "name": {"type": "string"}}}').alias("old"),
        F.concat(F.lit('{"properties": {'), name, F.lit('"id": {"type": "string"}'), extra, F.lit("}}")).alias("new"),
    )
    return schemas.compatibility(pairs).select(
        "id", "mode", F.array_join("missing", ",").alias("missing"), F.array_join("demanding", ",").alias("demanding"), "compatible"
    )
