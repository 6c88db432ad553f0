"""Telemetry schemas, and the canonical views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

STRINGS = T.MapType(T.StringType(), T.StringType())

METRIC = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField(
            "buckets",
            T.ArrayType(
                T.StructType(
                    [T.StructField("upper_bound", T.DoubleType()), T.StructField("count", T.LongType())]
                )
            ),
        ),
        T.StructField(
            "quantiles",
            T.ArrayType(
                T.StructType(
                    [T.StructField("quantile", T.DoubleType()), T.StructField("value", T.DoubleType())]
                )
            ),
        ),
        T.StructField("sum", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("labels", STRINGS),
    ]
)

SPAN_EVENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("attributes", STRINGS),
    ]
)

SPAN_LINK = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("attributes", STRINGS),
    ]
)

TRACE = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("duration_ns", T.LongType()),
        T.StructField("status_code", T.StringType()),
        T.StructField("status_message", T.StringType()),
        T.StructField("events", T.ArrayType(SPAN_EVENT)),
        T.StructField("links", T.ArrayType(SPAN_LINK)),
    ]
)

LOG = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("severity_text", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("attributes", STRINGS),
        T.StructField("data", T.StringType()),
    ]
)

RESOURCE = T.StructType(
    [
        T.StructField("resource_type", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("attributes", STRINGS),
    ]
)

SERVICE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("instance_id", T.StringType()),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("metric", METRIC),
        T.StructField("trace", TRACE),
        T.StructField("log", LOG),
        T.StructField("event", EVENT),
        T.StructField("attributes", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("resource", RESOURCE),
        T.StructField("service", SERVICE),
    ]
)


def as_struct(schema: T.StructType, **fields: Column) -> Column:
    """A struct of ``schema`` with the given fields; the others are null."""
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def as_record(**fields: Column) -> list[Column]:
    """The select list of a canonical record with the given columns; the others are null."""
    return [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; a zone-less timestamp column that is left is cast, as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = {
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(zoned) if zoned else df


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (series, ts, id, value)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), "ts", F.col("event_id").alias("id"), "value"
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flat service telemetry, one row per request."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "Log").otherwise("Metric").alias("record_type"),
        F.col("event_type").alias("service_name"),
        F.col("user_id").cast("string").alias("tenant_id"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("props").alias("attributes"),
    )


SPANS_SQL = """
SELECT event_id AS id, ts AS timestamp,
       CASE event_type WHEN 'error' THEN 'Log' ELSE 'Metric' END AS record_type,
       event_type AS service_name, CAST(user_id AS VARCHAR) AS tenant_id,
       value AS duration_ms,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       props AS attributes
FROM events"""

SERIES_SQL = "SELECT event_type AS series, ts, event_id AS id, value FROM events"

_FLAT = {
    "id": "CAST(event_id AS STRING)",
    "ts": "ts",
    "record_type": "CASE event_type WHEN 'view' THEN 'Trace' WHEN 'error' THEN 'Log' WHEN 'signup' THEN 'Event' ELSE 'Metric' END",
    "batch_id": "CAST(event_id DIV 1000 AS STRING)",
    "metric_name": "CASE event_type WHEN 'click' THEN 'http.click-Latency ms' WHEN 'purchase' THEN 'business.purchase total' END",
    "metric_unit": "CASE event_type WHEN 'click' THEN 'ms' WHEN 'purchase' THEN 'eur' END",
    "metric_type": "CASE event_type WHEN 'click' THEN 'Gauge' WHEN 'purchase' THEN 'Counter' END",
    "metric_value": "CASE WHEN event_type IN ('click', 'purchase') THEN value END",
    "trace_id": "CASE WHEN event_type = 'view' THEN lpad(CAST(user_id AS STRING), 32, '0') END",
    "span_id": "CASE WHEN event_type = 'view' THEN lpad(CAST(event_id AS STRING), 16, '0') END",
    "span_name": "CASE WHEN event_type = 'view' THEN concat('  page::View', CAST(k % 4 AS STRING), '()  ') END",
    "span_status": "CASE WHEN event_type = 'view' THEN CASE WHEN k >= 90 THEN 'Error' WHEN k < 10 THEN 'Unset' ELSE 'Ok' END END",
    "duration_ns": "CASE WHEN event_type = 'view' THEN CAST(round(value * 1000000) AS BIGINT) END",
    "log_level": "CASE WHEN event_type = 'error' THEN CASE WHEN k < 10 THEN 'Fatal' WHEN k < 40 THEN 'Error' WHEN k < 60 THEN 'Warn' ELSE 'Info' END END",
    "log_message": "CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN concat('connection timeout after ', CAST(k AS STRING), ' ms') WHEN 1 THEN concat('user authentication failed for u', CAST(user_id AS STRING)) WHEN 2 THEN concat('disk full on node ', CAST(k AS STRING)) ELSE concat('request done info k=', CAST(k AS STRING)) END END",
    "event_name": "CASE WHEN event_type = 'signup' THEN CASE WHEN k % 10 = 0 THEN ' ' ELSE 'signup' END END",
    "a_k": "CAST(k AS STRING)",
    "a_user": "CAST(user_id AS STRING)",
    "a_service": "CASE WHEN k % 3 = 0 THEN concat('svc-', CAST(user_id % 7 AS STRING)) END",
    "a_env": "CASE k % 5 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' END",
    "a_url": "concat('https://host', CAST(user_id % 3 AS STRING), '.example.com:8080/p/', CAST(k AS STRING), '?q=', CAST(k AS STRING))",
    "a_status": "CASE WHEN k % 11 = 0 THEN 'n/a' WHEN event_type = 'error' THEN '500' ELSE '200' END",
    "t_region": "concat('r', CAST(user_id % 5 AS STRING))",
    "t_service": "CASE WHEN k % 3 = 1 THEN concat('tag-', CAST(user_id % 4 AS STRING)) END",
    "value": "value",
    "user_id": "user_id",
    "event_type": "event_type",
    "event_id": "event_id",
    "k": "k",
}


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the scalar fields of the four record kinds worked out by rule."""
    keyed = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    )
    return keyed.select(*[F.expr(text).alias(name) for name, text in _FLAT.items()])


FLAT_SQL = (
    "SELECT "
    + ", ".join(
        f"{text.replace('STRING', 'VARCHAR').replace('event_id DIV 1000', 'event_id // 1000')} AS {name}"
        for name, text in _FLAT.items()
    )
    + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e"
)


def string_map(**entries: Column) -> Column:
    """A string map without the entries whose value is null."""
    pairs = [F.struct(F.lit(name).alias("key"), col.cast("string").alias("value")) for name, col in entries.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as canonical nested records of all four kinds."""
    return nest(flat(spark, sf_dir))


def nest(f: DataFrame) -> DataFrame:
    """The nested records of a frame in the shape of :func:`flat`."""
    col = F.col
    metric = F.when(
        col("record_type") == "Metric",
        as_struct(
            METRIC,
            name=col("metric_name"),
            description=F.concat(F.lit("per "), col("event_type")),
            unit=col("metric_unit"),
            metric_type=col("metric_type"),
            value=col("metric_value"),
            labels=string_map(kind=col("event_type"), bucket=(col("k") % 10)),
        ),
    )
    end = F.timestamp_micros(F.unix_micros("ts") + F.expr("duration_ns div 1000"))
    trace = F.when(
        col("record_type") == "Trace",
        as_struct(
            TRACE,
            trace_id=col("trace_id"),
            span_id=col("span_id"),
            name=col("span_name"),
            kind=F.lit("Server"),
            start_time=col("ts"),
            end_time=end,
            duration_ns=col("duration_ns"),
            status_code=col("span_status"),
            events=F.array(
                as_struct(SPAN_EVENT, name=F.lit("start"), timestamp=col("ts"), attributes=string_map(k=col("k")))
            ),
            links=F.array(as_struct(SPAN_LINK, trace_id=col("trace_id"), span_id=col("span_id"))),
        ),
    )
    log = F.when(
        col("record_type") == "Log",
        as_struct(
            LOG,
            level=col("log_level"),
            message=col("log_message"),
            body=col("log_message"),
            severity_number=(col("k") % 30),
            severity_text=F.upper(col("log_level")),
        ),
    )
    event = F.when(
        col("record_type") == "Event",
        as_struct(
            EVENT,
            name=col("event_name"),
            timestamp=col("ts"),
            attributes=F.when(col("k") % 2 == 0, string_map(k=col("k"))).otherwise(F.create_map().cast(STRINGS)),
            data=F.concat(F.lit('{"k":'), col("k").cast("string"), F.lit("}")),
        ),
    )
    attributes = F.map_from_entries(
        F.filter(
            F.array(
                *[
                    F.struct(F.lit(key).alias("key"), col(name).alias("value"))
                    for key, name in (
                        ("k", "a_k"),
                        ("user", "a_user"),
                        ("service.name", "a_service"),
                        ("env", "a_env"),
                        ("url", "a_url"),
                        ("status_code", "a_status"),
                    )
                ]
            ),
            lambda p: p["value"].isNotNull(),
        )
    )
    return f.select(
        *as_record(
            id=col("id"),
            timestamp=col("ts"),
            record_type=col("record_type"),
            source=F.lit("events"),
            batch_id=col("batch_id"),
            metric=metric,
            trace=trace,
            log=log,
            event=event,
            attributes=attributes,
            tags=string_map(region=col("t_region"), service=col("t_service")),
            resource=as_struct(
                RESOURCE,
                resource_type=F.lit("host"),
                resource_id=col("t_region"),
                attributes=string_map(environment=F.when(col("k") % 5 == 2, "dev")),
            ),
            service=F.when(col("k") % 6 == 2, as_struct(SERVICE, name=F.concat(F.lit("own-"), col("t_region")))),
        )
    )


def newest(df: DataFrame, column: str = "timestamp") -> Column:
    """The newest time in ``df`` as a constant; it stands in for the clock."""
    micros = df.agg(F.max(F.unix_micros(column)).alias("m")).first()["m"]
    return F.timestamp_micros(F.lit(micros).cast("bigint"))
