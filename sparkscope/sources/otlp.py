"""OTLP/JSON export documents, one per line, as canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkscope.model import LOG, METRIC, SPAN_EVENT, SPAN_LINK, STRINGS, TRACE, as_record, as_struct


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TEXT, FLAG, NUMBER = T.StringType(), T.BooleanType(), T.DoubleType()
ANY = _s(stringValue=TEXT, intValue=TEXT, doubleValue=NUMBER, boolValue=FLAG)
PAIRS = T.ArrayType(_s(key=TEXT, value=ANY))
RESOURCE = _s(attributes=PAIRS)

POINT = _s(timeUnixNano=TEXT, asDouble=NUMBER, asInt=TEXT, count=TEXT, attributes=PAIRS)
POINTS = T.ArrayType(POINT)
OTLP_METRIC = _s(
    name=TEXT,
    description=TEXT,
    unit=TEXT,
    gauge=_s(dataPoints=POINTS),
    sum=_s(dataPoints=POINTS, isMonotonic=FLAG),
    histogram=_s(dataPoints=POINTS),
)
METRICS = _s(
    resourceMetrics=T.ArrayType(
        _s(resource=RESOURCE, scopeMetrics=T.ArrayType(_s(metrics=T.ArrayType(OTLP_METRIC))))
    )
)

OTLP_LOG = _s(timeUnixNano=TEXT, severityNumber=T.IntegerType(), severityText=TEXT, body=ANY, attributes=PAIRS)
LOGS = _s(
    resourceLogs=T.ArrayType(
        _s(resource=RESOURCE, scopeLogs=T.ArrayType(_s(logRecords=T.ArrayType(OTLP_LOG))))
    )
)

OTLP_SPAN = _s(
    traceId=TEXT,
    spanId=TEXT,
    parentSpanId=TEXT,
    name=TEXT,
    kind=T.IntegerType(),
    startTimeUnixNano=TEXT,
    endTimeUnixNano=TEXT,
    status=_s(code=T.IntegerType(), message=TEXT),
    attributes=PAIRS,
    events=T.ArrayType(_s(timeUnixNano=TEXT, name=TEXT, attributes=PAIRS)),
    links=T.ArrayType(_s(traceId=TEXT, spanId=TEXT, attributes=PAIRS)),
)
SPANS = _s(
    resourceSpans=T.ArrayType(
        _s(resource=RESOURCE, scopeSpans=T.ArrayType(_s(spans=T.ArrayType(OTLP_SPAN))))
    )
)

# Span kinds and status codes by protocol number.
SPAN_KINDS = {1: "Internal", 2: "Server", 3: "Client", 4: "Producer", 5: "Consumer"}
STATUS_CODES = {1: "Ok", 2: "Error"}


def text_of(value: Column) -> Column:
    """An OTLP value as text; other kinds of value are the empty text."""
    return F.coalesce(
        value["stringValue"],
        value["intValue"],
        value["doubleValue"].cast("string"),
        value["boolValue"].cast("string"),
        F.lit(""),
    )


def pairs(entries: Column) -> Column:
    """OTLP key/value pairs as a string map; the last value of a repeated key stays."""
    items = F.coalesce(entries, F.array().cast(PAIRS))
    return F.map_from_entries(
        F.transform(items, lambda p: F.struct(p["key"].alias("key"), text_of(p["value"]).alias("value")))
    )


def nano_time(nanos: Column, as_of: Column) -> Column:
    """Unix nanoseconds as a time (to the microsecond); 0 or none is ``as_of``."""
    n = nanos.cast("bigint")
    return F.when(n > 0, F.timestamp_micros(F.call_function("div", n, F.lit(1000)))).otherwise(as_of)


def _choice(code: Column, names: dict[int, str], default: str) -> Column:
    out = F
    for number, name in names.items():
        out = out.when(code == number, name)
    return out.otherwise(default)


def read_documents(spark, path: str, schema: T.StructType) -> DataFrame:
    """The documents below ``path``, each with its file and its place there as ``_document``."""
    place = F.concat_ws("/", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string"), F.monotonically_increasing_id().cast("string"))
    return spark.read.schema(schema).json(path).select("*", place.alias("_document"))


def _down(df: DataFrame, *levels: str) -> DataFrame:
    """Explode resource -> scope -> item, keeping the resource attributes as ``_resource``.

    ``_place`` names the item: its document (by ``_document`` where there is one, else by its
    number in the frame), the document's content and the places on the way down.
    """
    outer, scope, item = levels
    number = F.col("_document") if "_document" in df.columns else F.monotonically_increasing_id().cast("string")
    content = F.xxhash64(F.to_json(F.struct(outer))).cast("string")
    df = df.select(F.concat_ws("/", number, content).alias("_d"), F.posexplode(outer).alias("_i", "_r"))
    df = df.select("_d", "_i", pairs(F.col("_r.resource.attributes")).alias("_resource"), F.posexplode(F.col("_r")[scope]).alias("_j", "_s"))
    df = df.select("_d", "_i", "_j", "_resource", F.posexplode(F.col("_s")[item]).alias("_k", "x"))
    return df.select(F.concat_ws("/", "_d", "_i", "_j", "_k").alias("_place"), "_resource", "x")


def metrics(docs: DataFrame, as_of: Column) -> DataFrame:
    """One record per data point that has a value; monotonic sums are counters, histograms count."""
    rows = _down(docs, "resourceMetrics", "scopeMetrics", "metrics")

    def points(kind: str, metric_type: Column, value) -> Column:
        data = F.coalesce(F.col("x")[kind]["dataPoints"], F.array().cast(POINTS))
        return F.transform(
            data,
            lambda p: F.struct(
                p["timeUnixNano"].alias("nano"),
                value(p).alias("value"),
                metric_type.alias("metric_type"),
                p["attributes"].alias("attributes"),
            ),
        )

    number = lambda p: F.coalesce(p["asDouble"], p["asInt"].cast("double"))
    monotonic = F.when(F.col("x.sum.isMonotonic"), "Counter").otherwise("Gauge")
    every = F.concat(
        points("gauge", F.lit("Gauge"), number),
        points("sum", monotonic, number),
        points("histogram", F.lit("Histogram"), lambda p: p["count"].cast("double")),
    )
    flat = rows.select("_place", "_resource", "x.name", "x.description", "x.unit", F.posexplode(every).alias("_p", "p"))
    metric = as_struct(
        METRIC,
        name=F.col("name"),
        description=F.coalesce("description", F.lit("")),
        unit=F.coalesce("unit", F.lit("")),
        metric_type=F.col("p.metric_type"),
        value=F.col("p.value"),
        labels=pairs(F.col("p.attributes")),
    )
    return flat.filter(F.col("p.value").isNotNull()).select(
        *as_record(
            id=F.sha2(F.concat_ws("/", "_place", "_p"), 256),
            timestamp=nano_time(F.col("p.nano"), as_of),
            record_type=F.lit("Metric"),
            source=F.lit("otlp_metrics"),
            metric=metric,
            attributes=F.col("_resource"),
            tags=F.create_map().cast(STRINGS),
        )
    )


def level(severity: Column) -> Column:
    """Log level of an OTLP severity number."""
    return (
        F.when(severity.between(1, 4), "Trace")
        .when(severity.between(5, 8), "Debug")
        .when(severity.between(9, 12), "Info")
        .when(severity.between(13, 16), "Warn")
        .when(severity.between(17, 20), "Error")
        .when(severity.between(21, 24), "Fatal")
        .otherwise("Info")
    )


def logs(docs: DataFrame, as_of: Column) -> DataFrame:
    rows = _down(docs, "resourceLogs", "scopeLogs", "logRecords")
    number = F.coalesce(F.col("x.severityNumber"), F.lit(0))
    message = text_of(F.col("x.body"))
    log = as_struct(
        LOG,
        level=level(number),
        message=message,
        body=message,
        severity_number=number,
        severity_text=F.coalesce(F.col("x.severityText"), F.lit("")),
    )
    return rows.select(
        *as_record(
            id=F.sha2("_place", 256),
            timestamp=nano_time(F.col("x.timeUnixNano"), as_of),
            record_type=F.lit("Log"),
            source=F.lit("otlp_logs"),
            log=log,
            attributes=F.col("_resource"),
            tags=pairs(F.col("x.attributes")),
        )
    )


def hex_id(encoded: Column) -> Column:
    """A base64 id as lower-case hex text."""
    return F.lower(F.hex(F.unbase64(encoded)))


def spans(docs: DataFrame, as_of: Column) -> DataFrame:
    rows = _down(docs, "resourceSpans", "scopeSpans", "spans")
    x = F.col("x")
    begin, end = x["startTimeUnixNano"].cast("bigint"), x["endTimeUnixNano"].cast("bigint")
    start = nano_time(x["startTimeUnixNano"], as_of)
    events = F.transform(
        F.coalesce(x["events"], F.array().cast(OTLP_SPAN["events"].dataType)),
        lambda e: as_struct(
            SPAN_EVENT, name=e["name"], timestamp=nano_time(e["timeUnixNano"], as_of), attributes=pairs(e["attributes"])
        ),
    )
    links = F.transform(
        F.coalesce(x["links"], F.array().cast(OTLP_SPAN["links"].dataType)),
        lambda l: as_struct(
            SPAN_LINK, trace_id=hex_id(l["traceId"]), span_id=hex_id(l["spanId"]), attributes=pairs(l["attributes"])
        ),
    )
    trace = as_struct(
        TRACE,
        trace_id=hex_id(x["traceId"]),
        span_id=hex_id(x["spanId"]),
        parent_span_id=F.coalesce(hex_id(x["parentSpanId"]), F.lit("")),
        name=x["name"],
        kind=_choice(x["kind"], SPAN_KINDS, "Internal"),
        start_time=start,
        end_time=F.when(end > 0, nano_time(x["endTimeUnixNano"], as_of)),
        duration_ns=F.when((begin > 0) & (end > 0), end - begin),
        status_code=_choice(x["status"]["code"], STATUS_CODES, "Unset"),
        events=events,
        links=links,
    )
    return rows.select(
        *as_record(
            id=F.sha2("_place", 256),
            timestamp=start,
            record_type=F.lit("Trace"),
            source=F.lit("otlp_spans"),
            trace=trace,
            attributes=F.col("_resource"),
            tags=pairs(x["attributes"]),
        )
    )
