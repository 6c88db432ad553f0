"""The ``data`` object of a record in JSON: one of Metric, Trace, Log or Event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from sparkscope.model import EVENT, LOG, METRIC, SPAN_EVENT, SPAN_LINK, STRINGS, TRACE, as_struct


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NUMBER, TEXT, COUNT, TIME = T.DoubleType(), T.StringType(), T.LongType(), T.TimestampType()

VALUE = _s(
    Counter=NUMBER,
    Gauge=NUMBER,
    Histogram=_s(buckets=METRIC["buckets"].dataType, sum=NUMBER, count=COUNT),
    Summary=_s(quantiles=METRIC["quantiles"].dataType, sum=NUMBER, count=COUNT),
)

PAYLOAD = _s(
    Metric=_s(name=TEXT, description=TEXT, unit=TEXT, metric_type=TEXT, value=VALUE, labels=STRINGS, timestamp=TIME),
    Trace=_s(
        trace_id=TEXT,
        span_id=TEXT,
        parent_span_id=TEXT,
        name=TEXT,
        kind=TEXT,
        start_time=TIME,
        end_time=TIME,
        duration_ns=COUNT,
        status=_s(code=TEXT, message=TEXT),
        attributes=STRINGS,
        events=T.ArrayType(SPAN_EVENT),
        links=T.ArrayType(SPAN_LINK),
    ),
    Log=_s(
        timestamp=TIME,
        level=TEXT,
        message=TEXT,
        attributes=STRINGS,
        body=TEXT,
        severity_number=T.IntegerType(),
        severity_text=TEXT,
    ),
    Event=_s(name=TEXT, timestamp=TIME, attributes=STRINGS, data=TEXT),
)


def payload_columns(data: Column) -> dict[str, Column]:
    """The four canonical structs of a payload; those of other kinds are null."""
    m, t, l, e = data["Metric"], data["Trace"], data["Log"], data["Event"]
    v = m["value"]
    metric = as_struct(
        METRIC,
        **{n: m[n] for n in ("name", "description", "unit", "metric_type", "labels")},
        value=F.coalesce(v["Counter"], v["Gauge"]),
        buckets=v["Histogram"]["buckets"],
        quantiles=v["Summary"]["quantiles"],
        sum=F.coalesce(v["Histogram"]["sum"], v["Summary"]["sum"]),
        count=F.coalesce(v["Histogram"]["count"], v["Summary"]["count"]),
    )
    same = ("trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", "duration_ns", "events", "links")
    trace = as_struct(
        TRACE, **{n: t[n] for n in same}, status_code=t["status"]["code"], status_message=t["status"]["message"]
    )
    log = as_struct(LOG, **{f.name: l[f.name] for f in LOG.fields})
    event = as_struct(EVENT, **{f.name: e[f.name] for f in EVENT.fields})
    return {
        "metric": F.when(m.isNotNull(), metric),
        "trace": F.when(t.isNotNull(), trace),
        "log": F.when(l.isNotNull(), log),
        "event": F.when(e.isNotNull(), event),
    }


def payload(metric: Column, trace: Column, log: Column, event: Column, timestamp: Column) -> Column:
    """The canonical structs as the one ``data`` object that file formats hold."""
    summed = lambda kind, part: F.struct(
        metric[part].alias(part), metric["sum"].alias("sum"), metric["count"].alias("count")
    )
    kind = metric["metric_type"]
    value = F.struct(
        F.when(kind == "Counter", metric["value"]).alias("Counter"),
        F.when(kind == "Gauge", metric["value"]).alias("Gauge"),
        F.when(kind == "Histogram", summed(kind, "buckets")).alias("Histogram"),
        F.when(kind == "Summary", summed(kind, "quantiles")).alias("Summary"),
    )
    m = F.struct(
        *[metric[n].alias(n) for n in ("name", "description", "unit", "metric_type")],
        value.alias("value"),
        metric["labels"].alias("labels"),
        timestamp.alias("timestamp"),
    )
    same = ("trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", "duration_ns")
    t = F.struct(
        *[trace[n].alias(n) for n in same],
        F.struct(trace["status_code"].alias("code"), trace["status_message"].alias("message")).alias("status"),
        trace["events"].alias("events"),
        trace["links"].alias("links"),
    )
    l = F.struct(timestamp.alias("timestamp"), *[log[f.name].alias(f.name) for f in LOG.fields])
    return F.struct(
        F.when(metric.isNotNull(), m).alias("Metric"),
        F.when(trace.isNotNull(), t).alias("Trace"),
        F.when(log.isNotNull(), l).alias("Log"),
        event.alias("Event"),
    )
