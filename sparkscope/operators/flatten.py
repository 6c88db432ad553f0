"""Nested records to and from the flat table layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.model import EVENT, LOG, METRIC, STRINGS, TRACE, as_record, as_struct


def metric_number() -> Column:
    """The metric's value, or the sum of a histogram or summary."""
    return F.coalesce(F.col("metric.value"), F.col("metric.sum"))


def wide(df: DataFrame) -> DataFrame:
    """The 14-column flat table."""
    return df.select(
        "id",
        "timestamp",
        "record_type",
        "source",
        "batch_id",
        F.col("metric.name").alias("metric_name"),
        metric_number().alias("metric_value"),
        F.col("metric.unit").alias("metric_unit"),
        F.col("log.message").alias("log_message"),
        F.col("log.level").alias("log_level"),
        F.col("trace.duration_ns").alias("trace_duration_ns"),
        F.col("event.name").alias("event_name"),
        F.coalesce(F.to_json("attributes"), F.lit("{}")).alias("attributes"),
        F.coalesce(F.to_json("tags"), F.lit("{}")).alias("tags"),
    )


def from_wide(df: DataFrame) -> DataFrame:
    """The 14-column flat table as canonical records; what it does not hold stays null."""
    kind, ts = F.col("record_type"), F.col("timestamp")
    metric = as_struct(
        METRIC,
        name=F.coalesce("metric_name", F.lit("unknown")),
        unit=F.col("metric_unit"),
        metric_type=F.lit("Gauge"),
        value=F.coalesce("metric_value", F.lit(0.0)),
    )
    log = as_struct(LOG, level=F.coalesce("log_level", F.lit("Info")), message=F.coalesce("log_message", F.lit("")))
    micros = F.expr("trace_duration_ns div 1000")
    trace = as_struct(
        TRACE,
        kind=F.lit("Internal"),
        start_time=ts,
        end_time=F.timestamp_micros(F.unix_micros(ts) + micros),
        duration_ns=F.col("trace_duration_ns"),
        status_code=F.lit("Ok"),
    )
    event = as_struct(EVENT, name=F.coalesce("event_name", F.lit("unknown")), timestamp=ts)
    return df.select(
        *as_record(
            id=F.col("id"),
            timestamp=ts,
            record_type=kind,
            source=F.col("source"),
            batch_id=F.col("batch_id"),
            metric=F.when(kind == "Metric", metric),
            log=F.when(kind == "Log", log),
            trace=F.when(kind == "Trace", trace),
            event=F.when(kind == "Event", event),
            attributes=F.from_json("attributes", STRINGS),
            tags=F.from_json("tags", STRINGS),
        )
    )


def sql_rows(df: DataFrame) -> DataFrame:
    """The 6-column table: one text value per record, whatever its kind."""
    value = (
        F.when(F.col("record_type") == "Metric", metric_number().cast("string"))
        .when(F.col("record_type") == "Trace", F.coalesce(F.col("trace.duration_ns"), F.lit(0)).cast("string"))
        .when(F.col("record_type") == "Log", F.col("log.message"))
        .otherwise(F.col("event.name"))
    )
    return df.select("id", "timestamp", "record_type", value.alias("value"), "source", "batch_id")


def span_rows(df: DataFrame) -> DataFrame:
    """The 9-column service table, with defaults for what a record does not have."""
    service = F.coalesce(F.col("service.name"), F.col("attributes")["service.name"], F.lit("unknown"))
    return df.select(
        "id",
        "timestamp",
        "record_type",
        service.alias("service_name"),
        F.coalesce(F.col("trace.name"), F.lit("unknown")).alias("operation_name"),
        F.coalesce(F.col("trace.duration_ns") / 1e6, F.lit(0.0)).alias("duration_ms"),
        F.coalesce(F.col("trace.status_code"), F.lit("unknown")).alias("status_code"),
        F.to_json("attributes").alias("attributes"),
        F.to_json("tags").alias("tags"),
    )


def long_keys(df: DataFrame, column: str, id: str = "id") -> DataFrame:
    """One row (id, key, value) per entry of a map column, for any number of keys."""
    return df.select(id, F.explode(column))


def spread_keys(df: DataFrame, column: str, prefix: str, keys: list[str]) -> DataFrame:
    """One ``<prefix><key>`` column for each of these keys of a map column; the map column goes."""
    legal = lambda k: "".join(c if c.isalnum() or c == "_" else "_" for c in k)
    return df.withColumns({prefix + legal(k): F.col(column)[k] for k in keys}).drop(column)
