"""The ingest flow: judge, normalise, enrich, sample and route records in one pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import enrich, quality, transforms as tr
from sparkscope.sources.sinks import routed, write_balanced

DEAD_LETTERS = "dead_letters"
SAMPLED_OUT = "sampled_out"
NO_ID = "Record has no id"


def refine(records: DataFrame) -> DataFrame:
    """Normalised metric and span names, categories, service, environment and correlation ids."""
    metric = F.col("metric").withField("name", tr.metric_name(F.col("metric.name")))
    trace = F.col("trace").withField("name", tr.span_name(F.col("trace.name")))
    named = records.withColumns({"metric": metric, "trace": trace})
    category = (
        F.when(F.col("record_type") == "Metric", tr.category(F.col("metric.name"), tr.METRIC_CATEGORIES, "other"))
        .when(F.col("record_type") == "Log", tr.category(F.col("log.message"), tr.LOG_CATEGORIES, "other"))
        .when(F.col("record_type") == "Trace", tr.category(F.col("trace.name"), tr.SERVICE_CATEGORIES, "service"))
    )
    extra = {
        "category": category,
        "service.name": F.coalesce(enrich.service_found(), F.lit("unknown")),
        "environment": F.coalesce(enrich.environment_found(), F.lit("unknown")),
        "correlation_id": enrich.correlation_id(),
    }
    return named.withColumn("attributes", tr.put_all(F.col("attributes"), extra))


def flow(records: DataFrame, as_of: Column, keep_sampled_out: bool = False) -> DataFrame:
    """Every record with its table and day: telemetry tables for good rows, ``dead_letters`` for the rest.

    Rejected rows carry their reason; rows without an id are among them. Rows that sampling leaves out are dropped, or kept
    under ``sampled_out`` on request. Batch and stream frames both go through unchanged
    code, and the source is read once.
    """
    reason = F.coalesce(quality.reject_reason(as_of), F.when(F.col("id").isNull(), F.lit(NO_ID)))
    judged = records.withColumn("reject_reason", reason)
    bad = F.col("reject_reason").isNotNull()
    rate = enrich.severity_rate()
    kept = (rate >= 1) | F.coalesce(enrich.chance(F.col("id")) < rate, F.lit(False))
    if keep_sampled_out:
        judged = judged.withColumn("_out", ~kept)
    else:
        # Sampling comes before the costly steps, so rows that are left out cost little.
        judged = judged.filter(bad | kept).withColumn("_out", F.lit(False))
    table = F.when(bad, DEAD_LETTERS).when(F.col("_out"), SAMPLED_OUT).otherwise(F.col("table"))
    return routed(refine(judged)).withColumn("table", table).drop("_out")


def write(flowed: DataFrame, path: str, mode: str = "append") -> None:
    """Write below ``table=/year=/month=/day=``; a day with many rows is shared by many tasks."""
    write_balanced(flowed, path, mode)


def write_stream(flowed: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """The same on a stream."""
    writer = flowed.writeStream.format("parquet").partitionBy("table", "year", "month", "day")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
