"""The ingest flow end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.catalog.enrich_queries import DRAW
from sparkscope.catalog.io_queries import log_records, metric_records, span_records
from sparkscope.model import FLAT_SQL, flat, nest, newest
from sparkscope.operators.quality import NO_IDS, NO_NAME
from sparkscope.plans import ingest
from sparkscope.session import scratch, stage


def landed(spark, records):
    """The records as a landing folder of Parquet files, one per core, to ingest from."""
    return stage(records.repartition(spark.sparkContext.defaultParallelism), "landing")


@query(
    "ingest_flow",
    f"""WITH rec AS ({FLAT_SQL}), j AS (SELECT *, CASE WHEN record_type = 'Trace' AND k % 7 = 0 THEN '{NO_IDS}' WHEN record_type = 'Metric' AND k % 7 = 2 THEN '{NO_NAME}' END AS reason,
      CASE record_type WHEN 'Trace' THEN CASE WHEN span_status = 'Error' THEN 1.0 ELSE 0.1 END WHEN 'Log' THEN CASE WHEN log_level IN ('Error', 'Fatal') THEN 1.0 WHEN log_level = 'Warn' THEN 0.5 ELSE 0.1 END ELSE 1.0 END AS rate FROM rec)
    SELECT id, CASE WHEN reason IS NOT NULL THEN 'dead_letters' WHEN record_type = 'Metric' THEN 'telemetry_metrics' WHEN record_type = 'Trace' THEN 'telemetry_traces' WHEN record_type = 'Log' THEN 'telemetry_logs' ELSE 'telemetry_events' END AS "table",
      CAST(day(ts) AS INTEGER) AS day, reason AS reject_reason, CASE WHEN record_type = 'Metric' THEN CASE WHEN k % 7 = 2 THEN '' WHEN event_type = 'click' THEN 'http_click_latency_ms' ELSE 'business_purchase_total' END END AS metric,
      CASE WHEN record_type = 'Trace' THEN 'page.View' || CAST(k % 4 AS VARCHAR) END AS span, coalesce(a_service, t_service, CASE WHEN k % 6 = 2 THEN 'own-' || t_region END, 'unknown') AS service,
      coalesce(a_env, CASE WHEN k % 5 = 2 THEN 'dev' END, 'unknown') AS environment,
      CASE WHEN record_type = 'Metric' THEN CASE WHEN k % 7 = 2 THEN 'other' WHEN event_type = 'click' THEN 'http' ELSE 'business' END WHEN record_type = 'Trace' THEN 'service'
        WHEN record_type = 'Log' THEN CASE WHEN contains(log_message, 'info') THEN 'info' ELSE 'other' END END AS category, sha256(id) AS correlation_id
    FROM j WHERE reason IS NOT NULL OR {DRAW} < rate""",
)
def ingest_flow(spark, d):
    f = flat(spark, d)
    broken = f.withColumns(
        {
            "span_id": F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.col("span_id")),
            "metric_name": F.when(F.col("k") % 7 == 2, F.lit("")).otherwise(F.col("metric_name")),
        }
    )
    path = scratch(spark, "ingest")
    ingest.write(ingest.flow(landed(spark, nest(broken)), newest(f, "ts")), path)
    attr = lambda k: F.col("attributes")[k]
    return spark.read.parquet(path).select(
        "id",
        "table",
        "day",
        "reject_reason",
        F.col("metric.name").alias("metric"),
        F.col("trace.name").alias("span"),
        attr("service.name").alias("service"),
        attr("environment").alias("environment"),
        attr("category").alias("category"),
        attr("correlation_id").alias("correlation_id"),
    )


@query(
    "ingest_otlp",
    """SELECT 'otlp_metrics' AS source, count(*) AS n, count(*) AS ids, 0 AS without_id FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'otlp_logs', count(*), count(*), 0 FROM events UNION ALL SELECT 'otlp_spans', count(*), count(*), 0 FROM events""",
)
def ingest_otlp(spark, d):
    """OTLP documents through the flow: every record lands in a telemetry table, with the dead letters or with the rest."""
    every = metric_records(spark, d).unionByName(log_records(spark, d)).unionByName(span_records(spark, d))
    path = scratch(spark, "ingest-otlp")
    ingest.write(ingest.flow(every, newest(flat(spark, d), "ts"), keep_sampled_out=True), path)
    lost = F.sum((F.col("reject_reason") == ingest.NO_ID).cast("int"))
    return spark.read.parquet(path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.coalesce(lost, F.lit(0)).cast("int").alias("without_id")
    )
