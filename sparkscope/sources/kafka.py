"""Kafka messages: JSON payloads as records, unreadable ones as dead letters.

The functions take a frame with Kafka's columns (key, value, topic, partition,
offset, timestamp), so the same code runs on ``read`` / ``readStream`` with
``format("kafka")`` wherever that connector is installed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkscope.model import METRIC, STRINGS, as_record, as_struct
from sparkscope.sources.bodies import payload_columns
from sparkscope.sources.files import FILE_BATCH, FILE_RECORD

MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def stream(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Follow Kafka topics; needs Spark's Kafka connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", topics).options(**options).load()


def json_records(messages: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Records of JSON messages, and the messages that are no JSON object.

    A payload is read as a batch, else as one record, else as a bare gauge whose
    name defaults to ``unknown_metric`` and whose value defaults to 0.0.
    """
    text = F.col("value").cast("string")
    is_object = F.coalesce(F.try_parse_json(text).cast("string").startswith("{"), F.lit(False))
    read = messages.withColumns({"_text": text, "_ok": is_object})
    bad = read.filter(~F.col("_ok")).select("topic", "partition", "offset", F.col("_text").alias("payload"))

    at = lambda path: F.get_json_object("_text", path)
    kind = (
        F.when(at("$.records").isNotNull(), "batch")
        .when(at("$.data").isNotNull() & at("$.record_type").isNotNull(), "record")
        .otherwise("gauge")
    )
    known = read.filter("_ok").withColumn("_kind", kind)
    message_id = F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    batch = F.from_json("_text", FILE_BATCH)
    single = F.from_json("_text", FILE_RECORD)
    gauge = as_struct(
        METRIC,
        name=F.coalesce(at("$.name"), F.lit("unknown_metric")),
        description=at("$.description"),
        unit=at("$.unit"),
        metric_type=F.lit("Gauge"),
        value=F.coalesce(at("$.value").try_cast("double"), F.lit(0.0)),
    )
    wrapped = F.struct(
        message_id.alias("id"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit("Metric").alias("record_type"),
        F.lit(None).cast(FILE_RECORD["data"].dataType).alias("data"),
        F.lit(None).cast(STRINGS).alias("attributes"),
        F.lit(None).cast(STRINGS).alias("tags"),
    )
    rows = known.withColumn(
        "_records",
        F.when(F.col("_kind") == "batch", batch["records"])
        .when(F.col("_kind") == "record", F.array(single))
        .otherwise(F.array(wrapped)),
    ).withColumns({"_batch": F.when(F.col("_kind") == "batch", batch["id"]).otherwise(message_id)})
    rows = rows.withColumn("_gauge", F.when(F.col("_kind") == "gauge", gauge))
    exploded = rows.select("_batch", "_gauge", F.explode("_records").alias("r"))
    structs = payload_columns(F.col("r.data"))
    structs["metric"] = F.coalesce(F.col("_gauge"), structs["metric"])
    return (
        exploded.select(
            *as_record(
                id=F.col("r.id"),
                timestamp=F.coalesce(F.col("r.timestamp"), as_of),
                record_type=F.coalesce(F.col("r.record_type"), F.lit("Metric")),
                source=F.lit("kafka_json"),
                batch_id=F.col("_batch"),
                attributes=F.coalesce(F.col("r.attributes"), F.create_map().cast(STRINGS)),
                tags=F.coalesce(F.col("r.tags"), F.create_map().cast(STRINGS)),
                **structs,
            )
        ),
        bad,
    )
