"""Running streams: drains, micro-batch sinks, staged chains, continuous SQL and late rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkscope.session import scratch


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", interval: str | None = None):
    """Write a stream to Parquet; without ``interval`` it takes what is there and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode(mode)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def drain(df: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything that is there now and return what it appended."""
    spark = df.sparkSession
    out, checkpoint = scratch(spark, label), scratch(spark, label + "-checkpoint")
    start(df, out, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def to_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update", interval: str | None = None):
    """Write each micro-batch to ``path/batch=<n>``; writing a batch again replaces it."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def drain_batches(df: DataFrame, label: str, mode: str = "update") -> DataFrame:
    """Run a stream over everything that is there now; the result has a column ``batch``."""
    spark = df.sparkSession
    out, checkpoint = scratch(spark, label), scratch(spark, label + "-checkpoint")
    to_batches(df, out, checkpoint, mode).awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def latest(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last result of each key out of update-mode micro-batches."""
    rest = [c for c in batches.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "batch").alias("_last")
    return batches.groupBy(*keys).agg(newest).select(*keys, "_last.*").drop("batch")


@dataclass
class Chain:
    """Ordered stages over a stream or batch; a stage that cannot be planned is counted and skipped."""

    stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]
    skipped: dict[str, str] = field(default_factory=dict)

    def build(self, df: DataFrame) -> DataFrame:
        for name, stage in self.stages:
            try:
                df = stage(df)
                df.schema
            except AnalysisException as problem:
                self.skipped[name] = str(problem).splitlines()[0]
        return df


def continuous(spark: SparkSession, view: str, source: DataFrame, sql: str) -> DataFrame:
    """A SQL text over a streaming view; start it with a trigger interval to re-run it for ever."""
    source.createOrReplaceTempView(view)
    return spark.sql(sql)


def split_late(df: DataFrame, ts: str, delay_seconds: int, path: str, checkpoint: str):
    """Write rows in time to ``path/rows`` and rows behind the watermark to ``path/late``.

    A row is late when its time is more than the delay before the newest time of the
    earlier micro-batches. Each micro-batch notes its newest time in ``path/seen``, so a
    repeated batch decides the same way.
    """
    spark = df.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            # The note of the batch before holds the newest time of all batches up to it.
            limit = spark.read.parquet(f"{path}/seen/batch={batch - 1}").first()["us"] if batch else None
            newest = rows.agg(F.greatest(F.max(F.unix_micros(ts)), F.lit(limit).cast("bigint")).alias("us"))
            newest.write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")
            late = F.lit(False) if limit is None else F.unix_micros(ts) < limit - delay_seconds * 1_000_000
            rows.filter(~late).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
            rows.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        finally:
            rows.unpersist()

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start()
