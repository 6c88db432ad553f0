"""Dead letters: failed rows kept as a table, queried, counted, expired and replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered
from sparkscope.operators.quality import classify_error
from sparkscope.sources.sinks import write_balanced


def letters(df: DataFrame, operation: Column, message: Column, retries: Column | None = None) -> DataFrame:
    """Rows of ``df`` (id, timestamp, source) as dead letters."""
    return df.select(
        "id",
        "timestamp",
        operation.alias("operation"),
        message.alias("error_message"),
        classify_error(message)["error_type"].alias("error_type"),
        "source",
        (F.lit(0) if retries is None else retries).cast("int").alias("retry_count"),
    )


def retained(df: DataFrame, max_records: int) -> DataFrame:
    """The newest ``max_records`` letters, by their positions: a retention setting, off unless asked for."""
    keyed = df.withColumn("_back", -F.unix_micros("timestamp"))
    return ordered.indexed(keyed, [], ["_back", "id"], "_i").filter(F.col("_i") < max_records).drop("_i", "_back")


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write letters partitioned by operation and day."""
    write_balanced(df.withColumn("day", F.to_date("timestamp")), path, mode, ["operation", "day"])


def find(
    df: DataFrame,
    operation: str | None = None,
    error_type: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Letters by operation, error type and time range, both ends included."""
    if operation is not None:
        df = df.filter(F.col("operation") == operation)
    if error_type is not None:
        df = df.filter(F.col("error_type") == error_type)
    if start is not None:
        df = df.filter(F.col("timestamp") >= start)
    if end is not None:
        df = df.filter(F.col("timestamp") <= end)
    return df


def stats(df: DataFrame) -> DataFrame:
    """Counts, mean retries and time span per operation, per error type and overall."""
    return df.groupingSets(
        [[F.col("operation")], [F.col("error_type")], []], F.col("operation"), F.col("error_type")
    ).agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.avg("retry_count"), 6).alias("avg_retries"),
        F.min("timestamp").alias("oldest"),
        F.max("timestamp").alias("newest"),
    )


def expire(df: DataFrame, as_of: Column, retention_seconds: int) -> DataFrame:
    """Letters younger than the retention."""
    micros = F.unix_micros(as_of) - retention_seconds * 1_000_000
    return df.filter(F.unix_micros("timestamp") > micros)


def replay(df: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """Letters taken out for another try (one retry more), and those that stay."""
    hit = F.coalesce(chosen, F.lit(False))
    return df.filter(hit).withColumn("retry_count", F.col("retry_count") + 1), df.filter(~hit)
