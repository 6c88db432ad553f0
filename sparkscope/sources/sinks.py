"""File sinks: formats, modes, partitioned tables, destinations, compaction and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The table of each record kind.
TABLES = {"Metric": "telemetry_metrics", "Trace": "telemetry_traces", "Log": "telemetry_logs", "Event": "telemetry_events"}


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """CSV with a header; map columns become JSON text."""
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode(mode).csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", mode: str = "append", rows_per_file: int | None = None) -> None:
    """Compressed Parquet; ``rows_per_file`` starts a new file whenever one is full."""
    writer = df.write.mode(mode).option("compression", codec)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def routed(df: DataFrame) -> DataFrame:
    """Add the table and the year / month / day a record belongs to."""
    table = F
    for kind, name in TABLES.items():
        table = table.when(F.col("record_type") == kind, name)
    ts = F.col("timestamp")
    return df.withColumns(
        {"table": table, "year": F.year(ts), "month": F.month(ts), "day": F.day(ts)}
    )


DAY = ["table", "year", "month", "day"]


def write_balanced(df: DataFrame, path: str, mode: str = "append", keys: Sequence[str] = DAY) -> None:
    """Write below ``key=value/`` folders from tasks of about equal size.

    Rows are rebalanced by the keys: small values share a task, and one that holds a large
    share of all rows is split among as many tasks as its bytes ask for.
    """
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write records below ``table=/year=/month=/day=``."""
    write_balanced(routed(df), path, mode)


def destinations() -> Column:
    """Where a record goes: always monitoring, errors also alerting, business metrics also analytics."""
    kind = F.col("record_type")
    error = F.when(kind == "Trace", F.col("trace.status_code") == "Error").when(
        kind == "Log", F.col("log.level").isin("Error", "Fatal")
    )
    words = ("business", "user", "revenue", "conversion")
    business = F.lit(False)
    for word in words:
        business = business | F.col("metric.name").contains(word)
    business = (kind == "Metric") & business
    return F.array_compact(
        F.array(F.lit("monitoring"), F.when(error, F.lit("alerting")), F.when(business, F.lit("analytics")))
    )


def fan_out(df: DataFrame) -> DataFrame:
    """One row per record and destination."""
    return df.withColumn("destination", F.explode(destinations()))


def compact(spark: SparkSession, path: str, target: str, file_bytes: int = 128 << 20) -> tuple[int, int]:
    """Rewrite a table's many small files as files of about ``file_bytes`` in ``target``.

    Their number follows from the table's bytes. Returns the row counts before and after; they
    must agree before a swap.
    """
    before = spark.read.parquet(path)
    sizes = before.select("_metadata.file_path", "_metadata.file_size").distinct()
    total = sizes.agg(F.sum("file_size")).first()[0] or 0
    before.repartition(max(1, -(-total // file_bytes))).write.parquet(target)
    return before.count(), spark.read.parquet(target).count()


def upsert_latest(current: DataFrame, changes: DataFrame, keys: Sequence[str], precombine: str) -> DataFrame:
    """Current rows and changes, keeping for each key the row with the highest ``precombine``.

    A change wins a tie. The newest row is found by a partial aggregate, so a key
    with very many changes does not gather in one task.
    """
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    others = [c for c in current.columns if c not in keys and c != precombine]
    newest = F.max(F.struct(F.col(precombine), F.col("_new"), *others)).alias("_row")
    out = rows.groupBy(*keys).agg(newest)
    return out.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in current.columns])
