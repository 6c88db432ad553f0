"""File sources: telemetry batches as JSON, JSON lines, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkscope.model import LOG, METRIC, STRINGS, TRACE, as_record, as_struct
from sparkscope.sources.bodies import PAYLOAD, payload_columns

FILE_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("data", PAYLOAD),
        T.StructField("attributes", STRINGS),
        T.StructField("tags", STRINGS),
    ]
)

FILE_BATCH = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("records", T.ArrayType(FILE_RECORD)),
        T.StructField("metadata", STRINGS),
    ]
)

LINE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def from_batches(batches: DataFrame, as_of: Column) -> DataFrame:
    """Exploded batches as canonical records; the type defaults to Metric, the time to ``as_of``."""
    rows = batches.select(
        F.col("id").alias("batch_id"), "source", F.explode("records").alias("r")
    )
    return rows.select(
        *as_record(
            id=F.col("r.id"),
            timestamp=F.coalesce(F.col("r.timestamp"), as_of),
            record_type=F.coalesce(F.col("r.record_type"), F.lit("Metric")),
            source=F.col("source"),
            batch_id=F.col("batch_id"),
            attributes=F.coalesce(F.col("r.attributes"), F.create_map().cast(STRINGS)),
            tags=F.coalesce(F.col("r.tags"), F.create_map().cast(STRINGS)),
            **payload_columns(F.col("r.data")),
        )
    )


def json_batches(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Files that hold one batch object, or an array of them, each."""
    return from_batches(spark.read.schema(FILE_BATCH).json(path, multiLine=True), as_of)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The lines below ``path`` as ``value``, each with an id of its own.

    The id hashes the line with its file, the block it was read from and its place there, so
    equal lines are separate records, and a task that runs again gives the same ids.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"), "value")
    return spark.read.text(path).select("value", F.sha2(F.to_json(place), 256).alias("line_id"))


def _line_records(lines: DataFrame, as_of: Column) -> DataFrame:
    """Simple ``{timestamp, type, name, value, message, attributes, tags}`` rows with a ``line_id`` as records."""
    kind = (
        F.when(F.col("type") == "log", "Log").when(F.col("type") == "trace", "Trace").otherwise("Metric")
    )
    ts = F.coalesce(F.col("timestamp").try_cast("timestamp"), as_of)
    typed = lines.withColumns({"_kind": kind, "_ts": ts})
    metric = as_struct(
        METRIC,
        name=F.coalesce("name", F.lit("unknown")),
        metric_type=F.lit("Gauge"),
        value=F.coalesce("value", F.lit(0.0)),
    )
    log = as_struct(LOG, level=F.lit("Info"), message=F.coalesce("message", F.lit("")))
    trace = as_struct(
        TRACE, name=F.lit("unknown"), kind=F.lit("Internal"), start_time=F.col("_ts"), end_time=F.col("_ts"), status_code=F.lit("Ok")
    )
    return typed.select(
        *as_record(
            id=F.col("line_id"),
            timestamp=F.col("_ts"),
            record_type=F.col("_kind"),
            source=F.lit("file"),
            metric=F.when(F.col("_kind") == "Metric", metric),
            log=F.when(F.col("_kind") == "Log", log),
            trace=F.when(F.col("_kind") == "Trace", trace),
            attributes=F.coalesce("attributes", F.create_map().cast(STRINGS)),
            tags=F.coalesce("tags", F.create_map().cast(STRINGS)),
        )
    )


def json_lines(spark: SparkSession, path: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Records of newline JSON, and the lines that are no JSON."""
    read = F.from_json("value", LINE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    lines = lines_of(spark, path).filter(F.trim("value") != "").withColumn("r", read)
    broken = F.col("r._corrupt_record").isNotNull()
    good = lines.filter(~broken).select("line_id", "r.*").drop("_corrupt_record")
    return _line_records(good, as_of), lines.filter(broken).select(F.col("value").alias("line"))


def csv_lines(spark: SparkSession, path: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Gauges of ``time,name,value[,...]`` lines below a header, and the lines with fewer fields.

    A value that is no number counts as 0.0 and a time that is none as ``as_of``.
    """
    lines = lines_of(spark, path).filter(~F.col("value").startswith("timestamp,"))
    parts = F.split("value", ",")
    cut = lines.withColumn("f", parts)
    ts = F.coalesce(F.get("f", F.lit(0)).try_cast("timestamp"), as_of)
    metric = as_struct(
        METRIC,
        name=F.trim(F.get("f", F.lit(1))),
        metric_type=F.lit("Gauge"),
        value=F.coalesce(F.trim(F.get("f", F.lit(2))).try_cast("double"), F.lit(0.0)),
    )
    records = cut.filter(F.size("f") >= 3).select(
        *as_record(
            id=F.col("line_id"),
            timestamp=ts,
            record_type=F.lit("Metric"),
            source=F.lit("file"),
            metric=metric,
            attributes=F.create_map().cast(STRINGS),
            tags=F.create_map().cast(STRINGS),
        )
    )
    return records, cut.filter(F.size("f") < 3).select(F.col("value").alias("line"))


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of flat wide Parquet files as canonical records."""
    from sparkscope.operators.flatten import from_wide

    return from_wide(spark.read.parquet(path))


def table_name(path: Column) -> Column:
    """A legal table name from a file path: its base name without ``.parquet``, odd characters as ``_``."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.parquet)+$", "")
    return F.regexp_replace(base, r"[^\p{L}\p{N}_]", "_")


def discover(spark: SparkSession, prefix: str) -> DataFrame:
    """Every ``.parquet`` file below ``prefix`` with the table name it gets and its size."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(prefix)
    )
    return files.select(table_name(F.col("path")).alias("table_name"), "path", "length")


def discovered_rows(spark: SparkSession, prefix: str) -> DataFrame:
    """The tables below ``prefix`` (folders or files named ``<table>.parquet``) and the rows of each."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema("_ int").parquet(prefix)
    name = table_name(F.regexp_extract("_metadata.file_path", r"([^/]+\.parquet)(/[^/]*)?$", 1))
    return rows.select(name.alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


def register_files(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    """Make a Parquet or CSV path a table that SQL can name."""
    reader = spark.read
    df = reader.parquet(path) if kind == "parquet" else reader.csv(path, header=True, inferSchema=True)
    df.createOrReplaceTempView(name)
    return df


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Follow a folder: each new file is read once."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)
