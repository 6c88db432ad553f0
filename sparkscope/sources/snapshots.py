"""Tables as lists of Parquet files: upserts that rewrite touched files only, compaction that clusters rows.

Each version of a table is a written list of its files (with row counts); data files are never changed. A version counts once
Spark has committed its list, so a job that dies leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkscope.session import stage
from sparkscope.sources.sinks import upsert_latest

#: Intervals into which a clustering column is cut, as a power of two.
CURVE_BITS = 8


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _version(spark: SparkSession, path: str) -> int:
    """The newest committed version, or -1."""
    fs, at = _fs(spark, f"{path}/versions")
    if not fs.exists(at):
        return -1
    names = [int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(names, default=-1)


def files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files (file, rows, bytes) of a version, by default the newest."""
    return spark.read.parquet(f"{path}/versions/v{_version(spark, path) if version is None else version}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version."""
    return spark.read.parquet(*[r["file"] for r in files(spark, path, version).select("file").collect()])


def _added(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows")).select("file", "rows", "bytes")


def _commit(spark: SparkSession, path: str, df: DataFrame, kept: DataFrame | None, rows_per_file: int | None) -> int:
    """Write ``df`` as new files and list them with the kept ones as the next version."""
    version = _version(spark, path) + 1
    folder = f"{path}/data/v{version}"
    writer = df.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(folder)
    added = _added(spark, folder)
    listed = added if kept is None else kept.unionByName(added)
    # Few rows, one per file: one small list.
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v{version}")
    return version


def create(df: DataFrame, path: str, rows_per_file: int | None = None) -> int:
    """A new table, or a new version that replaces all files."""
    return _commit(df.sparkSession, path, df, None, rows_per_file)


def upsert(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], precombine: str, rows_per_file: int | None = None) -> tuple[int, int]:
    """Merge ``changes`` into a table and return how many files were rewritten and how many kept.

    For each key the row with the highest ``precombine`` stays, a change on a tie. Keys not there yet are added. Files are found
    by their key columns alone: the range of the changed keys reaches the scan as a filter, so row groups and
    files outside it are skipped by their statistics, then a semi join on the keys names the files that hold one. Only those are read whole and
    written anew; all others are listed again as they are.
    """
    own = files(spark, path)
    bounds = changes.agg(*[x for k in keys for x in (F.min(k).alias(f"lo_{k}"), F.max(k).alias(f"hi_{k}"))]).first()
    if bounds[f"lo_{keys[0]}"] is None and changes.isEmpty():
        return 0, own.count()
    table = read(spark, path)
    near = table.select(*keys, F.col("_metadata.file_path").alias("file"))
    for k in keys:
        if bounds[f"lo_{k}"] is not None:
            inside = F.col(k).between(F.lit(bounds[f"lo_{k}"]), F.lit(bounds[f"hi_{k}"]))
            near = near.filter(inside | F.col(k).isNull())
    wanted = changes.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    found = stage(near.join(wanted, on, "left_semi").select("file").distinct(), "touched")
    touched, kept = [r["file"] for r in found.collect()], own.join(found, "file", "left_anti")
    old = spark.read.schema(table.schema).parquet(*touched) if touched else table.limit(0)
    _commit(spark, path, upsert_latest(old, changes.select(*table.columns), keys, precombine), kept, rows_per_file)
    return len(touched), own.count() - len(touched)


def curve(df: DataFrame, columns: Sequence[str]) -> Column:
    """A place on a Z-order curve: the bits of each column's interval, interleaved.

    Intervals hold about equally many rows, by an approximate quantile sketch; columns are numbers or times, nulls come first.
    """
    steps = 1 << CURVE_BITS
    number = lambda c: (F.unix_micros(c) if df.schema[c].dataType.typeName() == "timestamp" else F.col(c)).cast("double")

    def place_of(value: Column, bounds: Column) -> Column:
        """The number of bounds at or below the value, found in steps of falling powers of two."""
        halves = F.array(*[F.lit(1 << b) for b in reversed(range(CURVE_BITS))])
        return F.aggregate(halves, F.lit(0), lambda i, h: i + F.when(value >= F.get(bounds, i + h - 1), h).otherwise(0))

    cuts = df.agg(*[F.percentile_approx(number(c), [i / steps for i in range(1, steps)], 10_000).alias(c) for c in columns]).first()
    out = F.lit(0).cast("bigint")
    for at, c in enumerate(columns):
        bounds = F.array(*[F.lit(float(v)) for v in (cuts[c] or [0.0] * (steps - 1))])
        place = place_of(number(c), bounds)
        for b in range(CURVE_BITS):
            bit = F.shiftright(place, b).bitwiseAND(F.lit(1)).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(bit, b * len(columns) + at))
    return out


def cluster(spark: SparkSession, path: str, columns: Sequence[str], file_bytes: int = 128 << 20) -> int:
    """Rewrite a table as files of about ``file_bytes`` whose rows are near each other in all ``columns``.

    Rows go to files by ranges of their place on the curve, so filters on any of the columns skip most files. A range
    with many rows is cut by a row limit; a curve place that holds very many rows is spread by a second key.
    """
    own = files(spark, path)
    total = own.agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n")).first()
    parts = max(1, -(-(total["b"] or 0) // file_bytes))
    rows = max(1, -(-(total["n"] or 0) // parts))
    table = read(spark, path)
    placed = table.withColumn("_z", curve(table, columns))
    spread = F.xxhash64(*[c for c in table.columns])
    out = placed.repartitionByRange(parts, "_z", spread).sortWithinPartitions("_z").drop("_z")
    return _commit(spark, path, out, None, 2 * rows)
