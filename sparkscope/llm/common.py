"""Helpers the operators share: staged inputs with row numbers, positions, word hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkscope.session import scratch

ROW = "_row"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collect the paths of the tables that are staged meanwhile."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def drop(spark, paths: Sequence[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` (zstd) and go on from the written table."""
    path = scratch(df.sparkSession, label)
    for made in _RECORDS:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """The written table with a unique, from now on fixed row number ``_row``.

    Row numbers tell repeated rows apart, so null or repeated ids never merge rows.
    """
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()), label)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ..., which no column of an operator's own clashes with, and their names by the old ones."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named(names: dict[str, str]) -> list[Column]:
    """The columns of :func:`plain` under their old names."""
    return [F.col(c).alias(old) for old, c in names.items()]


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns an operator is about to add (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def positions(df: DataFrame, order: Sequence[Column], index: str, label: str, keys: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Add 0-based positions in the given order within each key, without one task per key.

    Rows are range-partitioned by (keys, order), sorted and written; a row's position is its
    place in its partition plus the counts of the partitions before. The counts per (key,
    partition) are at most the number of partitions plus the number of keys.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    placed = stage(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_g", F.monotonically_increasing_id()), label
    )
    part = F.shiftright("_g", 33)
    counts = placed.groupBy(*keys, part.alias("_p")).agg(F.min("_g").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    blocks = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_p").alias("_bp"),
        "_lo",
        (F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"),
        F.sum("_n").over(whole).alias("_all"),
    )
    on = part == F.col("_bp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(blocks, on).withColumn(index, F.col("_off") + F.col("_g") - F.col("_lo"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_g", "_lo", "_off", "_all", "_bp", *[f"_k{i}" for i in range(len(keys))])


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        size = np.diff(offsets_of(batch.column(batch.schema.get_field_index(text)))[0])
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (length n + 1) and bytes of a string or binary array; nulls hold no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, data


def binary_array(at: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array over rows ``data[at[i]:at[i+1]]``."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII marks.
_MARKS = np.ones(256, bool)
_MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def most_words(column: pa.Array) -> int:
    """A bound on the words of the texts of one array: its white space and a word more per text."""
    at, data = offsets_of(column)
    return int(np.count_nonzero(_SPACE[data[int(at[0]) : int(at[-1])]])) + len(column)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts of one array.

    ``start``/``end`` are byte places in ``data``, ``hash`` a 64-bit hash of each word, and the
    words of text i are ``first[i]:first[i + 1]``. With ``bare``, ASCII marks part words too.
    """

    def __init__(self, column: pa.Array, lower: bool = False, seed: int = 0, bare: bool = False):
        at, data = offsets_of(column)
        base = int(at[0])
        data = data[base : int(at[-1])]
        at = at - base
        if lower:
            data = _LOWER[data]
        inside = ~(_MARKS if bare else _SPACE)[data]
        edge = np.empty(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
        else:
            edge[:] = False
        # A text's border ends a word even where both neighbours are inside one.
        border = at[1:-1]
        border = np.unique(border[(border > 0) & (border < len(data))])
        border = border[inside[border - 1] & inside[border]] if len(border) else border
        places = np.sort(np.concatenate([np.flatnonzero(edge), border, border]))
        self.start, self.end = places[0::2], places[1::2]
        self.data, self.first = data, np.searchsorted(self.start, at)
        self.hash = self._hash(seed)

    def _hash(self, seed: int) -> np.ndarray:
        size = self.end - self.start
        order = np.argsort(-np.minimum(size, 65), kind="stable")
        start, short = self.start[order], size[order]
        out = np.full(len(order), (0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64, _U)
        long = int(np.searchsorted(-short, -64, "left"))  # words over 64 bytes come first
        for i in range(long):
            import xxhash

            a = int(start[i])
            out[i] = xxhash.xxh3_64_intdigest(self.data[a : a + int(short[i])].tobytes(), seed=seed)
        ends = np.searchsorted(-short[long:], -np.arange(1, 65), "right") + long if len(order) else np.zeros(64, int)
        for k in range(64):
            n = int(ends[k])
            if n <= long:
                break
            part = out[long:n]
            part += self.data[start[long:n] + k]
            part *= _U(0xD6E8FEB86659FD93)
            part ^= part >> _U(32)
        done = np.empty_like(out)
        done[order] = mix(out + size[order].astype(_U))
        return done


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive entries; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(width):
        out *= _U(0x9E3779B97F4A7C15)
        out += words[k : k + n]
        out ^= out >> _U(29)
    return mix(out)
