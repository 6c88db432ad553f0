"""Positions, ranks and sliding frames that never hold one key in one task.

A plain ``Window.partitionBy(series)`` sends a whole series to one task. Rows are
range-partitioned by ``(keys, order)`` instead, sorted and written once to the shared
folder, so a hot key spreads over many partitions and its row numbers come from counts per
partition. There is one path for all sizes.
Sliding frames run over fixed-size blocks of positions with a halo of neighbours.
Passing ``parts`` sets the number of range partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkscope.session import stage

BLOCK = 65_536


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None) -> DataFrame:
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return stage(
        ranged.sortWithinPartitions(*by).withColumn("_g", F.monotonically_increasing_id()), "placed"
    )


def _with_blocks(placed: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Join each row to its (keys, partition) block: first position, weight before, key total.

    There is one block per partition plus one per key, so the window over blocks
    sees at most as many rows per key as there are partitions.
    """
    part = F.shiftright("_g", 33)
    blocks = placed.groupBy(*keys, part.alias("_part")).agg(
        F.min("_g").alias("_lo"), F.sum(weight).alias("_w")
    )
    key = [F.col(k) for k in keys] or [F.lit(0)]
    to_here = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_bpart"),
        "_lo",
        (F.sum("_w").over(to_here) - F.col("_w")).alias("_off"),
        F.sum("_w").over(Window.partitionBy(*key)).alias("_total"),
    )
    on = part == F.col("_bpart")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(blocks, on).drop("_bpart", *[f"_k_{k}" for k in keys])


def indexed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    index: str = "i",
    total: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its key, and on request the key's row count.

    ``order`` should be total (end with a unique column): ties then split too.
    """
    joined = _with_blocks(_placed(df, keys, order, parts), keys, F.lit(1).cast("bigint"))
    out = joined.withColumn(index, F.col("_off") + F.col("_g") - F.col("_lo"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_g", "_lo", "_off", "_total")


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: str,
    before: str = "before",
    total: str = "total",
    parts: int | None = None,
) -> DataFrame:
    """Add the weight that lies before each row within its key, and the key's whole weight."""
    joined = _with_blocks(_placed(df, keys, order, parts), keys, F.col(weight)).withColumn(
        "_part", F.shiftright("_g", 33)
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    return (
        joined.withColumn(before, F.col("_off") + F.sum(weight).over(inside) - F.col(weight))
        .withColumn(total, F.col("_total"))
        .drop("_g", "_lo", "_off", "_total", "_part")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Callable[[Window], Column]],
    before: int = 0,
    after: int = 0,
    index: str = "i",
    size: int = BLOCK,
) -> DataFrame:
    """Evaluate window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``df`` carries positions from :func:`indexed`. Positions are cut into blocks of
    ``size`` rows and the edge rows are copied to the neighbouring block, so one
    task sees at most ``size + before + after`` rows whatever the key holds. Each
    entry of ``columns`` gets the ordered window and returns a column over it.
    """
    size = max(size, before, after, 1)
    block = (F.col(index) / size).cast("bigint")
    at = F.col(index) % size
    homes = [block]
    if before:
        homes.append(F.when(at >= size - before, block + 1))
    if after:
        homes.append(F.when((at < after) & (block > 0), block - 1))
    spread = df.withColumn("_home", block).withColumn("_block", F.explode(F.array_compact(F.array(*homes))))
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    return (
        spread.select("*", *[make(window).alias(name) for name, make in columns.items()])
        .filter(F.col("_block") == F.col("_home"))
        .drop("_block", "_home")
    )


def values_at(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    total: str | None = None,
    parts: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """The exact order statistics of ``value`` per key, one column per entry of ``ranks``.

    Each entry maps the number of values ``n`` to a 0-based rank. Equal values are
    counted before they are placed, so a value that repeats without end is one row. ``weight`` names
    the counts if that was done before.
    """
    rows = df.filter(F.col(value).isNotNull())
    if weight:
        counted = rows.select(*keys, value, F.col(weight).alias("_c"))
    else:
        counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = cumulative(counted, keys, [value], "_c", "_b", "_n", parts)
    picks = []
    for name, rank in ranks.items():
        r = rank(F.col("_n")).cast("bigint")
        hit = (F.col("_b") <= r) & (r < F.col("_b") + F.col("_c"))
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    if total:
        picks.append(F.max("_n").alias(total))
    return placed.groupBy(*keys).agg(*picks)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, parts: int | None = None
) -> DataFrame:
    """Sum of ``value`` from the key's first row up to and including each row."""
    summed = cumulative(df, keys, order, value, "_before", "_sum", parts)
    return summed.withColumn(out, F.col("_before") + F.col(value)).drop("_before", "_sum")


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rank: str | None = "rank",
    dense: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``rank`` and ``dense_rank`` by ascending ``value`` within each key."""
    peers = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = cumulative(peers, keys, [value], "_c", "_b", "_n", parts)
    if dense:
        placed = indexed(placed, keys, [value], "_d", parts=parts)
    cols = [F.col(k).alias(f"_k_{k}") for k in keys] + [F.col(value).alias("_v")]
    if rank:
        cols.append((F.col("_b") + 1).alias(rank))
    if dense:
        cols.append((F.col("_d") + 1).alias(dense))
    on = F.col(value).eqNullSafe(F.col("_v"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(placed.select(*cols), on).drop("_v", *[f"_k_{k}" for k in keys])
