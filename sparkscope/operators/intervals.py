"""Joins of values with the intervals that hold them, as equi-joins on slots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Slots along the values as a power of two, at most.
DEPTH = 40


def _nodes(first: Column, last: Column, depth: int) -> Column:
    """The fewest (level, slot) that cover slots ``first`` to ``last``; slot s of level n spans 2^n slots."""
    state = F.struct(first.alias("a"), (last + 1).alias("b"), F.array().cast("array<struct<level:int,slot:bigint>>").alias("out"))

    def climb(s: Column, level: Column) -> Column:
        some = s["a"] < s["b"]
        odd = lambda x: x % 2 == 1
        node = lambda at: F.struct(level.alias("level"), at.alias("slot"))
        left = F.when(some & odd(s["a"]), node(s["a"]))
        right = F.when(some & odd(s["b"]), node(s["b"] - 1))
        out = F.concat(s["out"], F.array_compact(F.array(left, right)))
        return F.struct(F.shiftright(s["a"] + F.when(odd(s["a"]), 1).otherwise(0), 1).alias("a"), F.shiftright(s["b"], 1).alias("b"), out.alias("out"))

    few = F.transform(F.sequence(first, last), lambda at: F.struct(F.lit(0).alias("level"), at.alias("slot")))
    return F.when(last - first <= 1, few).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(depth)), state, climb, lambda s: s["out"]))


def join(
    points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, closed: str = "left", on: Sequence[str] = ()
) -> DataFrame:
    """Every row of ``points`` with every row of ``intervals`` that holds its ``value``.

    ``closed`` says which ends belong to an interval: left, right, both or neither. A null
    or infinite ``low`` or ``high`` means no bound on that side. Columns named in ``on`` must be equal too; apart from
    those, the sides share no column names. Null and NaN values are in no interval; a NaN bound is above all values.

    The range of the values is cut into slots about as wide as the median interval. An interval
    becomes the fewest slots of any level (a slot of the next level spans two) that cover
    it, at most two a level however wide it is; a value has one slot in each level that occurs. Sides meet
    on (level, slot) in an equi-join, each pair at most once, and the true ends are checked after it. So a pair is
    only compared when it matches or ends within a slot of a match, and there is neither a nested loop nor a broadcast
    that AQE has not measured. Skewed slots are split by AQE.
    """
    x, lo, hi = (F.col(c).cast("double") for c in (value, low, high))
    fine = F.col(value).isNotNull() & ~F.isnan(x)
    finite = F.when(F.abs(x) < math.inf, x)
    span = points.filter(fine).agg(F.min(finite).alias("a"), F.max(finite).alias("b"), F.count_if(finite.isNull()).alias("inf")).first()
    start, end = (span["a"], span["b"]) if span["a"] is not None else (0.0, 0.0)
    # Infinite values lie in the outermost slots, like the ends of open intervals.
    clipped = lambda v, default: F.least(F.greatest(F.coalesce(v, F.lit(default)), F.lit(start)), F.lit(end))
    reaches = (F.coalesce(lo, F.lit(-math.inf)) <= F.lit(end)) & (F.coalesce(hi, F.lit(math.inf)) >= F.lit(start))
    cut = intervals.withColumns({"_a": clipped(lo, -math.inf), "_b": clipped(hi, math.inf)}).filter(reaches | F.lit(span["inf"] > 0)).filter("_a <= _b")
    middle = cut.agg(F.percentile_approx(F.col("_b") - F.col("_a"), 0.5).alias("w")).first()["w"]
    wide = end - start
    smallest = math.ldexp(1.0, math.frexp(wide)[1] - DEPTH) if 0 < wide < math.inf else 1.0
    width = max(math.ldexp(1.0, math.frexp(middle)[1]) if middle and middle < math.inf else smallest, smallest, 5e-324)
    slot = lambda v: F.floor((v - F.lit(start)) / F.lit(width)).cast("bigint")
    depth = math.frexp(wide / width)[1] + 1 if wide < math.inf else DEPTH + 1
    covered = cut.withColumn("_node", F.explode(_nodes(slot(F.col("_a")), slot(F.col("_b")), depth)))
    covered = covered.select(*intervals.columns, F.col("_node.level").alias("_level"), F.col("_node.slot").alias("_slot"))
    levels = [r[0] for r in covered.select("_level").distinct().collect()]  # at most DEPTH + 2
    placed = points.filter(fine).withColumn("_at", slot(F.least(F.greatest(x, F.lit(start)), F.lit(end))))
    placed = placed.withColumn("_l", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")))
    placed = placed.withColumn("_s", F.expr("shiftright(_at, _l)")).drop("_at")
    match = (F.col("_l") == F.col("_level")) & (F.col("_s") == F.col("_slot"))
    names = list(on)
    for name in names:
        covered = covered.withColumnRenamed(name, f"_on_{name}")
        match = match & (F.col(name) == F.col(f"_on_{name}"))
    v = F.col(value)
    above = v >= F.col(low) if closed in ("left", "both") else v > F.col(low)
    below = v <= F.col(high) if closed in ("right", "both") else v < F.col(high)
    within = F.coalesce(above, F.lit(True)) & F.coalesce(below, F.lit(True))
    return placed.join(covered, match).filter(within).drop("_l", "_s", "_level", "_slot", *[f"_on_{n}" for n in names])
