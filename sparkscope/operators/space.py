"""Points ``(id, x)`` in blocks of neighbours, and the pairs of blocks that can be near each other.

A partition tree, fitted on a bounded sample, sends each point to a leaf; leaves are cut into blocks of
bounded size. Searches compare blocks whose boxes are within reach, in any number of dimensions: the distance of two boxes
is a lower bound for all their points, so a box that is farther away holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered
from sparkscope.session import stage

#: Leaves of a tree at most, sample points a leaf, and boxes that meet the others at once.
LEAVES, SAMPLE, PACK = 16_384, 8, 256
#: Boxes and distances round differently; a bound is trusted up to this share of it.
SLACK = 1 - 1e-9


@dataclass
class Tree:
    """Inner nodes go left where ``x[axis] < cut``; their children are ``child`` and ``child + 1``. Leaves have child -1.

    ``low`` and ``high`` are the sides of each node's cell, infinite where nothing cuts it.
    """

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.child[node] >= 0)
            if not len(inner):
                return node
            own = node[inner]
            node[inner] = self.child[own] + (x[inner, self.axis[own]] >= self.cut[own])


def grow(x: np.ndarray, least: int = SAMPLE) -> Tree:
    """Halve the widest dimension at its median until a node holds ``least`` points or one place."""
    axis, cut, child, todo = [0], [0.0], [-1], [(0, np.arange(len(x)))]
    low, high = [np.full(x.shape[1], -np.inf)], [np.full(x.shape[1], np.inf)]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        spread = np.ptp(x[own], axis=0)
        axis[node] = int(spread.argmax())  # a leaf keeps the dimension in which its blocks are cut
        if len(own) <= least or not spread.max() > 0:
            continue
        values = x[own, axis[node]]
        middle = np.partition(values, len(values) // 2)[len(values) // 2]
        cut[node] = float(middle if middle > values.min() else values[values > middle].min())
        child[node] = len(child)
        right = values >= cut[node]
        for part, sides in ((own[~right], high), (own[right], low)):
            todo.append((len(child), part))
            axis.append(0), cut.append(0.0), child.append(-1)
            low.append(low[node].copy()), high.append(high[node].copy())
            sides[-1][axis[node]] = cut[node]
    return Tree(np.array(axis), np.array(cut), np.array(child), np.array(low), np.array(high))


def matrix(x: pd.Series) -> np.ndarray:
    return np.vstack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))


def dense(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of equally long lists."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def streamed(held: DataFrame, rows: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(held, batch)`` on all rows of each key, a batch at a time; a task holds what ``held`` has of one key."""
    cols = list(dict.fromkeys([*keys, *held.columns, *rows.columns]))
    filled = lambda df, side: df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in cols], F.lit(side).alias("_side"))
    # A fixed number of partitions: the work per row is large for its bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = filled(held, 0).unionByName(filled(rows, 1)).repartition(parts, *keys).sortWithinPartitions(*keys, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, met, table = None, [], None
        for batch in batches:
            by = np.stack([batch.column(c).to_numpy() for c in (*keys, "_side")], 1)
            new = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]).any(1)])) if len(by) else []
            for start, end in zip(new, [*new[1:], len(by)]):
                *key, side = by[start].tolist()
                if key != now:
                    now, met, table = key, [], None
                part = batch.slice(start, end - start)
                if side == 0:
                    met.append(part)
                elif met:
                    table = table or pa.Table.from_batches(met).combine_chunks()
                    yield from work(table, part)

    return both.mapInArrow(run, schema)


def blocks(points: DataFrame, size: int) -> DataFrame:
    """``points`` with the number of their ``_block``, of at most ``size`` points, and ``_safe``, within which all other points are of the same block; written.

    The tree has about four leaves a block, at most ``LEAVES``, and is fitted on ``SAMPLE`` points for each,
    chosen by a hash of the id. Leaves that hold more than a block are cut along their widest dimension.
    """
    n = points.count()
    leaves = min(LEAVES, -(-4 * n // size))
    wanted = leaves * SAMPLE
    chosen = points if n <= wanted else points.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < wanted)
    found = chosen.select("x").toPandas() if n > size else pd.DataFrame({"x": []})
    tree = grow(matrix(found["x"]), max(SAMPLE, n // max(1, leaves)) if n <= wanted else SAMPLE)

    @F.pandas_udf("struct<_leaf: bigint, _along: double, _safe: double>")
    def place(x: pd.Series) -> pd.DataFrame:
        rows = matrix(x)
        leaf = tree.leaves(rows)
        if len(tree.child) == 1:
            safe = np.full(len(rows), np.inf)
        else:
            safe = np.minimum(rows - tree.low[leaf], tree.high[leaf] - rows).min(1) * SLACK
        return pd.DataFrame({"_leaf": leaf, "_along": rows[np.arange(len(rows)), tree.axis[leaf]], "_safe": safe})

    placed = points.withColumn("_at", place("x")).select(*points.columns, "_at._leaf", "_at._along", "_at._safe")
    numbered = ordered.indexed(placed, ["_leaf"], ["_along", "id"], "_i", "_n")
    block = F.shiftleft("_leaf", 32) + F.floor(F.col("_i") / size)
    safe = F.when(F.col("_n") <= size, F.col("_safe")).otherwise(0.0)
    return stage(numbered.select(*points.columns, block.alias("_block"), safe.alias("_safe")), "blocks")


def boxes(placed: DataFrame, *more: Column) -> DataFrame:
    """One row per block: ``low`` and ``high`` of each dimension, and further aggregates of its points."""
    sides = placed.select("_block", F.posexplode("x").alias("_d", "_v")).groupBy("_block", "_d").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    box = sides.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_d", "lo", "hi"))).alias("s"))
    box = box.select("_block", F.transform("s", lambda e: e["lo"]).alias("low"), F.transform("s", lambda e: e["hi"]).alias("high"))
    return box.join(placed.groupBy("_block").agg(*more), "_block") if more else box


def gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """A lower bound for the distance of points of one box to those of each other one."""
    apart = np.maximum(0, np.maximum(lows - high, low - highs))
    return np.sqrt((apart * apart).sum(-1)) * SLACK


def near(heads: DataFrame, boxes_: DataFrame, nearest: bool = False) -> DataFrame:
    """(a, b, gap): for each row of ``heads`` the blocks whose boxes are within its ``reach``; written.

    Both sides have _block, low, high and kind. Blocks of one kind other than null do not meet. With ``nearest`` only the box
    with the least gap is wanted, per head and pack of boxes. Boxes travel in packs of ``PACK``, so a task
    holds one pack and streams through the heads.
    """
    packs = max(1, -(-boxes_.count() // PACK))
    cols = ["_block", "low", "high", "kind"]
    one = boxes_.select(F.pmod(F.xxhash64("_block"), F.lit(packs)).alias("pack"), F.lit(0).alias("side"), *cols, F.lit(0.0).alias("reach"))
    two = heads.select(F.explode(F.sequence(F.lit(0), F.lit(packs - 1)).cast("array<bigint>")).alias("pack"), F.lit(1).alias("side"), *cols, "reach")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held, sides = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    pack, held, sides = row["pack"], [], None
                if row["side"] == 0:
                    held.append(row)
                    continue
                if not held:
                    continue
                if sides is None:
                    sides = np.array([r["low"] for r in held]), np.array([r["high"] for r in held])
                gap = gaps(np.array(row["low"]), np.array(row["high"]), *sides)
                met = np.array([row["kind"] is None or r["kind"] != row["kind"] for r in held])
                hit = np.flatnonzero(met & (gap <= row["reach"]))
                if nearest and len(hit):
                    hit = hit[[gap[hit].argmin()]]
                if len(hit):
                    others = [held[i]["_block"] for i in hit]
                    yield pa.RecordBatch.from_arrays([pa.array([row["_block"]] * len(hit)), pa.array(others), pa.array(gap[hit])], ["a", "b", "gap"])

    both = one.unionByName(two).repartition("pack").sortWithinPartitions("pack", "side")
    return stage(both.mapInArrow(work, "a bigint, b bigint, gap double"), "pairs")


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``compare(a, b, distances)`` on every pair of blocks (a, b); a task holds one pair.

    Pairs grow with the points, so they meet them in a shuffle, never by a broadcast. Rows of ``a`` come from ``left`` and may carry ``_reach``: those farther than that from the box of ``b`` are left out.
    """
    cols = list(dict.fromkeys([*left.columns, *right.columns]))
    filled = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in cols if c != "_block"], "_block")
    pairs = pairs.hint("merge")
    side_a = pairs.join(filled(left), F.col("a") == F.col("_block")).withColumn("_a", F.lit(True))
    side_b = pairs.join(filled(right), F.col("b") == F.col("_block")).withColumn("_a", F.lit(False))
    wanted = ["a", "b", "_a", *[c for c in cols if c != "_block"]]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["_a"]], rows[~rows["_a"]]
        xa, xb = matrix(a["x"]), matrix(b["x"])
        if "_reach" in a and len(a) and len(b):
            inside = gaps(xa, xa, xb.min(0), xb.max(0)) <= a["_reach"].to_numpy(float)
            a, xa = a[inside], xa[inside]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        squared = np.zeros((len(xa), len(xb)))
        for k in range(xa.shape[1]):
            squared += (xa[:, k][:, None] - xb[:, k][None, :]) ** 2
        return compare(a, b, np.sqrt(squared))

    # A fixed number of partitions: the work per pair is large for its bytes.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = side_a.select(*wanted).unionByName(side_b.select(*wanted))
    return both.repartition(parts, "a", "b").groupBy("a", "b").applyInPandas(run, schema)
