"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkscope.session import drop, stage


#: Edges that a task shrinks at once; a node with more than one of so many equal shares of all links is a hub.
BLOCK, HUBS = 1 << 20, 256


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One link per node to the smallest node it reaches, over blocks of at least ``BLOCK`` edges of one partition."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK:
            yield _stars(pd.concat(held))
            held = []
    if held:
        yield _stars(pd.concat(held))


def _stars(edges: pd.DataFrame) -> pd.DataFrame:
    nodes, ends = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    low = np.arange(len(nodes))
    while len(nodes):
        new = low.copy()
        smallest = np.minimum(low[ends[:, 0]], low[ends[:, 1]])
        np.minimum.at(new, low[ends[:, 0]], smallest)
        np.minimum.at(new, low[ends[:, 1]], smallest)
        new = new[new][low]
        if (new == low).all():
            break
        low = new
    return pd.DataFrame({"hi": nodes, "lo": nodes[low]}, dtype="int64")


def with_least(links: DataFrame, rows: int, made: list[str] | None = None) -> DataFrame:
    """``links`` (u, v), at most ``rows`` of them, with m, the smallest v of each u, and no u's links in one task.

    Minima are partial aggregates. Nodes with more than a share of all rows, at most ``HUBS`` of them,
    get theirs by a broadcast; the links of all others meet them in a shuffle.
    """
    return _meet(links, _around(links, made), rows)


def _around(links: DataFrame, made: list[str] | None) -> DataFrame:
    """Of each u of ``links`` (u, v) the smallest v, the number of links and of those to smaller nodes, written."""
    below = F.sum(F.when(F.col("v") < F.col("u"), 1).otherwise(0))
    return stage(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"), below.alias("below")), "least", made)


def _meet(links: DataFrame, around: DataFrame, rows: int) -> DataFrame:
    hubs = around.filter(F.col("n") > rows // HUBS)
    hot = links.join(F.broadcast(hubs.select("u", "m")), "u")
    rest = links.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(around.select("u", "m").hint("merge"), "u")
    return hot.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of its component for every node of ``edges`` (columns a, b).

    Each partition first shrinks its own edges to stars, a bounded block at a time; what is left makes fewer
    partitions, which shrink theirs once more. Then, until only stars are left,
    alternates large-star and small-star steps (Kiveris et al., 2014), which need a
    logarithmic number of rounds and never gather a node's neighbours: each step is a
    minimum per node and a join back, in which hubs are split (:func:`with_least`). Rounds go through written tables; a
    round's tables go when the next one is written.
    """
    numbered = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    once: list[str] = []
    contracted = stage(numbered.mapInPandas(_contract, "hi bigint, lo bigint"), "edges", once)
    contracted = stage(contracted.toDF("a", "b").mapInPandas(_contract, "hi bigint, lo bigint"), "edges")
    drop(numbered.sparkSession, once)
    nodes = contracted.select(F.col("hi").alias("node")).distinct()
    pairs, old = contracted.filter("hi <> lo"), []
    # In a star every node has larger neighbours only, or a smaller one and no other link.
    loose = (F.col("below") > 0) & (F.col("n") > 1)
    while True:
        made: list[str] = []
        # Large star: every neighbour above a node links to the smallest one around it.
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        around = _around(both, made)
        rows, more = around.agg(F.sum("n"), F.max(loose)).first()
        if not more:
            drop(pairs.sparkSession, made)
            break
        up = _meet(both, around, rows).filter("v > u")
        # A row a link at most, so repeated ones need not go before the next step.
        large = stage(up.select(F.col("v").alias("u"), F.least("m", "u").alias("v")), "large", made)
        # Small star: a node and its smaller neighbours link to the smallest of them.
        down = with_least(large, rows, made)
        small = (
            down.select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("link"))
            .select("link.*")
            .filter("hi <> lo")
            .distinct()
        )
        pairs, last = stage(small, "stars", made), old
        drop(pairs.sparkSession, last + made[:-1])
        old = made[-1:]
    root = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.join(root.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
