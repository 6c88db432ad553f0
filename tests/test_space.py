"""Neighbour searches in many dimensions, spanning trees with outliers, eigenvectors, hubs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.catalog.cluster_queries import customers
from sparkscope.operators import cluster, graph, space


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def distances(x):
    out = np.zeros((len(x), len(x)))
    for k in range(x.shape[1]):
        out += (x[:, k][:, None] - x[:, k][None, :]) ** 2
    return np.sqrt(out)


def clusters(seed, n, dims, centres=12, spread=20.0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * spread + rng.normal(size=(n, dims))


@pytest.fixture
def recorded(monkeypatch):
    """The tables of block pairs that a search goes through."""
    met, real = [], space.near
    monkeypatch.setattr(space, "near", lambda *a, **k: met.append(real(*a, **k)) or met[-1])
    return met


def test_tree_leaves_are_its_cuts():
    x = clusters(0, 500, 5)
    x[:100] = x[0]
    tree = space.grow(x, 8)
    leaf = tree.leaves(x)
    sizes = np.unique(leaf, return_counts=True)[1]
    assert len(sizes) > 40 and len(set(leaf[:100])) == 1 and sorted(sizes)[-2] <= 8
    one = space.grow(np.zeros((0, 1)))
    assert one.leaves(x).tolist() == [0] * 500


def test_sixteen_dimensions(spark, monkeypatch, recorded):
    monkeypatch.setattr(cluster, "BLOCK", 32)
    x = clusters(1, 600, 16)
    points, d = frame(spark, x), distances(x)
    # Comparisons: pairs of blocks times their points, far below all pairs.
    counted = cluster.block_pairs(points, 6.0, lambda a, b, far: a.iloc[:1].assign(n=far.size)[["id", "n"]], "id bigint, n bigint")
    total = counted.agg(F.sum("n")).first()[0]
    assert 600 * 2 < total < 600 * 600 / 4
    np.fill_diagonal(d, np.inf)
    near = d <= 6.0
    core = near.sum(1) >= 4
    label = np.full(600, -1)
    for seed in np.flatnonzero(core):
        todo = [seed] if label[seed] == -1 else []
        while todo:
            i = todo.pop()
            if label[i] == -1:
                label[i] = seed
                todo += np.flatnonzero(near[i] & core & (label == -1)).tolist()
    for i in np.flatnonzero(~core & (near & core[None]).any(1)):
        label[i] = label[np.where(near[i] & core, d[i], np.inf).argmin()]
    got = {r["id"]: r["label"] for r in cluster.dbscan(points, 6.0, 4).collect()}
    assert [got[i] for i in range(600)] == label.tolist()


def test_nearest_in_many_dimensions(spark, monkeypatch, recorded):
    monkeypatch.setattr(cluster, "BLOCK", 32)
    x = clusters(2, 400, 12)
    x[-1] = 1e4  # an outlier
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    got = {r["id"]: [(e["distance"], e["other"]) for e in r["near"]] for r in cluster.nearest(frame(spark, x), 5).collect()}
    assert got == {i: sorted((d[i, j], j) for j in range(400) if j != i)[:5] for i in range(400)}
    blocks = 400 / 8
    assert recorded[0].count() < blocks * blocks / 2


def test_single_link_with_an_outlier(spark, monkeypatch, recorded):
    """Two crowds and a far point: rounds stay near linear in pairs of blocks, the outlier costs its own search."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 100, (700, 2)), rng.uniform(0, 100, (700, 2)) + 400, [[1e6, 1e6]]])
    got = {r["id"]: r["label"] for r in cluster.single_link(frame(spark, x), 3, block=128).collect()}
    assert [got[i] for i in range(1401)] == [0] * 700 + [700] * 700 + [1400]
    blocks = 1401 / 32
    assert max(pairs.count() for pairs in recorded) < 30 * blocks


def test_single_link_broadcasts_nothing_that_grows(spark, monkeypatch, tmp_path):
    """Points, trees and pairs of blocks meet in shuffles; a broadcast would pass through the driver in every round."""
    rng = np.random.default_rng(6)
    money = rng.uniform(0, 9000, (24, 2)).tolist()
    spark.createDataFrame([(i, m[0]) for i, m in enumerate(money)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, m[1] * 20) for i, m in enumerate(money) if i % 7], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    seen, real = [], cluster.stage
    planned = lambda df, label: seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(cluster, "stage", lambda df, label, *a: planned(df, label) or real(df, label, *a))
    points = customers(spark, str(tmp_path))
    out = cluster.single_link(points, 5, block=16)
    planned(out, "out")
    rows = points.collect()
    x, ids = np.array([r["x"] for r in rows]), [r["id"] for r in rows]
    d = distances(x)
    of, left = list(range(len(ids))), len(ids)
    for i, j in sorted(((i, j) for i in range(len(ids)) for j in range(i)), key=lambda p: d[p]):
        if left > 5 and of[i] != of[j]:
            of, left = [of[i] if c == of[j] else c for c in of], left - 1
    least = {c: min(ids[i] for i in range(len(ids)) if of[i] == c) for c in of}
    assert {r["id"]: r["label"] for r in out.collect()} == {ids[i]: least[c] for i, c in enumerate(of)}
    grows = {"places", "trees", "ways", "bounded", "picked", "out"}
    assert grows <= {label for label, _ in seen}
    assert [label for label, plan in seen if label in grows and "Broadcast" in plan] == []


def test_spanning_tree_of_ties(spark):
    """On a grid all edges are equally long; the tree is still one."""
    x = np.array([[i, j] for i in range(12) for j in range(9)], float)
    edges = cluster._spanning(frame(spark, x), 16).collect()
    assert len(edges) == len(x) - 1 and {e["w"] for e in edges} == {1.0}
    reached = {0}
    while True:
        more = reached | {e["b"] for e in edges if e["a"] in reached} | {e["a"] for e in edges if e["b"] in reached}
        if more == reached:
            break
        reached = more
    assert len(reached) == len(x)


def test_eigenvectors_match_numpy(spark):
    rng = np.random.default_rng(4)
    weight = rng.uniform(0, 1, (40, 40)) * (rng.uniform(size=(40, 40)) < 0.3)
    weight = np.triu(weight, 1) + np.triu(weight, 1).T + np.diag(np.full(40, 0.01))
    scaled = weight / np.sqrt(weight.sum(0)[:, None] * weight.sum(0)[None, :])
    rows = [(i, j, float(scaled[i, j])) for i in range(40) for j in range(40) if scaled[i, j]]
    matrix = spark.createDataFrame(rows, "src long, dst long, m double")
    vectors, values = cluster.eigenvectors(matrix, spark.range(40), 3, tolerance=1e-6)
    want, axes = np.linalg.eigh(scaled)
    got = np.array([r["v"][:3] for r in vectors.orderBy("id").collect()])
    assert values[:3] == pytest.approx(want[::-1][:3], abs=1e-6)
    for k in range(3):
        assert abs(got[:, k] @ axes[:, -1 - k]) == pytest.approx(1, abs=1e-4)


def test_products_write_no_tables(spark, monkeypatch):
    """Parts that borrow from each other, one without entries; the iteration writes its parts and its result, not each product."""
    rng = np.random.default_rng(8)
    weight = rng.uniform(0, 1, (60, 60)) * (rng.uniform(size=(60, 60)) < 0.15)
    weight = np.triu(weight, 1) + np.triu(weight, 1).T + np.diag(np.full(60, 0.01))
    scaled = weight / np.sqrt(weight.sum(0)[:, None] * weight.sum(0)[None, :])
    rows = [(i, j, float(scaled[i, j])) for i in range(60) for j in range(60) if scaled[i, j]]
    made, write = [], cluster.stage
    monkeypatch.setattr(cluster, "stage", lambda df, label, *more: made.append(label) or write(df, label, *more))
    nodes = spark.range(61).select("id", F.when(F.col("id") == 60, -5).otherwise(F.col("id") % 4 * 1000).alias("part"))
    vectors, values = cluster.eigenvectors(spark.createDataFrame(rows, "src long, dst long, m double"), nodes, 2, tolerance=1e-6, rounds=20)
    want, axes = np.linalg.eigh(scaled)
    got = {r["id"]: r["v"] for r in vectors.collect()}
    assert len(got) == 61 and np.allclose(got[60], 0, atol=1e-5)
    assert values == pytest.approx(want[::-1][:2], abs=1e-6)
    for k in range(2):
        assert abs(sum(got[i][k] * axes[i, -1 - k] for i in range(60))) == pytest.approx(1, abs=1e-4)
    assert made == ["numbered", "parts", "eigenvectors"]


def test_nearest_asks_only_blocks_within_reach(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 64)
    monkeypatch.setattr(cluster, "ASKED", 5)  # many turns
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 10, (900, 2)).round(1)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    made, write = [], cluster.stage

    def kept(df, label, *more):
        made.append((label, write(df, label, *more)))
        return made[-1][1]

    monkeypatch.setattr(cluster, "stage", kept)
    got = {r["id"]: [(e["distance"], e["other"]) for e in r["near"]] for r in cluster.nearest(frame(spark, x), 4).collect()}
    assert got == {i: sorted((d[i, j], j) for j in range(900) if j != i)[:4] for i in range(900)}
    assert [0 < table.count() < 3 * 900 for label, table in made if label == "asked"] == [True]


def test_spectral_parts_rings(spark):
    """Two rings, one inside the other, which k-means can't part."""
    turn = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    ring = np.stack([np.cos(turn), np.sin(turn)], 1)
    x = np.concatenate([ring * 10, ring[::2] * 3])
    got = {r["id"]: r["label"] for r in cluster.spectral(frame(spark, x), 2, 6).collect()}
    assert len({got[i] for i in range(90)}) == 1 and len({got[i] for i in range(90, 135)}) == 1 and got[0] != got[90]
    few = cluster.spectral(frame(spark, x[:2]), 3).collect()
    assert {r["label"] for r in few} == {0, 1}


@pytest.mark.parametrize("centre", [0, 10**9])
def test_components_with_a_hub(spark, centre):
    """A star that holds most edges, beside chains; the hub's links are dealt out by a broadcast, not by its key."""
    edges = [(centre, i) for i in range(1, 6001)] + [(i, i + 1) for i in range(20_000, 20_400)] + [(7, 20_000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert len(got) == 6001 + 401 and set(got.values()) == {min(centre, 1)}
    links = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    out = graph.with_least(links, len(edges))
    assert out.count() == len(edges) and out.filter(F.col("u") == centre).select("m").distinct().collect() == [(1,)]


def test_stars_are_components_without_a_round(spark, monkeypatch):
    made, write = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label, *more: made.append(label) or write(df, label, *more))
    stars = spark.createDataFrame([(i, i % 7) for i in range(7, 500)] + [(600, 600)], "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in graph.components(stars).collect()}
    assert got == {i: i % 7 for i in range(500)} | {600: 600}
    assert "large" not in made
    made.clear()
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] * 2, "a long, b long").repartition(7)
    assert {r["component"] for r in graph.components(path).collect()} == {0}
    assert "large" in made
