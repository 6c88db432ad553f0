"""Window features and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.catalog.series_queries import P, rounded
from sparkscope.model import series, table
from sparkscope.operators import cluster as cl


def customers(spark, d):
    """One point per customer: balance, number of orders and mean price, in comparable units."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("p")
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    x = F.array(F.col("c_acctbal") / 1000, F.coalesce("n", F.lit(0)).cast("double"), F.coalesce("p", F.lit(0.0)) / 50_000)
    return c.join(o.hint("merge"), "id", "left").select("id", x.alias("x"))


def embeddings(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("bigint").alias("label")
    )


@query(
    "feat_windows",
    P
    + """, w AS (SELECT *, least(greatest(n // 10, 5), 50) AS win FROM p),
    f2 AS (SELECT a.series, a.i, any_value(a.win) AS win, avg(b.value) AS m, var_samp(b.value) AS v, max(b.value) - min(b.value) AS r, regr_slope(b.value, b.i) AS slope FROM w a JOIN w b ON a.series = b.series AND b.i >= a.i AND b.i < a.i + a.win
      WHERE a.i + a.win <= a.n GROUP BY a.series, a.i),
    ac AS (SELECT f2.series, f2.i, sum((b.value - m) * (c.value - m)) AS s FROM f2 JOIN w b ON b.series = f2.series AND b.i >= f2.i AND b.i < f2.i + f2.win - 1 JOIN w c ON c.series = b.series AND c.i = b.i + 1 GROUP BY f2.series, f2.i)
    SELECT f2.series, f2.i, round(m, 6) AS mean, round(sqrt(v), 6) AS std_dev, round(r, 6) AS value_range, round(slope, 6) AS trend, round(CASE WHEN v = 0 THEN 0 ELSE s / ((win - 1) * v) END, 6) AS seasonality FROM f2 JOIN ac ON f2.series = ac.series AND f2.i = ac.i""",
)
def feat_windows(spark, d):
    return rounded(cl.window_features(series(spark, d)), *cl.FEATURES)


@query("clu_kmeans")
def clu_kmeans(spark, d):
    features = cl.window_features(series(spark, d))
    points = features.select(
        F.concat_ws("-", "series", F.col("i").cast("string")).alias("id"), F.array(*cl.FEATURES).alias("x")
    )
    return cl.kmeans(points, 8).select("id", "label")


POINTS = """SELECT c_custkey AS id, c_acctbal / 1000 AS x, coalesce(n, 0)::DOUBLE AS y, coalesce(p, 0.0) / 50000 AS z FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""


@query(
    "clu_dbscan",
    f"""WITH RECURSIVE pt AS ({POINTS}), dist AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM pt a JOIN pt b ON a.id <> b.id),
    near AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM dist), par AS (SELECT (SELECT avg(d) FROM near WHERE r = 5) AS eps, least(greatest((SELECT count(*) FROM pt) // 20, 2), 10) AS m),
    link AS (SELECT a, b, d FROM dist, par WHERE d <= eps), core AS (SELECT a FROM link GROUP BY a HAVING count(*) >= (SELECT m FROM par)),
    cl AS (SELECT a, b FROM link WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
    lab(node, label) USING KEY (node) AS (SELECT a, a FROM core UNION SELECT cl.b, min(lab.label) FROM lab JOIN cl ON cl.a = lab.node JOIN recurring.lab AS known ON known.node = cl.b WHERE lab.label < known.label GROUP BY cl.b),
    edge AS (SELECT l.a, arg_min(l.b, (l.d, l.b)) AS c FROM link l WHERE l.a NOT IN (SELECT a FROM core) AND l.b IN (SELECT a FROM core) GROUP BY l.a)
    SELECT pt.id, coalesce(lab.label, le.label, -1) AS label FROM pt LEFT JOIN lab ON lab.node = pt.id LEFT JOIN edge ON edge.a = pt.id LEFT JOIN lab le ON le.node = edge.c""",
)
def clu_dbscan(spark, d):
    return cl.dbscan(customers(spark, d)).select("id", "label")


@query(
    "clu_single_link",
    f"""WITH RECURSIVE pt AS ({POINTS}), t(node, best, src, done) USING KEY (node) AS (
      SELECT id, CASE WHEN id = (SELECT min(id) FROM pt) THEN 0 ELSE 'infinity'::DOUBLE END, CAST(NULL AS BIGINT), false FROM pt UNION
      (WITH open_ AS (SELECT * FROM recurring.t WHERE NOT done), nxt AS (SELECT node, x, y, z FROM open_ JOIN pt ON id = node ORDER BY best, node LIMIT 1),
        d AS (SELECT o.*, nxt.node AS via, o.node = nxt.node AS now, sqrt((p.x - nxt.x) * (p.x - nxt.x) + (p.y - nxt.y) * (p.y - nxt.y) + (p.z - nxt.z) * (p.z - nxt.z)) AS far FROM open_ o JOIN pt p ON p.id = o.node, nxt)
       SELECT node, CASE WHEN now OR best <= far THEN best ELSE far END, CASE WHEN now OR best <= far THEN src ELSE via END, now FROM d)),
    e AS (SELECT *, row_number() OVER (ORDER BY best DESC) <= 4 OR src IS NULL AS cut FROM t),
    r AS (SELECT node, node AS top FROM e WHERE cut UNION ALL SELECT e.node, r.top FROM e JOIN r ON e.src = r.node WHERE NOT cut)
    SELECT node AS id, min(node) OVER (PARTITION BY top) AS label FROM r""",
)
def clu_single_link(spark, d):
    return cl.single_link(customers(spark, d), 5).select("id", "label")


@query("clu_spectral")
def clu_spectral(spark, d):
    return cl.spectral(customers(spark, d), 4).select("id", "label")


@query("clu_auto")
def clu_auto(spark, d):
    return cl.auto(embeddings(spark, d).drop("label")).select("id", "label")


def sound(labelled, k):
    """What must hold of any clustering into at most ``k`` clusters, as numbers and verdicts."""
    few = F.col("strays") <= F.col("points") * 0.02
    return cl.soundness(labelled, k).select("points", "ids", F.col("clusters").between(1, k).alias("clusters_fit"), few.alias("nearest_own"), "apart", "sized")


_SOUND = "SELECT count(*) AS points, count(*) AS ids, true AS clusters_fit, true AS nearest_own, CAST(0 AS BIGINT) AS apart, true AS sized FROM "


@query(
    "clu_kmeans_sound",
    P + f", w AS (SELECT *, least(greatest(n // 10, 5), 50) AS win FROM p) {_SOUND} w WHERE i + win <= n",
)
def clu_kmeans_sound(spark, d):
    """The clusters of clu_kmeans: each window once, in the cluster whose mean is nearest, sizes that add up."""
    features = cl.window_features(series(spark, d))
    points = features.select(F.concat_ws("-", "series", F.col("i").cast("string")).alias("id"), F.array(*cl.FEATURES).alias("x"))
    return sound(cl.kmeans(points, 8), 8)


@query("clu_auto_sound", _SOUND + "embeddings")
def clu_auto_sound(spark, d):
    """The same of clu_auto, which takes k-means for these many points."""
    return sound(cl.auto(embeddings(spark, d).drop("label")), 10)


@query(
    "clu_spectral_sound",
    "SELECT count(*) AS points, count(*) AS ids, true AS clusters_fit, CAST(0 AS BIGINT) AS apart, true AS sized FROM customer",
)
def clu_spectral_sound(spark, d):
    """The same of clu_spectral, whose clusters need not be round: copies share a label, sizes add up."""
    return sound(cl.spectral(customers(spark, d), 4), 4).drop("nearest_own")


@query(
    "clu_summary",
    """WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label <> -1),
    c AS (SELECT label, pos, avg(v) AS c FROM e GROUP BY 1, 2), g AS (SELECT e.label, vec_id, sqrt(sum(power(v - c, 2))) AS dist FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY 1, 2)
    SELECT g.label, count(*) AS size, round(1 / (1 + avg(dist)), 6) AS score, any_value(k.c1) AS center_1, any_value(k.cl) AS center_sum FROM g JOIN
    (SELECT label, round(max(CASE WHEN pos = 1 THEN c END), 6) AS c1, round(sum(c), 5) AS cl FROM c GROUP BY label) k ON g.label = k.label GROUP BY g.label""",
)
def clu_summary(spark, d):
    out = cl.summary(embeddings(spark, d))
    total = F.aggregate("center", F.lit(0.0), lambda s, v: s + v)
    return out.select(
        "label", "size", F.round("score", 6).alias("score"), F.round(F.col("center")[0], 6).alias("center_1"), F.round(total, 5).alias("center_sum")
    )
