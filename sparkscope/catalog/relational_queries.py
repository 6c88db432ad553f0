"""Joins, windows, sorting, paging, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import SERIES_SQL, SPANS_SQL, series, spans, table
from sparkscope.operators import intervals, ordered, relational as rel
from sparkscope.session import small_side

S = f"WITH s AS ({SERIES_SQL}) "


# -- joins ----------------------------------------------------------------------


@query(
    "join_inner",
    """SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS orders, round(avg(o_totalprice), 6) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2 HAVING count(*) > 20""",
)
def join_inner(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    out = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))
    return out.agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 6).alias("avg_price")).filter("orders > 20")


@query(
    "join_left_multi",
    """SELECT c_custkey, count(o_orderkey) AS orders, count(l_orderkey) AS returned_lines, count(DISTINCT o_orderkey) AS distinct_orders, round(sum(l_extendedprice), 4) AS returned_price
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY c_custkey""",
)
def join_left_multi(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice")
    joined = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("orders"),
        F.count("l_orderkey").alias("returned_lines"),
        F.countDistinct("o_orderkey").alias("distinct_orders"),
        F.round(F.sum("l_extendedprice"), 4).alias("returned_price"),
    )


@query(
    "join_history_deviation",
    """SELECT e.event_id AS id, e.event_type, round(h.historical_avg, 6) AS historical_avg, round(e.value - h.historical_avg, 6) AS deviation FROM events e JOIN
    (SELECT event_type, avg(value) AS historical_avg FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY event_type) h ON e.event_type = h.event_type WHERE e.ts >= TIMESTAMP '2024-01-20'""",
)
def join_history_deviation(spark, d):
    e = table(spark, d, "events")
    cut = F.lit("2024-01-20").cast("timestamp")
    out = rel.deviation(e.filter(F.col("ts") >= cut), e.filter(F.col("ts") < cut), ["event_type"], "value")
    return out.select(
        F.col("event_id").alias("id"), "event_type", F.round("historical_avg", 6).alias("historical_avg"), F.round("deviation", 6).alias("deviation")
    )


_AB = """WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') """


def _ab(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_totalprice")
    b = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment", "c_acctbal")
    return a, b, a.o_custkey == b.c_custkey


@query("join_right", _AB + "SELECT o_orderkey, c_custkey, c_acctbal FROM a RIGHT JOIN b ON o_custkey = c_custkey")
def join_right(spark, d):
    a, b, on = _ab(spark, d)
    return a.join(b, on, "right").select("o_orderkey", "c_custkey", "c_acctbal")


@query("join_full", _AB + "SELECT o_orderkey, o_custkey, c_custkey FROM a FULL JOIN b ON o_custkey = c_custkey")
def join_full(spark, d):
    a, b, on = _ab(spark, d)
    return a.join(b, on, "full").select("o_orderkey", "o_custkey", "c_custkey")


@query("join_semi", _AB + "SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE o_custkey = c_custkey)")
def join_semi(spark, d):
    a, b, on = _ab(spark, d)
    return a.join(b, on, "left_semi")


@query("join_anti", _AB + "SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    a, b, on = _ab(spark, d)
    return a.join(b, on, "left_anti")


@query(
    "join_cross",
    "SELECT s_suppkey, r_name, n_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey",
)
def join_cross(spark, d):
    """Every supplier with every region: the SQL cross product against a dimension of fixed size."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    regions = small_side(r.select("r_name"), max_rows=1_000)
    return s.join(n, s.s_nationkey == n.n_nationkey).crossJoin(regions).select("s_suppkey", "r_name", "n_name")


_BANDS = "SELECT n_nationkey AS band, n_nationkey * 20.0 AS low, n_nationkey * 20.0 + 20 AS high FROM nation"


@query("join_theta", f"SELECT event_id AS id, band, value FROM events JOIN ({_BANDS}) b ON value >= low AND value < high")
def join_theta(spark, d):
    """Match each value to its band, by the slots of both."""
    bands = table(spark, d, "nation").selectExpr(
        "n_nationkey AS band", "CAST(n_nationkey * 20 AS DOUBLE) AS low", "CAST(n_nationkey * 20 + 20 AS DOUBLE) AS high"
    )
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    return intervals.join(e, bands, "value", "low", "high").select("id", "band", "value")


@query(
    "join_broadcast_lookup",
    "SELECT l_orderkey, l_linenumber, s_name, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
)
def join_broadcast_lookup(spark, d):
    names = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = small_side(names.select("s_suppkey", "s_name", "n_name"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return l.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name", "n_name")


# -- windows -----------------------------------------------------------------------


@query("win_row_number", S + "SELECT id, series, row_number() OVER (PARTITION BY series ORDER BY ts, id) AS rn FROM s")
def win_row_number(spark, d):
    return rel.row_numbers(series(spark, d), ["series"], ["ts", "id"]).select("id", "series", "rn")


@query("win_lag", S + "SELECT id, series, value, lag(value) OVER (PARTITION BY series ORDER BY ts, id) AS previous FROM s")
def win_lag(spark, d):
    return rel.neighbours(series(spark, d), ["series"], ["ts", "id"], "value").select("id", "series", "value", "previous")


@query("win_lead", S + "SELECT id, series, value, lead(value, 3) OVER (PARTITION BY series ORDER BY ts, id) AS next FROM s")
def win_lead(spark, d):
    return rel.neighbours(series(spark, d), ["series"], ["ts", "id"], "value", 3).select("id", "series", "value", "next")


@query("win_rank", "SELECT event_id AS id, event_type, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS rank FROM events")
def win_rank(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "user_id")
    return ordered.ranked(e, ["event_type"], "user_id").select("id", "event_type", "rank")


@query("win_dense_rank", "SELECT event_id AS id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS dense FROM events")
def win_dense_rank(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "user_id")
    return ordered.ranked(e, ["event_type"], "user_id", rank=None, dense="dense").select("id", "event_type", "dense")


@query("win_ntile", S + "SELECT id, series, CAST(ntile(7) OVER (PARTITION BY series ORDER BY value, id) AS INTEGER) AS tile FROM s")
def win_ntile(spark, d):
    return rel.tiles(series(spark, d), ["series"], ["value", "id"], 7).select("id", "series", "tile")


@query(
    "win_first_last",
    S + """SELECT id, series, first_value(value) OVER w AS first_value, last_value(value) OVER w AS last_value FROM s
    WINDOW w AS (PARTITION BY series ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def win_first_last(spark, d):
    return rel.ends(series(spark, d), ["series"], ["ts", "id"], "value").select("id", "series", "first_value", "last_value")


@query(
    "win_running_sum",
    S + "SELECT id, series, round(sum(value) OVER (PARTITION BY series ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 4) AS running FROM s",
)
def win_running_sum(spark, d):
    out = ordered.running_sum(series(spark, d), ["series"], ["ts", "id"], "value", "running")
    return out.select("id", "series", F.round("running", 4).alias("running"))


@query(
    "win_range_frame",
    S + "SELECT id, series, round(sum(value) OVER (PARTITION BY series ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), 4) AS last_6h FROM s",
)
def win_range_frame(spark, d):
    out = rel.range_sum(series(spark, d), ["series"], "ts", "value", 6 * 3600, "last_6h")
    return out.select("id", "series", F.round("last_6h", 4).alias("last_6h"))


@query(
    "win_moving_avg",
    S + """SELECT id, series, ma FROM (SELECT *, round(avg(value) OVER (PARTITION BY series ORDER BY ts, id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS ma,
      row_number() OVER (PARTITION BY series ORDER BY ts, id) AS rn FROM s) WHERE rn >= 12""",
)
def win_moving_avg(spark, d):
    from sparkscope.operators.series import moving_average

    return moving_average(series(spark, d), 12).select("id", "series", F.round("moving_avg", 6).alias("ma"))


# -- sort, limit, sets ------------------------------------------------------------------


@query("sort_multi", "SELECT o_orderpriority, o_orderdate, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_multi(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    return o.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query("limit", "SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def limit(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("offset", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 30 OFFSET 100")
def offset(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "value").orderBy("ts", "event_id").offset(100).limit(30)


@query("top_k", f"WITH t AS ({SPANS_SQL}) SELECT tenant_id, count(*) AS n FROM t GROUP BY tenant_id ORDER BY n DESC, tenant_id LIMIT 10")
def top_k(spark, d):
    counts = spans(spark, d).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    return rel.top(counts, F.col("n"), 10, ["tenant_id"])


_U, _V = "SELECT user_id FROM events WHERE event_type = 'click'", "SELECT user_id FROM events WHERE event_type = 'error' AND value > 60"


def _uv(spark, d):
    e = table(spark, d, "events")
    return (
        e.filter("event_type = 'click'").select("user_id"),
        e.filter("event_type = 'error' AND value > 60").select("user_id"),
    )


@query("union", f"{_U} UNION {_V}")
def union(spark, d):
    u, v = _uv(spark, d)
    return u.union(v).distinct()


@query("union_all", f"{_U} UNION ALL {_V}")
def union_all(spark, d):
    u, v = _uv(spark, d)
    return u.union(v)


@query("intersect", f"SELECT *, 'set' AS form FROM ({_U} INTERSECT {_V}) UNION ALL SELECT *, 'bag' FROM ({_U} INTERSECT ALL {_V})")
def intersect(spark, d):
    u, v = _uv(spark, d)
    return u.intersect(v).withColumn("form", F.lit("set")).union(u.intersectAll(v).withColumn("form", F.lit("bag")))


@query("except", f"SELECT *, 'set' AS form FROM ({_U} EXCEPT {_V}) UNION ALL SELECT *, 'bag' FROM ({_U} EXCEPT ALL {_V})")
def except_(spark, d):
    u, v = _uv(spark, d)
    return u.subtract(v).withColumn("form", F.lit("set")).union(u.exceptAll(v).withColumn("form", F.lit("bag")))


_SUB = """SELECT x.event_type, x.n, round(x.total, 4) AS total FROM (SELECT event_type, count(*) AS n, sum(value) AS total FROM {t} GROUP BY event_type) x
    WHERE x.n > (SELECT count(*) / 6 FROM {t}) AND x.event_type IN (SELECT event_type FROM {t} WHERE value > 345)"""


@query("subquery", _SUB.format(t="events"))
def subquery(spark, d):
    table(spark, d, "events").createOrReplaceTempView("scope_events")
    return spark.sql(_SUB.format(t="scope_events"))


_DERIVED = """SELECT s.n_name, max(s.n) AS suppliers, round(sum(b.balance), 4) AS balance FROM (SELECT n_nationkey, n_name, count(*) AS n FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name) s
    JOIN (SELECT c_nationkey, sum(c_acctbal) AS balance FROM {customer} GROUP BY c_nationkey) b ON b.c_nationkey = s.n_nationkey GROUP BY s.n_name"""


@query("derived_table", _DERIVED.format(nation="nation", supplier="supplier", customer="customer"))
def derived_table(spark, d):
    names = {t: f"scope_{t}" for t in ("nation", "supplier", "customer")}
    for t, view in names.items():
        table(spark, d, t).createOrReplaceTempView(view)
    return spark.sql(_DERIVED.format(**names))
