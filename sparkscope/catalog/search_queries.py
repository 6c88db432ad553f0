"""Search tables and tenancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import SPANS_SQL, newest, spans, table
from sparkscope.operators import search as se, tenancy as tn

_STOP = ", ".join(f"'{w}'" for w in se.STOP_WORDS)


def _tokens(c):
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', ' ', 'g'), '\\s+'), lambda w: strlen(w) > 2 AND NOT list_contains([{_STOP}], w))"


@query(
    "idx_tokens",
    f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS ts FROM documents) SELECT doc_id, unnest(ts) AS term, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS position FROM t""",
)
def idx_tokens(spark, d):
    return se.token_rows(table(spark, d, "documents"), "doc_id", "text")


@query(
    "idx_postings",
    f"""WITH f AS (SELECT doc_id, 'text' AS field, {_tokens('text')} AS ts FROM documents UNION ALL SELECT doc_id, 'source', {_tokens('source')} FROM documents),
    t AS (SELECT doc_id, field, unnest(ts) AS term, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS position FROM f)
    SELECT term, doc_id, field, count(*) AS frequency, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM t GROUP BY term, doc_id, field""",
)
def idx_postings(spark, d):
    out = se.postings(table(spark, d, "documents"), "doc_id", ["text", "source"])
    return out.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(
    "idx_term_stats",
    f"""WITH f AS (SELECT doc_id, {_tokens('text')} AS ts FROM documents), t AS (SELECT doc_id, unnest(ts) AS term FROM f)
    SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term""",
)
def idx_term_stats(spark, d):
    return se.term_stats(se.postings(table(spark, d, "documents"), "doc_id", ["text"]), "doc_id")


@query(
    "idx_key_profile",
    """WITH k AS (SELECT concat_ws('|', CAST(l_partkey AS VARCHAR), l_returnflag, l_linestatus) AS key FROM lineitem)
    SELECT count(*) AS total, count(DISTINCT key) AS unique_keys, count(*) - count(DISTINCT sha256(key)) AS repeats, count(DISTINCT key) - count(DISTINCT sha256(key)) AS hash_collisions,
      round(count(*) / count(DISTINCT sha256(key)), 6) AS load_factor, round(avg(strlen(key)), 6) AS avg_key_length FROM k""",
)
def idx_key_profile(spark, d):
    return se.key_profile(table(spark, d, "lineitem"), ["l_partkey", "l_returnflag", "l_linestatus"])


@query(
    "idx_bbox",
    "SELECT label, round(min(embedding[1]), 6) AS min_x, round(min(embedding[2]), 6) AS min_y, round(max(embedding[1]), 6) AS max_x, round(max(embedding[2]), 6) AS max_y FROM (SELECT label, embedding::DOUBLE[] AS embedding FROM embeddings) GROUP BY label",
)
def idx_bbox(spark, d):
    points = table(spark, d, "embeddings").select(
        "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )
    box = se.bounding_box(points, "x", "y", ["label"])
    return box.select("label", *[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


_ENTRIES = "SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE d.lang END AS lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(
    "idx_null_sweep",
    f"""WITH e AS ({_ENTRIES}) SELECT field, count(CASE WHEN v IS NULL OR v = '' THEN 1 END) AS orphans, count(*) AS entries, (SELECT count(*) FROM e WHERE lang <> '' AND quality IS NOT NULL AND toxic IS NOT NULL) AS clean_rows
    FROM (SELECT unnest(['lang', 'quality', 'toxic']) AS field, unnest([lang, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS v FROM e) GROUP BY field""",
)
def idx_null_sweep(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")).alias("lang"))
    entries = docs.join(table(spark, d, "labels"), "doc_id", "left")
    clean, report = se.sweep(entries, ["lang", "quality", "toxic"])
    return report.crossJoin(F.broadcast(clean.agg(F.count(F.lit(1)).alias("clean_rows"))))


# -- tenancy -----------------------------------------------------------------------


def grants(spark, d):
    """Tenant n may query the data of tenant n + 25 and tenant n's region."""
    n = table(spark, d, "nation")
    text = lambda c: c.cast("string")
    return n.select(
        text(F.col("n_nationkey")).alias("source"), F.lit("query").alias("operation"), text(F.col("n_nationkey") + 25).alias("target")
    ).unionByName(
        n.select(text(F.col("n_nationkey")).alias("source"), F.lit("export").alias("operation"), text(F.col("n_regionkey")).alias("target"))
    )


@query(
    "ten_scope",
    f"""WITH t AS ({SPANS_SQL}) SELECT id, tenant_id, 'query' AS operation FROM t WHERE tenant_id IN ('7', '32') UNION ALL SELECT id, tenant_id, 'delete' FROM t WHERE tenant_id = '7'
    UNION ALL SELECT id, tenant_id, 'compliance' FROM t UNION ALL SELECT id, tenant_id, 'closed' FROM t WHERE tenant_id = '7'""",
)
def ten_scope(spark, d):
    rows, g = spans(spark, d).select("id", "tenant_id"), grants(spark, d)
    cases = {
        "query": tn.visible(rows, "7", "query", g),
        "delete": tn.visible(rows, "7", "delete", g),
        "compliance": tn.visible(rows, "7", "compliance", g, tn.Sharing(compliance_sharing=True)),
        "closed": tn.visible(rows, "7", "query", g, tn.Sharing(cross_tenant_analytics=False)),
    }
    out = None
    for operation, df in cases.items():
        one = df.withColumn("operation", F.lit(operation))
        out = one if out is None else out.unionByName(one)
    return out


RESOURCES = ["cpu_cores", "connections", "requests_per_second", "memory_bytes"]
USAGE_SQL = """SELECT CAST(user_id AS VARCHAR) AS tenant_id, sum(value) / 1000 AS cpu_cores, CAST(count(*) AS DOUBLE) AS connections, count(DISTINCT date_trunc('hour', ts)) * 10.0::DOUBLE AS requests_per_second, sum(value) * 250000 AS memory_bytes FROM events GROUP BY 1"""
QUOTA_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS tenant_id, 2 + c_custkey % 4 AS cpu_cores, 60 + c_custkey % 30 AS connections, NULL AS requests_per_second, NULL AS memory_bytes FROM customer"
LIMITS = f"""WITH u AS ({USAGE_SQL}), q AS ({QUOTA_SQL}), l AS (SELECT u.tenant_id, unnest(['cpu_cores', 'connections', 'requests_per_second', 'memory_bytes']) AS resource, unnest([u.cpu_cores, u.connections, u.requests_per_second, u.memory_bytes]) AS used,
    unnest([coalesce(q.cpu_cores, 1)::DOUBLE, coalesce(q.connections, 100)::DOUBLE, coalesce(q.requests_per_second, 1000)::DOUBLE, coalesce(q.memory_bytes, 1073741824)::DOUBLE]) AS quota FROM u LEFT JOIN q ON u.tenant_id = q.tenant_id) """
_LEVEL = "CASE WHEN {p} >= 95 THEN 'critical' WHEN {p} >= 80 THEN 'warning' ELSE 'normal' END"


def usage(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("tenant_id")).agg(
        (F.sum("value") / 1000).alias("cpu_cores"),
        F.count(F.lit(1)).cast("double").alias("connections"),
        (F.countDistinct(F.date_trunc("hour", "ts")) * 10.0).alias("requests_per_second"),
        (F.sum("value") * 250_000).alias("memory_bytes"),
    )


def quotas(spark, d):
    c = table(spark, d, "customer")
    none = F.lit(None).cast("double")
    return c.select(
        F.col("c_custkey").cast("string").alias("tenant_id"),
        (2 + F.col("c_custkey") % 4).cast("double").alias("cpu_cores"),
        (60 + F.col("c_custkey") % 30).cast("double").alias("connections"),
        none.alias("requests_per_second"),
        none.alias("memory_bytes"),
    )


@query("ten_utilisation", LIMITS + f"SELECT tenant_id, resource, round(used, 5) AS used, quota, round(used / quota * 100, 8) AS percent, {_LEVEL.format(p='used / quota * 100')} AS level FROM l")
def ten_utilisation(spark, d):
    out = tn.utilisation(usage(spark, d), quotas(spark, d), RESOURCES)
    return out.withColumns({"used": F.round("used", 5), "percent": F.round("percent", 8)})


_REQ = """, r AS (SELECT CAST(user_id AS VARCHAR) AS tenant_id, CASE WHEN event_type = 'click' THEN 'cpu_cores' ELSE 'connections' END AS resource, event_id AS request, value / 10 AS amount FROM events WHERE event_type IN ('click', 'error'))"""


@query(
    "ten_request_check",
    LIMITS
    + _REQ
    + f"""SELECT request, r.tenant_id, r.resource, m.mode, used + amount > quota AS exceeded, {_LEVEL.format(p='((used + amount) / quota * 100)')} AS level, m.mode <> 'strict' OR used + amount <= quota AS allowed
    FROM r JOIN l ON r.tenant_id = l.tenant_id AND r.resource = l.resource CROSS JOIN (SELECT unnest(['strict', 'soft']) AS mode) m""",
)
def ten_request_check(spark, d):
    e = table(spark, d, "events").filter("event_type IN ('click', 'error')")
    requests = e.select(
        F.col("user_id").cast("string").alias("tenant_id"),
        F.when(F.col("event_type") == "click", "cpu_cores").otherwise("connections").alias("resource"),
        F.col("event_id").alias("request"),
        (F.col("value") / 10).alias("amount"),
    )
    limits = tn.with_limits(usage(spark, d), quotas(spark, d), RESOURCES)
    cols = ["request", "tenant_id", "resource", "exceeded", "level", "allowed"]
    strict = tn.check_requests(limits, requests, "strict").select(*cols, F.lit("strict").alias("mode"))
    return strict.unionByName(tn.check_requests(limits, requests, "soft").select(*cols, F.lit("soft").alias("mode")))


@query(
    "ten_autoscale",
    f"""WITH q AS ({QUOTA_SQL}), s AS (SELECT CAST(user_id AS VARCHAR) AS tenant_id, value / 20 AS cpu, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    m AS (SELECT tenant_id, count(*) AS samples, avg(cpu) AS a FROM s WHERE rn <= 5 GROUP BY tenant_id),
    c AS (SELECT CAST(user_id AS VARCHAR) AS tenant_id, max(ts) AS at FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT m.tenant_id, samples, round(a, 6) AS avg_cpu, samples >= 5 AND a / coalesce(q.cpu_cores, 1) * 100 > 95 AND NOT coalesce(epoch_us((SELECT max(ts) FROM events)) - epoch_us(c.at) < 86400000000, false) AS scale_up
    FROM m LEFT JOIN q ON m.tenant_id = q.tenant_id LEFT JOIN c ON c.tenant_id = m.tenant_id""",
)
def ten_autoscale(spark, d):
    e = table(spark, d, "events")
    tenant = F.col("user_id").cast("string").alias("tenant_id")
    samples = e.select(tenant, "ts", F.col("event_id").alias("seq"), (F.col("value") / 20).alias("cpu_cores"))
    scaled = e.filter("event_type = 'signup'").groupBy(tenant).agg(F.max("ts").alias("scaled_at"))
    return tn.needs_scaling(samples, quotas(spark, d), cooldown_seconds=86_400, scaled=scaled, as_of=newest(e, "ts"))
