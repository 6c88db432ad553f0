"""Record transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import FLAT_SQL, SERIES_SQL, flat, newest, records, series, table
from sparkscope.operators import transforms as tr
from sparkscope.operators.transforms import Step

REC = f"WITH rec AS ({FLAT_SQL}) "

def attr(key):
    return F.col("attributes")[key]


def tag(key):
    return F.col("tags")[key]


@query("map_copy", REC + "SELECT id, a_env AS env, a_env AS deployment, t_region AS area, t_region AS region FROM rec")
def map_copy(spark, d):
    out = tr.copy(tr.copy(records(spark, d), "env", "deployment"), "region", "tags.area")
    return out.select("id", attr("env").alias("env"), attr("deployment").alias("deployment"), tag("area").alias("area"), tag("region").alias("region"))


@query("map_rename", REC + "SELECT id, CAST(NULL AS VARCHAR) AS env, a_env AS deployment, a_k AS k, CAST(NULL AS VARCHAR) AS region, t_region AS area FROM rec")
def map_rename(spark, d):
    out = tr.rename(tr.rename(records(spark, d), "env", "deployment"), "tags.region", "tags.area")
    return out.select("id", attr("env").alias("env"), attr("deployment").alias("deployment"), attr("k").alias("k"), tag("region").alias("region"), tag("area").alias("area"))


@query("map_set", REC + "SELECT id, 'x' AS env, '1' AS flag, a_k AS k FROM rec")
def map_set(spark, d):
    out = tr.set_field(tr.set_field(records(spark, d), "env", F.lit("x")), "tags.flag", F.lit("1"))
    return out.select("id", attr("env").alias("env"), tag("flag").alias("flag"), attr("k").alias("k"))


@query(
    "map_remove",
    REC + """SELECT id, CAST(NULL AS VARCHAR) AS env, CAST(NULL AS VARCHAR) AS region,
    CAST(4 + CASE WHEN a_service IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n FROM rec""",
)
def map_remove(spark, d):
    out = tr.remove_field(tr.remove_field(records(spark, d), "env"), "tags.region")
    return out.select("id", attr("env").alias("env"), tag("region").alias("region"), F.size("attributes").alias("n"))


@query("map_add", REC + "SELECT id, coalesce(a_env, 'none') AS env, a_k AS k FROM rec")
def map_add(spark, d):
    out = tr.add(tr.add(records(spark, d), "env", "none"), "k", "0")
    return out.select("id", attr("env").alias("env"), attr("k").alias("k"))


@query("map_replace", REC + "SELECT id, CASE WHEN a_env IS NOT NULL THEN 'hidden' END AS env, a_k AS k FROM rec")
def map_replace(spark, d):
    out = tr.replace(records(spark, d), "env", "env", "hidden")
    return out.select("id", attr("env").alias("env"), attr("k").alias("k"))


@query("map_field_mapping", REC + "SELECT id, CAST(NULL AS VARCHAR) AS old, a_service AS svc FROM rec")
def map_field_mapping(spark, d):
    out = tr.map_field(records(spark, d), "service.name", "svc")
    return out.select("id", attr("service.name").alias("old"), attr("svc").alias("svc"))


@query("map_conditional_set", REC + "SELECT id, CASE WHEN a_env = 'prod' THEN 'high' END AS tier FROM rec")
def map_conditional_set(spark, d):
    out = tr.set_when(records(spark, d), "tier", attr("env") == "prod", "high")
    return out.select("id", attr("tier").alias("tier"))


@query(
    "json_extract",
    "SELECT event_id AS id, json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS inner_id, event_type AS inner_type, CAST(NULL AS VARCHAR) AS missing FROM events",
)
def json_extract(spark, d):
    nested = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")).alias("a")))
    return table(spark, d, "events").withColumn("doc", nested).select(
        F.col("event_id").alias("id"),
        tr.json_at(F.col("props"), "k").alias("k"),
        tr.json_at(F.col("doc"), "a.id").alias("inner_id"),
        tr.json_at(F.col("doc"), "a.type").alias("inner_type"),
        tr.json_at(F.col("doc"), "a.b").alias("missing"),
    )


@query(
    "ts_format",
    REC + "SELECT id, CASE WHEN k % 10 = 0 THEN a_status ELSE strftime(ts, '%Y/%m/%d %H-%M') END AS text FROM rec",
)
def ts_format(spark, d):
    raw = F.when(F.col("k") % 10 == 0, F.col("a_status")).otherwise(tr.rfc3339(F.col("ts")))
    # A status such as 500 must not be read as a year, so only full times are reformatted.
    text = F.when(raw.contains("T"), tr.reformat_time(raw, "yyyy/MM/dd HH-mm")).otherwise(raw)
    return flat(spark, d).select("id", text.alias("text"))


@query(
    "type_convert",
    REC
    + """SELECT id, TRY_CAST(a_status AS BIGINT) AS as_int, TRY_CAST(a_k AS DOUBLE) AS as_float,
       CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END AS as_bool, ts AS as_ts,
       CASE WHEN TRY_CAST(a_status AS BIGINT) IS NULL THEN 'status: cannot read ''n/a'' as integer' END AS error FROM rec""",
)
def type_convert(spark, d):
    flag = F.when(F.col("k") % 3 == 0, "true").when(F.col("k") % 3 == 1, "false").otherwise("maybe")
    status = F.col("a_status")
    return flat(spark, d).select(
        "id",
        tr.convert(status, "integer").alias("as_int"),
        tr.convert(F.col("a_k"), "float").alias("as_float"),
        tr.convert(flag, "boolean").alias("as_bool"),
        tr.convert(tr.rfc3339(F.col("ts")), "timestamp").alias("as_ts"),
        tr.conversion_error(status, "status", "integer")["message"].alias("error"),
    )


@query(
    "transform_status",
    REC
    + """SELECT id, CASE WHEN n = 0 THEN 'Success' ELSE 'Partial' END AS lenient, n AS lenient_errors,
       CASE WHEN n = 0 THEN 'Success' ELSE 'Failed' END AS strict, CAST(least(n, 1) AS INTEGER) AS strict_errors
    FROM (SELECT id, CAST((TRY_CAST(a_status AS BIGINT) IS NULL)::INT + (a_env IS NOT NULL)::INT AS INTEGER) AS n FROM rec)""",
)
def transform_status(spark, d):
    errors = [
        tr.conversion_error(F.col("a_status"), "status", "integer"),
        tr.conversion_error(F.col("a_env"), "env", "float"),
    ]
    rows = flat(spark, d)
    lenient = tr.with_status(rows, errors).select(
        "id", "a_status", "a_env", F.col("status").alias("lenient"), F.size("errors").alias("lenient_errors")
    )
    return tr.with_status(lenient, errors, continue_on_error=False).select(
        "id", "lenient", "lenient_errors", F.col("status").alias("strict"), F.size("errors").alias("strict_errors")
    )


@query(
    "template_render",
    REC
    + """SELECT id, concat(record_type, ':', a_k, '@', t_region, ' ', coalesce(a_env, '${attributes.env}'), ' ',
       CASE WHEN k % 6 = 2 THEN concat('own-', t_region) ELSE '${service}' END, ' ', CAST(epoch_us(ts) // 1000000 AS VARCHAR), '/',
       CAST(epoch_us(ts) // 1000 AS VARCHAR), ' ', id, ' ${other}') AS text FROM rec""",
)
def template_render(spark, d):
    text = tr.render(
        "${record_type}:${attributes.k}@${tags.region} ${attributes.env} ${service} "
        "${timestamp_unix}/${timestamp_ms} ${id} ${other}"
    )
    return records(spark, d).select("id", text.alias("text"))


@query(
    "step_chain",
    REC
    + """SELECT id, a_status AS status_text, TRY_CAST(a_k AS DOUBLE) AS a_k, 'v2' AS version,
       TRY_CAST(a_status AS DOUBLE) AS status_number FROM rec""",
)
def step_chain(spark, d):
    rows = flat(spark, d).select("id", "a_status", "a_k", "a_env", F.col("a_status").alias("status_number"))
    steps = [
        Step("rename_field", "a_status", "status_text"),
        Step("add_field", "version", "v2"),
        Step("convert_type", "a_k", "number"),
        Step("convert_type", "status_number", "number"),
        Step("remove_field", "a_env"),
        Step("remove_field", "not_there"),
    ]
    return tr.apply_steps(rows, steps)


@query("str_upper", "SELECT p_partkey AS id, upper(p_name) AS out FROM part UNION ALL SELECT page_id, upper(url) FROM pages")
def str_upper(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("out")).unionByName(
        table(spark, d, "pages").select(F.col("page_id").alias("id"), F.upper("url").alias("out"))
    )


@query("str_lower", "SELECT doc_id AS id, lower(text) AS out FROM documents")
def str_lower(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("out"))


@query(
    "str_trim",
    "SELECT doc_id AS id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS out FROM documents",
)
def str_trim(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), tr.trim(F.col("text")).alias("out"))


@query("str_replace", "SELECT doc_id AS id, replace(text, 'the', 'THE') AS out FROM documents")
def str_replace(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.replace("text", F.lit("the"), F.lit("THE")).alias("out")
    )


@query("str_substring", "SELECT doc_id AS id, substring(text, 6, 20) AS mid, substring(text, 11) AS tail FROM documents")
def str_substring(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        tr.substring(F.col("text"), 5, 25).alias("mid"),
        tr.substring(F.col("text"), 10).alias("tail"),
    )


@query(
    "url_domain",
    """SELECT page_id AS id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^https?://([^/]*)', 1) ELSE url END AS out FROM pages
    UNION ALL SELECT event_id, concat('host', CAST(user_id % 3 AS VARCHAR), '.example.com:8080') FROM events
    UNION ALL SELECT p_partkey, p_name FROM part""",
)
def url_domain(spark, d):
    urls = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    urls = urls.unionByName(flat(spark, d).select(F.col("event_id").alias("id"), F.col("a_url").alias("url")))
    urls = urls.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("url")))
    return urls.select("id", tr.url_domain(F.col("url")).alias("out"))


@query(
    "url_path",
    """SELECT page_id AS id, CASE WHEN regexp_matches(url, '^https?://') THEN concat('/', regexp_extract(url, '^https?://[^/]*/(.*)$', 1)) ELSE url END AS out FROM pages
    UNION ALL SELECT event_id, concat('/p/', json_extract_string(props, '$.k'), '?q=', json_extract_string(props, '$.k')) FROM events""",
)
def url_path(spark, d):
    urls = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    urls = urls.unionByName(flat(spark, d).select(F.col("event_id").alias("id"), F.col("a_url").alias("url")))
    return urls.select("id", tr.url_path(F.col("url")).alias("out"))


@query("str_truncate", "SELECT doc_id AS id, CASE WHEN length(text) > 40 THEN concat(left(text, 40), '...') ELSE text END AS out FROM documents")
def str_truncate(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), tr.truncate(F.col("text"), 40).alias("out"))


@query("str_hash", "SELECT doc_id AS id, sha256(text) AS out FROM documents")
def str_hash(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), tr.text_hash(F.col("text")).alias("out"))


@query("regex_group1", "SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages")
def regex_group1(spark, d):
    return table(spark, d, "pages").select(
        F.col("page_id").alias("id"),
        tr.group1(F.col("html"), "<title>([^<]*)</title>").alias("title"),
        tr.group1(F.col("url"), "[?&]page=([0-9]+)").alias("page"),
    )


@query(
    "norm_metric_name",
    REC
    + """SELECT id, regexp_replace(replace(replace(replace(lower(metric_name), ' ', '_'), '-', '_'), '.', '_'), '[^\\p{L}\\p{N}_]', '', 'g') AS out FROM rec
    UNION ALL SELECT c_name, regexp_replace(replace(replace(replace(lower(c_name), ' ', '_'), '-', '_'), '.', '_'), '[^\\p{L}\\p{N}_]', '', 'g') FROM customer""",
)
def norm_metric_name(spark, d):
    names = flat(spark, d).select("id", F.col("metric_name").alias("name")).unionByName(
        table(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_name").alias("name"))
    )
    return names.select("id", tr.metric_name(F.col("name")).alias("out"))


@query("norm_span_name", REC + "SELECT id, replace(replace(trim(span_name), '::', '.'), '()', '') AS out FROM rec")
def norm_span_name(spark, d):
    return flat(spark, d).select("id", tr.span_name(F.col("span_name")).alias("out"))


def _case(column: str, categories: dict[str, list[str]], default: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in categories.items()
    )
    return f"CASE {arms} ELSE '{default}' END"


@query("cat_metric", REC + f"SELECT id, {_case('metric_name', tr.METRIC_CATEGORIES, 'other')} AS category FROM rec WHERE metric_name IS NOT NULL")
def cat_metric(spark, d):
    rows = flat(spark, d).filter(F.col("metric_name").isNotNull())
    return rows.select("id", tr.category(F.col("metric_name"), tr.METRIC_CATEGORIES, "other").alias("category"))


@query("cat_service", f"SELECT page_id AS id, {_case('url', tr.SERVICE_CATEGORIES, 'service')} AS category FROM pages")
def cat_service(spark, d):
    return table(spark, d, "pages").select(
        F.col("page_id").alias("id"), tr.category(F.col("url"), tr.SERVICE_CATEGORIES, "service").alias("category")
    )


@query(
    "cat_log",
    REC
    + f"""SELECT id, {_case('log_message', tr.LOG_CATEGORIES, 'other')} AS category FROM rec WHERE log_message IS NOT NULL
    UNION ALL SELECT CAST(doc_id AS VARCHAR), {_case('text', tr.LOG_CATEGORIES, 'other')} FROM documents""",
)
def cat_log(spark, d):
    logs = flat(spark, d).filter(F.col("log_message").isNotNull()).select("id", F.col("log_message").alias("text"))
    logs = logs.unionByName(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    return logs.select("id", tr.category(F.col("text"), tr.LOG_CATEGORIES, "other").alias("category"))


@query("stamp_processed", f"WITH s AS ({SERIES_SQL}) SELECT id, (SELECT max(ts) FROM s) AS processed_at, 'windower' AS processor_name, '1.0.0' AS processor_version FROM s")
def stamp_processed(spark, d):
    rows = series(spark, d)
    return tr.stamp(rows.select("id"), newest(rows, "ts"), "windower", "1.0.0")


@query(
    "time_bucket",
    """SELECT event_id AS id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS quarter,
    time_bucket(INTERVAL 7 SECOND, ts, TIMESTAMP '1970-01-01') AS seven FROM events""",
)
def time_bucket(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        tr.floor_time(F.col("ts"), 900).alias("quarter"),
        tr.floor_time(F.col("ts"), 7).alias("seven"),
    )


@query(
    "parse_record",
    REC
    + """SELECT id, metric_name AS m_name, metric_value AS m_value, CASE WHEN record_type = 'Metric' THEN event_type END AS m_kind, trace_id AS t_trace, duration_ns AS t_ns,
       log_level AS l_level, log_message AS l_message, event_name AS e_name, a_url AS url, t_region AS region FROM rec""",
)
def parse_record(spark, d):
    text = records(spark, d).select(
        "id",
        *[F.to_json(kind).alias(kind) for kind in ("metric", "trace", "log", "event", "attributes", "tags")],
    )
    read = text.select(
        "id",
        *[tr.parse(F.col(kind), kind).alias(kind) for kind in ("metric", "trace", "log", "event")],
        tr.string_map_of(F.col("attributes")).alias("attributes"),
        tr.string_map_of(F.col("tags")).alias("tags"),
    )
    return read.select(
        "id",
        F.col("metric.name").alias("m_name"),
        F.col("metric.value").alias("m_value"),
        F.col("metric.labels")["kind"].alias("m_kind"),
        F.col("trace.trace_id").alias("t_trace"),
        F.col("trace.duration_ns").alias("t_ns"),
        F.col("log.level").alias("l_level"),
        F.col("log.message").alias("l_message"),
        F.col("event.name").alias("e_name"),
        F.col("attributes")["url"].alias("url"),
        F.col("tags")["region"].alias("region"),
    )


@query(
    "extract_ids",
    REC
    + """SELECT id, coalesce(CASE WHEN k % 6 = 2 THEN concat('own-', t_region) END, a_service) AS service_name,
       span_name AS operation_name, trace_id, span_id FROM rec""",
)
def extract_ids(spark, d):
    text = records(spark, d).select("id", F.to_json(F.struct("trace", "service", "attributes")).alias("doc"))
    return text.select(
        "id", *[tr.extract(F.col("doc"), w).alias(w) for w in ("service_name", "operation_name", "trace_id", "span_id")]
    )
