"""Data quality and dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import FLAT_SQL, LOG, STRINGS, as_record, as_struct, flat, newest, nest, records, table
from sparkscope.operators import dlq, quality as q, rules
from sparkscope.operators import transforms as tr
from sparkscope.operators.quality import Check, FieldRule
from sparkscope.session import scratch

REC = f"WITH rec AS ({FLAT_SQL}) "
CLOCK = "(SELECT max(ts) FROM events)"


def document_logs(spark, d, clock):
    """documents as log records that spread over the days before and after the clock."""
    docs = table(spark, d, "documents")
    when = F.timestamp_micros(F.unix_micros(clock) - (F.col("doc_id") % 40 - 2) * 86_400_000_000)
    return docs.select(
        *as_record(
            id=F.concat(F.lit("d"), F.col("doc_id").cast("string")),
            timestamp=when,
            record_type=F.lit("Log"),
            source=F.col("source"),
            log=as_struct(LOG, level=F.lit("Info"), message=F.col("text"), severity_number=(F.col("doc_id") % 30)),
            attributes=F.create_map(F.lit("lang"), F.col("lang")).cast(STRINGS),
            tags=F.create_map().cast(STRINGS),
        )
    )


DOC_TS = f"{CLOCK} - to_days(CAST(doc_id % 40 - 2 AS INTEGER))"


@query(
    "dq_gate",
    REC
    + f"""SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 40 - 2 > 30 THEN '{q.TOO_OLD}'
         WHEN doc_id % 40 - 2 < 0 THEN '{q.IN_FUTURE}'
         WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) = '' THEN '{q.NO_MESSAGE}'
         WHEN strlen(text) > 10000 THEN '{q.LONG_MESSAGE}' END AS reject_reason FROM documents
    UNION ALL SELECT id, CASE WHEN record_type = 'Trace' AND k % 7 = 0 THEN '{q.NO_IDS}'
         WHEN record_type = 'Trace' AND k % 7 = 1 THEN '{q.LONG_IDS}' WHEN record_type = 'Metric' AND k % 7 = 2 THEN '{q.NO_NAME}'
         WHEN record_type = 'Metric' AND k % 7 = 3 THEN '{q.LONG_NAME}' END FROM rec""",
)
def dq_gate(spark, d):
    f = flat(spark, d)
    broken = f.withColumns(
        {
            "span_id": F.when(F.col("k") % 7 == 0, F.lit(" ")).otherwise(F.col("span_id")),
            "trace_id": F.when(F.col("k") % 7 == 1, F.repeat("trace_id", F.lit(2))).otherwise(F.col("trace_id")),
            "metric_name": F.when(F.col("k") % 7 == 2, F.lit(""))
            .when(F.col("k") % 7 == 3, F.repeat("metric_name", F.lit(30)))
            .otherwise(F.col("metric_name")),
        }
    )
    clock = newest(f, "ts")
    return q.judged(nest(broken).unionByName(document_logs(spark, d, clock)), clock).select("id", "reject_reason")


@query(
    "dq_rules",
    REC
    + """, judged AS (SELECT *, a_url NOT LIKE 'https://host2%' AS c1, coalesce(a_env, '') <> '' AS c2,
       NOT coalesce(TRY_CAST(a_status AS DOUBLE) BETWEEN 100 AND 599, false) AS f3, NOT coalesce(length(t_service) BETWEEN 5 AND 5, false) AS f4 FROM rec)
    SELECT id, NOT c1 AS dropped, coalesce(a_env, CASE WHEN c1 THEN 'unset' END) AS env, CASE WHEN c1 THEN f3 END AS skipped,
       array_to_string(list_filter([CASE WHEN NOT c1 THEN 'url' END, CASE WHEN c1 AND NOT c2 THEN 'env' END,
         CASE WHEN c1 AND f3 THEN 'status' END, CASE WHEN c1 AND NOT f3 AND f4 THEN 'service' END,
         CASE WHEN c1 AND NOT f3 AND NOT (k < 50) THEN 'small' END], lambda x: x IS NOT NULL), ',') AS failed FROM judged""",
)
def dq_rules(spark, d):
    checks = [
        Check("url", "url", "pattern", "^https://host[01]", "drop"),
        Check("env", "env", "required", action="use_default", default="unset"),
        Check("status", "status_code", "range", (100, 599), "skip_enrichment"),
        Check("service", "tags.service", "length", (5, 5)),
        Check("small", "k", "custom", F.col("attributes")["k"].cast("int") < 50),
        Check("off", "missing", "required", action="drop", enabled=False),
    ]
    kept, dropped = q.apply_checks(records(spark, d), checks)
    cols = lambda flag: ["id", F.lit(flag).alias("dropped"), F.col("attributes")["env"].alias("env")]
    joined = F.array_join("failed", ",").alias("failed")
    return kept.select(*cols(False), F.col("skip_enrichment").alias("skipped"), joined).unionByName(
        dropped.select(*cols(True), F.lit(None).cast("boolean").alias("skipped"), joined)
    )


@query(
    "dq_expr",
    REC
    + """SELECT id, (coalesce(a_env = 'prod', false) OR TRY_CAST(a_k AS DOUBLE) > 50) AND metric_name IS NOT NULL AS e_mixed,
       coalesce(a_env <> 'prod', false) AS e_ne, coalesce(contains(log_message, 'timeout') OR starts_with(log_message, 'disk'), false) AS e_text,
       coalesce(suffix(a_url, '9'), false) AS e_suffix, coalesce(metric_value <= 20.5, false) AS e_num,
       coalesce(TRY_CAST(a_status AS DOUBLE) = 500, false) AS e_eq FROM rec""",
)
def dq_expr(spark, d):
    doc = F.col("doc")
    rows = records(spark, d).select("id", F.to_json(F.struct("metric", "log", "attributes")).alias("doc"))
    mixed = (q.compare(doc, "$.attributes.env", "==", "prod") | q.compare(doc, "$.attributes.k", ">", 50)) & q.exists(
        doc, "$.metric.name"
    )
    text = q.text_test(doc, "$.log.message", "contains", "timeout") | q.text_test(
        doc, "$.log.message", "startsWith", "disk"
    )
    return rows.select(
        "id",
        mixed.alias("e_mixed"),
        q.compare(doc, "$.attributes.env", "!=", "prod").alias("e_ne"),
        text.alias("e_text"),
        q.text_test(doc, "$.attributes.url", "endsWith", "9").alias("e_suffix"),
        q.compare(doc, "$.metric.value", "<=", 20.5).alias("e_num"),
        q.compare(doc, "$.attributes.status_code", "==", 500).alias("e_eq"),
    )


@query(
    "dq_builtin",
    f"""WITH c AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN concat('user', CAST(user_id AS VARCHAR), '@mail.example.com')
      WHEN 1 THEN concat('https://h', CAST(user_id AS VARCHAR), '.example.com/', event_type) WHEN 2 THEN concat('10.0.', CAST(user_id AS VARCHAR), '.', CAST(event_id % 2000 AS VARCHAR))
      WHEN 3 THEN regexp_replace(md5(CAST(event_id AS VARCHAR)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
      WHEN 4 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS text FROM events
      UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT doc_id, text FROM documents)
    SELECT id, regexp_matches(text, '{q.EMAIL}') AS is_email, regexp_matches(text, '{q.URL}') AS is_url,
      regexp_matches(text, '{q.IPV4}') OR regexp_matches(text, '{q.IPV6}') AS is_ip, regexp_matches(text, '{q.UUID}') AS is_uuid,
      regexp_matches(text, '{q.NUMBER}') AS is_number FROM c""",
)
def dq_builtin(spark, d):
    uid = F.col("user_id").cast("string")
    eid = F.col("event_id").cast("string")
    dashed = F.regexp_replace(F.md5(eid), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    case = F.col("event_id") % 6
    text = (
        F.when(case == 0, F.concat(F.lit("user"), uid, F.lit("@mail.example.com")))
        .when(case == 1, F.concat(F.lit("https://h"), uid, F.lit(".example.com/"), F.col("event_type")))
        .when(case == 2, F.concat(F.lit("10.0."), uid, F.lit("."), (F.col("event_id") % 2000).cast("string")))
        .when(case == 3, dashed)
        .when(case == 4, eid)
        .otherwise(F.col("event_type"))
    )
    c = table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("text"))
    c = c.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")))
    c = c.unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    t = F.col("text")
    return c.select(
        "id",
        q.is_email(t).alias("is_email"),
        q.is_url(t).alias("is_url"),
        q.is_ip(t).alias("is_ip"),
        q.is_uuid(t).alias("is_uuid"),
        q.is_number(t).alias("is_number"),
    )


@query(
    "dq_schema_errors",
    REC
    + """SELECT id, 'error' AS kind, 'EMPTY_EVENT_NAME' AS code, 'High' AS severity, 'data.event.name' AS field_path FROM rec WHERE record_type = 'Event' AND trim(event_name) = ''
    UNION ALL SELECT id, 'error', 'FUTURE_EVENT_TIMESTAMP', 'Medium', 'data.event.timestamp' FROM rec WHERE record_type = 'Event' AND ts > (SELECT max(ts) FROM rec) - INTERVAL 5 DAY
    UNION ALL SELECT id, 'warning', 'EMPTY_EVENT_ATTRIBUTES', 'Low', 'data.event.attributes' FROM rec WHERE record_type = 'Event' AND k % 2 <> 0
    UNION ALL SELECT id, 'error', 'EMPTY_METRIC_NAME', 'High', 'data.metric.name' FROM rec WHERE record_type = 'Metric' AND k % 9 = 0
    UNION ALL SELECT id, 'error', 'EMPTY_SPAN_ID', 'High', 'data.trace.span_id' FROM rec WHERE record_type = 'Trace' AND k % 9 = 0
    UNION ALL SELECT id, 'error', 'EMPTY_TRACE_ID', 'High', 'data.trace.trace_id' FROM rec WHERE record_type = 'Trace' AND k % 9 = 1
    UNION ALL SELECT id, 'error', 'EMPTY_LOG_MESSAGE', 'High', 'data.log.message' FROM rec WHERE record_type = 'Log' AND k % 9 = 0""",
)
def dq_schema_errors(spark, d):
    f = flat(spark, d)
    blank = lambda name, rest: F.when(F.col("k") % 9 == rest, F.lit("")).otherwise(F.col(name))
    broken = f.withColumns(
        {
            "metric_name": blank("metric_name", 0),
            "span_id": blank("span_id", 0),
            "trace_id": blank("trace_id", 1),
            "log_message": blank("log_message", 0),
        }
    )
    return q.schema_findings(nest(broken), newest(f, "ts") - F.expr("INTERVAL 5 DAYS"))


@query(
    "dq_duplicates",
    """WITH d AS (SELECT event_id // 2 AS id, ts, event_id AS seq FROM events UNION ALL SELECT event_id, ts, -event_id - 1 FROM events)
    SELECT id, ts, seq, 'DUPLICATE_RECORD_ID' AS code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS rn FROM d) WHERE rn > 1""",
)
def dq_duplicates(spark, d):
    e = table(spark, d, "events")
    twice = e.selectExpr("event_id DIV 2 AS id", "ts", "event_id AS seq").unionByName(
        e.selectExpr("event_id AS id", "ts", "-event_id - 1 AS seq")
    )
    return q.repeated_ids(twice, "id", ["ts", "seq"]).withColumn("code", F.lit("DUPLICATE_RECORD_ID"))


@query(
    "dq_old",
    f"SELECT event_id AS id, ts, 'OLD_TIMESTAMP' AS code FROM events WHERE (epoch_us({CLOCK}) - epoch_us(ts)) // 3600000000 > 24",
)
def dq_old(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts")
    return q.old_rows(rows, newest(rows, "ts"), "ts").withColumn("code", F.lit("OLD_TIMESTAMP"))


_OK = """CASE record_type WHEN 'Metric' THEN k % 2 = 0 AND k % 10 <> 4 WHEN 'Event' THEN k % 10 <> 0 ELSE true END"""
_NAME = "regexp_replace(replace(replace(replace(lower(metric_name), ' ', '_'), '-', '_'), '.', '_'), '[^\\p{L}\\p{N}_]', '', 'g')"


@query(
    "dq_sanitize",
    REC
    + f"""SELECT id, ts AS timestamp, CASE WHEN record_type = 'Metric' THEN {_NAME} END AS metric, log_message AS message, CASE WHEN record_type = 'Log' THEN CASE WHEN k % 30 > 24 THEN 9 ELSE CAST(k % 30 AS INTEGER) END END AS severity,
       CAST(4 + (a_env IS NOT NULL)::INT + (a_service IS NOT NULL)::INT AS INTEGER) AS n_attributes, true AS valid FROM rec WHERE {_OK}
    UNION ALL SELECT id, ts, CASE WHEN k % 2 = 0 THEN {_NAME} ELSE metric_name END, NULL, NULL, NULL, false FROM rec WHERE NOT ({_OK})
    UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 40 - 2 > 30 OR doc_id % 40 - 2 < 0 THEN {CLOCK} ELSE {DOC_TS} END, NULL,
       regexp_replace(text, '\\p{{Cc}}', '', 'g'), CASE WHEN doc_id % 30 > 24 THEN 9 ELSE CAST(doc_id % 30 AS INTEGER) END, 1, true FROM documents WHERE strlen(text) <= 1024
    UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), {DOC_TS}, NULL, NULL, NULL, NULL, false FROM documents WHERE strlen(text) > 1024""",
)
def dq_sanitize(spark, d):
    f = flat(spark, d)
    named = f.withColumns(
        {
            "metric_name": F.when(F.col("k") % 2 == 0, tr.metric_name(F.col("metric_name"))).otherwise(F.col("metric_name")),
            "metric_value": F.when(F.col("k") % 10 == 4, F.lit(2e9)).otherwise(F.col("metric_value")),
        }
    )
    clock = newest(f, "ts")
    out = q.sanitized(nest(named).unionByName(document_logs(spark, d, clock)), clock)
    shown = lambda c: F.when(F.col("valid"), c)
    return out.select(
        "id",
        "timestamp",
        F.col("metric.name").alias("metric"),
        shown(F.col("log.message")).alias("message"),
        shown(F.col("log.severity_number")).alias("severity"),
        shown(F.size("attributes")).alias("n_attributes"),
        "valid",
    )


_VERDICTS = {
    "env_set": ("a_env IS NOT NULL", "Field is required"),
    "value_set": ("metric_value IS NOT NULL", "Field cannot be null"),
    "message_size": ("strlen(log_message) BETWEEN 5 AND 25", "String length must be between 5 and 25"),
    "value_range": ("value BETWEEN 0.5 AND 300.0", "Value must be between 0.5 and 300.0"),
    "user_digits": ("regexp_matches(a_user, '^[0-9]+$')", "Value does not match pattern: ^[0-9]+$"),
    "env_known": ("a_env IN ('prod', 'staging')", "Value must be one of: prod, staging"),
    "positive": ("value > 1", "Custom validation failed"),
}


@query(
    "dq_field_report",
    REC
    + " UNION ALL ".join(
        f"SELECT id, '{n}' AS rule, coalesce({t}, false) AS is_valid, CASE WHEN NOT coalesce({t}, false) THEN '{e}' END AS error FROM rec"
        for n, (t, e) in _VERDICTS.items()
    ),
)
def dq_field_report(spark, d):
    rules = [
        FieldRule("env_set", "required", "a_env"),
        FieldRule("value_set", "not_null", "metric_value"),
        FieldRule("message_size", "string_length", "log_message", (5, 25)),
        FieldRule("value_range", "numeric_range", "value", (0.5, 300.0)),
        FieldRule("user_digits", "regex_pattern", "a_user", "^[0-9]+$"),
        FieldRule("env_known", "enum_values", "a_env", ("prod", "staging")),
        FieldRule("positive", "custom", "value", F.col("value") > 1),
    ]
    return q.field_report(flat(spark, d), rules)


@query(
    "dq_type_match",
    REC
    + """SELECT id, schema_id, schema_type, CASE WHEN schema_type <> record_type THEN 'RECORD_TYPE_MISMATCH' END AS code FROM
    (SELECT id, record_type, user_id % 25 AS schema_id FROM rec) r LEFT JOIN
    (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Metric' WHEN 1 THEN 'Trace' WHEN 2 THEN 'Log' ELSE 'Event' END AS schema_type FROM nation) ON n_nationkey = schema_id""",
)
def dq_type_match(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("Metric", "Trace", "Log", "Event")])
    schemas = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("schema_id"),
        F.get(kinds, F.col("n_nationkey") % 4).alias("schema_type"),
    )
    rows = flat(spark, d).select("id", "record_type", (F.col("user_id") % 25).alias("schema_id"))
    return q.type_match(rows, schemas).drop("record_type")


def dead_letters(spark, d):
    f = flat(spark, d).filter(F.col("log_level").isin("Error", "Fatal"))
    rows = f.select("id", F.col("ts").alias("timestamp"), F.lit("events").alias("source"), "k", "log_message")
    operation = F.concat(F.lit("op-"), (F.col("k") % 4 + F.col("id").cast("bigint") % 2).cast("string"))
    return dlq.letters(rows, operation, F.col("log_message"), F.col("k") % 5)


def _type_sql(message: str, own: tuple = ()) -> str:
    found = ", ".join(
        f"CASE WHEN regexp_matches({message}, '{p}') THEN {{'s': {prio} + strlen(regexp_extract({message}, '{p}', 0)), 'o': {-i}, 't': '{t}', 'v': '{sev}', 'm': 'pattern', 'n': '{name}'}} END"
        for i, (name, p, t, sev, prio) in enumerate((*q.ERROR_PATTERNS, *own))
    )
    words = " ".join(
        f"WHEN contains(lower({message}), '{w}') THEN {{'s': 0, 'o': 0, 't': '{t}', 'v': '{sev}', 'm': 'keyword', 'n': '{w}'}}"
        for w, t, sev in q.ERROR_KEYWORDS
    )
    return (
        f"coalesce(list_max(list_filter([{found}], lambda x: x IS NOT NULL)), "
        f"CASE {words} ELSE {{'s': 0, 'o': 0, 't': 'Unknown', 'v': 'Error', 'm': 'default', 'n': ''}} END)"
    )


LETTERS = f"""WITH rec AS ({FLAT_SQL}), dl AS (SELECT id, ts AS timestamp, concat('op-', CAST(k % 4 + event_id % 2 AS VARCHAR)) AS operation, log_message AS error_message,
    ({_type_sql('log_message')}).t AS error_type, 'events' AS source, CAST(k % 5 AS INTEGER) AS retry_count FROM rec WHERE log_level IN ('Error', 'Fatal')) """


@query("dlq_write", LETTERS + "SELECT * FROM dl")
def dlq_write(spark, d):
    path = scratch(spark, "letters")
    dlq.write(dead_letters(spark, d), path)
    return spark.read.parquet(path).drop("day")


@query(
    "dlq_query",
    LETTERS
    + """SELECT *, 'operation' AS q FROM dl WHERE operation = 'op-1' UNION ALL SELECT *, 'type' FROM dl WHERE error_type = 'Timeout'
    UNION ALL SELECT *, 'range' FROM dl WHERE timestamp >= (SELECT max(ts) FROM rec) - INTERVAL 10 DAY AND timestamp <= (SELECT max(ts) FROM rec) - INTERVAL 3 DAY""",
)
def dlq_query(spark, d):
    dl = dead_letters(spark, d)
    clock = newest(table(spark, d, "events"), "ts")
    return (
        dlq.find(dl, operation="op-1")
        .withColumn("q", F.lit("operation"))
        .unionByName(dlq.find(dl, error_type="Timeout").withColumn("q", F.lit("type")))
        .unionByName(
            dlq.find(
                dl, start=clock - F.expr("INTERVAL 10 DAYS"), end=clock - F.expr("INTERVAL 3 DAYS")
            ).withColumn("q", F.lit("range"))
        )
    )


@query(
    "dlq_stats",
    LETTERS
    + "SELECT operation, error_type, count(*) AS records, round(avg(retry_count), 6) AS avg_retries, min(timestamp) AS oldest, max(timestamp) AS newest FROM dl GROUP BY GROUPING SETS ((operation), (error_type), ())",
)
def dlq_stats(spark, d):
    return dlq.stats(dead_letters(spark, d))


@query("dlq_expire", LETTERS + "SELECT * FROM dl WHERE timestamp > (SELECT max(ts) FROM rec) - INTERVAL 7 DAY")
def dlq_expire(spark, d):
    return dlq.expire(dead_letters(spark, d), newest(table(spark, d, "events"), "ts"), 7 * 86_400)


@query(
    "dlq_replay",
    LETTERS
    + """SELECT id, error_type, retry_count + CASE WHEN error_type = 'Timeout' AND retry_count < 3 THEN 1 ELSE 0 END AS retry_count,
       CASE WHEN error_type = 'Timeout' AND retry_count < 3 THEN 'replayed' ELSE 'queued' END AS state FROM dl""",
)
def dlq_replay(spark, d):
    out, left = dlq.replay(dead_letters(spark, d), (F.col("error_type") == "Timeout") & (F.col("retry_count") < 3))
    cols = ["id", "error_type", "retry_count"]
    return out.select(*cols, F.lit("replayed").alias("state")).unionByName(
        left.select(*cols, F.lit("queued").alias("state"))
    )


@query(
    "err_classify",
    f"""WITH rec AS ({FLAT_SQL}), m AS (SELECT id, log_message AS message FROM rec WHERE log_message IS NOT NULL UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), text FROM documents
      UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages), c AS (SELECT id, {_type_sql('message')} AS a FROM m)
    SELECT id, a.t AS error_type, a.v AS severity, a.m AS method, a.n AS matched FROM c""",
)
def err_classify(spark, d):
    m = flat(spark, d).filter("log_message IS NOT NULL").select("id", F.col("log_message").alias("message"))
    m = m.unionByName(
        table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("message"))
    )
    m = m.unionByName(
        table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("message"))
    )
    return m.select("id", q.classify_error(F.col("message")).alias("a")).select("id", "a.*")


OWN_PATTERNS = (
    q.ErrorPattern("shouted", "[A-Z]{3,}!!", "Validation", "Warning", 60),
    q.ErrorPattern("never", "[a-z]", "Unknown", "Fatal", 900, enabled=False),
)


@query(
    "err_classify_own",
    f"""WITH c AS (SELECT doc_id, {_type_sql('text', tuple((p.name, p.pattern, p.error_type, p.severity, p.priority) for p in OWN_PATTERNS if p.enabled))} AS a FROM documents)
    SELECT doc_id, a.t AS error_type, a.v AS severity, a.m AS method, a.n AS matched FROM c""",
)
def err_classify_own(spark, d):
    """Documents by the built-in patterns and a caller's own."""
    answer = q.classify_error(F.col("text"), OWN_PATTERNS)
    return table(spark, d, "documents").select("doc_id", answer.alias("a")).select("doc_id", "a.*")


def _builtin_sql() -> str:
    rows = ", ".join(f"('a{i:04d}', '{n}', '{p}', '{t}', '{sev}', {prio})" for i, (n, p, t, sev, prio) in enumerate(q.ERROR_PATTERNS))
    return f"SELECT * FROM (VALUES {rows}) b(rule, name, pattern, kind, severity, priority)"


_HEAD = "regexp_extract(text, '^[A-Za-z]+ [a-z]+', 0)"


@query(
    "err_classify_table",
    f"""WITH h AS (SELECT item_id, {_HEAD} AS head FROM benchmark), p AS ({_builtin_sql()} UNION ALL
      SELECT 'bitem' || item_id, 'item' || item_id, CASE WHEN item_id % 3 = 0 THEN replace(head, ' ', '.*') WHEN item_id % 3 = 1 THEN head || '|[0-9]' || item_id ELSE head || '|' || item_id || '!!' END,
        'Validation', 'Warning', CAST(item_id % 40 + 40 AS INTEGER) FROM h WHERE head <> '' AND item_id % 5 <> 4),
    c AS (SELECT doc_id, rule, name, kind, severity, priority + strlen(regexp_extract(text, pattern, 0)) AS s FROM documents, p WHERE regexp_matches(text, pattern)),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, rule) = 1),
    w AS (SELECT doc_id, {_type_sql('text')} AS a FROM documents)
    SELECT w.doc_id, coalesce(kind, a.t) AS error_type, coalesce(b.severity, a.v) AS severity, CASE WHEN b.doc_id IS NULL THEN a.m ELSE 'pattern' END AS method, coalesce(name, a.n) AS matched
    FROM w LEFT JOIN b ON b.doc_id = w.doc_id""",
)
def err_classify_table(spark, d):
    """Documents by patterns that the benchmark items make, one a row, some switched off."""
    item, head = F.col("item_id").cast("string"), F.regexp_extract("text", "^[A-Za-z]+ [a-z]+", 0)
    pattern = (
        F.when(F.col("item_id") % 3 == 0, F.regexp_replace(head, " ", ".*"))
        .when(F.col("item_id") % 3 == 1, F.concat(head, F.lit("|[0-9]"), item))
        .otherwise(F.concat(head, F.lit("|"), item, F.lit("!!")))
    )
    patterns = table(spark, d, "benchmark").filter(head != "").select(
        F.concat(F.lit("item"), item).alias("name"),
        pattern.alias("pattern"),
        F.lit("Validation").alias("error_type"),
        F.lit("Warning").alias("severity"),
        (F.col("item_id") % 40 + 40).cast("int").alias("priority"),
        (F.col("item_id") % 5 != 4).alias("enabled"),
    )
    found = rules.classify(table(spark, d, "documents").select("doc_id", "text"), patterns, "text")
    return found.drop("text")
