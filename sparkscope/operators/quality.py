"""Data quality: gates, rules, predicates, sanitizing, verdicts and error classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import transforms as tr
from sparkscope.operators.filters import resolve
from sparkscope.session import small_side

# Patterns of the built-in text checks, of metric names and of label keys.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
IPV6 = r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
METRIC_NAME = r"^[a-zA-Z_:][a-zA-Z0-9_:]*$"
LABEL_KEY = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"

# Reasons of the ingest gate.
TOO_OLD = "Record timestamp is too old (older than 30 days)"
IN_FUTURE = "Record timestamp is in the future (more than 1 hour ahead)"
NO_NAME = "Metric name cannot be empty"
LONG_NAME = "Metric name is too long (max 255 characters)"
NO_IDS = "Trace ID and Span ID cannot be empty"
LONG_IDS = "Trace ID or Span ID is too long"
NO_MESSAGE = "Log message cannot be empty"
LONG_MESSAGE = "Log message is too long (max 10000 characters)"
MANY_ATTRIBUTES = "Too many attributes (max 100)"


def _blank(c: Column) -> Column:
    return tr.trim(F.coalesce(c, F.lit(""))) == ""


def reject_reason(as_of: Column) -> Column:
    """Why the ingest gate refuses a canonical record, or null."""
    ts, kind = F.col("timestamp"), F.col("record_type")
    trace, span = F.col("trace.trace_id"), F.col("trace.span_id")
    return (
        F.when(ts < as_of - F.expr("INTERVAL 30 DAYS"), TOO_OLD)
        .when(ts > as_of + F.expr("INTERVAL 1 HOUR"), IN_FUTURE)
        .when((kind == "Metric") & _blank(F.col("metric.name")), NO_NAME)
        .when((kind == "Metric") & (F.octet_length("metric.name") > 255), LONG_NAME)
        .when((kind == "Trace") & (_blank(trace) | _blank(span)), NO_IDS)
        .when((kind == "Trace") & ((F.octet_length(trace) > 32) | (F.octet_length(span) > 16)), LONG_IDS)
        .when((kind == "Log") & _blank(F.col("log.message")), NO_MESSAGE)
        .when((kind == "Log") & (F.octet_length("log.message") > 10_000), LONG_MESSAGE)
        .when(F.size("attributes") > 100, MANY_ATTRIBUTES)
    )


def judged(df: DataFrame, as_of: Column) -> DataFrame:
    """All records with their ``reject_reason`` (null where accepted), for one write of both kinds."""
    return df.withColumn("reject_reason", reject_reason(as_of))


def gate(df: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and rejected ones with their ``reject_reason``.

    Writing both reads the source twice; :func:`judged` serves a single pass.
    """
    marked = judged(df, as_of)
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, marked.filter(F.col("reject_reason").isNotNull())


# -- validation rules ---------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """required / pattern / range / length / custom on a field, and what failing does.

    ``action``: drop, mark_error, use_default or skip_enrichment. ``argument`` is the
    pattern, the (low, high) pair, or the boolean column of a custom check.
    """

    name: str
    field: str
    kind: str
    argument: Any = None
    action: str = "mark_error"
    default: str | None = None
    enabled: bool = True

    def passes(self) -> Column:
        if self.kind == "custom":
            return F.coalesce(self.argument, F.lit(False))
        text = F.coalesce(resolve(self.field), F.lit(""))
        if self.kind == "required":
            return text != ""
        if self.kind == "pattern":
            return text.rlike(self.argument)
        low, high = self.argument
        if self.kind == "range":
            return F.coalesce(text.try_cast("double").between(low, high), F.lit(False))
        if self.kind == "length":
            return F.octet_length(text).between(low, high)
        raise ValueError(f"unknown check: {self.kind}")


def apply_checks(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """Run the checks in order; returns the kept rows and the dropped ones.

    Both carry ``failed`` (names of failed checks); kept rows also ``skip_enrichment``.
    Checks after a skip or a drop do not run. Defaults go to attributes.
    """
    stopped, dropped, skipped, failed = F.lit(False), F.lit(False), F.lit(False), []
    defaults: list[tuple[str, Column]] = []
    for check in checks:
        if not check.enabled:
            continue
        fails = ~stopped & ~check.passes()
        failed.append(F.when(fails, F.lit(check.name)))
        if check.action == "drop":
            dropped, stopped = dropped | fails, stopped | fails
        elif check.action == "skip_enrichment":
            skipped, stopped = skipped | fails, stopped | fails
        elif check.action == "use_default":
            defaults.append((check.field, F.when(fails, F.lit(check.default))))
    judged = df.withColumns(
        {
            "failed": F.array_compact(F.array(*failed)),
            "skip_enrichment": skipped,
            "_dropped": dropped,
            **{f"_default_{n}": value for n, (_, value) in enumerate(defaults)},
        }
    )
    for n, (name, _) in enumerate(defaults):
        judged = tr.set_field(judged, "attributes." + name, F.col(f"_default_{n}")).drop(f"_default_{n}")
    return (
        judged.filter(~F.col("_dropped")).drop("_dropped"),
        judged.filter("_dropped").drop("_dropped", "skip_enrichment"),
    )


# -- predicates over JSON documents ---------------------------------------------


def at(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def compare(doc: Column, path: str, op: str, value: str | float) -> Column:
    """==, !=, >, >=, <, <= at a JSON path; an absent path is false, also for !=."""
    found = at(doc, path)
    if isinstance(value, str):
        tests = {"==": found == value, "!=": found != value}
    else:
        number = found.try_cast("double")
        tests = {
            "==": number == value,
            "!=": F.coalesce(number != value, F.lit(True)),
            ">": number > value,
            ">=": number >= value,
            "<": number < value,
            "<=": number <= value,
        }
    return found.isNotNull() & F.coalesce(tests[op], F.lit(False))


def text_test(doc: Column, path: str, op: str, value: str) -> Column:
    """contains, startsWith or endsWith at a JSON path."""
    found = at(doc, path)
    tests = {"contains": found.contains, "startsWith": found.startswith, "endsWith": found.endswith}
    return F.coalesce(tests[op](value), F.lit(False))


def exists(doc: Column, path: str) -> Column:
    return at(doc, path).isNotNull()


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(URL), F.lit(False))


def is_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4) | c.rlike(IPV6), F.lit(False))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMBER), F.lit(False))


# -- coded findings ---------------------------------------------------------------


def _finding(hit: Column, code: str, severity: str, path: str, kind: str = "error") -> Column:
    entry = F.struct(
        F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(path).alias("field_path")
    )
    return F.when(hit, entry)


def schema_findings(df: DataFrame, as_of: Column) -> DataFrame:
    """One row per coded error or warning of a canonical record."""
    kind = F.col("record_type")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    event = kind == "Event"
    found = [
        _finding((kind == "Metric") & empty("metric.name"), "EMPTY_METRIC_NAME", "High", "data.metric.name"),
        _finding((kind == "Trace") & empty("trace.trace_id"), "EMPTY_TRACE_ID", "High", "data.trace.trace_id"),
        _finding((kind == "Trace") & empty("trace.span_id"), "EMPTY_SPAN_ID", "High", "data.trace.span_id"),
        _finding((kind == "Log") & empty("log.message"), "EMPTY_LOG_MESSAGE", "High", "data.log.message"),
        _finding(event & _blank(F.col("event.name")), "EMPTY_EVENT_NAME", "High", "data.event.name"),
        _finding(event & (F.col("event.timestamp") > as_of), "FUTURE_EVENT_TIMESTAMP", "Medium", "data.event.timestamp"),
        _finding(
            event & (F.size(F.coalesce("event.attributes", F.create_map().cast("map<string,string>"))) == 0),
            "EMPTY_EVENT_ATTRIBUTES",
            "Low",
            "data.event.attributes",
            "warning",
        ),
    ]
    return df.select("id", F.inline(F.array_compact(F.array(*found))))


def repeated_ids(df: DataFrame, key: str = "id", order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Second and later occurrences of an id, by ``order``, which must tell rows apart.

    The first occurrence comes from a partial aggregate, so one id that holds a
    large share of the rows costs one value per task, not a sorted group.
    """
    seen = F.struct(*order)
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(seen).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = first.filter("_n > 1").drop("_n")
    return df.join(repeated, (F.col(key) == F.col("_key")) & (seen > F.col("_first"))).drop("_key", "_first")


def old_rows(df: DataFrame, as_of: Column, column: str = "timestamp") -> DataFrame:
    """Rows more than 24 full hours old."""
    hours = F.floor((F.unix_micros(as_of) - F.unix_micros(column)) / 3_600_000_000)
    return df.filter(hours > 24)


# -- sanitizing ---------------------------------------------------------------------

MAX_TEXT = 1024


def clean(c: Column) -> Column:
    """The text without control characters."""
    return F.regexp_replace(c, r"\p{Cc}", "")


def _clean_map(entries: Column, labels: bool = False) -> Column:
    kept = F.map_filter(entries, lambda k, _: k.rlike(LABEL_KEY)) if labels else entries
    cleaned = F.transform_values(F.transform_keys(kept, lambda k, _: clean(k)), lambda _, v: clean(v))
    return F.map_filter(cleaned, lambda k, v: (k != "") & (v != ""))


def _fits(*texts: Column) -> Column:
    ok = F.lit(True)
    for text in texts:
        ok = ok & (F.coalesce(F.octet_length(text), F.lit(0)) <= MAX_TEXT)
    return ok


def _fits_map(entries: Column, limit: int) -> Column:
    short = F.forall(
        F.map_entries(entries),
        lambda e: (F.octet_length(e["key"]) <= MAX_TEXT) & (F.octet_length(e["value"]) <= MAX_TEXT),
    )
    return F.coalesce((F.size(entries) <= limit) & short, F.lit(True))


def sanitized(df: DataFrame, as_of: Column) -> DataFrame:
    """All records with ``valid``: cleaned where they are, as they came where they are not."""
    kind, value = F.col("record_type"), F.col("metric.value")
    finite = value.isNull() | (~F.isnan(value) & (F.abs(value) <= 1e9))
    metric_ok = (
        F.col("metric.name").rlike(METRIC_NAME)
        & _fits(F.col("metric.name"), F.col("metric.description"), F.col("metric.unit"))
        & finite
        & _fits_map(F.col("metric.labels"), 50)
    )
    log_ok = _fits(F.col("log.message"), F.col("log.body"), F.col("log.severity_text"))
    in_range = lambda t: t.between(as_of - F.expr("INTERVAL 30 DAYS"), as_of + F.expr("INTERVAL 1 HOUR"))
    clamp = lambda t: F.when(t.isNotNull(), F.when(in_range(t), t).otherwise(as_of))
    start, end = clamp(F.col("trace.start_time")), clamp(F.col("trace.end_time"))
    trace_ok = (
        (F.col("trace.trace_id") != "")
        & (F.col("trace.span_id") != "")
        & _fits(F.col("trace.trace_id"), F.col("trace.span_id"), F.col("trace.parent_span_id"), F.col("trace.name"))
        & F.coalesce(end >= start, F.lit(True))
    )
    event_ok = ~_blank(F.col("event.name")) & _fits(F.col("event.name")) & _fits_map(F.col("event.attributes"), 100)
    own = (
        F.when(kind == "Metric", metric_ok)
        .when(kind == "Log", log_ok)
        .when(kind == "Trace", trace_ok)
        .when(kind == "Event", event_ok)
    )
    valid = F.coalesce(own, F.lit(False)) & _fits_map(F.col("attributes"), 100) & _fits_map(F.col("tags"), 100)
    marked = df.withColumn("valid", valid)

    def update(struct: str, **fields: Column) -> Column:
        out = F.col(struct)
        for name, c in fields.items():
            out = out.withField(name, c)
        return out

    def where_valid(**columns: Column) -> dict[str, Column]:
        return {n: F.when(F.col("valid"), c).otherwise(F.col(n)) for n, c in columns.items()}

    severity = F.when(F.col("log.severity_number") > 24, 9).otherwise(F.col("log.severity_number"))
    return marked.withColumns(
        where_valid(
            timestamp=clamp(F.col("timestamp")),
            attributes=_clean_map(F.col("attributes")),
            tags=_clean_map(F.col("tags")),
            metric=update(
                "metric",
                name=clean(F.col("metric.name")),
                description=clean(F.col("metric.description")),
                unit=clean(F.col("metric.unit")),
                labels=_clean_map(F.col("metric.labels"), labels=True),
            ),
            log=update(
                "log",
                message=clean(F.col("log.message")),
                body=clean(F.col("log.body")),
                severity_text=clean(F.col("log.severity_text")),
                severity_number=severity,
            ),
            trace=update(
                "trace",
                trace_id=clean(F.col("trace.trace_id")),
                span_id=clean(F.col("trace.span_id")),
                name=clean(F.col("trace.name")),
                start_time=start,
                end_time=end,
            ),
            event=update(
                "event",
                name=clean(F.col("event.name")),
                timestamp=clamp(F.col("event.timestamp")),
                attributes=_clean_map(F.col("event.attributes")),
            ),
        )
    )


def sanitize(df: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Cleaned valid records, and the invalid ones as they came."""
    marked = sanitized(df, as_of)
    return marked.filter("valid").drop("valid"), marked.filter("NOT valid").drop("valid")


# -- verdicts per record and rule ------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """required, not_null, string_length, numeric_range, regex_pattern, enum_values or custom."""

    name: str
    kind: str
    field: str
    argument: Any = None

    def verdict(self) -> tuple[Column, str]:
        c = F.col(self.field) if self.field else F.lit(None)
        if self.kind == "required":
            return c.isNotNull(), "Field is required"
        if self.kind == "not_null":
            return c.isNotNull(), "Field cannot be null"
        if self.kind == "string_length":
            low, high = self.argument
            return F.octet_length(c).between(low, high), f"String length must be between {low} and {high}"
        if self.kind == "numeric_range":
            low, high = self.argument
            return c.between(low, high), f"Value must be between {low} and {high}"
        if self.kind == "regex_pattern":
            return c.rlike(self.argument), f"Value does not match pattern: {self.argument}"
        if self.kind == "enum_values":
            return c.isin(*self.argument), f"Value must be one of: {', '.join(self.argument)}"
        if self.kind == "custom":
            return self.argument, "Custom validation failed"
        raise ValueError(f"unknown validation type: {self.kind}")


def field_report(df: DataFrame, rules: Sequence[FieldRule], key: str = "id") -> DataFrame:
    """One verdict (``rule``, ``is_valid``, ``error``) per record and rule."""
    verdicts = []
    for rule in rules:
        ok, error = rule.verdict()
        ok = F.coalesce(ok, F.lit(False))
        verdicts.append(
            F.struct(F.lit(rule.name).alias("rule"), ok.alias("is_valid"), F.when(~ok, F.lit(error)).alias("error"))
        )
    return df.select(key, F.inline(F.array(*verdicts)))


def type_match(df: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``code`` RECORD_TYPE_MISMATCH where the record type is not its schema's type.

    ``df`` has ``schema_id`` and ``record_type``; ``schemas`` has ``schema_id`` and ``schema_type``.
    """
    joined = df.join(small_side(schemas.select("schema_id", "schema_type")), "schema_id", "left")
    differs = F.col("schema_type").isNotNull() & (F.col("schema_type") != F.col("record_type"))
    return joined.withColumn("code", F.when(differs, "RECORD_TYPE_MISMATCH"))


# -- error classes -----------------------------------------------------------------------

# Fixed values: (name, pattern, error type, severity, priority).
ERROR_PATTERNS = [
    ("network_timeout", r"timeout|deadline|connection.*refused|Connection refused", "Timeout", "Warning", 100),
    ("network_error", r"network.*error|connection.*failed", "Network", "Error", 90),
    ("authentication_error", r"unauthorized|authentication.*failed|invalid.*token|Authentication failed|Permission denied", "Authentication", "Error", 80),
    ("authorization_error", r"forbidden|permission.*denied|access.*denied", "Authorization", "Error", 80),
    ("validation_error", r"validation.*failed|invalid.*input|malformed|custom.*error", "Validation", "Warning", 70),
    ("resource_error", r"out.*of.*memory|disk.*full|resource.*exhausted", "Resource", "Critical", 95),
    ("temporary_error", r"temporary.*failure|retry.*later|service.*unavailable", "Temporary", "Warning", 60),
    ("permanent_error", r"permanent.*failure|fatal.*error|unrecoverable", "Permanent", "Fatal", 100),
]
# Fixed values: (keyword, error type, severity), tried in this order on the lower-cased message.
ERROR_KEYWORDS = [
    ("network", "Network", "Warning"),
    ("timeout", "Timeout", "Warning"),
    ("auth", "Authentication", "Error"),
    ("permission", "Authorization", "Error"),
    ("validation", "Validation", "Warning"),
    ("config", "Configuration", "Error"),
    ("resource", "Resource", "Critical"),
    ("temporary", "Temporary", "Warning"),
    ("permanent", "Permanent", "Fatal"),
    ("debug", "Unknown", "Debug"),
    ("info", "Unknown", "Info"),
    ("warning", "Temporary", "Warning"),
    ("error", "Unknown", "Error"),
    ("critical", "Resource", "Critical"),
    ("fatal", "Permanent", "Fatal"),
]


def _may_match(message: Column, pattern: str) -> Column:
    """Whether some alternative of the pattern has all its literal parts in the message.

    The patterns are literals joined by ``.*`` and ``|``, so this is necessary for a match
    and much cheaper than the regular expression.
    """
    out = F.lit(False)
    for alternative in pattern.split("|"):
        parts = F.lit(True)
        for literal in alternative.split(".*"):
            parts = parts & message.contains(literal)
        out = out | parts
    return out


@dataclass(frozen=True)
class ErrorPattern:
    """A caller's regular expression with what it stands for; ``priority`` competes with the built-in ones."""

    name: str
    pattern: str
    error_type: str
    severity: str
    priority: int = 0
    enabled: bool = True


def classify_error(
    message: Column, patterns: Sequence[ErrorPattern] = (), disabled: Sequence[str] = (), default: tuple[str, str] = ("Unknown", "Error")
) -> Column:
    """Struct (error_type, severity, method, matched) of an error message.

    Among the built-in patterns (without the ``disabled`` names) and the caller's that match, the
    highest priority plus match length wins (the earlier one on a tie, built-in ones first); then
    the first keyword; then ``default``.
    """

    scored = []
    for order, (name, pattern, kind, severity, priority) in enumerate(ERROR_PATTERNS):
        score = F.lit(priority) + F.octet_length(F.regexp_extract(message, pattern, 0))
        entry = F.struct(
            score.alias("score"), F.lit(-order).alias("order"), _answer(kind, severity, "pattern", name).alias("answer")
        )
        if name not in disabled:
            scored.append(F.when(_may_match(message, pattern) & message.rlike(pattern), entry))
    for order, own in enumerate((p for p in patterns if p.enabled), len(ERROR_PATTERNS)):
        score = F.lit(own.priority) + F.octet_length(F.regexp_extract(message, own.pattern, 0))
        found = _answer(own.error_type, own.severity, "pattern", own.name)
        entry = F.struct(score.alias("score"), F.lit(-order).alias("order"), found.alias("answer"))
        scored.append(F.when(message.rlike(own.pattern), entry))
    best = F.array_max(F.array_compact(F.array(*scored)))["answer"]
    return F.coalesce(best, by_keyword(message, default))


def _answer(kind: str, severity: str, method: str, matched: str) -> Column:
    return F.struct(
        F.lit(kind).alias("error_type"),
        F.lit(severity).alias("severity"),
        F.lit(method).alias("method"),
        F.lit(matched).alias("matched"),
    )


def by_keyword(message: Column, default: tuple[str, str]) -> Column:
    """Struct (error_type, severity, method, matched) of the first keyword that a message holds, or ``default``."""

    def by_word(lower: Column) -> Column:
        out = F
        for word, kind, severity in ERROR_KEYWORDS:
            out = out.when(lower.contains(word), _answer(kind, severity, "keyword", word))
        return out.otherwise(_answer(*default, "default", ""))

    # The one-element transform lower-cases the message once for all keywords.
    return F.transform(F.array(F.lower(message)), by_word)[0]
