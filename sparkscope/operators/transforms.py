"""Record transforms: map edits, strings, JSON, dates, type conversion and step lists."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkscope import model
from sparkscope.operators.filters import resolve

# Keyword categories, first match wins.
METRIC_CATEGORIES = {
    "http": ["http", "request"],
    "system": ["cpu", "memory"],
    "error": ["error", "exception"],
    "business": ["business", "user"],
}
SERVICE_CATEGORIES = {
    "api": ["api", "http"],
    "database": ["db", "database"],
    "cache": ["cache", "redis"],
    "messaging": ["queue", "kafka"],
}
LOG_CATEGORIES = {
    "error": ["error", "exception"],
    "warning": ["warn", "warning"],
    "info": ["info", "information"],
    "debug": ["debug", "trace"],
}

WHITESPACE = " \t\n\r\x0b\x0c"


# -- attribute maps ---------------------------------------------------------


def _place(target: str) -> tuple[str, str]:
    """The map column and key that a target names; a bare name is an attribute."""
    for prefix in ("tags", "attributes"):
        if target.startswith(prefix + "."):
            return prefix, target[len(prefix) + 1 :]
    return "attributes", target


def put(entries: Column, key: str, value: Column) -> Column:
    """The map with ``key`` set, a null map counting as empty; a null value leaves the map as it is."""
    others = F.map_filter(_held(entries), lambda k, _: k != key)
    return F.when(value.isNotNull(), F.map_concat(others, F.create_map(F.lit(key), value))).otherwise(entries)


def _held(entries: Column) -> Column:
    return F.coalesce(entries, F.create_map().cast(model.STRINGS))


def put_all(entries: Column, values: dict[str, Column]) -> Column:
    """The map with several keys set in one rebuild, a null map counting as empty; null values leave their key as it is."""
    names = list(values)
    pairs = F.array(
        *[F.struct(F.lit(n).alias("key"), F.coalesce(c, entries[n]).alias("value")) for n, c in values.items()]
    )
    others = F.map_filter(_held(entries), lambda k, _: ~k.isin(names))
    return F.map_concat(others, F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


def without(entries: Column, key: str) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def set_field(df: DataFrame, target: str, value: Column) -> DataFrame:
    where, key = _place(target)
    return df.withColumn(where, put(F.col(where), key, value.cast("string")))


def remove_field(df: DataFrame, target: str) -> DataFrame:
    """Drop the key; a bare name goes from attributes and from tags."""
    where, key = _place(target)
    df = df.withColumn(where, without(F.col(where), key))
    if where == target.split(".")[0]:
        return df
    return df.withColumn("tags", without(F.col("tags"), key))


def copy(df: DataFrame, source: str, target: str) -> DataFrame:
    return set_field(df, target, resolve(source))


def rename(df: DataFrame, source: str, target: str) -> DataFrame:
    found = df.withColumn("_moved", resolve(source))
    return set_field(remove_field(found, source), target, F.col("_moved")).drop("_moved")


def add(df: DataFrame, target: str, value: str) -> DataFrame:
    """Set only where the field is absent."""
    return set_field(df, target, F.when(resolve(target).isNull(), F.lit(value)))


def replace(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Set only where the source field is present."""
    return set_field(df, target, F.when(resolve(source).isNotNull(), F.lit(value)))


def map_field(df: DataFrame, source: str, target: str) -> DataFrame:
    """Move an attribute to another key where it is present."""
    moved = F.col("attributes")[source]
    return df.withColumn(
        "attributes",
        F.when(moved.isNotNull(), put(without(F.col("attributes"), source), target, moved)).otherwise(
            F.col("attributes")
        ),
    )


def set_when(df: DataFrame, target: str, condition: Column, value: str) -> DataFrame:
    return set_field(df, target, F.when(condition, F.lit(value)))


# -- text -------------------------------------------------------------------


def trim(c: Column) -> Column:
    """Strip blanks, tabs and line ends at both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def substring(c: Column, start: int, end: int | None = None) -> Column:
    """Characters from 0-based ``start`` up to but without ``end``."""
    length = F.length(c) - start if end is None else F.lit(max(end - start, 0))
    return F.substring(c, F.lit(start + 1), length)


def url_domain(c: Column) -> Column:
    """Host with its port; text that is no http(s) URL stays as it is."""
    return F.when(c.rlike("^https?://"), F.regexp_extract(c, "^https?://([^/]*)", 1)).otherwise(c)


def url_path(c: Column) -> Column:
    """Path with its query string; text that is no http(s) URL stays as it is."""
    path = F.concat(F.lit("/"), F.regexp_extract(c, r"(?s)^https?://[^/]*/(.*)$", 1))
    return F.when(c.rlike("^https?://"), path).otherwise(c)


def truncate(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length)), F.lit("..."))).otherwise(c)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def group1(c: Column, pattern: str) -> Column:
    """First capture group, or the empty text when nothing matches."""
    return F.regexp_extract(c, pattern, 1)


def metric_name(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), " -.", "___"), r"[^\p{L}\p{N}_]", "")


def span_name(c: Column) -> Column:
    return F.replace(F.replace(trim(c), F.lit("::"), F.lit(".")), F.lit("()"), F.lit(""))


def category(c: Column, categories: dict[str, list[str]], default: str) -> Column:
    out = F
    for name, words in categories.items():
        hit = c.contains(words[0])
        for word in words[1:]:
            hit = hit | c.contains(word)
        out = out.when(hit, name)
    return out.otherwise(default)


# -- JSON, dates and types ----------------------------------------------------


def json_at(c: Column, path: str) -> Column:
    """The value at a dotted path of JSON text; strings come unquoted, absent paths are null."""
    return F.get_json_object(c, "$." + path)


def rfc3339(ts: Column) -> Column:
    """The time as RFC 3339 text with as many fraction digits as it needs (0, 3 or 6)."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(whole, fraction, F.lit("+00:00"))


def reformat_time(c: Column, pattern: str) -> Column:
    """Time text in another format; text that is no time stays as it is."""
    return F.coalesce(F.date_format(c.try_cast("timestamp"), pattern), c)


TYPES = {
    "string": lambda c: c,
    "integer": lambda c: c.try_cast("bigint"),
    "float": lambda c: c.try_cast("double"),
    "boolean": lambda c: F.when(c.isin("true", "false"), c == "true"),
    "timestamp": lambda c: c.try_cast("timestamp"),
}


def convert(c: Column, target: str) -> Column:
    """The text as ``target``; null where it cannot be read so."""
    return TYPES[target](c)


def conversion_error(c: Column, field: str, target: str) -> Column:
    """A (code, message) entry where text is present but not readable as ``target``."""
    failed = c.isNotNull() & convert(c, target).isNull()
    message = F.concat(F.lit(f"{field}: cannot read '"), c, F.lit(f"' as {target}"))
    return F.when(failed, F.struct(F.lit("TRANSFORM_ERROR").alias("code"), message.alias("message")))


def with_status(df: DataFrame, errors: Sequence[Column], continue_on_error: bool = True) -> DataFrame:
    """Add ``errors`` and ``status``: Success, or Partial / Failed where an entry is present.

    Without ``continue_on_error`` only the first error counts and the record fails.
    """
    found = F.array_compact(F.array(*errors))
    if not continue_on_error:
        found = F.slice(found, 1, 1)
    bad = "Partial" if continue_on_error else "Failed"
    return df.withColumn("errors", found).withColumn(
        "status", F.when(F.size("errors") == 0, "Success").otherwise(bad)
    )


def floor_time(ts: Column, seconds: int) -> Column:
    """The start of the ``seconds``-wide interval, counted from the epoch, that holds ``ts``."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def stamp(df: DataFrame, as_of: Column, name: str, version: str) -> DataFrame:
    """Add when and by what the rows were processed."""
    return df.withColumns(
        {"processed_at": as_of, "processor_name": F.lit(name), "processor_version": F.lit(version)}
    )


# -- templates and step lists -------------------------------------------------

_HOLE = re.compile(r"\$\{([^}]*)\}")


def render(template: str) -> Column:
    """Fill ``${...}`` holes of a template from a canonical record; unknown holes stay."""
    values = {
        "timestamp": lambda: rfc3339(F.col("timestamp")),
        "timestamp_unix": lambda: F.unix_seconds("timestamp").cast("string"),
        "timestamp_ms": lambda: F.unix_millis("timestamp").cast("string"),
        "id": lambda: F.col("id"),
        "record_type": lambda: F.col("record_type"),
        "service": lambda: F.col("service.name"),
    }
    parts, end = [], 0
    for hole in _HOLE.finditer(template):
        name, text = hole.group(1), F.lit(hole.group(0))
        parts.append(F.lit(template[end : hole.start()]))
        if name in values:
            parts.append(F.coalesce(values[name](), text))
        elif name.startswith(("attributes.", "tags.")):
            where, key = name.split(".", 1)
            parts.append(F.coalesce(F.col(where)[key], text))
        else:
            parts.append(text)
        end = hole.end()
    return F.concat(*parts, F.lit(template[end:]))


@dataclass(frozen=True)
class Step:
    """rename_field (field, value=new name), add_field, remove_field or convert_type."""

    kind: str
    field: str
    value: Any = None


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run ordered steps over flat rows; a step on an absent column does nothing."""
    for step in steps:
        if step.kind == "add_field":
            df = df.withColumn(step.field, F.lit(step.value))
        elif step.field not in df.columns:
            continue
        elif step.kind == "rename_field":
            df = df.withColumnRenamed(step.field, step.value)
        elif step.kind == "remove_field":
            df = df.drop(step.field)
        elif step.kind == "convert_type":
            kind = {"number": "double"}.get(step.value, step.value)
            df = df.withColumn(step.field, F.col(step.field).try_cast(kind))
        else:
            raise ValueError(f"unknown step: {step.kind}")
    return df


# -- structured text ----------------------------------------------------------


def parse(c: Column, kind: str) -> Column:
    """JSON text as the struct of a metric, trace / span, log or event."""
    schema = {"metric": model.METRIC, "trace": model.TRACE, "span": model.TRACE, "log": model.LOG, "event": model.EVENT}
    return F.from_json(c, schema[kind])


def string_map_of(c: Column) -> Column:
    """JSON object text as a string map."""
    return F.from_json(c, T.MapType(T.StringType(), T.StringType()))


def extract(c: Column, what: str) -> Column:
    """service_name, operation_name, trace_id or span_id out of record JSON text."""
    paths = {
        "service_name": ["$.service.name", "$.attributes['service.name']"],
        "operation_name": ["$.trace.name"],
        "trace_id": ["$.trace.trace_id"],
        "span_id": ["$.trace.span_id"],
    }
    return F.coalesce(*[F.get_json_object(c, p) for p in paths[what]])
