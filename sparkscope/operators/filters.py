"""Field lookup and filter rules, as columns over canonical records or flat rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Rule:
    """One comparison; ``value`` is text, or a list for ``in`` / ``not_in`` / ``between``."""

    field: str
    op: str
    value: Any = None
    action: str = "include"
    enabled: bool = True


DIRECT = {
    "id": "id",
    "record_type": "record_type",
    "source": "source",
    "batch_id": "batch_id",
    "data.metric.name": "metric.name",
    "data.log.message": "log.message",
    "service": "service.name",
    "resource": "resource.resource_type",
}


def resolve(field: str) -> Column:
    """The text value of a field of a canonical record; null when there is none.

    Order: fixed columns, then attributes, tags, the metric's own fields, and its labels.
    """
    if field == "timestamp":
        from sparkscope.operators.transforms import rfc3339

        return rfc3339(F.col("timestamp"))
    if field.startswith("attributes."):
        return F.col("attributes")[field.removeprefix("attributes.")]
    if field.startswith("tags."):
        return F.col("tags")[field.removeprefix("tags.")]
    if field == "service":
        return F.coalesce(F.col("service.name"), F.col("attributes")["service"])
    if field in DIRECT:
        return F.col(DIRECT[field]).cast("string")
    found = [F.col("attributes")[field], F.col("tags")[field]]
    if field.startswith("metric."):
        own = field.removeprefix("metric.")
        if own in ("description", "unit"):
            found.append(F.when(F.col("metric").isNotNull(), F.coalesce(F.col(field), F.lit(""))))
        elif own in ("name", "value"):
            found.append(F.col(field).cast("string"))
    found.append(F.col("metric.labels")[field])
    return F.coalesce(*found)


def _items(value: Any) -> list:
    if isinstance(value, str):
        return [v.strip() for v in value.split(",")]
    return list(value)


def _number(c: Column) -> Column:
    return c.try_cast("double")


OPS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: c != F.lit(v),
    "contains": lambda c, v: c.contains(str(v)),
    "not_contains": lambda c, v: ~c.contains(str(v)),
    "starts_with": lambda c, v: c.startswith(str(v)),
    "ends_with": lambda c, v: c.endswith(str(v)),
    "regex": lambda c, v: c.rlike(str(v)),
    "gt": lambda c, v: _number(c) > float(v),
    "ge": lambda c, v: _number(c) >= float(v),
    "lt": lambda c, v: _number(c) < float(v),
    "le": lambda c, v: _number(c) <= float(v),
    "in": lambda c, v: c.isin(_items(v)),
    "not_in": lambda c, v: ~c.isin(_items(v)),
    "between": lambda c, v: _number(c).between(float(v[0]), float(v[1])),
    "exists": lambda c, v: c.isNotNull(),
    "not_exists": lambda c, v: c.isNull(),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def predicate(rule: Rule, field: Callable[[str], Column] = resolve) -> Column:
    """The rule as a boolean column that is never null: a missing field matches nothing."""
    if rule.op not in OPS:
        raise ValueError(f"unknown filter operator: {rule.op}")
    return F.coalesce(OPS[rule.op](field(rule.field), rule.value), F.lit(False))


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def match(df: DataFrame, rules: Sequence[Rule], any_of: bool = False, invert: bool = False) -> DataFrame:
    """Rows that match all (or any) of the rules, or with ``invert`` the others."""
    hits = [predicate(r) for r in rules if r.enabled]
    if not hits:
        return df.filter(F.lit(invert))
    keep = _any(hits) if any_of else _all(hits)
    return df.filter(~keep if invert else keep)


def by_first_match(df: DataFrame, rules: Sequence[Rule], mode: str = "include") -> DataFrame:
    """Include rows that any enabled rule matches, or exclude exactly those."""
    hit = _any([predicate(r) for r in rules if r.enabled])
    return df.filter(hit if mode == "include" else ~hit)


def by_all_rules(df: DataFrame, rules: Sequence[Rule], mode: str = "include") -> DataFrame:
    """Include rows that every enabled rule matches, or exclude exactly those."""
    hit = _all([predicate(r) for r in rules if r.enabled])
    return df.filter(hit if mode == "include" else ~hit)


def in_sequence(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Apply include / exclude rules one after the other to flat rows.

    On flat rows a null is a value of its own, so ``is_null`` can match.
    """
    for rule in rules:
        if rule.action not in ("include", "exclude"):
            raise ValueError(f"unknown filter action: {rule.action}")
        hit = predicate(rule, F.col)
        df = df.filter(hit if rule.action == "include" else ~hit)
    return df


def without_nulls(df: DataFrame) -> DataFrame:
    """Rows that hold no null."""
    return df.na.drop("any")


def when_true(left: Column | str, op: str | None = None, right: Any = None) -> Column:
    """A condition of the kinds ``flag``, ``a == b``, ``a != b``, ``a > b``, ``a < b``.

    Comparisons for equality trim their text; ordering compares numbers only.
    """
    side = (lambda x: x if isinstance(x, Column) else F.lit(str(x)))
    l = side(left)
    if op is None:
        return F.coalesce(F.lower(l).isin("true", "1", "yes"), F.lit(False))
    r = side(right)
    tests = {
        "==": lambda: F.trim(l) == F.trim(r),
        "!=": lambda: F.trim(l) != F.trim(r),
        ">": lambda: F.trim(l).try_cast("double") > F.trim(r).try_cast("double"),
        "<": lambda: F.trim(l).try_cast("double") < F.trim(r).try_cast("double"),
    }
    return F.coalesce(tests[op](), F.lit(False))


def since(df: DataFrame, as_of: Column, hours: int = 0, days: int = 0, column: str = "timestamp") -> DataFrame:
    """Rows of the last hours / days before ``as_of``, both ends included."""
    span = F.expr(f"INTERVAL {days * 24 + hours} HOURS")
    return df.filter((F.col(column) >= as_of - span) & (F.col(column) <= as_of))


def first_per_batch(df: DataFrame, limit: int, batch: str = "batch_id", order: str = "id") -> DataFrame:
    """The first ``limit`` rows of every batch.

    Spark turns ``row_number <= limit`` into a per-task group limit before the
    shuffle, so a batch of any size sends few rows.
    """
    w = Window.partitionBy(batch).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
