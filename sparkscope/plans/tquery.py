"""Structured telemetry queries: type, time range, filters, aggregations and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered
from sparkscope.operators.aggregates import MIDDLE, floor_rank
from sparkscope.operators.filters import Rule, predicate
from sparkscope.session import stage


@dataclass(frozen=True)
class TimeRange:
    """``start`` (included) to ``end`` (excluded), or the last hours / days before ``as_of``."""

    start: str | None = None
    end: str | None = None
    last_hours: int = 0
    last_days: int = 0
    as_of: Column | None = None

    def condition(self) -> Column:
        ts = F.col("timestamp")
        if self.as_of is not None:
            span = F.expr(f"INTERVAL {self.last_hours + 24 * self.last_days} HOURS")
            return (ts >= self.as_of - span) & (ts <= self.as_of)
        keep = F.lit(True)
        if self.start:
            keep = keep & (ts >= F.lit(self.start).cast("timestamp"))
        if self.end:
            keep = keep & (ts < F.lit(self.end).cast("timestamp"))
        return keep


@dataclass(frozen=True)
class Aggregation:
    """One function over one field; ``param`` is the percentile or the histogram's bucket width.

    Medians and percentiles are exact (nearest rank for the latter). A histogram is text,
    ``start:rows`` per bucket in ascending order.
    """

    function: str
    field: str | None
    alias: str
    param: Any = None

    def column(self) -> Column:
        c = F.col(self.field) if self.field else F.lit(1)
        seconds = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
        build = {
            "count": lambda: F.count(c),
            "sum": lambda: F.round(F.sum(c), 6),
            "avg": lambda: F.round(F.avg(c), 6),
            "min": lambda: F.min(c),
            "max": lambda: F.max(c),
            "std": lambda: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6),
            "rate": lambda: F.coalesce(F.try_divide(F.count(c), seconds), F.lit(0.0)),
            "cardinality": lambda: F.countDistinct(c),
            "approx_cardinality": lambda: F.approx_count_distinct(c),
        }
        if self.function not in build:
            raise ValueError(f"unknown aggregation: {self.function}")
        return build[self.function]().alias(self.alias)


#: Rows up to the end of a page that Spark's own top-n gathers; longer ones are cut by position.
PAGE = 10_000
RANKED = ("median", "percentile", "histogram")


def _orders(own: Sequence[Aggregation], df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Medians and percentiles of one field per group, all from values placed in order once."""
    ranks = {}
    for a in own:
        if a.function == "median":
            ranks |= {f"{a.alias}{end}": rank for end, rank in MIDDLE.items()}
        else:
            ranks[a.alias] = floor_rank(a.param)
    found = ordered.values_at(df, keys, field, ranks)
    middle = lambda a: (F.col(f"{a.alias}_low") + F.col(f"{a.alias}_high")) / 2
    return found.select(*keys, *[(middle(a) if a.function == "median" else F.col(a.alias)).alias(a.alias) for a in own])


def _histogram(a: Aggregation, df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """The rows per bucket of one field as text per group, counted before they are gathered."""
    start = (F.floor(F.col(field) / a.param) * a.param).cast("double")
    counted = df.filter(F.col(field).isNotNull()).groupBy(*keys, start.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_n"))), lambda b: F.concat_ws(":", b["_at"], b["_n"]))
    return counted.groupBy(*keys).agg(F.array_join(line, ",").alias(a.alias))


def _grouped(ask: TelemetryQuery, df: DataFrame) -> DataFrame:
    """All aggregations per group; those over ranked values are joined to the others by the group keys.

    With ranked values the records are read once: keys, times and fields are written, and all passes go over those.
    """
    names = list(ask.group_by)
    inner = [f"_key{i}" for i in range(len(names))]
    fields = {f: f"_f{i}" for i, f in enumerate(dict.fromkeys(a.field for a in ask.aggregations if a.field))}
    keyed = df.select(*[F.col(path).alias(k) for k, path in zip(inner, ask.group_by.values())], "timestamp", *[F.col(f).alias(c) for f, c in fields.items()])
    ranked = [a for a in ask.aggregations if a.function in RANKED]
    if ranked:
        keyed = stage(keyed, "query")
    plain = [replace(a, field=fields.get(a.field)).column() for a in ask.aggregations if a.function not in RANKED] or [F.count(F.lit(1)).alias("_rows")]
    out = keyed.groupBy(*inner).agg(*plain)
    parts = []
    for field, c in fields.items():
        own = [a for a in ranked if a.field == field and a.function != "histogram"]
        parts += [_orders(own, keyed.select(*inner, c), inner, c)] if own else []
    parts += [_histogram(a, keyed, inner, fields[a.field]) for a in ranked if a.function == "histogram"]
    for i, one in enumerate(parts):
        one = one.withColumnsRenamed({k: f"_{i}{k}" for k in inner})
        on = F.lit(True)
        for k in inner:
            on = on & F.col(k).eqNullSafe(F.col(f"_{i}{k}"))
        out = out.join(one, on, "left")
    return out.select(*[F.col(k).alias(n) for k, n in zip(inner, names)], *[a.alias for a in ask.aggregations])


def _page(df: DataFrame, order: list[str], offset: int, limit: int | None) -> DataFrame:
    """``limit`` rows from ``offset`` on, by their positions, so that no task sees all rows up to there."""
    placed = ordered.indexed(df, [], order, "_at")
    wanted = F.col("_at") >= offset
    if limit is None:
        return placed.filter(wanted).drop("_at")
    return placed.filter(wanted & (F.col("_at") < offset + limit)).orderBy("_at").drop("_at")


KINDS = {"Metrics": "Metric", "Traces": "Trace", "Logs": "Log", "Events": "Event"}

TYPED = {
    "trace_id": "trace.trace_id",
    "span_id": "trace.span_id",
    "operation": "trace.name",
    "status": "trace.status_code",
    "level": "log.level",
    "metric": "metric.name",
    "service": "service.name",
}


@dataclass(frozen=True)
class TelemetryQuery:
    """What to ask of a frame of canonical records.

    ``where`` holds the predicates of the typed variants (trace_id, span_id,
    operation, status, level, metric, service), each a value or a list.
    """

    kind: str = "All"
    time_range: TimeRange = TimeRange()
    filters: Sequence[Rule] = ()
    where: dict[str, Any] = field(default_factory=dict)
    select: dict[str, str] = field(default_factory=dict)
    group_by: dict[str, str] = field(default_factory=dict)
    aggregations: Sequence[Aggregation] = ()
    limit: int | None = None
    offset: int = 0


def run(ask: TelemetryQuery, records: DataFrame) -> DataFrame:
    """The query as one lazy DataFrame; paging orders by (timestamp, id) or the group keys."""
    df = records
    if ask.kind != "All":
        df = df.filter(F.col("record_type") == KINDS[ask.kind])
    df = df.filter(ask.time_range.condition())
    for name, wanted in ask.where.items():
        values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        df = df.filter(F.col(TYPED[name]).isin(*values))
    for rule in ask.filters:
        df = df.filter(predicate(rule))
    if ask.aggregations:
        df = _grouped(ask, df)
        order = list(ask.group_by)
    else:
        df = df.select("id", "timestamp", *[F.col(p).alias(n) for n, p in ask.select.items()])
        order = ["timestamp", "id"]
    if ask.offset and order and (ask.limit is None or ask.offset + ask.limit > PAGE):
        return _page(df, order, ask.offset, ask.limit)
    if ask.limit is not None or ask.offset:
        if order:
            df = df.orderBy(*order)
        if ask.offset:
            df = df.offset(ask.offset)
        if ask.limit is not None:
            df = df.limit(ask.limit)
    return df
