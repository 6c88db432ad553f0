"""Named functions: scalars and aggregates as column builders, and table functions over frames.

Scalar functions can also be made known to SQL. Aggregates that need exact percentiles
are evaluated by :func:`aggregate`, which places values instead of gathering a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkscope.operators import aggregates as ag, anomalies, cluster, forecast, ordered, series, transforms as tr


@dataclass(frozen=True)
class Function:
    """``kind`` is scalar, aggregate, rank (an exact percentile; ``build`` maps n to a rank) or table."""

    name: str
    kind: str
    build: Callable[..., Any]
    sql: str | None = None


class Registry:
    """Functions by name: add, remove, get, list and call."""

    def __init__(self, functions: Sequence[Function] = ()):
        self._functions = {f.name: f for f in functions}

    def add(self, function: Function) -> None:
        self._functions[function.name] = function

    def remove(self, name: str) -> bool:
        return self._functions.pop(name, None) is not None

    def get(self, name: str) -> Function:
        if name not in self._functions:
            raise KeyError(f"unknown function: {name}")
        return self._functions[name]

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, f in self._functions.items() if kind in (None, f.kind))

    def call(self, name: str, *args: Any, **params: Any) -> Any:
        """A column for scalars and aggregates, a DataFrame for table functions."""
        return self.get(name).build(*args, **params)

    def aggregate(self, df: DataFrame, keys: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
        """The named aggregates of ``value`` per key, one column each."""
        wanted = [self.get(n) for n in names]
        plain = [f.build(F.col(value)).alias(f.name) for f in wanted if f.kind == "aggregate"]
        ranks = {f.name: f.build for f in wanted if f.kind == "rank"}
        out = df.groupBy(*keys).agg(*plain) if plain else None
        if ranks:
            ranked = ordered.values_at(df, keys, value, ranks)
            out = ranked if out is None else out.join(ranked, list(keys), "left")
        return out

    def register(self, spark: SparkSession) -> list[str]:
        """Make the functions that have a SQL body known to SQL in this session."""
        made = []
        for f in self._functions.values():
            if f.sql:
                spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}{f.sql}")
                made.append(f.name)
        return sorted(made)


def _aggregates(prefix: str) -> list[Function]:
    plain = {
        "avg": F.avg,
        "stddev": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)),
        "min": F.min,
        "max": F.max,
        "count": F.count,
        "sum": F.sum,
    }
    out = [Function(f"{prefix}_{n}", "aggregate", b) for n, b in plain.items()]
    return out + [Function(f"{prefix}_p{p}", "rank", ag.floor_rank(p)) for p in (95, 99)]


def _clusters(df: DataFrame, k: int = 2) -> DataFrame:
    features = cluster.window_features(df)
    points = features.withColumn("x", F.array(*cluster.FEATURES))
    return cluster.kmeans(points, k).select("series", "i", "label")


def default() -> Registry:
    """The functions every session knows."""
    json_text = "(doc STRING) RETURNS STRING RETURN "
    scalars = [
        Function(
            "extract_service_name",
            "scalar",
            lambda c: tr.extract(c, "service_name"),
            json_text + "coalesce(get_json_object(doc, '$.service.name'), get_json_object(doc, \"$.attributes['service.name']\"))",
        ),
        Function(
            "extract_operation_name",
            "scalar",
            lambda c: tr.extract(c, "operation_name"),
            json_text + "get_json_object(doc, '$.trace.name')",
        ),
        Function(
            "extract_trace_id",
            "scalar",
            lambda c: tr.extract(c, "trace_id"),
            json_text + "get_json_object(doc, '$.trace.trace_id')",
        ),
        Function(
            "extract_span_id",
            "scalar",
            lambda c: tr.extract(c, "span_id"),
            json_text + "get_json_object(doc, '$.trace.span_id')",
        ),
        *[
            Function(f"parse_{kind}", "scalar", lambda c, kind=kind: tr.parse(c, kind))
            for kind in ("trace", "span", "metric", "log")
        ],
        Function("extract_attributes", "scalar", lambda c: tr.string_map_of(F.get_json_object(c, "$.attributes"))),
        Function("extract_tags", "scalar", lambda c: tr.string_map_of(F.get_json_object(c, "$.tags"))),
        Function("round_to_interval", "scalar", tr.floor_time),
        Function("normalize_metric_name", "scalar", tr.metric_name),
    ]
    tables = [
        Function("time_series_agg", "table", lambda df, **p: ag.summary(df, ["series"], "value", **p)),
        Function("analyze_trend", "table", series.trend),
        Function("calculate_trend", "table", series.simple_trend),
        Function("detect_anomaly", "table", anomalies.ensemble),
        Function("forecast", "table", forecast.ensemble),
        Function("forecast_values", "table", forecast.naive),
        Function("calculate_correlation", "table", series.correlation),
        Function("calculate_regression", "table", lambda df: series.regression(series.index(df))),
        Function("cluster_analysis", "table", _clusters),
    ]
    return Registry([*scalars, *_aggregates("telemetry"), *_aggregates("custom"), *tables])
