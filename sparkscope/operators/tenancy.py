"""Tenants: whose rows may be read, how much of a quota is used, and when to scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkscope.session import small_side

WARNING, CRITICAL = 80.0, 95.0

# The quota of a tenant that has none of its own.
DEFAULT_QUOTA = {
    "cpu_cores": 1.0,
    "memory_bytes": 1_073_741_824,
    "storage_bytes": 10_737_418_240,
    "network_bandwidth_bps": 100_000_000,
    "connections": 100,
    "requests_per_second": 1000,
    "ingestion_rate_bps": 10_000_000,
    "query_time_seconds": 300,
}


@dataclass(frozen=True)
class Sharing:
    """What tenants may see of each other at all."""

    cross_tenant_analytics: bool = True
    compliance_sharing: bool = False


def visible(
    df: DataFrame, tenant: str, operation: str, grants: DataFrame, rules: Sharing = Sharing(), column: str = "tenant_id"
) -> DataFrame:
    """The rows ``tenant`` may use for ``operation``: its own and those granted.

    ``grants`` has source, operation and target. Where no grant for the operation exists,
    compliance work may see everything if that is shared.
    """
    own = F.col(column) == tenant
    if not rules.cross_tenant_analytics:
        return df.filter(own)
    granted = grants.filter((F.col("source") == tenant) & (F.col("operation") == operation))
    if rules.compliance_sharing and operation == "compliance" and granted.isEmpty():
        return df
    targets = granted.select(F.col("target").alias("_target")).distinct()
    marked = df.join(small_side(targets.withColumn("_granted", F.lit(True))), F.col(column) == F.col("_target"), "left")
    return marked.filter(own | F.col("_granted").isNotNull()).drop("_target", "_granted")


def _resources(*names: str) -> list[str]:
    return list(names or DEFAULT_QUOTA)


def level(percent: Column) -> Column:
    return F.when(percent >= CRITICAL, "critical").when(percent >= WARNING, "warning").otherwise("normal")


def with_limits(usage: DataFrame, quotas: DataFrame, resources: list[str]) -> DataFrame:
    """One row per tenant and resource: what is used and what is allowed, by quota or by default."""
    long = lambda df, name: df.select(
        "tenant_id",
        F.inline(
            F.array(*[F.struct(F.lit(r).alias("resource"), F.col(r).cast("double").alias(name)) for r in resources])
        ),
    )
    default = F
    for resource, amount in DEFAULT_QUOTA.items():
        default = default.when(F.col("resource") == resource, float(amount))
    joined = long(usage, "used").join(long(quotas, "quota"), ["tenant_id", "resource"], "left")
    return joined.withColumn("quota", F.coalesce("quota", default))


def utilisation(usage: DataFrame, quotas: DataFrame, resources: list[str]) -> DataFrame:
    """Percent of the quota in use, and whether that is a warning or critical."""
    percent = F.col("used") / F.col("quota") * 100
    return with_limits(usage, quotas, resources).withColumn("percent", percent).withColumn("level", level(F.col("percent")))


def check_requests(limits: DataFrame, requests: DataFrame, mode: str = "strict") -> DataFrame:
    """Whether each request (tenant_id, resource, amount) may go on top of what is used.

    strict refuses what passes the limit, soft and best_effort let it through; ``exceeded``
    is noted in all modes.
    """
    after = F.col("used") + F.col("amount")
    judged = requests.join(limits, ["tenant_id", "resource"]).withColumns(
        {"exceeded": after > F.col("quota"), "level": level(after / F.col("quota") * 100)}
    )
    allowed = ~F.col("exceeded") if mode == "strict" else F.lit(True)
    return judged.withColumn("allowed", allowed)


def needs_scaling(
    samples: DataFrame, quotas: DataFrame, last: int = 5, cooldown_seconds: int = 300, scaled: DataFrame | None = None, as_of: Column | None = None
) -> DataFrame:
    """Whether the mean cpu of the last samples is critical; needs that many samples.

    ``samples`` has tenant_id, ts, seq and cpu_cores. Tenants in ``scaled`` (tenant_id,
    scaled_at) wait for the cooldown to pass.
    """
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("ts"), F.desc("seq"))
    recent = samples.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= last)
    means = recent.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("samples"), F.avg("cpu_cores").alias("avg_cpu"))
    joined = means.join(quotas.select("tenant_id", F.col("cpu_cores").alias("quota")), "tenant_id", "left")
    quota = F.coalesce("quota", F.lit(DEFAULT_QUOTA["cpu_cores"]))
    hot = (F.col("samples") >= last) & (F.col("avg_cpu") / quota * 100 > CRITICAL)
    if scaled is not None:
        joined = joined.join(scaled, "tenant_id", "left")
        waiting = F.unix_micros(as_of) - F.unix_micros("scaled_at") < cooldown_seconds * 1_000_000
        hot = hot & ~F.coalesce(waiting, F.lit(False))
    return joined.select("tenant_id", "samples", F.round("avg_cpu", 6).alias("avg_cpu"), hot.alias("scale_up"))
