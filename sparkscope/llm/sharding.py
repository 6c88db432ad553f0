"""Sharding: proportional stratified interleaving of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import named, plain, positions, table, without

ADDED = ("shard", "slot")


def interleave(docs: DataFrame, shards: int = 16, source: str = "source", key: str = "doc_id", seed: int = 17, ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are shuffled by a seeded hash of their id and ranked within their source; row r of n
    stands at the fraction (r + 0.5) / n of the whole order. Sorting by that fraction and cutting
    into equal runs gives every shard the mixture of the sources, and counts at most one apart.
    Both sorts are range shuffles whose positions come from counts per partition, so a source
    that holds a third of all rows spreads like the others.

    A null source is a source of its own, a null id hashes like the empty string. Repeated ids
    stand next to each other, ordered by the columns in ``ties``; what is still equal gets any
    of the places. Fewer rows than shards leave shards empty; an empty table gives an empty
    result. Input columns named shard or slot are replaced.
    """
    own, names = plain(without(docs, ADDED))
    source = names[source]
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(names[key]).cast("string"), F.lit("")))
    order = [F.col("_key"), *[F.col(names[t]).asc_nulls_first() for t in ties]]
    ranked = positions(own.withColumn("_key", F.md5(salted.cast("binary"))), order, "_rank", "shard-ranked", [source], "_of")
    mixed = ranked.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_of")).drop("_key", "_rank", "_of")
    placed = positions(mixed, [F.col("_at"), F.col(source).asc_nulls_first()], "_rank", "shard-placed", total="_n")
    shard = f"_rank * {shards} div _n"
    slot = F.col("_rank") - F.expr(f"({shard} * _n + {shards - 1}) div {shards}")
    return placed.select(*named(names), F.expr(shard).cast("int").alias("shard"), slot.alias("slot"))


@query("op6_interleaved_shards")
def op6(spark, sf_dir):
    """Every document's shard and slot under the law of equal counts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return interleave(docs, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
