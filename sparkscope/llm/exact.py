"""Exact dedup: frequent digests are settled map-side, the others by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import ROW, named, numbered, plain, stage, table, without

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
HEAVY = 256
TRACKED = 4096


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with its group of equal texts: keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A frequent-items sketch (a Misra-Gries
    summary that merges; at most ``TRACKED`` counters) names up to ``HEAVY`` digests. Their
    rows are counted exactly, and the verified winners, at most ``HEAVY`` rows, are broadcast,
    so a group that holds a third of all rows is never shuffled. The remaining digests meet in
    partial aggregates and an ordinary shuffle.

    Null text counts as empty; a null id is smaller than any other. Of repeated rows with the
    same id exactly one is kept. An empty table gives an empty result. Input columns named like
    the added ones are replaced; all others are returned as they are.
    """
    own, names = plain(without(docs, ADDED))
    digest = F.unhex(F.sha2(F.coalesce(F.col(names[text]), F.lit("")).cast("binary"), 256))
    rows = numbered(own.withColumn("_digest", digest).withColumn("_short", F.xxhash64("_digest")), "exact-rows")
    top = stage(
        rows.agg(F.expr(f"approx_top_k(_short, {HEAVY}, {TRACKED})").alias("t")).select(F.explode("t.item").alias("_short")),
        "exact-frequent",
    )
    best = [F.max(F.struct(F.col(names[key]).alias("id"), F.col(ROW).alias("at"))).alias("_best"), F.count(F.lit(1)).alias("_size")]
    winners = stage(
        rows.join(F.broadcast(top), "_short", "left_semi").groupBy("_digest").agg(*best).filter("_size > 1"), "exact-winners"
    )
    heavy = rows.join(F.broadcast(winners), "_digest")
    light = rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    settled = light.join(light.groupBy("_digest").agg(*best), "_digest")
    return heavy.unionByName(settled).select(
        *named(names),
        F.col("_best.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_best.at") == F.col(ROW)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    own, names = plain(docs)
    return exact_dedup(own, names[text], names[key]).filter("kept").select(*named(names))


@query(
    "op7_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
         g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op7(spark, sf_dir):
    """One row per document with the document of its text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", *ADDED)
