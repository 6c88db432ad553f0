"""Search tables: tokens, postings, key profiles, bounding boxes and null sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Words that are not indexed.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "this", "that", "these", "those",
]

NOT_WORD = r"[^\p{L}\p{M}\p{N}\p{Pc}\s]"


def tokens(text: Column) -> Column:
    """Lower-cased words of three bytes or more that are no stop words, in order."""
    cleaned = F.regexp_replace(F.lower(text), NOT_WORD, " ")
    words = F.split(cleaned, r"\s+")
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(STOP_WORDS))


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per token with its position in the document."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("position", "term"))


def postings(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per term, document and field: how often and where the term is.

    The texts are spread by document before they are cut into tokens; grouping by term,
    document and field then needs no shuffle of the tokens, which are far larger.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(key, *fields).repartition(parts, key)
    rows = spread.select(key, F.inline(texts)).select(key, "field", F.posexplode(tokens(F.col("text"))).alias("position", "term"))
    return rows.groupBy("term", key, "field").agg(
        F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_list("position")).alias("positions")
    )


def term_stats(posted: DataFrame, key: str) -> DataFrame:
    """Per term: documents and occurrences."""
    return posted.groupBy("term").agg(
        F.countDistinct(key).alias("documents"), F.sum("frequency").alias("occurrences")
    )


def composite_key(fields: Sequence[str]) -> Column:
    """The fields' text joined by a bar; a missing field counts as the empty text."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def key_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, repeated keys, SHA-256 collisions, load factor and mean key length.

    Keys are counted before they are hashed, so a key that repeats is hashed once per task.
    """
    keys = df.groupBy(composite_key(fields).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    hashed = keys.withColumn("hash", F.sha2("key", 256)).groupBy("hash").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.octet_length("key")).alias("bytes")
    )
    return hashed.agg(
        F.sum("n").alias("total"),
        F.sum("k").alias("unique_keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("repeats"),
        (F.sum("k") - F.count(F.lit(1))).alias("hash_collisions"),
        F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("load_factor"),
        F.round(F.sum("bytes") / F.sum("n"), 6).alias("avg_key_length"),
    )


def bounding_box(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """The smallest box that holds the coordinates, per key."""
    return df.groupBy(*keys).agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y")
    )


def sweep(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an entry in every column, and how many entries are null or empty per column."""
    empty = {c: F.col(c).isNull() | (F.col(c).cast("string") == "") for c in columns}
    clean = df
    for hit in empty.values():
        clean = clean.filter(~hit)
    entries = F.array(*[F.struct(F.lit(c).alias("field"), hit.alias("orphan")) for c, hit in empty.items()])
    report = df.select(F.inline(entries)).groupBy("field").agg(
        F.count_if("orphan").alias("orphans"), F.count(F.lit(1)).alias("entries")
    )
    return clean, report
