"""Line dedup: lines that several documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import named, plain, stage, table, without

ADDED = ("n_lines", "n_dropped", "kept_text")
#: White space at the ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case, all else unchanged."""
    bare = F.trim(line, F.lit(BLANKS))
    # lower() is fast but knows letters beyond A-Z, so it only sees lines of ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _digest(line: Column, least: int) -> Column:
    """128 bits that stand for a line's key; null where the key is too short to count."""
    key = normalised(line)
    return F.when(F.char_length(key) >= least, F.md5(key.cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def drop_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10, documents: int = 2) -> DataFrame:
    """Every row of ``docs`` with n_lines, n_dropped and kept_text, its lines that stay.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at
    least ``least`` code points that at least ``documents`` rows hold lose all their lines, except
    in the smallest id that holds them; there all of them stay. Other lines stay as they are.

    Each document sends a key once, so counting one is a partial sum, and a line that every
    document holds is one row a task. Only keys that are dropped somewhere are written; they meet the
    lines again by a join whose large side AQE can split, and the places of a document's dropped
    lines, at most as many as it has lines, meet the document. Keys are compared by MD5 digests.

    Null and empty texts are one empty line. A null id is smaller than any other. Rows with the same id are
    one place for the exception: a line they hold stays in all of them if theirs is the smallest id. An empty table
    gives an empty result. Input columns named like the added ones are replaced.
    """
    own, names = plain(without(docs, ADDED))
    own = own.withColumn(names[text], F.coalesce(F.col(names[text]), F.lit("")))
    # Rows of one id and text lose the same lines, so the two name a document well enough.
    own = own.withColumn("_doc", F.struct(F.col(names[key]).alias("id"), F.md5(F.col(names[text]).cast("binary")).alias("text")))
    lines = _lines(F.col(names[text]))

    held = own.select(F.struct(F.col("_doc.id")).alias("at"), F.explode(F.array_distinct(F.transform(lines, lambda x: _digest(x, least)))).alias("key"))
    shared = stage(
        held.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= documents) & ~F.col("first").eqNullSafe(F.col("last")))
        .select("key", "first"),
        "line-keys",
    )
    placed = own.select("_doc", F.posexplode(lines).alias("place", "line")).select("_doc", "place", _digest(F.col("line"), least).alias("key"))
    lost = placed.filter("key IS NOT NULL").join(shared, "key").filter(F.struct("_doc.id") > F.col("first"))
    places = stage(lost.groupBy("_doc").agg(F.array_sort(F.collect_set("place")).alias("_places")), "line-places")

    found = own.join(places.withColumnRenamed("_doc", "_at"), F.col("_doc").eqNullSafe(F.col("_at")), "left")
    found = found.withColumn("_n", F.size(lines)).withColumn("_lost", F.coalesce(F.size("_places"), F.lit(0)))
    # The runs between dropped lines, cut out one by one, so that a long text costs no more than its
    # length. Inside the outer transform the lines are a value, split once.
    starts = F.concat(F.array(F.lit(0)), F.transform("_places", lambda p: p + 1))
    runs = F.arrays_zip(starts.alias("a"), F.concat(F.col("_places"), F.array(F.col("_n"))).alias("b"))
    left = F.transform(F.array(lines), lambda all_: F.flatten(F.transform(runs, lambda r: F.slice(all_, r["a"] + 1, r["b"] - r["a"]))))[0]
    kept = F.when(F.col("_lost") == 0, F.col(names[text])).otherwise(F.array_join(left, "\n"))
    return found.select(
        *named(names), F.col("_n").cast("bigint").alias("n_lines"), F.col("_lost").cast("bigint").alias("n_dropped"), kept.alias("kept_text")
    )


@query(
    "op11_line_dedup",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
               FROM documents),
         k AS (SELECT doc_id, i, line,
                      translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
               FROM l),
         s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
         m AS (SELECT doc_id, i, line, coalesce(first < doc_id, FALSE) AS lost FROM k LEFT JOIN s USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op11(spark, sf_dir):
    """One row per document with a digest of the lines that stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
