"""Substring dedup: words of repeated 20-word windows, found through difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.chunks import ANSWER, DOCS, NOTE, SECOND, answered, array_of, at_chunks, bucket_bits, by_bucket, chunked, in_set, messages, notes, unpack
from sparkscope.llm.common import Words, binary_array, mix, named, plain, positions, shingle_hashes, stage, table, without

WINDOW = 20
#: Every difference modulo 13 is the difference of two of these, so for any two windows there is
#: a shift below 13 that brings both to places of the cover.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
ADDED = ("n_words", "n_removed")
_U = np.uint64


class Places:
    """The words of a chunk with their place in their document and the words left from there on."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts)
        count = np.diff(words.first)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.place = np.arange(len(self.doc)) - np.repeat(words.first[:-1], count)
        self.left = np.repeat(count, count) - self.place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at cover places, and the hashes of the anchors that begin there."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[self.place % PERIOD] & (self.left >= ANCHOR))
        return at, shingle_hashes(self.words.hash, ANCHOR)[at] if len(at) else np.zeros(0, _U)

    def candidates(self, shared: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Word numbers where windows begin that hold an anchor met more than once, in first documents."""
        at, key = self.anchors()
        at = at[in_set(key, shared) & first[self.doc[at]]] if len(at) else at
        begins = np.zeros(len(self.doc) + 1, bool)
        for shift in range(PERIOD):
            start = at[self.place[at] >= shift] - shift
            begins[start[self.left[start] >= WINDOW]] = True
        return np.flatnonzero(begins)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that begin there."""
        one, two = np.zeros(len(at), _U), np.full(len(at), 1, _U)
        for k in range(WINDOW):
            word = self.words.hash[at + k]
            one = (one ^ word) * _U(0x9E3779B97F4A7C15)
            one ^= one >> _U(32)
            two = (two + word) * _U(0xC2B2AE3D27D4EB4F)
            two ^= two >> _U(29)
        return mix(one), mix(two)


class Asked:
    """The distinct candidate windows of a chunk, ascending, each with its earliest document."""

    def __init__(self, places: Places, note: np.ndarray, shared: np.ndarray):
        self.first = np.zeros(len(places.words.first) - 1, bool)
        self.order = np.zeros(len(self.first), np.int64)
        self.first[note[:, 0]], self.order[note[:, 0]] = note[:, 2] == 1, note[:, 1]
        at = places.candidates(shared, self.first)
        one, two = places.windows(at)
        by = np.lexsort((places.place[at], self.order[places.doc[at]], two, one))
        self.at, one, two = at[by], one[by], two[by]
        self.new = np.ones(len(at), bool)
        self.new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.one, self.two = one[self.new], two[self.new]
        self.least = self.order[places.doc[self.at[self.new]]]


def _texts(row: dict, text: str) -> pa.Array:
    batch = unpack(row["a"])
    return batch, batch.column(batch.schema.get_field_index(text))


def _shared(rows: list[dict]) -> list[tuple]:
    """Of each chunk's anchors those that occur more than once anywhere."""
    sizes = [len(r["a"]) // 8 for r in rows]
    keys, counts = array_of(rows, "a", _U), array_of(rows, "b", np.uint16)
    known, which = np.unique(keys, return_inverse=True)
    often = (np.bincount(which, weights=counts, minlength=len(known)) > 1)[which]
    out, at = [], 0
    for r, n in zip(rows, sizes):
        own = keys[at : at + n][often[at : at + n]]
        if len(own):
            out.append((r["chunk"], ANSWER, r["bucket"], own, None, None))
        at += n
    return out


def _earliest(rows: list[dict]) -> list[tuple]:
    """For each chunk's windows one bit each: whether the earliest document that has it lies elsewhere."""
    sizes = [len(r["a"]) // 8 for r in rows]
    one, two, least = array_of(rows, "a", _U), array_of(rows, "b", _U), array_of(rows, "c", np.int64)
    by = np.lexsort((least, two, one))
    new = np.ones(len(by), bool)
    new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    lowest = least[by][new][np.cumsum(new) - 1]
    later = np.zeros(len(by), bool)
    later[by] = least[by] > lowest
    out, at = [], 0
    for r, n in zip(rows, sizes):
        out.append((r["chunk"], SECOND, r["bucket"], np.packbits(later[at : at + n]), np.array([n], np.int64), None))
        at += n
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with the repeated words taken out of its text, and n_words and n_removed.

    Words are runs of bytes other than ASCII white space. A word goes when a window of 20
    consecutive words covers it whose words also begin earlier: in a document with a smaller id,
    or earlier in the same one; windows are judged on the input. What stays is joined by spaces.

    Anchors of 8 words are hashed only at places that are 0, 1, 3 or 9 modulo 13. Any two equal
    windows share an anchor at the same shift in both, so only windows around anchors that occur
    twice are extended to their 20 words, hashed to 128 bits and sent to find their earliest
    document. Of equal texts only the first takes part; all windows of the others repeat it.

    Null text has no words and stays null; null ids come first; equal ids come in the order of
    the written chunks. An empty table gives an empty result. Input columns named n_words or
    n_removed are replaced, all others are returned as they are.
    """
    docs = without(docs, ADDED)
    chunks = chunked(docs, text, "repeat-chunks")
    bits = bucket_bits(chunks)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, texts = _texts(row, text)
                ids = own.column(own.schema.get_field_index(key)).cast(pa.int64())
                digests = pa.array([xxhash.xxh3_128_digest((t or "").encode()) for t in texts.to_pylist()], pa.binary())
                n = own.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n)), ids, digests], ["chunk", "at", "id", "digest"])

    rows = stage(chunks.mapInArrow(narrow, "chunk bigint, at bigint, id bigint, digest binary"), "repeat-rows")
    place = F.struct(F.col("id").alias("i"), F.col("chunk").alias("c"), F.col("at").alias("a"))
    firsts = rows.groupBy("digest").agg(F.min(place).alias("p")).select(F.col("p.c").alias("chunk"), F.col("p.a").alias("at"), F.lit(1).alias("first"))
    ordered = positions(rows.select("chunk", "at", "id"), [F.col("id").asc_nulls_first(), F.col("chunk"), F.col("at")], "order", "repeat-order")
    marked = ordered.join(firsts, ["chunk", "at"], "left").select("chunk", "at", "order", F.coalesce("first", F.lit(0)).alias("first"))
    info = stage(notes(marked, ["order", "first"]), "repeat-notes")

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, anchor = Places(_texts(row, text)[1]).anchors()
                keys, counts = np.unique(anchor, return_counts=True)
                out: list[tuple] = []
                by_bucket(out, row["chunk"], ANSWER, bits, keys, np.minimum(counts, 65_535).astype(np.uint16))
                yield messages(out)

    shared = answered(chunks.mapInArrow(ask_anchors, chunks.schema), _shared, "repeat-anchors")

    def ask_windows(chunk: int, by: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        for row in by.get(DOCS, []):
            own = Asked(Places(_texts(row, text)[1]), array_of(by[NOTE], "a", np.int64).reshape(-1, 3), np.sort(array_of(by.get(ANSWER, []), "a", _U)))
            out: list[tuple] = []
            by_bucket(out, chunk, SECOND, bits, own.one, own.two, own.least)
            yield messages(out)

    later = answered(at_chunks([info, shared, chunks], ask_windows, chunks.schema), _earliest, "repeat-windows")
    fields = [f for f in docs.schema.fields]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_words bigint", "n_removed bigint"])

    def cut(chunk: int, by: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        for row in by.get(DOCS, []):
            batch, texts = _texts(row, text)
            places = Places(texts)
            own = Asked(places, array_of(by[NOTE], "a", np.int64).reshape(-1, 3), np.sort(array_of(by.get(ANSWER, []), "a", _U)))
            flags = [np.unpackbits(np.frombuffer(r["a"], np.uint8))[: int(np.frombuffer(r["b"], np.int64)[0])] for r in by.get(SECOND, [])]
            elsewhere = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
            # A window repeats if its first occurrence lies in another chunk, or before it in this one.
            repeats = ~own.new | elsewhere[np.cumsum(own.new) - 1] if len(own.at) else np.zeros(0, bool)
            count = np.diff(places.words.first)
            gone = np.zeros(len(places.doc) + 1, np.int64)
            start = own.at[repeats]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + WINDOW, -1)
            # Copies of an earlier text repeat it whole if they have a window at all.
            drop = (np.cumsum(gone)[:-1] > 0) | (~own.first & (count >= WINDOW))[places.doc]
            removed = np.bincount(places.doc[drop], minlength=len(count))
            column = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            columns[column] = _joined(places, ~drop, texts.is_null()).cast(batch.schema.field(column).type)
            names = [*batch.schema.names, *ADDED]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count.astype(np.int64)), pa.array(removed.astype(np.int64))], names)

    return at_chunks([info, shared, later, chunks], cut, schema)


def unrepeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated words taken out of its texts, and no other change."""
    own, names = plain(docs)
    return remove_repeats(own, names[text], names[key]).select(*named(names))


def _joined(places: Places, keep: np.ndarray, null: pa.Array) -> pa.Array:
    """Each text's kept words with one space between them, assembled in one buffer."""
    words, doc = places.words, places.doc[keep]
    start, size = words.start[keep], (words.end - words.start)[keep]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    room = size + ~last
    ends = np.cumsum(room)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 0x20, np.uint8)
    target = np.repeat(ends - room, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[target] = words.data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    per_doc = np.bincount(doc, weights=room, minlength=len(words.first) - 1).astype(np.int64)
    made = binary_array(np.concatenate([[0], np.cumsum(per_doc)]), out).cast(pa.large_string())
    return pa.compute.if_else(null, pa.scalar(None, pa.large_string()), made)


@query(
    "op4_repeated_windows",
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
         p AS (SELECT doc_id, unnest(range(1, len(l) - 18)) AS i, l FROM w WHERE len(l) >= 20),
         h AS (SELECT doc_id, i, md5(array_to_string(list_slice(l, i, i + 19), ' ')) AS k FROM p),
         r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
         g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
         d AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
         k AS (SELECT w.doc_id, l, coalesce(gone, []::BIGINT[]) AS gone FROM w LEFT JOIN d ON w.doc_id = d.doc_id),
         f AS (SELECT doc_id, len(l) AS n_words, len(gone) AS n_removed,
                      array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda j: CASE WHEN list_contains(gone, j) THEN NULL ELSE l[j] END), lambda x: x IS NOT NULL), ' ') AS kept FROM k)
    SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM f
    """,
)
def op4(spark, sf_dir):
    """How many words of every document repeat, and the checksum of what is kept."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
