"""Documents in compressed columnar chunks, and keys that are looked up across all chunks.

Some operators compare all parts of all documents. They do so by messages between chunks of
documents and buckets of keys: a chunk sends each bucket its distinct keys (one entry a key and
chunk, so a key that every document holds stays small), the bucket answers, and the answer meets
the chunk again by a shuffle on the chunk's number. Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkscope.llm.common import most_words, pieces_of, stage

#: Text bytes in a chunk, about; one longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Key bits that name a bucket, at least: keys of one bucket are a range.
BUCKET_BITS = 7
#: Words of all texts for a bucket. A word gives at most two keys, and about half a one as a rule.
BUCKET_WORDS = 2 << 20
MESSAGE = "chunk bigint, kind int, bucket int, a binary, b binary, c binary"
_TYPES = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
#: Kinds of messages, in the order in which a chunk's task meets them.
NOTE, ANSWER, SECOND, DOCS = 0, 1, 2, 9


def messages(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (chunk, kind, bucket, a, b, c), the last three as arrays or bytes or None."""
    columns = list(zip(*rows)) if rows else [[]] * 6
    blobs = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in col] for col in columns[3:]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*columns[:3], *blobs], _TYPES.types)], schema=_TYPES)


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def chunked(docs: DataFrame, text: str, label: str) -> DataFrame:
    """A written table of messages, one per chunk, each with all columns of its documents; ``b`` bounds its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for n, piece in enumerate(pieces_of(batches, text, CHUNK_BYTES)):
            words = most_words(piece.column(piece.schema.get_field_index(text)))
            yield messages([(base + n, DOCS, 0, pack(piece), np.array([words], ">i8"), None)])

    return stage(docs.mapInArrow(work, MESSAGE), label)


def bucket_bits(chunks: DataFrame) -> int:
    """Key bits that name a bucket, so that a bucket's share of the keys does not grow with the chunks."""
    words = chunks.agg(F.sum(F.conv(F.hex("b"), 16, 10).cast("bigint"))).first()[0] or 0
    return min(30, max(BUCKET_BITS, (-(-words // BUCKET_WORDS) - 1).bit_length()))


def by_bucket(rows: list[tuple], chunk: int, kind: int, bits: int, key: np.ndarray, *more: np.ndarray) -> None:
    """Append a message for each bucket, named by ``bits`` bits, that has some of these ascending keys."""
    if not len(key):
        return
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows.append((chunk, kind, int(bucket[a]), *(list(x[a:b] for x in (key, *more)) + [None, None])[:3]))


def answered(asked: DataFrame, answer: Callable[[list[dict]], list[tuple]], label: str) -> DataFrame:
    """Each bucket's answer to all its messages, written. ``answer`` gets and gives whole buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and held:
                    yield messages(answer(held))
                    held = []
                bucket = row["bucket"]
                held.append(row)
        if held:
            yield messages(answer(held))

    return stage(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(work, MESSAGE), label)


def at_chunks(frames: list[DataFrame], work: Callable[[int, dict[int, list[dict]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work(chunk, messages by kind)`` for every chunk, with all messages that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["chunk"] != chunk and held:
                    yield from work(chunk, held)
                    held = {}
                chunk = row["chunk"]
                held.setdefault(row["kind"], []).append(row)
        if held:
            yield from work(chunk, held)

    every = reduce(DataFrame.unionByName, frames)
    return every.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(run, schema)


def array_of(rows: list[dict], column: str, kind) -> np.ndarray:
    """One array from the blobs of these messages."""
    return np.frombuffer(b"".join(r[column] or b"" for r in rows), kind)


def notes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Small numbers per document (chunk, at, columns) as one message per chunk: ``a`` holds them row by row as longs."""
    width = len(columns) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield messages([(r["chunk"], NOTE, 0, np.array([[x[c] for c in ("at", *columns)] for x in r["rows"]], np.int64).reshape(-1, width), None, None) for r in batch.to_pylist()])

    fields = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("at", *columns)])
    return df.groupBy("chunk").agg(F.sort_array(F.collect_list(fields)).alias("rows")).mapInArrow(work, MESSAGE)


def in_set(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Whether each key is among the ascending ones."""
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_, keys)
    at[at == len(sorted_)] = 0
    return sorted_[at] == keys
