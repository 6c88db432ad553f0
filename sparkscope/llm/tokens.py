"""Token-id output: files of concatenated ids whose document boundaries are Elias-Fano encoded."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import binary_array, pieces_of, stage, table
from sparkscope.llm.encoder import ByteLevel, encoder
from sparkscope.session import scratch

MAGIC = b"EFTOK1\0\0"
BLOCK = 512
#: A file is closed when it holds so many ids or documents; one longer document makes a longer file.
MAX_IDS, MAX_DOCS = 16_000_000, 131_072


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits an entry, with select.

    Low bits are packed; high bits are unary in a bitmap. For select, a 32-bit count of ones is
    kept per block of 512 bits: entry i lies in the block that holds the i-th one.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        blocks = (int(places[-1]) // BLOCK + 1) if n else 0
        bitmap = np.zeros(blocks * BLOCK, np.uint8)
        bitmap[places] = 1
        ones = np.concatenate([[0], np.cumsum(bitmap.reshape(blocks, BLOCK).sum(axis=1, dtype=np.int64))])
        return cls(n, bits, low, np.packbits(bitmap, bitorder="little"), ones.astype(np.uint32))

    def select(self, index: np.ndarray) -> np.ndarray:
        """The entries at these places, in any order."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, np.uint64)
        block = np.searchsorted(self.ones, index, "right") - 1
        blocks, own = np.unique(block, return_inverse=True)
        rows = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[blocks], axis=1, bitorder="little")
        at = np.flatnonzero(rows)  # the ones of these blocks, block after block
        first = np.concatenate([[0], np.cumsum(rows.sum(axis=1, dtype=np.int64))])
        hit = at[first[own] + index - self.ones[block].astype(np.int64)] % BLOCK
        high = (block * BLOCK + hit - index).astype(np.uint64)
        out = high << np.uint64(self.low_bits)
        bit = index[:, None] * self.low_bits + np.arange(self.low_bits)
        value = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return out + (value.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def dump(self) -> tuple[dict, bytes]:
        parts = [x.tobytes() for x in (self.low, self.high, self.ones)]
        return {"n": self.n, "low_bits": self.low_bits, "bytes": [len(p) for p in parts]}, b"".join(parts)

    @classmethod
    def load(cls, head: dict, data: memoryview) -> EliasFano:
        a, b, c = head["bytes"]
        return cls(
            head["n"], head["low_bits"], np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a : a + b], np.uint8), np.frombuffer(data[a + b : a + b + c], "<u4")
        )


def file_bytes(keys: list[int | None], ends: np.ndarray, ids: np.ndarray, wide: bool) -> list[bytes]:
    """One file: magic, header length, JSON header, boundaries, document ids, ids.

    Keys are ascending with nulls first; they are Elias-Fano encoded above the smallest.
    """
    known = [k for k in keys if k is not None]
    least = known[0] if known else 0
    bounds, names = EliasFano.of(ends), EliasFano.of(np.array([k - least for k in known], np.uint64))
    (b_head, b_data), (k_head, k_data) = bounds.dump(), names.dump()
    head = {"docs": len(keys), "ids": len(ids), "width": 4 if wide else 2, "nulls": len(keys) - len(known), "least": least, "bounds": b_head, "keys": k_head}
    text = json.dumps(head).encode()
    return [MAGIC, struct.pack("<I", len(text)), text, b_data, k_data, ids.astype("<u4" if wide else "<u2").tobytes()]


class TokenFile:
    """Random access to one written file; only the header and the boundaries are held."""

    def __init__(self, source):
        self.source = source
        start = source.read_at(len(MAGIC) + 4, 0)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", start[len(MAGIC) :])
        self.head = head = json.loads(source.read_at(size, len(start)))
        at = len(start) + size
        parts = [sum(head[k]["bytes"]) for k in ("bounds", "keys")]
        data = memoryview(source.read_at(sum(parts), at))
        self.bounds = EliasFano.load(head["bounds"], data[: parts[0]])
        self.keys = EliasFano.load(head["keys"], data[parts[0] :])
        self.at = at + sum(parts)

    def documents(self, first: int, last: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Keys, bounds within the file (one more than documents) and ids of documents first to last - 1."""
        nulls, width = self.head["nulls"], self.head["width"]
        names = self.keys.select(np.arange(max(first - nulls, 0), max(last - nulls, 0)))
        keys = [None] * (max(nulls - first, 0) - max(nulls - last, 0)) + [int(k) + self.head["least"] for k in names]
        bounds = self.bounds.select(np.arange(max(first - 1, 0), last)).astype(np.int64)
        if first == 0:
            bounds = np.concatenate([[0], bounds])
        raw = self.source.read_at(int(bounds[-1] - bounds[0]) * width, self.at + int(bounds[0]) * width)
        return keys, bounds, np.frombuffer(raw, "<u4" if width == 4 else "<u2").astype("<u4")


def write(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = 0) -> DataFrame:
    """Encode every whole text and write token files in ascending id order; returns their manifest.

    Documents are range-partitioned and sorted by id (equal ids by a hash of the text), so files
    follow each other as partitions do. Each task encodes its documents and writes files of
    bounded size below ``spark.checkpoint.dir`` under names of their own. The manifest (path,
    docs, ids, base = ids in all files before) is a written table that names only the files of
    tasks that were committed: what a lost executor left behind is never read.

    Null text counts as empty and yields the end id alone; null ids come first. An empty table
    gives an empty manifest. Other columns are not read.
    """
    home = scratch(docs.sparkSession, "tokens")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        files, folder = FileSystem.from_uri(home)
        files.create_dir(folder, recursive=True)
        encode = encoder(ByteLevel, tokenizer)
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal made, keys, held, sizes
            path = f"{folder}/part-{part:06d}-{made:04d}-{uuid.uuid4().hex}.tok"
            ids = np.concatenate(held)
            # Two bytes hold every id of a vocabulary of at most 65,536.
            wide = encode.pieces.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536 or end > 65_535
            with files.open_output_stream(path) as out:
                for block in file_bytes(keys, np.cumsum(np.concatenate(sizes)), ids, wide):
                    out.write(block)
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "seq": made, "path": f"{home}/{os.path.basename(path)}", "docs": len(keys), "ids": len(ids)}], schema=schema
            )
            made, keys, held, sizes = made + 1, [], [], []
            return row

        for batch in pieces_of(batches, "t"):
            ids, at = encode.encode([t or "" for t in batch.column(1).to_pylist()], end)
            keys += batch.column(0).to_pylist()
            held.append(ids.astype(np.uint32))
            sizes.append(np.diff(at))
            if sum(map(len, held)) >= MAX_IDS or len(keys) >= MAX_DOCS:
                yield close()
        if keys:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    by = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    ordered = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).repartitionByRange(*by).sortWithinPartitions(*by)
    files = stage(ordered.mapInArrow(save, "part int, seq int, path string, docs bigint, ids bigint"), "manifest")
    # Two levels: files of a partition, then partitions, whose number the shuffle bounds.
    before = lambda w: F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("_base"))
    return (
        files.withColumn("_own", before(Window.partitionBy("part").orderBy("seq")))
        .join(parts, "part")
        .select("path", "docs", "ids", (F.col("_base") + F.col("_own")).alias("base"))
    )


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the files in ``manifest``: id, start (ids of all before), n_tokens, ids (little-endian 32-bit)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for row in batch.to_pylist():
                files, path = FileSystem.from_uri(row["path"])
                with files.open_input_file(path) as source:
                    held = TokenFile(source)
                    step = max(1, min(4096, (1 << 20) * row["docs"] // max(row["ids"], 1)))
                    for first in range(0, row["docs"], step):
                        keys, bounds, ids = held.documents(first, min(first + step, row["docs"]))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys, pa.int64()),
                                pa.array(bounds[:-1] + row["base"]),
                                pa.array(np.diff(bounds)),
                                binary_array((bounds - bounds[0]) * 4, ids.view(np.uint8)).cast(pa.binary()),
                            ],
                            ["k", "start", "n_tokens", "ids"],
                        )

    spread = manifest.select("path", "docs", "ids", "base").repartition("path")
    return spread.mapInArrow(load, "k bigint, start bigint, n_tokens bigint, ids binary").withColumnRenamed("k", key)


@query("op1_token_files")
def op1(spark, sf_dir):
    """Every document read back from the token files: its place, its number of ids and their checksum."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = stage(write(docs, public_tokenizers.path("byte_bpe_50k.json")), "manifest-based")
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
