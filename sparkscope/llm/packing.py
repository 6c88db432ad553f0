"""Packing: best-fit decreasing with a segment tree over remaining capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import ROW, binary_array, numbered, pieces_of, stage, table
from sparkscope.llm.encoder import WordLevel, encoder

WINDOW = 4096
#: Tails that are packed together. More tails make more groups, each packed on its own.
GROUP = 16_384


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (1 to ``window``), and the number of bins.

    Lengths are placed in decreasing order, each into the open bin with the least room that
    still holds it. A segment tree over rooms 0 to ``window`` marks which rooms some open bin
    has; its leftmost marked leaf at or after a length is that bin. Bins of equal room are a
    stack.
    """
    size = 1 << window.bit_length()
    tree = bytearray(2 * size)  # 1 where the range below has an open bin
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def set_leaf(room: int, value: int) -> None:
        node = room + size
        while node and tree[node] != value:
            tree[node] = value
            node >>= 1
            if not value and (tree[2 * node] or tree[2 * node + 1]):
                break

    def tightest(room: int) -> int:
        node = room + size
        while not tree[node]:
            # On to the next range to the right, which begins where this one ends.
            while node & 1:
                node >>= 1
            if not node:
                return -1
            node += 1
        while node < size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - size

    for i, n in zip(order.tolist(), lengths[order].tolist()):
        room = tightest(n)
        if room < 0:
            bins[i], left = made, window - n
            made += 1
        else:
            bins[i], offsets[i], left = open_bins[room].pop(), window - room, room - n
            if not open_bins[room]:
                set_leaf(room, 0)
        if left:
            open_bins[left].append(int(bins[i]))
            set_leaf(left, 1)
    return bins, offsets, made


def tokenized(docs: DataFrame, tokenizer: str, text: str, key: str, end: int) -> DataFrame:
    """A written table of _row, id, ids (little-endian 32-bit) and n (number of ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(WordLevel, tokenizer)
        for batch in pieces_of(batches, "t"):
            ids, at = known.encode([t or "" for t in batch.column(1).to_pylist()], end)
            blob = binary_array(at * 4, ids.astype("<u4").view(np.uint8)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blob, pa.array(np.diff(at))], ["k", "ids", "n"])

    texts = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return numbered(texts.mapInArrow(encode, "k bigint, ids binary, n bigint"), "packing-ids")


def placed(ids: DataFrame, window: int) -> DataFrame:
    """_row, full (id of the first full window's sequence), tail_sequence and tail_offset of each document."""
    groups = max(1, -(-ids.count() // GROUP))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), schema=schema)
        if not found.num_rows:
            return
        rows, group, n = (found.column(c).to_numpy() for c in ("r", "g", "n"))
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            own = own[np.argsort(rows[own])]  # the same order whatever order the rows came in
            full, tail = n[own] // window, n[own] % window
            some = np.flatnonzero(tail)
            bins, offsets, made = best_fit(tail[some], window)
            base = int(g) << 40
            sequence, offset = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
            sequence[some], offset[some] = base + bins, offsets
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[own]), pa.array(base + made + np.cumsum(full) - full), pa.array(sequence), pa.array(offset)],
                ["r", "full", "tail_sequence", "tail_offset"],
            )

    schema = pa.schema([("g", pa.int64()), ("r", pa.int64()), ("n", pa.int64())])
    group = F.pmod(F.xxhash64(ROW), F.lit(groups))
    spread = ids.select(group.alias("g"), F.col(ROW).alias("r"), "n").repartition(groups, "g")
    return spread.mapInArrow(pack, "r bigint, full bigint, tail_sequence bigint, tail_offset bigint")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = 2, window: int = WINDOW) -> DataFrame:
    """All documents' ids in sequences of at most ``window`` ids, one row per piece.

    Columns: id, start (the document's ids before the piece), length, ids (little-endian 32-bit),
    doc_tokens, sequence_id, offset (gapless from 0 in the sequence). A document longer than the
    window is first cut into full windows, each a sequence of its own. The tails are packed by
    best fit decreasing, in groups of about ``GROUP`` documents dealt by a hash of the row, so
    the work spreads at any size; only lengths travel to the packing, and a join by row
    brings the places back to the ids. Sequences shorter than the window are padded to it.

    Null text counts as empty and gives the end id alone; null and repeated ids are kept apart.
    An empty table gives an empty result. Other columns are not read.
    """
    ids = tokenized(docs, tokenizer, text, key, end)
    where = placed(ids, window)
    full = F.expr(f"n div {window}")
    joined = ids.join(where, F.col(ROW) == F.col("r"))
    # Pieces are cut before they are spread, so a long document's ids are not repeated per piece.
    starts = F.sequence(F.lit(0), (F.expr(f"(n + {window - 1}) div {window}") - 1).cast("int"))
    cut = F.transform(starts, lambda i: F.substring(F.col("ids"), i * (4 * window) + 1, F.lit(4 * window)))
    pieces = joined.select("k", "n", "full", "tail_sequence", "tail_offset", F.posexplode(cut).alias("i", "piece"))
    whole = F.col("i") < full
    length = F.when(whole, F.lit(window)).otherwise(F.expr(f"n % {window}")).cast("bigint")
    return pieces.select(
        F.col("k").alias(key),
        (F.col("i").cast("bigint") * window).alias("start"),
        length.alias("length"),
        F.col("piece").alias("ids"),
        F.col("n").alias("doc_tokens"),
        F.when(whole, F.col("full") + F.col("i")).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("tail_offset")).cast("bigint").alias("offset"),
    )


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op9_packed_sequences")
def op9(spark, sf_dir):
    """Every piece of every document, where it lies, and the checksum of its ids."""
    pieces = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
