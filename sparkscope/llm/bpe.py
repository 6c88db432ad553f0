"""Byte-level BPE encoding and decoding by a rank file, with a segment tree per match."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import binary_array, pieces_of, table
from sparkscope.llm.encoder import ByteLevel, Pieces, encoder

NONE_ = 2**62
NONE = np.int64(NONE_)
#: Tree nodes handled at once, and matches that are not worth handling side by side.
NODES, FEW = 1 << 21, 10


class Ranks:
    """A rank file: token bytes by id, and the rank that two neighbouring tokens merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.bytes[rank] = token
        self.sizes = np.array([len(b) for b in self.bytes])
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                left, right = self.ids.get(token[:i]), self.ids.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        # Open addressing in two arrays; keys that are not there end at an empty slot.
        self.bits = (4 * len(pairs) + 1).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        waiting, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot = self._slot(waiting)
        while len(waiting):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = waiting[free]  # of several keys for a slot the last stays
            put = self.keys[slot] == waiting
            self.ranks[slot[put]] = values[put]
            waiting, values, slot = waiting[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that these pairs merge to; ``NONE`` where they don't."""
        key = left << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def rank_of(self, left: int, right: int) -> int:
        """:meth:`rank` of one pair."""
        key, mask = left << 32 | right, (1 << self.bits) - 1
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while True:
            found = self.keys.item(slot)
            if found == key:
                return self.ranks.item(slot)
            if found == -1:
                return NONE_
            slot = (slot + 1) & mask

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit bytes; a piece that is a token is that token."""
        out: list[bytes | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            own = self.ids.get(piece)
            if own is not None:
                out[i] = own.to_bytes(4, "little")
            elif piece:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
            else:
                out[i] = b""
        for size, members in classes.items():
            step = max(1, NODES // (2 * size))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], size)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Merge pieces of at most ``size`` bytes side by side, each in a segment tree of its own.

        A leaf holds rank * size + position of the pair that begins at a live position, so the
        root is the leftmost minimum rank. A merge changes three leaves: the merged pair, its
        right part (which dies) and the pair before it; each climbs to the root.
        """
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(size) < sizes[:, None]
        token = np.zeros((n, size + 1), np.int64)
        token[:, :size][inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        next_at = np.arange(1, size + 2)
        after = np.where(next_at < sizes[:, None], next_at, size)  # ``size`` is the end
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        tree = np.full((n, 2 * size), NONE)
        pairs = np.arange(size) + 1 < sizes[:, None]
        left, right = token[:, :size][pairs], token[:, 1:][pairs]
        rank = self.rank(left, right)
        leaves = np.full((n, size), NONE)
        leaves[pairs] = np.where(rank == NONE, NONE, rank * size + np.broadcast_to(np.arange(size), (n, size))[pairs])
        tree[:, size:] = leaves
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = inside.copy()
        tree, token, after, before, live = tree.ravel(), token.ravel(), after.ravel(), before.ravel(), live.ravel()
        wide = size + 1

        def climb(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base, node = rows * (2 * size), at + size
            tree[base + node] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])

        rows = np.flatnonzero(tree[1 :: 2 * size] < NONE) if size > 1 else np.zeros(0, np.int64)
        while len(rows):
            if len(rows) <= FEW:
                for row in rows.tolist():
                    own = slice(row * wide, (row + 1) * wide), slice(row * size, (row + 1) * size)
                    token[own[0]], gone = self._finish(size, tree[row * 2 * size : (row + 1) * 2 * size], token[own[0]], after[own[0]], before[own[1]])
                    live[row * size + gone] = False
                break
            best = tree[rows * (2 * size) + 1]
            at, merged = best % size, best // size
            here = rows * wide + at
            gone = after[here]
            next_ = after[rows * wide + gone]
            token[here], after[here] = merged, next_
            live[rows * size + gone] = False
            some = np.flatnonzero(next_ < size)
            before[rows[some] * size + next_[some]] = at[some]
            climb(rows, gone, np.full(len(rows), NONE))
            value = np.full(len(rows), NONE)
            if len(some):
                r = self.rank(merged[some], token[rows[some] * wide + next_[some]])
                value[some] = np.where(r == NONE, NONE, r * size + at[some])
            climb(rows, at, value)
            prior = before[rows * size + at]
            some = np.flatnonzero(prior >= 0)
            if len(some):
                r = self.rank(token[rows[some] * wide + prior[some]], merged[some])
                climb(rows[some], prior[some], np.where(r == NONE, NONE, r * size + prior[some]))
            rows = rows[tree[rows * (2 * size) + 1] < NONE]
        live = live.reshape(n, size)
        ids = token.reshape(n, wide)[:, :size][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _finish(self, size: int, tree: np.ndarray, token: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rest of the merges of one match, one at a time in its tree: its tokens, and the positions that died.

        With few matches left a loop over plain arrays is faster than steps over all of them; a climb ends where a node keeps its value.
        """
        tree, token, after, before = (array("q", x.astype(np.int64).tobytes()) for x in (tree, token, after, before))
        gone = array("q")

        def put(at: int, value: int) -> None:
            node = at + size
            while tree[node] != value:
                tree[node] = value
                if node == 1:
                    return
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1

        while tree[1] < NONE_:
            merged, at = divmod(tree[1], size)
            dead = after[at]
            next_ = after[dead]
            token[at], after[at] = merged, next_
            gone.append(dead)
            put(dead, NONE_)
            rank = NONE_
            if next_ < size:
                before[next_] = at
                rank = self.rank_of(merged, token[next_])
            put(at, NONE_ if rank == NONE_ else rank * size + at)
            prior = before[at]
            if prior >= 0:
                rank = self.rank_of(token[prior], merged)
                put(prior, NONE_ if rank == NONE_ else rank * size + prior)
        return np.frombuffer(token, np.int64), np.frombuffer(gone, np.int64) if gone else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class RankPieces(Pieces):
    """Pieces merged by ranks."""

    def load(self, path: str) -> None:
        self.ranks = Ranks(path)

    def raw(self, strings: list[str]) -> list[bytes]:
        return self.ranks.merge([s.encode() for s in strings])


def _encoded(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) to (id, number of ids, ids)."""
    known = encoder(ByteLevel, ranks, RankPieces)
    for batch in pieces_of(batches, "t"):
        ids, at = known.encode([t or "" for t in batch.column(1).to_pylist()])
        blob = binary_array(at * 4, ids.astype("<u4").view(np.uint8)).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), blob], ["k", "n_tokens", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    """Batches (id, number of ids, ids) with the decoded bytes."""
    known = encoder(ByteLevel, ranks, RankPieces).pieces.ranks
    for batch in pieces_of(batches, "ids", 8 << 20):
        rows = [np.frombuffer(x or b"", "<u4") for x in batch.column(2).to_pylist()]
        ids = np.concatenate(rows) if rows else np.zeros(0, "<u4")
        ends = np.concatenate([[0], np.cumsum(known.sizes[ids])])
        at = ends[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
        data = np.frombuffer(known.decode(ids), np.uint8)
        yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(at, data).cast(pa.binary())], ["k", "n_tokens", "ids", "decoded"])


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))


def encode(docs: DataFrame, ranks: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, n_tokens and ids (little-endian 32-bit) of every whole text, by a rank file.

    The pattern's matches are encoded one by one: a match that is itself a token gives its id,
    any other merges its neighbours, lowest rank first and leftmost among equals. Matches met
    before are looked up in the worker, in a bounded table. Null text counts as empty and has no
    ids; null and repeated ids stay rows of their own. Other columns are not read.
    """
    out = _texts(docs, text, key).mapInArrow(lambda b: _encoded(b, ranks), "k bigint, n_tokens bigint, ids binary")
    return out.withColumnRenamed("k", key)


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id") -> DataFrame:
    """``encoded`` (id, n_tokens, ids) with the decoded bytes; null ids decode to nothing."""
    rows = encoded.select(F.col(key).alias("k"), "n_tokens", "ids")
    out = rows.mapInArrow(lambda b: _decoded(b, ranks), "k bigint, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("k", key)


def round_trip(docs: DataFrame, ranks: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``decode(encode(docs))`` in one pass of one worker."""
    rows = _texts(docs, text, key)
    out = rows.mapInArrow(lambda b: _decoded(_encoded(b, ranks), ranks), "k bigint, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("k", key)


@query("op2_rank_bpe")
def op2(spark, sf_dir):
    """Number and checksum of every document's ids, and the checksum of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
