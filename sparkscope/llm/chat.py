"""Chat formatting: columnar byte assembly of conversations, with a loss mask, and the way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import offsets_of, table

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>"
#: Every control string begins with "<|"; inside roles and texts such a pair gets one more
#: backslash between its two characters, so that none is left, and loses it on the way back.
ESCAPE, ESCAPED = r"<(\\*)\|", r"<\1\\|"
_UNESCAPE = re.compile(r"<\\(\\*)\|")
#: Bytes of roles, texts and marks in a segment, at most, or one longer turn.
SEGMENT = 4 << 20
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Buffer, np.ndarray]:
    """All turns one after the other in one buffer.

    Each turn is five segments: mark, role, mark, text, mark. Segment lengths give cumulative
    offsets, and one scatter index copies marks and contents from their buffers. Returns the
    offsets of the turns (one more than turns), the buffer and the offsets of the texts in it.
    """
    n = len(roles)
    (role_at, role_data), (text_at, text_data) = offsets_of(roles), offsets_of(texts)
    marks = np.frombuffer(TURN + TEXT + END, np.uint8)
    source = np.concatenate([marks, role_data[role_at[0] : role_at[-1]], text_data[text_at[0] : text_at[-1]]])
    roles_from = len(marks) - role_at[0]
    texts_from = len(marks) + role_at[-1] - role_at[0] - text_at[0]
    starts, sizes = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, (at, size) in enumerate(
        [
            (0, len(TURN)),
            (role_at[:-1] + roles_from, np.diff(role_at)),
            (len(TURN), len(TEXT)),
            (text_at[:-1] + texts_from, np.diff(text_at)),
            (len(TURN) + len(TEXT), len(END)),
        ]
    ):
        starts[:, k], sizes[:, k] = at, size
    ends = np.cumsum(sizes.ravel())
    total = int(ends[-1]) if n else 0
    begins = (ends - sizes.ravel()).reshape(n, 5)
    index = np.repeat((starts - begins).ravel(), sizes.ravel())
    index += np.arange(total)
    buffer = pa.allocate_buffer(total)
    np.take(source, index, out=np.frombuffer(buffer, np.uint8), mode="clip")
    return np.concatenate([begins[:, 0], [total]]), buffer, begins[:, 3]


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Runs of whole conversations from rows sorted by conversation."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        if held:
            last = held[-1].column(0)[-1]
            # The place where the conversation that is open ends in this batch.
            same = conv.is_null() if not last.is_valid else pc.equal(conv, last).fill_null(False)
            other = pc.index(same, False).as_py()
            end = batch.num_rows if other < 0 else other
            held.append(batch.slice(0, end))
            if end == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            batch, held = batch.slice(end), []
            conv = batch.column(0)
        last = conv[-1]
        same = conv.is_null() if not last.is_valid else pc.equal(conv, last).fill_null(False)
        start = pc.index(same, True).as_py()
        rest = batch.slice(0, start)
        step = max(1, rest.num_rows * limit // max(rest.nbytes, 1))
        at = 0
        while at < rest.num_rows:
            end = min(at + step, rest.num_rows)
            own = rest.column(0)
            while end < rest.num_rows and own[end] == own[end - 1] or end < rest.num_rows and not own[end].is_valid and not own[end - 1].is_valid:
                end += 1
            yield pa.Table.from_batches([rest.slice(at, end - at)])
            at = end
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Runs of rows of at most ``limit`` bytes, or one longer row."""
    for batch in batches:
        size = sum(np.diff(offsets_of(batch.column(i))[0]) for i in (1, 2)) + len(TURN + TEXT + END)
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > limit:
                yield pa.Table.from_batches([batch.slice(start, i - start)])
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield pa.Table.from_batches([batch.slice(start)])


def _formatted(found: pa.Table) -> list[pa.Array]:
    """id, formatted and loss of each conversation in rows sorted by conversation."""
    found = found.combine_chunks()
    ids = found.column(0).combine_chunks() if found.num_rows else pa.array([], pa.int64())
    columns = [pc.replace_substring_regex(found.column(i).combine_chunks().cast(pa.large_string()).fill_null(""), ESCAPE, ESCAPED) for i in (1, 2)]
    at, buffer, texts = assemble(*columns)
    code = ids.fill_null(0).to_numpy(zero_copy_only=False)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (known[1:] != known[:-1])
    first = np.flatnonzero(new)
    where = np.concatenate([at[first], at[-1:]])
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(where), buffer])
    mine = np.flatnonzero(pc.equal(found.column(1).combine_chunks(), "assistant").fill_null(False).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(first, mine, "right") - 1
    begin = texts[mine] - where[owner]
    size = np.diff(offsets_of(columns[1])[0])[mine]
    spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(begin + size)], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first) + 1)), pa.int32()), spans)
    return [ids.take(pa.array(first)), formatted.cast(pa.string()), loss]


def _parts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(F.col(conv).cast("bigint").alias("c"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"), F.col(turn).alias("n"))


def _order() -> list:
    return [F.col(x).asc_nulls_first() for x in ("c", "n", "r", "t")]


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss`` (array of start and end).

    ``formatted`` holds all turns as ``<|turn|>role<|text|>text<|end|>``; ``loss`` gives the byte
    ranges (in UTF-8) of the assistants' texts. Rows meet by a shuffle on the conversation, are
    sorted by the task (which may spill) and pass through it as a stream, so that it holds one
    conversation at a time, or about 8 MB of short ones. A conversation is one value, like a text,
    and cannot pass 2 GB; :func:`format_segments` has no such limit.

    Turns come in ascending order, nulls first; equal turns by role, then text, and repeated rows
    all stay. Null roles and texts are empty; rows with a null conversation id form one
    conversation. An empty table gives an empty result. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _groups(batches):
            yield pa.RecordBatch.from_arrays(_formatted(found), ["c", "formatted", "loss"])

    ordered = _parts(rows, conv, turn, role, text).repartition("c").sortWithinPartitions(*_order()).drop("n")
    out = ordered.mapInArrow(work, "c bigint, formatted string, loss array<struct<start: bigint, end: bigint>>")
    return out.withColumnRenamed("c", conv)


def format_segments(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limit: int = SEGMENT
) -> DataFrame:
    """Conversations as :func:`format_chats` has them, in segments of whole turns: id, ``segment``, ``formatted``, ``loss``.

    The segments of a conversation in ascending order, one after the other, are its formatted
    text; ``loss`` counts from the begin of the segment. Turns are placed by a range shuffle on
    (conversation, turn, role, text), so a long conversation spreads over tasks, and a task
    holds about ``limit`` bytes at a time. Segment numbers are unique, not dense.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for n, found in enumerate(_pieces(batches, limit)):
            ids, *more = _formatted(found)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), base + n, np.int64)), *more], ["c", "segment", "formatted", "loss"])

    ordered = _parts(rows, conv, turn, role, text).repartitionByRange(*_order()).sortWithinPartitions(*_order()).drop("n")
    out = ordered.mapInArrow(work, "c bigint, segment bigint, formatted string, loss array<struct<start: bigint, end: bigint>>")
    return out.withColumnRenamed("c", conv)


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The turns (array of role and text) and the texts under the loss mask, from formatted conversations or segments alone."""
    number = ["segment"] if "segment" in formatted.columns else []

    def plain(text: str) -> str:
        return _UNESCAPE.sub(r"<\1|", text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses = [], []
            for text, spans in zip(batch.column(len(number) + 1).to_pylist(), batch.column(len(number) + 2).to_pylist()):
                turns.append([{"role": plain(r), "text": plain(t)} for r, t in _TURNS.findall(text)])
                data = text.encode()
                losses.append([plain(data[s["start"] : s["end"]].decode()) for s in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(number) + 2], pa.array(turns, turn_type), pa.array(losses, pa.list_(pa.string()))], ["c", *number, "formatted", "turns", "loss"])

    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    out = formatted.select(F.col(conv).alias("c"), *number, "formatted", "loss").mapInArrow(
        work, f"c bigint, {'segment bigint, ' if number else ''}formatted string, turns array<struct<role: string, text: string>>, loss array<string>"
    )
    return out.withColumnRenamed("c", conv)


def digests(segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation the number of its turns and the lengths and checksums of what :func:`read_chats` reads from its segments.

    Segments meet in order and pass through one task per conversation as a stream.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        made, held = [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made)) or [[]] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        def close() -> None:
            made.append((held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]))

        for batch in batches:
            for i in range(batch.num_rows):
                c, n, said, loss, chars = (batch.column(k)[i].as_py() for k in range(5))
                if held is None or c != held[0]:
                    if held is not None:
                        close()
                    held = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[1] += n
                held[2].update(said.encode())
                held[3] += len(loss)
                held[4].update(loss.encode())
                held[5] += chars
            yield flush()
        if held is not None:
            close()
            yield flush()

    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    fields = [F.size("turns").cast("bigint").alias("n"), F.array_join(lines, "").alias("said"), F.array_join("loss", "").alias("own"), F.length("formatted").cast("bigint").alias("chars")]
    parts = read_chats(segments, conv).select(F.col(conv).alias("c"), "segment", *fields)
    ordered = parts.repartition("c").sortWithinPartitions(F.col("c").asc_nulls_first(), "segment").drop("segment")
    schema = "c bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(work, schema).withColumnRenamed("c", conv)


@query(
    "op5_chat_format",
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
         g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                      sum(23 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
               FROM c GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """,
)
def op5(spark, sf_dir):
    """Checksums of every conversation's turns and of its loss text, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digests(format_segments(rows.unionByName(more)))
