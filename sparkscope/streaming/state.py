"""Keyed state on streams: a get / set / delete / exists store, count windows and alert states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def store(commands: DataFrame) -> DataFrame:
    """Run commands ``(key, seq, op, value)`` against a store and return ``(key, seq, op, found, value)``.

    ``op`` is set, get, delete or exists. Within a micro-batch a key's commands run in
    the order of ``seq``.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, value = state.get if state.exists else (False, 0.0)
        rows = pd.concat(list(chunks)).sort_values("seq")
        out = []
        for seq, op, new in zip(rows["seq"], rows["op"], rows["value"]):
            before, old = held, value
            if op == "set":
                held, value = True, float(new)
            elif op == "delete":
                held, value = False, 0.0
            shown = value if op == "set" else old
            out.append((key[0], seq, op, before, shown if (before or op == "set") else None))
        state.update((held, value))
        yield pd.DataFrame(out, columns=["key", "seq", "op", "found", "value"])

    return commands.groupBy("key").applyInPandasWithState(
        run,
        "key string, seq bigint, op string, found boolean, value double",
        "held boolean, value double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def _ordered(chunks: Iterator[pd.DataFrame], by: list[str], columns: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order, narrowed to ``columns`` as they come; ordered chunks are not sorted again."""
    rows = pd.concat([c[columns] for c in chunks])
    keys = rows[by]
    return rows if len(by) == 1 and keys[by[0]].is_monotonic_increasing else rows.sort_values(by, kind="stable")


def _wait(state: GroupState, newest: pd.Timestamp, idle_seconds: int) -> None:
    """Let a key's state expire when the watermark passes its newest row by ``idle_seconds``."""
    due = int(newest.value // 1_000_000) + idle_seconds * 1000
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def _expiring(df: DataFrame, idle_seconds: int | None, lateness: str) -> tuple[DataFrame, str]:
    """``df`` and its kind of timeout; expiry follows event time, so it needs a column ``ts`` and a watermark."""
    if idle_seconds is None:
        return df, GroupStateTimeout.NoTimeout
    return df.withWatermark("ts", lateness), GroupStateTimeout.EventTimeTimeout


def count_windows(df: DataFrame, size: int, idle_seconds: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Close a window of a key after every ``size`` rows of ``(key, seq, value)``: its number, sum and mean.

    A key's rows of one micro-batch are sorted and cut as arrays; only the open window is state. With
    ``idle_seconds``, which needs a column ``ts``, a key leaves the state when the watermark (``lateness`` behind the newest row) is that far past its
    newest row; its open window, if it has rows, is closed as it is. Rows of a key that comes back start from window 0.
    """
    schema = "key string, window_no bigint, rows bigint, total double, mean double"
    columns = ["seq", "value", *(["ts"] if idle_seconds is not None else [])]

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, count, total = state.get if state.exists else (0, 0, 0.0)
        if state.hasTimedOut:
            state.remove()
            left = [(key[0], number, count, total, total / count)] if count else []
            yield pd.DataFrame(left, columns=["key", "window_no", "rows", "total", "mean"])
            return
        held = _ordered(chunks, ["seq"], columns)
        rows = held["value"].to_numpy(dtype=float)
        window = (count + np.arange(len(rows))) // size
        sums = np.bincount(window, weights=rows)
        sums[0] += total
        closed = (count + len(rows)) // size
        left = (count + len(rows)) % size
        state.update((number + closed, left, float(sums[closed]) if left else 0.0))
        if idle_seconds is not None:
            _wait(state, held["ts"].max(), idle_seconds)
        sums = sums[:closed]
        yield pd.DataFrame({"key": key[0], "window_no": number + np.arange(closed), "rows": size, "total": sums, "mean": sums / size})

    rows, timeout = _expiring(df, idle_seconds, lateness)
    return rows.groupBy("key").applyInPandasWithState(run, schema, "number bigint, count bigint, total double", "append", timeout)


def alert_changes(df: DataFrame, idle_seconds: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Rows ``(key, ts, seq, hit, cooldown_seconds)`` as changes of an alert, with ``in_cooldown``.

    An alert is active at its first hit and resolved at the first miss after. ``in_cooldown``
    marks one that starts within the cooldown after the previous one of its key was resolved.
    State is whether the alert is active and when the last one ended. With ``idle_seconds`` a key without rows for that
    long (by the watermark) leaves the state; an alert that is still active then is resolved at the time it expired.
    Choose it longer than any cooldown.
    """
    columns = ["ts", "seq", "hit", "cooldown_seconds"]

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, ended, last = state.get if state.exists else (False, None, 0)
        if state.hasTimedOut:
            state.remove()
            gone = [(key[0], pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), last, "Resolved", False)] if active else []
            yield pd.DataFrame(gone, columns=["key", "ts", "seq", "status", "in_cooldown"])
            return
        rows = _ordered(chunks, ["ts", "seq"], columns)
        hit = rows["hit"].to_numpy(dtype=bool)
        changed = rows[hit != np.concatenate([[active], hit[:-1]])]
        starts = changed["hit"].to_numpy(dtype=bool)
        ends = changed["ts"].where(~starts)
        before = ends.shift(1)
        if len(changed) and ended is not None and starts[0]:
            before.iloc[0] = pd.Timestamp(ended, unit="us")
        gap = (changed["ts"] - before).dt.total_seconds()
        if not ends.dropna().empty:
            ended = int(ends.dropna().iloc[-1].value // 1000)
        state.update((bool(hit[-1]), ended, int(rows["seq"].iloc[-1])))
        if idle_seconds is not None:
            _wait(state, rows["ts"].max(), idle_seconds)
        yield pd.DataFrame(
            {
                "key": key[0],
                "ts": changed["ts"],
                "seq": changed["seq"],
                "status": np.where(starts, "Active", "Resolved"),
                "in_cooldown": starts & (gap < changed["cooldown_seconds"]).to_numpy(),
            }
        )

    rows, timeout = _expiring(df, idle_seconds, lateness)
    return rows.groupBy("key").applyInPandasWithState(
        run, "key string, ts timestamp, seq bigint, status string, in_cooldown boolean", "active boolean, ended bigint, last bigint", "append", timeout
    )
