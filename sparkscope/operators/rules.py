"""Rules that come from tables: error patterns looked up by their literals, alert rules by their ranges.

The plan has the same size whatever the number of rules, and a row only meets rules that can match it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import intervals, ordered
from sparkscope.operators.alerts import EPSILON, AlertRule, holds
from sparkscope.operators.quality import ERROR_PATTERNS, ErrorPattern, by_keyword
from sparkscope.session import stage

PATTERN_COLUMNS = "name string, pattern string, error_type string, severity string, priority int, enabled boolean"
#: What ends a literal run of a pattern, and what makes its last letter optional.
_META = re.compile(r"\.|[*+?{}^$]")
_NESTED = re.compile(r"[()\[\]\\{}]")
#: What patterns with classes are not looked into for, and a class of plain letters, digits and spans of them.
_DEEP = re.compile(r"[()\\{}]")
_CLASS = re.compile(r"\[((?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9 _])+)\]")
#: Bytes of a key, and spellings of one needle at most.
LENGTHS, SPELLINGS = (3, 4, 6, 8, 12, 16), 64
#: Text bytes that a task looks through at once, about.
RUN = 4 << 20
_U = np.uint64


def needles(pattern: str) -> list[str]:
    """One literal of at least three bytes for each alternative, which every match of it holds; else none.

    Patterns with groups, classes or escapes are not looked into.
    """
    if _NESTED.search(pattern):
        return []
    out = []
    for alternative in pattern.split("|"):
        runs, at = [], 0
        for meta in [*_META.finditer(alternative), None]:
            end = meta.start() if meta else len(alternative)
            run = alternative[at:end]
            # A letter before * or ? may be missing.
            runs.append(run[:-1] if meta and meta.group() in "*?" else run)
            at = meta.end() if meta else end
        best = max(runs, key=lambda run: len(run.encode()))
        if len(best.encode()) < 3:
            return []
        out.append(best)
    return out


def _alternatives(pattern: str) -> list[list[tuple[str, ...] | None]] | None:
    """The alternatives of a pattern as lists of what a place must hold, one of some letters, or None for anything."""
    if _DEEP.search(pattern):
        return None
    out, at = [[]], 0
    while at < len(pattern):
        here = pattern[at]
        if here == "[":
            found = _CLASS.match(pattern, at)
            if not found:
                return None
            letters = re.findall(r"[A-Za-z0-9]-[A-Za-z0-9]|.", found[1])
            letters = {chr(c) for x in letters for c in range(ord(x[0]), ord(x[-1]) + 1)}
            out[-1].append(tuple(sorted(letters)) if len(letters) <= SPELLINGS else None)
            at = found.end()
            continue
        if here == "|":
            out.append([])
        elif here in "*?":  # the letter before may be missing
            out[-1][-1:] = [None]
        elif here in ".+^$":
            out[-1].append(None)
        else:
            out[-1].append((here,))
        at += 1
    return out


def spelt_needles(pattern: str) -> list[str]:
    """The needles of a pattern, a class of plain letters as all its spellings: one of them is in every match.

    Patterns with groups, other classes or escapes are not looked into. They have no needles and meet every message.
    """
    out = needles(pattern)
    if out:
        return out
    for places in _alternatives(pattern) or [[]]:
        best, spelt = 0, []
        for start in range(len(places)):
            size, words = 0, [""]
            for letters in places[start:]:
                if letters is None or len(words) * len(letters) > SPELLINGS:
                    break
                words = [w + x for w in words for x in letters]
                size = min(len(w.encode()) for w in words)
                # The longest, up to what a key can tell; then the one with the fewest spellings.
                told = min(size, LENGTHS[-1])
                if told >= LENGTHS[0] and (told, -len(words)) > (best, -len(spelt)):
                    best, spelt = told, words
                if told == LENGTHS[-1]:
                    break
        if not spelt:
            return []
        out += spelt
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _codes(data: np.ndarray, lengths: Sequence[int] = LENGTHS) -> Iterator[tuple[int, np.ndarray]]:
    """For each length that the bytes reach, a hash of that many bytes from each place on."""
    runs = {1: data.astype(_U)}
    for n in (2, 4, 8):
        if len(data) >= n:
            half = runs[n // 2]
            runs[n] = (half[: -(n // 2)] << _U(4 * n)) | half[n // 2 :]
    for length in lengths:
        if len(data) < length:
            return
        n = max(k for k in runs if k <= length)  # two such runs overlap or meet
        part = runs[n]
        yield length, _mix((part[: len(part) - length + n] + _U(length)) * _U(0x9E3779B97F4A7C15) ^ part[length - n :])


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, offsets and bytes of runs of about ``RUN`` bytes, or one longer text."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + RUN, "right")) - 1)
        yield start, stop, at[start : stop + 1] - at[start], data[at[start] : at[stop]]
        start = stop


def _keys(found: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """Key and length of each needle's first bytes, as many as a key can have."""
    out = set()
    for data in (x.encode() for x in found):
        length = max(n for n in LENGTHS if n <= len(data))
        out.add((int(next(_codes(np.frombuffer(data[:length], np.uint8), [length]))[1].view(np.int64)[0]), length))
    return sorted(out) or [(None, None)]


def pattern_table(spark, patterns: Sequence[ErrorPattern]) -> DataFrame:
    """Patterns as a table of :data:`PATTERN_COLUMNS`."""
    rows = [(p.name, p.pattern, p.error_type, p.severity, p.priority, p.enabled) for p in patterns]
    return spark.createDataFrame(rows, PATTERN_COLUMNS)


def _index(patterns: DataFrame) -> DataFrame:
    """The patterns with ``key`` and ``length``, one row for each key of theirs; both are null where there is none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, rule) for p, rule in zip(batch["pattern"], batch["rule"]) for key in _keys(spelt_needles(p))]
            key, length, rule = ([r[i] for r in rows] for i in range(3))  # as objects: a null must not make floats of keys
            yield pd.DataFrame({"key": pd.array(key, "Int64"), "length": pd.array(length, "Int32"), "rule": rule})

    held = patterns.select("pattern", "rule").mapInPandas(work, "key bigint, length int, rule string")
    return stage(held.join(patterns, "rule"), "pattern-index")


def classify(messages: DataFrame, patterns: DataFrame, message: str = "message", disabled: Sequence[str] = (), default: tuple[str, str] = ("Unknown", "Error")) -> DataFrame:
    """``messages`` with error_type, severity, method and matched, as ``quality.classify_error`` gives them.

    ``patterns`` has :data:`PATTERN_COLUMNS`, any number of rows. Among the enabled ones and the built-in ones
    (without the ``disabled`` names) that match a message, the highest priority plus match length in bytes wins; on a tie built-in
    ones in their order, then the smallest name. Then the first keyword counts, then ``default``.

    Patterns are indexed by 3 to 16 bytes that each match must hold. Tasks look up which of those occur in a message by a bit filter
    of at most 2 MB; candidates meet their pattern in a join and are verified there. Patterns without such bytes
    meet every message. Null messages get the default.
    """
    spark = messages.sparkSession
    own = patterns.filter(F.coalesce("enabled", F.lit(True)) & F.col("pattern").isNotNull()).select(
        F.concat(F.lit("b"), "name").alias("rule"), "name", "pattern", "error_type", "severity", F.coalesce("priority", F.lit(0)).alias("priority")
    )
    fixed = [(f"a{i:04d}", *p) for i, p in enumerate(ERROR_PATTERNS) if p[0] not in disabled]
    built_in = spark.createDataFrame(fixed, "rule string, name string, pattern string, error_type string, severity string, priority int")
    index = _index(own.unionByName(built_in))
    everywhere = index.filter("key IS NULL").drop("key", "length")
    keyed = index.filter("key IS NOT NULL")
    bits = min(24, max(10, (64 * keyed.count()).bit_length()))
    lengths = sorted(r["length"] for r in keyed.select("length").distinct().collect())
    two = F.array(F.shiftrightunsigned("key", 64 - bits).cast("int"), F.col("key").bitwiseAND((1 << bits) - 1).cast("int"))
    wanted = np.zeros(1 << bits, bool)
    for r in keyed.select(F.explode(two).alias("slot")).distinct().toLocalIterator():
        wanted[r["slot"]] = True
    sent = np.packbits(wanted)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(sent).astype(bool)
        for batch in batches:
            for start, stop, ends, data in _texts(batch.column(1)):
                rows, found = [], []
                for length, codes in _codes(data, lengths):
                    hit = np.flatnonzero(held[codes >> _U(64 - bits)])
                    hit = hit[held[codes[hit] & _U((1 << bits) - 1)]]
                    row = np.searchsorted(ends, hit, "right") - 1
                    inside = hit + length <= ends[row + 1]
                    rows.append(row[inside])
                    found.append(codes[hit[inside]].view(np.int64))
                if rows:
                    row, key = np.concatenate(rows), np.concatenate(found)
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                    names = batch.column(0).slice(start, stop - start).take(pa.array(row[new]))
                    yield pa.RecordBatch.from_arrays([names, pa.array(key[new])], ["_row", "key"])

    numbered = stage(messages.withColumn("_row", F.monotonically_increasing_id()), "messages")
    text = F.col(message)
    keys = numbered.select("_row", message).mapInArrow(keys_of, "_row bigint, key bigint")
    candidates = keys.join(keyed, "key").drop("key", "length").dropDuplicates(["_row", "rule"])
    met = candidates.join(numbered.select("_row", message), "_row")
    if not everywhere.isEmpty():
        met = met.unionByName(numbered.filter(text.isNotNull()).select("_row", message).crossJoin(everywhere))
    match = F.call_function("regexp_extract", text, F.col("pattern"), F.lit(0))
    held = met.withColumn("_match", match).filter((F.col("_match") != "") | F.regexp_like(text, F.col("pattern")))
    answer = F.struct("error_type", "severity", F.lit("pattern").alias("method"), F.col("name").alias("matched"))
    score = -(F.col("priority") + F.octet_length("_match"))
    best = held.groupBy("_row").agg(F.min(F.struct(score.alias("s"), "rule", answer.alias("answer"))).alias("_best"))
    judged = numbered.join(best, "_row", "left")
    found = F.coalesce(F.col("_best.answer"), by_keyword(text, default))
    return judged.withColumn("_answer", found).select(*messages.columns, "_answer.*")


# -- alert rules -------------------------------------------------------------------------

RULE_COLUMNS = "id string, metric string, op string, low double, high double, severity string, cooldown_seconds bigint, enabled boolean"


def rule_table(spark, rules: Sequence[AlertRule]) -> DataFrame:
    """Rules as a table of :data:`RULE_COLUMNS`."""
    rows = [(r.id, r.metric, r.op, float(r.low), None if r.high is None else float(r.high), r.severity, r.cooldown_seconds, r.enabled) for r in rules]
    return spark.createDataFrame(rows, RULE_COLUMNS)


def _enabled(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled").select(
        F.col("id").alias("rule_id"), F.col("metric").alias("rule_metric"), "op", "low", "high", "severity", "cooldown_seconds"
    )


def judged(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (metric, ..., value) with every enabled rule on their metric and whether it ``hit``, one row a rule.

    A metric that holds most rows is split by AQE's skew join.
    """
    met = metrics.join(_enabled(rules), F.col("metric") == F.col("rule_metric")).drop("rule_metric")
    return met.withColumn("hit", F.coalesce(holds(F.col("op"), F.col("value"), F.col("low"), F.col("high")), F.lit(False)))


def _range(low: Column | None, high: Column | None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct((none if low is None else low).alias("from"), (none if high is None else high).alias("to"))


def _equals(low: pd.Series) -> pd.DataFrame:
    """The first and last value that count as equal to each one; null for those without."""
    x, out = low.to_numpy(float), []
    with np.errstate(all="ignore"):
        for side in (-math.inf, math.inf):
            end = np.nextafter(np.nextafter(x + math.copysign(EPSILON, side), side), side)
            while (far := np.isfinite(x) & ~(np.abs(end - x) < EPSILON)).any():
                end = np.where(far, np.nextafter(end, x), end)
            out.append(pd.Series(end, dtype="Float64").mask(~np.isfinite(x)))
    return pd.DataFrame(dict(zip(("first", "last"), out)))


def _totals(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """For every enabled rule and range of values that hit it: how many hits, the least and the most value.

    Values and the ends of all ranges are sorted once; a range's hits are the difference of two positions there, so
    neither depends on how many rows a rule hits.
    """
    value = F.col("value").cast("double")
    values = metrics.filter("value IS NOT NULL AND metric IS NOT NULL").groupBy("metric", value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = stage(values, "values")
    every = values.groupBy("metric").agg(F.sum("n").alias("_all"), F.min("v").alias("_min"), F.max("v").alias("_max"))
    op, low, high = F.col("op"), F.col("low"), F.col("high")
    none = F.lit(None).cast("double")

    def span(low=none, low_in=False, high=none, high_in=False):
        return F.struct(low.alias("from"), F.lit(low_in).alias("from_in"), high.alias("to"), F.lit(high_in).alias("to_in"))

    same = F.col("_same")
    ranges = (
        F.when(op == "gt", F.array(span(low)))
        .when(op == "lt", F.array(span(high=low)))
        .when((op == "eq") & same["first"].isNotNull(), F.array(span(same["first"], True, same["last"], True)))
        .when((op == "between") & high.isNotNull(), F.array(span(low, True, high, True)))
        .when((op == "ne") & same["first"].isNull(), F.array(span()))
        .when(op == "ne", F.array(span(high=same["first"]), span(same["last"])))
        .when((op == "outside") & high.isNull(), F.array(span(high=low)))
        .when((op == "outside") & (low > high), F.array(span()))
        .when(op == "outside", F.array(span(high=low), span(high)))
    )
    equals = F.pandas_udf(_equals, "struct<first: double, last: double>")
    asked = _enabled(rules).filter(low.isNotNull()).withColumn("_same", equals("low"))
    asked = asked.select(F.col("rule_metric").alias("metric"), "rule_id", "op", "low", "high", "severity", "cooldown_seconds", F.explode(ranges).alias("_r"))
    asked = stage(asked, "ranges")
    ends = asked.select("metric", F.explode(F.array("_r.from", "_r.to")).alias("v")).filter("v IS NOT NULL").distinct()
    both = values.unionByName(ends.select("metric", "v", F.lit(0).cast("bigint").alias("n")))
    places = both.groupBy("metric", "v").agg(F.sum("n").alias("n")).withColumn("_d", (F.col("n") > 0).cast("bigint"))
    placed = ordered.cumulative(places, ["metric"], ["v"], "n", "_below", "_t").drop("_t")
    placed = stage(ordered.cumulative(placed, ["metric"], ["v"], "_d", "_i", "_t").drop("_t"), "places")
    # The values right before and after each place.
    found = placed.filter("_d = 1").select("metric", F.col("_i").alias("_at"), F.col("v").alias("_v"))
    before = found.select("metric", (F.col("_at") + 1).alias("_i"), F.col("_v").alias("_before"))
    after = found.select("metric", F.col("_at").alias("_next"), F.col("_v").alias("_after"))
    around = placed.withColumn("_next", F.col("_i") + F.col("_d")).join(before, ["metric", "_i"], "left").join(after, ["metric", "_next"], "left")
    own = F.when(F.col("_d") == 1, F.col("v"))
    around = around.select(
        "metric", "v", "_below", (F.col("_below") + F.col("n")).alias("_upto"),
        "_before", "_after", F.coalesce(own, "_before").alias("_at_most"), F.coalesce(own, "_after").alias("_at_least"),
    )
    around = stage(around, "around")
    side = lambda end: around.select("metric", F.col("v").alias(f"_{end}"), F.struct(*[c for c in around.columns if c[0] == "_"]).alias(f"_{end}_at"))
    met = asked.withColumns({"_from": F.col("_r.from"), "_to": F.col("_r.to")}).join(every, "metric")
    met = met.join(side("from"), ["metric", "_from"], "left").join(side("to"), ["metric", "_to"], "left")
    start, stop, r = F.col("_from_at"), F.col("_to_at"), F.col("_r")
    skipped = F.when(r["from"].isNull(), 0).when(r["from_in"], start["_below"]).otherwise(start["_upto"])
    reached = F.when(r["to"].isNull(), F.col("_all")).when(r["to_in"], stop["_upto"]).otherwise(stop["_below"])
    least = F.when(r["from"].isNull(), F.col("_min")).when(r["from_in"], start["_at_least"]).otherwise(start["_after"])
    most = F.when(r["to"].isNull(), F.col("_max")).when(r["to_in"], stop["_at_most"]).otherwise(stop["_before"])
    out = met.select("rule_id", "metric", "op", "low", "high", "severity", "cooldown_seconds", (reached - skipped).alias("hits"), least.alias("least"), most.alias("most"))
    return out.filter("hits > 0")


def hits(metrics: DataFrame, rules: DataFrame, totals: bool = False) -> DataFrame:
    """The rows of :func:`judged` that hit, without going through the rules that do not.

    A rule becomes the ranges of values that can hit it, and values meet the ranges of their metric in an interval join.
    With ``totals`` the rows are counted, not made: per rule and range ``hits``, ``least`` and ``most``.
    """
    if totals:
        return _totals(metrics, rules)
    op, low, high = F.col("op"), F.col("low"), F.col("high")
    ranges = (
        F.when(op == "gt", F.array(_range(low, None)))
        .when(op == "lt", F.array(_range(None, low)))
        .when(op == "eq", F.array(_range(low - EPSILON, low + EPSILON)))
        .when(op == "between", F.array(_range(low, high)))
        .when(op == "ne", F.array(_range(None, low), _range(low, None)))
        .when((op == "outside") & (low > high), F.array(_range(None, None)))
        .when((op == "outside") & high.isNull(), F.array(_range(None, low)))
        .when(op == "outside", F.array(_range(None, low), _range(high, None)))
    )
    # Ranges without a bound they need can't be hit; ``from`` and ``to`` without a value mean no bound.
    able = low.isNotNull() & (high.isNotNull() | (op != "between"))
    spans = _enabled(rules).filter(able).withColumn("_r", F.explode(ranges)).select("*", F.col("_r.from").alias("_from"), F.col("_r.to").alias("_to")).drop("_r")
    near = intervals.join(
        metrics, spans.withColumnRenamed("rule_metric", "_metric").withColumn("metric", F.col("_metric")).drop("_metric"), "value", "_from", "_to", "both", on=["metric"]
    ).drop("_from", "_to")
    sure = F.coalesce(holds(op, F.col("value"), low, high), F.lit(False))
    found = near.filter(sure).withColumn("hit", F.lit(True))
    # NaN lies in no range but is above every threshold.
    odd = judged(metrics.filter(F.isnan("value")), rules).filter("hit")
    return found.unionByName(odd)
