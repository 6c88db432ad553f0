"""Rule tables, stored sketches, file-wise upserts and clustered compaction."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.operators import alerts, quality, rollups, rules
from sparkscope.operators.alerts import AlertRule
from sparkscope.operators.quality import ErrorPattern
from sparkscope.session import scratch, stage
from sparkscope.sources import snapshots


def test_needles():
    cases = {
        "timeout|deadline": ["timeout", "deadline"], "out.*of.*memory": ["memory"], "ab|timeout": [], "(?i)timeout": [], "time?out|x+yzab": ["tim", "yzab"],
        "a*bcde": ["bcde"], "^lost$": ["lost"], "[a-z]+lost": [], "née.": ["née"], "": [],
    }
    assert {p: rules.needles(p) for p in cases} == cases


def test_needles_of_short_classes():
    cases = {"[0-9]12": [f"{i}12" for i in range(10)], "abcdef|[x-z]9!": ["abcdef", "x9!", "y9!", "z9!"], "[0-9]5": [], "[^a]bcd": [], "[a|b]cd+": []}
    assert {p: rules.spelt_needles(p) for p in cases} == cases


def test_patterns_with_classes_meet_few_messages(spark, monkeypatch):
    """A pattern is only tried on messages that hold its needle, and no key is shared by all messages."""
    own = [ErrorPattern(f"n{i}", f"Head number {i} of|[0-9]{i}", "Validation", "Warning", 500) for i in range(100, 140)]
    own += [ErrorPattern("short", "[0-9]x", "Timeout", "Error", 700), ErrorPattern("long", "abcdefghijklmnopqrstuvw.*é", "Timeout", "Error", 900)]
    texts = ["Head number 117 of", "7104", "104", "Head number 117", "7x", "", None, "abcdefghijklmnopqrstuvw é", "abcdefghijklmnopqrstuv é"] + [f"text {i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, message string").repartition(3)
    monkeypatch.setattr(rules, "RUN", 64)
    made = {}
    monkeypatch.setattr(rules, "stage", lambda df, label: made.setdefault(label, stage(df, label)))
    want = df.select("id", "message", quality.classify_error(F.col("message"), own).alias("a")).select("id", "message", "a.*")
    got = rules.classify(df, rules.pattern_table(spark, own))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [r["rule"] for r in made["pattern-index"].filter("key IS NULL").collect()] == ["bshort"]


def test_patterns_from_a_table(spark):
    """The same answers as patterns in the plan, for many messages and odd patterns."""
    own = [
        ErrorPattern("disk", "disk.*full|no space", "Resource", "Critical", 200), ErrorPattern("off", "a", "Unknown", "Fatal", 900, enabled=False),
        ErrorPattern("shouted", "[A-Z]{3,}!!", "Validation", "Warning", 60), ErrorPattern("accent", "échec.*", "Permanent", "Fatal", 75),
        ErrorPattern("tie", "timeout|deadline", "Network", "Info", 100), ErrorPattern("empty", "x*", "Unknown", "Debug", 1),
    ]
    texts = [None, "", "timeout", "no space left", "WOW!! timeout", "un échec de plus", "disk is\nfull", "disk nearly full error", "nothing", "Connection refused", "é", "fatal x error"]
    rng = random.Random(2)
    texts += [" ".join(rng.choices(["timeout", "disk", "full", "error", "ABC!!", "é", "no", "space", "échec"], k=rng.randint(1, 8))) for _ in range(80)]
    df = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "id long, message string, matched_ string")
    for patterns, disabled in ((own, ()), (own[:1], ("network_timeout",)), ([], ())):
        want = df.select("id", "message", "matched_", quality.classify_error(F.col("message"), patterns, disabled).alias("a")).select("id", "message", "matched_", "a.*")
        got = rules.classify(df, rules.pattern_table(spark, patterns), disabled=disabled)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ten_thousand_patterns(spark):
    """The plan is as long as with ten."""
    many = lambda n: spark.range(n).select(
        F.format_string("p%05d", "id").alias("name"), F.format_string("code-%05d.*lost", "id").alias("pattern"), F.lit("Network").alias("error_type"),
        F.lit("Error").alias("severity"), F.lit(500).alias("priority"), F.lit(True).alias("enabled"),
    )
    df = spark.range(300).select("id", F.format_string("a code-%05d was lost", F.col("id") * 37).alias("message"))
    big, small = rules.classify(df, many(10_000)), rules.classify(df, many(10))
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(big) == size(small)
    got = {r["id"]: r["matched"] for r in big.collect()}
    assert got == {i: f"p{i * 37:05d}" if i * 37 < 10_000 else "" for i in range(300)}


def test_alert_rules_from_a_table(spark):
    rng = random.Random(4)
    ops = ["gt", "lt", "eq", "ne", "between", "outside"]
    own = [AlertRule(f"r{i}", rng.choice("ab"), rng.choice(ops), rng.randint(-3, 12), rng.choice([None, rng.randint(-3, 14)]), enabled=i % 9 > 0) for i in range(120)]
    values = [(m, float(v)) for m in "abc" for v in range(-4, 15)] + [("a", math.nan), ("b", None), ("a", math.inf), ("b", -math.inf), ("a", 2.5)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id long, metric string, value double")
    want = alerts.judge(df, own)
    table = rules.rule_table(spark, own)
    got = rules.judged(df, table)
    pick = lambda x: sorted(map(str, x.select(*want.columns).collect()))
    assert got.columns == want.columns and pick(got) == pick(want)
    assert pick(rules.hits(df, table)) == pick(want.filter("hit"))


def test_alert_rules_are_counted_without_their_rows(spark):
    rng = random.Random(6)
    odd = [math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-20, 0.5, math.nextafter(0.5, 1), math.nextafter(1, 0), 1.0, math.nextafter(1, 2), 3.0, math.nextafter(3, 4)]
    ops = ["gt", "lt", "eq", "ne", "between", "outside"]
    ends = lambda: rng.choice([*odd, *range(-3, 13)])
    own = [AlertRule(f"r{i}", rng.choice("abd"), rng.choice(ops), ends(), rng.choice([None, ends()]), enabled=i % 9 > 0) for i in range(200)]
    values = [(m, float(v)) for m in "abc" for v in [*range(-4, 15), *odd] for _ in range(1 + int(v == 3))] + [("b", None), (None, 1.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id long, metric string, value double").cache()
    table = rules.rule_table(spark, own)
    ends = lambda low, high: (F.min(low).alias("least"), F.max(high).alias("most"))
    want = alerts.judge(df, own).filter("hit").groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), *ends("value", "value"))
    got = rules.hits(df, table, totals=True).groupBy("rule_id").agg(F.sum("hits").alias("hits"), *ends("least", "most"))
    pick = lambda x: sorted((r["rule_id"], r["hits"], str(r["least"] + 0.0), str(r["most"] + 0.0)) for r in x.collect())
    assert pick(got) == pick(want)


def test_rollups_merge(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "hot" if i % 3 else "b", float(v), int(u)) for i, v, u in zip(range(30_000), rng.normal(size=30_000), rng.integers(0, 4000, 30_000))]
    df = spark.createDataFrame(rows, "s long, k string, v double, u long").withColumn("ts", F.timestamp_seconds(F.col("s") * 20))
    df = df.unionByName(df.limit(1).withColumns({"k": F.lit("none"), "v": F.lit(None).cast("double")}))
    fine = rollups.rollup(df, "ts", "1 hour", ["k"], "v", "u")
    path = scratch(spark, "rolled")
    fine.write.parquet(path)
    wide = rollups.widen(rollups.widen(spark.read.parquet(path), "1 day", ["k"]), "7 days", [])
    got = wide.select("n", "total", "low", "high", rollups.quantile(0.5).alias("p50"), rollups.quantile(0.9).alias("p90"), rollups.uniques().alias("u")).collect()
    assert len(got) == 1 and got[0]["n"] == 30_000
    v = np.sort([r[2] for r in rows])
    assert got[0]["total"] == pytest.approx(v.sum()) and (got[0]["low"], got[0]["high"]) == (v[0], v[-1])
    for name, p in (("p50", 0.5), ("p90", 0.9)):
        assert abs(np.searchsorted(v, got[0][name]) / len(v) - p) < 0.02
    assert abs(got[0]["u"] / len({r[3] for r in rows}) - 1) < 0.06
    empty = fine.filter("k = 'none'").select("n", rollups.quantile(0.5).alias("p")).collect()
    assert [(r["n"], r["p"]) for r in empty] == [(0, None)]


def test_upserts_rewrite_touched_files(spark):
    path = scratch(spark, "table")
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit("a").alias("part"), F.lit(1).cast("bigint").alias("version"), F.lit("old").alias("v"))
    snapshots.create(rows.repartitionByRange(20, "k"), path)
    before = {r["file"] for r in snapshots.files(spark, path).collect()}
    changes = [(5, "a", 2, "new"), (5, "a", 3, "newest"), (6, "a", 0, "stale"), (150, "a", 1, "tie"), (9000, "a", 1, "added"), (7, "b", 1, "other key"), (None, "a", 1, "null key")]
    df = spark.createDataFrame(changes, "k long, part string, version long, v string")
    rewritten, kept = snapshots.upsert(spark, path, df, ["k", "part"], "version")
    after = {r["file"] for r in snapshots.files(spark, path).collect()}
    assert (rewritten, kept) == (1, 19) and len(before & after) == 19
    got = {(r["k"], r["part"]): (r["version"], r["v"]) for r in snapshots.read(spark, path).collect()}
    want = {(i, "a"): (1, "old") for i in range(4000)} | {(5, "a"): (3, "newest"), (150, "a"): (1, "tie"), (9000, "a"): (1, "added"), (7, "b"): (1, "other key"), (None, "a"): (1, "null key")}
    assert got == want
    assert snapshots.read(spark, path, 0).count() == 4000
    # The null key is found again, and nothing changes without changes.
    assert snapshots.upsert(spark, path, spark.createDataFrame([(None, "a", 4, "again")], df.schema), ["k", "part"], "version")[0] == 1
    assert snapshots.read(spark, path).filter("k IS NULL").select("v").collect() == [("again",)]
    assert snapshots.upsert(spark, path, df.limit(0), ["k", "part"], "version")[0] == 0


def test_clustering_serves_both_columns(spark):
    path = scratch(spark, "curve")
    rows = spark.range(40_000).select("id", (F.xxhash64("id") % 1000).alias("x"), F.when(F.col("id") % 50 > 0, F.rand(3)).alias("y"))
    first = snapshots.create(rows.repartition(30), path)
    size = snapshots.files(spark, path).agg(F.sum("bytes")).first()[0]
    second = snapshots.cluster(spark, path, ["x", "y"], file_bytes=size // 30)
    assert snapshots.read(spark, path).exceptAll(rows).isEmpty() and snapshots.read(spark, path).count() == 40_000
    listed = snapshots.files(spark, path).collect()
    assert len(listed) >= 25 and max(f["bytes"] for f in listed) < 3 * size / 30

    def needed(version, wanted):
        held = snapshots.read(spark, path, version).select("*", F.col("_metadata.file_path").alias("file"))
        ends = held.groupBy("file").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
        return ends.filter(wanted).count()

    for wanted in ("a <= -900", "c <= 0.1", "a <= -700 AND c <= 0.2"):
        assert needed(second, wanted) < needed(first, wanted) * 0.7
