"""Sources, layouts, rules and schemas on small hand-made inputs that the tables lack."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from sparkscope.operators import aggregates as ag, dlq, enrich, filters, flatten, quality, schemas, search, tenancy
from sparkscope.operators import transforms as tr
from sparkscope.operators.alerts import AlertRule, judge
from sparkscope.operators.filters import Rule
from sparkscope.session import scratch, small_side
from sparkscope.sources import files, kafka, otlp, sinks

CLOCK = "2024-06-01T12:00:00Z"


def clock():
    return F.lit(CLOCK).cast("timestamp")


def lines(spark, label, *texts):
    path = scratch(spark, label)
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(path)
    return path


@pytest.fixture(scope="module")
def mixed(spark):
    """One record of each metric kind, plus odd logs and events."""
    base = {"timestamp": "2024-06-01T11:00:00Z", "attributes": {"a": "1"}, "tags": {"a": "2", "b": "3"}}
    value = lambda kind, v: {"name": f"m_{kind}", "metric_type": kind, "value": {kind: v}, "labels": {"zone": "z"}}
    data = [
        {"Metric": value("Counter", 4.0)},
        {"Metric": value("Gauge", 2.5)},
        {"Metric": value("Histogram", {"buckets": [{"upper_bound": 1.0, "count": 3}], "sum": 9.5, "count": 3})},
        {"Metric": value("Summary", {"quantiles": [{"quantile": 0.5, "value": 2.0}], "sum": 7.0, "count": 2})},
        {"Log": {"level": "Error", "message": "naïve \u0007 \"quoted\" ünïcode\n", "severity_number": 30}},
        {"Event": {"name": " ", "timestamp": "2024-06-02T00:00:00Z", "attributes": {}}},
        {"Trace": {"trace_id": "t", "span_id": "s", "name": "x", "duration_ns": 5_000_000, "status": {"code": "Error"}}},
    ]
    records = [
        {**base, "id": f"r{i}", "record_type": next(iter(d)), "data": d} for i, d in enumerate(data)
    ]
    path = lines(spark, "batch", json.dumps({"id": "b1", "source": "s", "records": records}))
    return files.json_batches(spark, path, clock())


def test_json_batch_reads_every_metric_kind(mixed):
    got = {r["id"]: r for r in flatten.wide(mixed).collect()}
    assert [got[f"r{i}"]["metric_value"] for i in range(4)] == [4.0, 2.5, 9.5, 7.0]
    assert got["r4"]["log_level"] == "Error" and "ünïcode" in got["r4"]["log_message"]
    assert json.loads(got["r0"]["attributes"]) == {"a": "1"}


def test_wide_round_trip_keeps_text_and_numbers(mixed):
    wide = flatten.wide(mixed)
    again = flatten.wide(flatten.from_wide(wide))
    cols = [c for c in wide.columns if c not in ("attributes", "tags")]
    assert sorted(map(str, wide.select(cols).collect())) == sorted(map(str, again.select(cols).collect()))


def test_json_batch_array_and_defaults(spark):
    docs = [{"id": "x", "source": "s", "records": [{"id": "1"}, {"id": "2", "record_type": "Log"}]}] * 2
    got = files.json_batches(spark, lines(spark, "array", json.dumps(docs)), clock()).collect()
    assert len(got) == 4
    assert {r["record_type"] for r in got} == {"Metric", "Log"}
    assert {r["timestamp"].isoformat() for r in got} == {"2024-06-01T12:00:00"}


def test_json_lines_keep_what_is_broken_apart(spark):
    path = lines(spark, "jsonl", '{"name": "a", "value": 1.5}', "{oops", '{"type": "log", "message": "m"}', "")
    good, bad = files.json_lines(spark, path, clock())
    assert sorted(r["record_type"] for r in good.collect()) == ["Log", "Metric"]
    assert [r["line"] for r in bad.collect()] == ["{oops"]


def test_csv_lines(spark):
    path = lines(spark, "csv", "timestamp,name,value", "2024-05-01T00:00:00Z, cpu , 3.5", "bad,mem,x,more", "a,b")
    good, bad = files.csv_lines(spark, path, clock())
    got = {r["metric"]["name"]: r for r in good.collect()}
    assert got["cpu"]["metric"]["value"] == 3.5
    assert got["mem"]["metric"]["value"] == 0.0 and got["mem"]["timestamp"].isoformat() == "2024-06-01T12:00:00"
    assert [r["line"] for r in bad.collect()] == ["a,b"]


def test_kafka_payloads(spark):
    texts = ['{"value": 3}', "nope", '["a"]', '{"records": [{"id": "q", "record_type": "Log", "data": {"Log": {"message": "m"}}}]}']
    rows = [(None, bytearray(t.encode()), "topic", 0, i, None) for i, t in enumerate(texts)]
    good, bad = kafka.json_records(spark.createDataFrame(rows, kafka.MESSAGE), clock())
    got = {r["id"]: r for r in good.collect()}
    assert got["topic-0-0"]["metric"]["name"] == "unknown_metric" and got["topic-0-0"]["metric"]["value"] == 3.0
    assert got["q"]["log"]["message"] == "m"
    assert sorted(r["offset"] for r in bad.collect()) == [1, 2]


def test_otlp_points_without_value_or_time(spark):
    points = [{"asInt": "7"}, {"timeUnixNano": "1700000000123456789", "asDouble": 1.5}, {"timeUnixNano": "5"}]
    doc = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": points}}]}]}]}
    path = lines(spark, "otlp", json.dumps(doc))
    got = sorted(otlp.metrics(otlp.read_documents(spark, path, otlp.METRICS), clock()).collect(), key=lambda r: r["metric"]["value"])
    assert [r["metric"]["value"] for r in got] == [1.5, 7.0]
    assert got[0]["timestamp"].isoformat() == "2023-11-14T22:13:20.123456"
    assert got[1]["timestamp"].isoformat() == "2024-06-01T12:00:00"


def test_severity_bands(spark):
    got = spark.range(26).select("id", otlp.level(F.col("id")).alias("level")).collect()
    names = ["Info"] + [n for n in ("Trace", "Debug", "Info", "Warn", "Error", "Fatal") for _ in range(4)] + ["Info"]
    assert [r["level"] for r in got] == names


def test_field_lookup_prefers_attributes(mixed):
    row = mixed.filter("id = 'r0'").select(
        filters.resolve("a").alias("a"),
        filters.resolve("b").alias("b"),
        filters.resolve("zone").alias("zone"),
        filters.resolve("metric.unit").alias("unit"),
        filters.resolve("none").alias("none"),
    ).first()
    assert tuple(row) == ("1", "3", "z", "", None)


def test_a_missing_field_matches_nothing_but_not_exists(mixed):
    keep = lambda *rules: mixed.transform(filters.match, list(rules)).count()
    assert keep(Rule("none", "ne", "x")) == 0
    assert keep(Rule("none", "not_in", "x")) == 0
    assert keep(Rule("none", "not_exists")) == 7
    assert keep() == 0
    assert filters.match(mixed, [], invert=True).count() == 7
    with pytest.raises(ValueError):
        filters.predicate(Rule("a", "like", "x"))


def test_tags_targets_are_honoured(mixed):
    out = tr.set_field(tr.rename(mixed, "tags.b", "tags.c"), "tags.d", F.lit("9")).filter("id = 'r0'").first()
    assert out["tags"] == {"a": "2", "c": "3", "d": "9"} and out["attributes"] == {"a": "1"}


def test_put_all_keeps_other_keys_and_skips_nulls(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>")
    got = df.select(tr.put_all(F.col("m"), {"b": F.lit("9"), "a": F.lit(None).cast("string"), "c": F.lit("3")}).alias("m"))
    assert got.first()["m"] == {"a": "1", "b": "9", "c": "3"}


@pytest.mark.parametrize(
    "url, domain, path",
    [
        ("http://h.example/a/b?q=1", "h.example", "/a/b?q=1"),
        ("https://h:8080", "h:8080", "/"),
        ("ftp://h/a", "ftp://h/a", "ftp://h/a"),
    ],
)
def test_urls(spark, url, domain, path):
    row = spark.range(1).select(tr.url_domain(F.lit(url)).alias("d"), tr.url_path(F.lit(url)).alias("p")).first()
    assert tuple(row) == (domain, path)


def test_rfc3339_shows_the_digits_it_needs(spark):
    texts = ["2024-01-01T00:00:01Z", "2024-01-01T00:00:01.250Z", "2024-01-01T00:00:01.000250Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tr.rfc3339(F.col("t").cast("timestamp"))).collect()]
    assert got == ["2024-01-01T00:00:01+00:00", "2024-01-01T00:00:01.250+00:00", "2024-01-01T00:00:01.000250+00:00"]


@pytest.mark.parametrize(
    "message, kind, severity",
    [
        ("connection was refused", "Timeout", "Warning"),
        ("Authentication failed: invalid token", "Authentication", "Error"),
        ("out of memory then fatal error", "Permanent", "Fatal"),
        ("CONFIG broken", "Configuration", "Error"),
        ("just a warning", "Temporary", "Warning"),
        ("hello", "Unknown", "Error"),
    ],
)
def test_error_classes(spark, message, kind, severity):
    row = spark.range(1).select(quality.classify_error(F.lit(message)).alias("a")).first()["a"]
    assert (row["error_type"], row["severity"]) == (kind, severity)


def test_sanitize(mixed, spark):
    good, bad = quality.sanitize(mixed, clock())
    log = good.filter("id = 'r4'").first()["log"]
    assert log["message"] == 'naïve  "quoted" ünïcode' and log["severity_number"] == 9
    assert [r["id"] for r in bad.collect()] == ["r5"]


def test_gate_reports_the_first_reason(mixed):
    late = F.lit("2024-08-01").cast("timestamp")
    _, bad = quality.gate(mixed, late)
    assert {r["reject_reason"] for r in bad.collect()} == {quality.TOO_OLD}


def test_dead_letters_retention_drops_the_oldest(spark):
    rows = [(str(i), f"2024-01-{i:02d}", "s") for i in range(1, 11)]
    df = spark.createDataFrame(rows, "id string, t string, source string").select("id", F.col("t").cast("timestamp").alias("timestamp"), "source")
    letters = dlq.letters(df, F.lit("op"), F.lit("timeout"))
    path = scratch(spark, "letters")
    dlq.write(letters, path)
    assert spark.read.parquet(path).count() == 10
    assert sorted(r["id"] for r in dlq.retained(letters, 4).collect()) == ["10", "7", "8", "9"]


def test_schema_evolution(spark):
    old = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    new = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
    assert schemas.conflicts(old, new) == []
    narrower = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType(), False)])
    assert len(schemas.conflicts(old, narrower)) == 2
    df = spark.createDataFrame([(1, "x")], old)
    assert schemas.evolve(df, new).first().asDict() == {"a": 1, "b": "x", "c": None}
    with pytest.raises(ValueError, match="a: int to string"):
        schemas.evolve(df, narrower)


def test_upsert_lets_a_change_win_a_tie(spark):
    current = spark.createDataFrame([("k", 1, "old"), ("m", 5, "keep")], "id string, v int, x string")
    changes = spark.createDataFrame([("k", 1, "new"), ("m", 4, "stale")], "id string, v int, x string")
    got = {r["id"]: r["x"] for r in sinks.upsert_latest(current, changes, ["id"], "v").collect()}
    assert got == {"k": "new", "m": "keep"}


def test_percentile_ranks_stay_inside(spark):
    df = spark.range(4).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    assert ag.percentiles(df, ["k"], "v", (100,)).first()["p100"] == 3.0
    assert ag.percentiles(df, ["k"], "v", (50,), ag.round_rank).first()["p50"] == 2.0


def test_summary_of_a_constant_and_of_few_values(spark):
    df = spark.createDataFrame([("c", 2.0)] * 5 + [("f", 1.0), ("f", 3.0)], "k string, v double")
    got = {r["k"]: r for r in ag.summary(df, ["k"], "v", "population", "avg4").collect()}
    assert got["c"]["std_dev"] == 0.0 and got["c"]["q1"] == 2.0
    assert (got["f"]["q1"], got["f"]["median"], got["f"]["q3"]) == (1.0, 2.0, 3.0)


def test_rules_without_any_enabled_pass_rows_through(spark):
    df = spark.range(3)
    assert ag.by_rules(df, [ag.AggregateRule("x", enabled=False)]) is df


@pytest.mark.parametrize(
    "op, low, high, hits",
    [("gt", 2, None, [3]), ("lt", 2, None, [1]), ("eq", 2, None, [2]), ("ne", 2, None, [1, 3]), ("between", 2, 3, [2, 3]), ("outside", 2, 3, [1])],
)
def test_alert_conditions(spark, op, low, high, hits):
    df = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 3.0), ("other", 9.0)], "metric string, value double")
    got = judge(df, [AlertRule("r", "m", op, low, high), AlertRule("off", "m", "gt", 0, enabled=False)]).filter("hit")
    assert sorted(r["value"] for r in got.collect()) == hits


def test_tokens(spark):
    text = "The QUICK-brown fox, was über on snake_case 42 é"
    got = spark.range(1).select(search.tokens(F.lit(text)).alias("t")).first()["t"]
    assert got == ["quick", "brown", "fox", "über", "snake_case"]


def test_visible_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "tenant_id string")
    grants = spark.createDataFrame([("a", "read", "b")], "source string, operation string, target string")
    see = lambda *args: sorted(r[0] for r in tenancy.visible(df, *args).collect())
    assert see("a", "read", grants) == ["a", "b"]
    assert see("a", "write", grants) == ["a"]
    assert see("a", "compliance", grants, tenancy.Sharing(compliance_sharing=True)) == ["a", "b", "c"]
    assert see("a", "read", grants, tenancy.Sharing(cross_tenant_analytics=False)) == ["a"]


def test_sampling_is_stable_and_close_to_its_rate(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    once, again = enrich.sample(df, 0.2), enrich.sample(df.repartition(7), 0.2)
    assert once.count() == again.intersect(once).count()
    assert 3_600 < once.count() < 4_400


def test_small_side_is_checked(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(spark.range(10), 10))
    assert not hinted(small_side(spark.range(11), 10))


def test_a_record_without_id_is_a_dead_letter(spark, sf_dir):
    from sparkscope.model import newest, records
    from sparkscope.plans import ingest

    rows = records(spark, sf_dir).filter("record_type in ('Metric', 'Event')")
    flowed = ingest.flow(rows.withColumn("id", F.lit(None).cast("string")), newest(rows)).cache()
    assert flowed.count() == rows.count()
    assert {r["table"] for r in flowed.select("table").distinct().collect()} == {ingest.DEAD_LETTERS}
    assert flowed.filter("reject_reason is null").isEmpty()


def test_put_on_a_null_map(spark):
    from sparkscope.operators import transforms as tr

    df = spark.sql("select cast(null as map<string, string>) as m, 'x' as v")
    got = df.select(tr.put(F.col("m"), "k", F.col("v")).alias("a"), tr.put_all(F.col("m"), {"k": F.col("v")}).alias("b")).first()
    assert got["a"] == {"k": "x"} and got["b"] == {"k": "x"}


def test_tenants_without_a_quota_take_the_default(spark):
    usage = spark.createDataFrame([("a", 1.9, 50.0), ("b", 0.9, 99.0)], "tenant_id string, cpu_cores double, connections double")
    quotas = spark.createDataFrame([("a", 2.0, None), ("z", 9.0, 9.0)], usage.schema)
    got = {(r["tenant_id"], r["resource"]): (r["quota"], r["level"]) for r in tenancy.utilisation(usage, quotas, ["cpu_cores", "connections"]).collect()}
    assert got == {
        ("a", "cpu_cores"): (2.0, "critical"), ("a", "connections"): (100.0, "normal"),
        ("b", "cpu_cores"): (1.0, "warning"), ("b", "connections"): (100.0, "critical"),
    }
    samples = spark.createDataFrame([(t, i, i, 1.0) for t in "ab" for i in range(5)], "tenant_id string, ts long, seq long, cpu_cores double")
    scale = {r["tenant_id"]: r["scale_up"] for r in tenancy.needs_scaling(samples, quotas).collect()}
    assert scale == {"a": False, "b": True}


def test_landed_otlp_documents_are_compressed(spark, sf_dir):
    from sparkscope.catalog import io_queries

    f = io_queries.flat(spark, sf_dir)
    path = io_queries._documents(spark, f, F.struct(F.col("event_type").alias("name")), "resourceSpans", "scopeSpans", "spans", "otlp-test")
    files = [r[0] for r in spark.read.text(path).select("_metadata.file_path").distinct().collect()]
    assert files and all(name.endswith(".gz") for name in files)
