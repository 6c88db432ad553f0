"""Line dedup, collocations and whitening on odd rows, hot keys and small numbers of everything."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm import brute
from sparkscope.llm import lines, phrases, whiten

SCHEMA = "doc_id bigint, text string, lang string, n_lines string, kept_text string, key string, `f` string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "a", "b", "c", "d") for i, t, lang in rows], SCHEMA)


ODD = [
    (1, None, "en"), (2, "", None), (3, "\n\n", "en"), (4, "a shared line here\nown line of four", "en"),
    (5, "own line of five\n \tA SHARED line here\r\nshort\na shared LINE here", "en"), (None, "a shared line here\nshort", "de"),
    (6, "short\nÀ shared line\nà shared line\nÀ Shared line", "fr"), (7, "à SHARED line\nÀ shared line", "fr"),
    (7, "à SHARED line\nÀ shared line", "fr"), (7, "other text\na shared line here", "fr"), (8, "0123456789\n012345678", "en"),
    (9, "0123456789\n012345678\n0123456789  ", "en"),
]


def test_lines_on_odd_rows(spark):
    got = lines.drop_repeated_lines(table_of(spark, ODD)).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got))) == sorted(
        map(str, brute.line_dedup([(i, t) for i, t, _ in ODD]))
    )
    assert {r["key"] for r in got} == {"c"} and all(isinstance(r["n_lines"], int) for r in got)
    assert lines.drop_repeated_lines(table_of(spark, [])).count() == 0


def test_lines_hot_and_long(spark):
    """A line that each document holds, a third of all rows with one id and text, and a text of 200,000 lines."""
    rows = [(i, f"the same line in all\nnumber {i} of many lines", "en") for i in range(3000)]
    rows += [(5000, "the same line in all\nalways this text", "en")] * 1500
    long = "\n".join(f"line number {i // 2}" if i % 3 else f"own {i}, a line" for i in range(200_000))
    rows += [(6000, "line number 1\nline number 2", "en"), (7000, long, "en"), (7001, "the same line in all\n" + long, "en")]
    got = lines.drop_repeated_lines(table_of(spark, rows).repartition(9)).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got))) == sorted(
        map(str, brute.line_dedup([(i, t) for i, t, _ in rows]))
    )


def test_lines_in_more_documents(spark):
    rows = [(i, "in two of them all" if i < 2 else "in three of them all", "en") for i in range(5)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_repeated_lines(table_of(spark, rows), documents=3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def babble(seed, n, words=30):
    rng = random.Random(seed)
    own = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(words)]
    return "".join(rng.choice(own).title() + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_phrases_match_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, babble(seed * 3 + i % 2, rng.randint(0, 400), 20 + 60 * (i % 2)), rng.choice(["en", "de", None])) for i in range(40)]
    rows += [(i, t, lang) for i, t, lang in ODD] + [(None, "new york city hall. " * 50, "en"), (3, "x y " * 300, "en")]
    for least, top, contained in [((3, 25, 100), (10**6, 5, 100)), ((8, 1000, 90),)][seed]:
        got = phrases.collocations(table_of(spark, rows), least=least, top=top, contained=contained).collect()
        assert sorted(map(tuple, got)) == brute.collocations([(t, lang) for _, t, lang in rows], least, top, contained)


def test_phrases_without_rows(spark):
    assert phrases.collocations(table_of(spark, [])).count() == 0
    assert phrases.collocations(table_of(spark, [(1, None, None), (2, " .\n", "en")]), least=1).count() == 0


def test_search_stops_early(spark, monkeypatch):
    """Frequent words are not taken up once the rarer ones settle the result; ties at the end are."""
    rare = [(i, f"qa{j} qb{j}. " * 3, "en") for i, j in enumerate(range(60))]
    often = [(100 + i, "of the of the and. " * 40, "en") for i in range(40)]
    passes, real = [], phrases.grown
    monkeypatch.setattr(phrases, "grown", lambda k: passes.append(k) or real(k))
    got = sorted(map(tuple, phrases.collocations(table_of(spark, rare + often), least=3, top=10).collect()))
    assert got == brute.collocations([(t, lang) for _, t, lang in rare + often], 3, 10)
    assert passes.count(2) < len(phrases.SHARES) + 1


def test_scores_beyond_64_bits(spark):
    rows = [(10**12 + 7, 9 * 10**12 + 1, 3 * 10**12 + 1, 2 * 10**12 + 3), (100, 10**13, 100, 100), (7, 10, 7, 7)]
    df = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint").withColumn("s", phrases.score("a", "n", "l", "r"))
    assert [r["s"] for r in df.collect()] == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_equal_hashes_are_told_apart():
    words = np.array([[1, 2], [3, 4], [1, 2], [5, 6], [3, 4]], np.uint64)
    found = phrases.distinct(words, np.array([1, 1, 2, 7, 1]), np.array([9, 9, 9, 4, 9], np.uint64))
    assert found.words.tolist() == [[5, 6], [1, 2], [3, 4]] and found.n.tolist() == [7, 3, 2] and found.h.tolist() == [4, 9, 9]
    assert len(phrases.distinct(words[:0], np.zeros(0, np.int64), np.zeros(0, np.uint64)).n) == 0


def test_folding_holds_phrases_and_not_messages(monkeypatch):
    """A phrase of every chunk: its messages are summed as they come."""
    monkeypatch.setattr(phrases, "FOLD", 50)
    most, real = [], phrases.distinct
    monkeypatch.setattr(phrases, "distinct", lambda words, *rest: most.append(len(words)) or real(words, *rest))
    words = np.array([[1, 2], [3, 4]], np.uint64)
    names = ["bucket", "size", "words", "n"]
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([2], pa.int32()), pa.array([words.tobytes()]), pa.array([np.array([1, 2], np.int32).tobytes()])], names)
    out = list(phrases.folded(iter([batch] * 10_000), 15_000))
    assert [(c.to_pylist()) for c in out[0].columns] == [[words[1].astype(">u8").tobytes()], [20_000]]
    assert max(most) < 60


def test_a_task_holds_the_phrases_of_one_bucket(monkeypatch):
    """However many buckets meet in a task, what is summed at once is one size of one bucket and what waits for it."""
    monkeypatch.setattr(phrases, "FOLD", 50)
    monkeypatch.setattr(phrases, "BATCH", 4096)
    most, real = [], phrases.distinct
    monkeypatch.setattr(phrases, "distinct", lambda words, *rest: most.append(len(words)) or real(words, *rest))
    rng = np.random.default_rng(0)
    want, sent = {}, []
    for k in (2, 3):
        rows = rng.integers(0, 1 << 63, (2000, k)).astype(np.uint64)
        for part in (rows, rows[::2]):  # two chunks, of which the second has every other phrase
            h = phrases.hashes(lambda j, part=part: part[:, j], k)
            found = real(part, np.full(len(part), 3), h)
            sent += [r for b in phrases.dealt(found, 6) for r in b.to_pylist()]
        want |= {r.astype(">u8").tobytes(): 6 - 3 * (i % 2) for i, r in enumerate(rows)}
    sent.sort(key=lambda r: (r["bucket"], r["size"]))
    names = {"bucket": pa.int32(), "size": pa.int32(), "words": pa.binary(), "n": pa.binary()}
    batches = [pa.RecordBatch.from_pylist(sent[i : i + 7], pa.schema(list(names.items()))) for i in range(0, len(sent), 7)]
    most.clear()
    out = [r for b in phrases.folded(iter(batches), 1) for r in b.to_pylist()]
    assert {r["key"]: r["f"] for r in out} == want and len(out) == len(want)
    assert {r["key"] for b in phrases.folded(iter(batches), 4) for r in b.to_pylist()} == {k for k, f in want.items() if f == 6}
    assert max(most) < 160


@given(st.lists(st.text("ab .\n", max_size=30), max_size=6), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_spans_cut_no_phrase(texts, limit):
    from sparkscope.llm.common import offsets_of

    at, data = offsets_of(pa.array(texts, pa.string()))
    for row, last, start, end in phrases.spans(at, data, limit):
        found = phrases.Pieces(data[start:end], np.clip(at[row : last + 1], start, end) - start, 0)
        if last == row + 1 and end < at[last]:
            assert chr(data[end]) in ".\n"
        assert len(found.start) == sum(len(t) for t in (texts[i][max(0, start - at[i]) : end - at[i]].replace(".", " ").split() for i in range(row, last)))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, deviation string, _x string")


@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_scatter_is_exact(rows):
    sums, products = whiten.scatter(np.array(rows, np.int64))
    x = np.array(rows, object)
    assert sums == list(x.sum(0)) and all(products[d][e] == (x[:, d] * x[:, e]).sum() for d in range(3) for e in range(d, 3))


@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=5, max_size=5), min_size=1, max_size=9))
def test_squares_are_exact(rows):
    assert whiten.squares(np.array(rows, np.int64)) == [sum(v * v for v in r) for r in rows]


def test_whiten_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i if i else None, [*rng.normal(size=5).tolist(), 3.0]) for i in range(200)] + [(7, [0.5, 0.25]), (7, [])]
    bad = [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan")] * 6), (303, [float("inf"), 1.0])]
    model = whiten.fit(vectors(spark, good + bad), k=8)
    ints = [[int(np.floor(c * 1024)) + 100_000 for c in [*v, *[0.0] * (6 - len(v))]] for _, v in good]
    n, deviation, values, explained = brute.whitened(ints)
    assert model.rows == n == 202
    out = whiten.whiten(vectors(spark, good + bad), model)
    assert out.columns == ["vec_id", "embedding", "_x", "deviation", "whitened"]
    got = out.toPandas()
    assert sorted(map(int, got.deviation)) == sorted(deviation) and set(got["_x"]) == {"y"}
    whole = np.array(got.whitened.tolist(), float)
    assert np.sort(np.abs(whole[:, 0])) == pytest.approx(np.sort(np.abs(values[:, 0])), abs=1e-9)
    assert model.explained() == pytest.approx(explained.tolist(), abs=1e-9)
    assert whiten.identity_error(out) < 1e-9


def test_whiten_without_variance(spark):
    """No rows, one row and constant columns: rows stay, components without variance are null."""
    assert whiten.fit(vectors(spark, [])) is None
    assert whiten.whiten(vectors(spark, [(1, None)]), whiten.fit(vectors(spark, [(1, None)]))).count() == 0
    one = vectors(spark, [(1, [1.0, 2.0])])
    row = whiten.whiten(one, whiten.fit(one)).first()
    assert row["deviation"] == 0 and row["whitened"] == [None, None]
    flat = vectors(spark, [(i, [float(i), 5.0, 5.0]) for i in range(10)])
    got = whiten.whiten(flat, whiten.fit(flat)).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in got)
    assert whiten.identity_error(whiten.whiten(flat, whiten.fit(flat))) < 1e-9


def test_phrase_filters_reach_the_driver_as_arrays(spark, monkeypatch):
    frame = type(spark.range(1))
    keys = spark.range(5000).select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key")).repartition(3)
    sizes, collect = [], frame.collect
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("rows"))
    monkeypatch.setattr(frame, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    held = phrases.filter_of(keys)
    assert held.has(phrases.hashes(lambda j: np.arange(5000, dtype=np.uint64), 1)).all()
    assert not held.has(phrases.hashes(lambda j: np.arange(10**6, 10**6 + 5000, dtype=np.uint64), 1)).all()
    assert max(sizes) <= 100
