"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from llm import brute
from sparkscope.llm import bpe, chat, chunks, exact, near, packing, quality, sharding, substring, tokens, topk
from sparkscope.llm.common import Words
from sparkscope.llm.encoder import ByteLevel, WordLevel, encoder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_words string, shard string, _row string"
BYTES, RANKS, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))


def rows():
    long, passage = prose(1, 6000), prose(2, 60)
    texts = [None, "", " \n\t ", "one", "one", "ONE", "two words", prose(3, 80), prose(3, 80), prose(3, 80) + " more", long, long + " x", "a" * 5000,
             passage, prose(4, 30) + " " + passage, prose(5, 30) + "\n" + passage + " end", "x " * 300, None, "naïve \x85  café <|endoftext|> <|end|> <\\|"]
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), "k", "w", "s", "r") for i, t in enumerate(texts)]
    out += [(None, "one", None, None, None, None, None, None, None)] * 2 + [(7, prose(3, 80), "en", "s1", 1, "k", "w", "s", "r")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is not None, str(v)) for v in x)


def test_exact(docs, none):
    got = [r.asDict() for r in exact.exact_dedup(docs).collect()]
    assert len(got) == len(rows()) and set(docs.columns) | set(exact.ADDED) == set(got[0])
    by = {}
    for i, t, *_ in rows():
        by.setdefault(t or "", []).append(i)
    for r in got:
        ids = by[r["text"] or ""]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = exact.keep_one(docs).collect()
    assert sorted(r["text"] or "" for r in kept) == sorted(by)
    assert exact.exact_dedup(none).count() == 0


def test_exact_groups_beyond_the_sketch(spark):
    """A third of all rows in one group, and more groups than are broadcast."""
    texts = ["hot"] * 3000 + [f"t{i % 1500}" for i in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r for r in exact.exact_dedup(df).collect()}
    last = {t: i for i, t in enumerate(texts)}
    assert len(got) == 9000 and all(got[i]["keep_id"] == last[t] and got[i]["kept"] == (last[t] == i) for i, t in enumerate(texts))


@pytest.mark.parametrize("n", [0, 5, 16, 1000])
def test_shards(spark, n):
    data = [(i if i % 10 else None, "hot" if i % 3 else (f"s{i % 7}" if i % 2 else None), "x") for i in range(n)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, slot string")
    got = sharding.interleave(df).collect()
    assert len(got) == n and set(df.columns) | {"shard"} == set(sharding.interleave(df).columns)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values()), default=0) - (min(map(len, slots.values())) if len(slots) == 16 else 0) <= 1
    if n == 1000:  # every shard has the mixture, to within a row or two of each source
        for s in slots:
            assert abs(sum(r["source"] == "hot" for r in got if r["shard"] == s) - 667 / 16) <= 2


def test_token_files(docs, none):
    manifest = tokens.write(docs, BYTES)
    got = sorted(tokens.read(manifest).collect(), key=lambda r: r["start"])
    known = encoder(ByteLevel, BYTES)
    want = {}
    for i, t, *_ in rows():
        want.setdefault(i, []).append([*known.encode([t or ""])[0].tolist(), 0])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(own) and own in want[r["doc_id"]]
        at += len(own)
    assert len(got) == len(rows())
    assert tokens.read(tokens.write(none, BYTES)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=400), st.randoms())
def test_elias_fano(values, rng):
    values = np.sort(np.array(values, np.uint64))
    head, data = tokens.EliasFano.of(values).dump()
    held = tokens.EliasFano.load(head, memoryview(data))
    index = np.array(rng.sample(range(len(values)), len(values) // 2), np.int64)
    assert (held.select(index) == values[index]).all()


def test_token_file_access():
    ids, ends = np.arange(700, dtype=np.uint32), np.array([0, 0, 5, 300, 300, 700])
    blob = b"".join(tokens.file_bytes([None, -7, -7, 0, 5, 2**60], ends, ids, False))

    class Source:
        def read_at(self, n, at):
            return blob[at : at + n]

    held = tokens.TokenFile(Source())
    for a in range(6):
        for b in range(a + 1, 7):
            keys, bounds, got = held.documents(a, b)
            assert keys == [None, -7, -7, 0, 5, 2**60][a:b]
            assert bounds.tolist() == [0, *ends.tolist()][a : b + 1] and got.tolist() == ids[bounds[0] : bounds[-1]].tolist()


def test_bpe(docs, none):
    got = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t, *_ in rows())
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0


ODD = st.lists(st.sampled_from(list("aAbB '.!1é́İΣς \x85\x1c\n\t\r") + ["'s", "'S", "  ", "日本", "<|endoftext|>", "aaaa"]), max_size=60).map("".join)


@functools.cache
def test_bpe_long_match():
    """A match of 200,000 bytes without a break, as the library merges it, within seconds."""
    import time

    import tiktoken

    ranks = bpe.Ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks.ids, special_tokens={})
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    short = ["".join(rng.choices("abcd", k=rng.randint(1, 30))) for _ in range(40)]
    start = time.monotonic()
    got = ranks.merge([x.encode() for x in (long, *short)])
    assert time.monotonic() - start < 30
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(x) for x in (long, *short)]


def libraries():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    out = []
    for kind, path in ((ByteLevel, BYTES), (WordLevel, WORD)):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        out.append((encoder(kind, path), lambda t, own=library: own.encode(t, add_special_tokens=False).ids))
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [*out, (encoder(ByteLevel, RANKS, bpe.RankPieces), library.encode_ordinary)]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_encoders_match_their_libraries(texts):
    for own, library in libraries():
        ids, at = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library(t) for t in texts]


def top_brute(rows, every, k):
    """(query id, rank, vec_id, score) of (id, integer vector) rows; each row is a query or candidate of its own."""
    out = []
    for q, (key, v) in enumerate(rows):
        if key % every == 0:
            best = sorted((-int(v @ x), i) for r, (i, x) in enumerate(rows) if r != q)[:k]
            out += [(key, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, np.floor(rng.normal(size=8)).tolist()) for i in range(150)]
    data += [(i, [1.0] * 8) for i in range(150, 260)]  # ties
    data += [(40, [2.0] * 8), (40, [2.0] * 8), (7, [1.0] * 8), (-20, [3.0] * 3)]  # repeated ids, a negative one, a short vector
    odd = [(300, None), (320, [1.0, None]), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x", "y") for r in data + odd], "vec_id bigint, embedding array<float>, rank string, score string")
    whole = [(i, np.floor(np.array([*v, *[0.0] * (8 - len(v))]) * 64).astype(int)) for i, v in data]
    got = topk.top_k(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == top_brute(whole, 20, 20)
    assert sorted(map(tuple, topk.top_k(df, every=7, k=3).collect())) == top_brute(whole, 7, 3)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]
    bare = spark.createDataFrame([(0, []), (1, [])], few.schema)
    assert [tuple(r) for r in topk.top_k(bare).collect()] == [(0, 1, 1, 0)]


def test_top_k_ships_few_runs_of_clusters(spark, monkeypatch):
    """Many runs: results as before, and runs of far clusters never meet."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "RUN", 2)
    met, real = [], topk._pairs
    monkeypatch.setattr(topk, "_pairs", lambda *a: met.append(real(*a)) or met[-1])
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 16)) * 40
    x = centres[rng.integers(0, 4, 700)] + rng.normal(size=(700, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    whole = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in data]
    assert sorted(map(tuple, topk.top_k(df, every=5, k=4).collect())) == top_brute(whole, 5, 4)
    runs = -(-700 // 32)
    assert 0 < met[0].count() < runs * (runs - 1) / 2


def test_top_k_stops_early():
    """On clustered vectors most products are never evaluated."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32)) * 300
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 4).astype(np.int64)
    pivots, queries, rows = x[:32], x[:20], np.arange(4000)
    best = topk.Best(rows[:20], 10)
    done = topk.search(best, queries, topk.distances(queries, pivots), rows, rows, x, topk.distances(x, pivots))
    scores = queries @ x.T
    scores[np.arange(20), np.arange(20)] = -(10**15)
    assert (best.score == -np.sort(-scores, axis=1)[:, :10]).all()
    assert done < 20 * 4000 / 3


def test_substring(spark, docs, none):
    data = [(i, t) for i, t, *_ in rows() if i is not None]
    data = [data[i] for i in sorted({d[0]: n for n, d in enumerate(data)}.values())]  # distinct ids
    got = substring.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    want = sorted(brute.repeats(sorted(data)))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], (r["text"] or "").encode()) for r in got) == want
    every = substring.remove_repeats(docs)
    assert every.count() == len(rows()) and set(every.columns) == set(docs.columns) | {"n_removed"}
    assert substring.remove_repeats(none).count() == 0


def test_substring_random(spark):
    """Few words, so that windows repeat within and across documents at all shifts."""
    rng = random.Random(4)
    base = [rng.choice("abcd") for _ in range(400)]
    data = []
    for i in range(150):
        a, n = rng.randrange(300), rng.randrange(0, 90)
        w = base[a : a + n]
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("xyz"))
        data.append((i, rng.choice([" ", "\n "]).join(w)))
    got = substring.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"].encode()) for r in got) == brute.repeats(data)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    data = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (2, 5, "assistant", "<|end|> <\\|x <"),
            (None, 1, "user|>", "é"), (None, 0, "assistant", ""), (-7, 0, "user", said), (-7, 1, "assistant", said)]
    data += [(3, i, "user" if i % 2 else "assistant", f"{i}ß" * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, p or "", x or "") for i, t, p, x in data if i == c))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(p, x) for _, _, p, x in own]
        assert r["loss"] == [x for _, _, p, x in own if p == "assistant"]
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_chat_segments(spark):
    """A conversation with most of the rows, and the one without an id, are formatted in bounded pieces by many tasks."""
    data = [(3 if i % 3 else None, i // 2, "user" if i % 2 else "assistant", f"{i}ß <|end|>" * (i % 9)) for i in range(6000)] + [(4, 1, None, None)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    # Else AQE makes one task of so few bytes.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments = chat.format_segments(df, limit=2_000).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(len(r["formatted"].encode()) for r in segments) < 4_000
    assert len({r["segment"] >> 32 for r in segments if r["conv_id"] == 3}) > 2
    got = {r["conv_id"]: r for r in chat.digests(chat.format_segments(df, limit=2_000)).collect()}
    whole = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df).collect()}
    assert set(got) == set(whole) == {3, 4, None}
    for c, r in got.items():
        own = sorted((t, p or "", x or "") for i, t, p, x in data if i == c)
        loss = "".join(x for _, p, x in own if p == "assistant")
        said = "".join(f"{p}\n{x}\n" for _, p, x in own)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["n_turns"] == len(own)
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == len(whole[c])
        assert "".join(x["formatted"] for x in sorted((x for x in segments if x["conv_id"] == c), key=lambda x: x["segment"])) == whole[c]


def test_texts_without_known_grams_stay(spark):
    """With a positive cut too: nothing in them tells the classes apart."""
    one = pa.array(["good words here", "", None, "zzz", "bad"])
    doc, gram = quality.KINDS[1].grams(pa.array(["good words here"]))
    bad = quality.KINDS[1].grams(pa.array(["bad"]))[1]
    model = quality.Model(quality.KINDS[1], np.unique(np.concatenate([gram, bad])), None, cut=3.0)
    model.weight = np.where(np.isin(model.bucket, bad), -2.0, 1.0).astype(np.float32)
    ratios = model.ratios(one)
    assert ratios[0] == len(gram) - 3.0 and ratios[1:4].tolist() == [0.0, 0.0, 0.0] and ratios[4] < -3.0
    df = spark.createDataFrame([(i, t) for i, t in enumerate(one.to_pylist())] + [(None, "zzz"), (3, "zzz")], "doc_id bigint, text string")
    kept = {(r["doc_id"], r["text"]) for r in quality.classify(df, [model]).filter("kept").collect()}
    assert {(1, ""), (2, None), (3, "zzz"), (None, "zzz")} <= kept and (4, "bad") not in kept


def test_rows_that_tie_stay_by_both_ways(spark, monkeypatch):
    """classify and keep_good keep the same rows where scores tie at the bound."""
    df = spark.createDataFrame([(5, "same text")] * 6 + [(6, "bad")] * 3, "doc_id bigint, text string")
    bad = quality.KINDS[1].grams(pa.array(["bad"]))[1]
    model = quality.Model(quality.KINDS[1], np.unique(bad), np.full(len(np.unique(bad)), -9.0, np.float32))
    monkeypatch.setattr(quality, "fit", lambda *a: [model])
    assert quality.classify(df, [model]).filter("kept").count() == 6
    assert quality.keep_good(df, None).count() == 6


def test_quality(spark, docs, none):
    label = "doc_id bigint, quality int, toxic int"
    bad = [(100 + i, "BUY!! NOW!! " * 20) for i in range(30)] + [(200 + i, prose(i, 50) + " vile words") for i in range(30)]
    fine = [(300 + i, prose(50 + i, 60)) for i in range(60)]
    known = spark.createDataFrame(bad + fine, "doc_id bigint, text string")
    marks = [(i, 0, 0) for i in range(100, 130)] + [(i, 1, 1) for i in range(200, 230)] + [(i, 1, 0) for i in range(300, 360)]
    labels = spark.createDataFrame([*marks, (None, 1, 0), (5000, 0, 0), (100, None, None)], label)
    models = quality.fit(known, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(known, models).collect()}
    assert not any(kept[i] for i in range(100, 130)) and sum(kept[i] for i in range(300, 360)) >= 55
    stay = quality.keep_good(known, labels).collect()
    assert {r["doc_id"] for r in stay} == {i for i, k in kept.items() if k}
    out = quality.classify(docs, models)
    assert out.count() == len(rows()) and set(docs.columns) <= set(out.columns)
    assert all(r["kept"] for r in quality.classify(docs, []).collect())
    assert quality.classify(none, models).count() == 0 and quality.fit(none, labels) == []


def test_packing(docs, none):
    got = packing.pack(docs, WORD).collect()
    known = encoder(WordLevel, WORD)
    want = sorted(np.append(known.encode([t or ""])[0], 2).astype("<u4").tobytes() for _, t, *_ in rows())
    by, sequences = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["length"] == r["doc_tokens"]:
            by.setdefault("whole", []).append(bytes(r["ids"]))
        else:
            by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    texts = by.pop("whole", []) + [b"".join(x for _, x in sorted(parts)) for parts in by.values()]
    assert sorted(texts) == want
    for parts in sequences.values():
        ends = 0
        for offset, n in sorted(parts):
            assert offset == ends
            ends += n
        assert ends <= 4096
    assert packing.pack(none, WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.just(50))
def test_best_fit(lengths, window):
    lengths = np.array(lengths, np.int64)
    bins, offsets, made = packing.best_fit(lengths, window)
    room = []
    for n in sorted(lengths.tolist(), reverse=True):  # the plain version: least room that holds it
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    used = np.bincount(bins, weights=lengths, minlength=made)
    assert sorted(window - used) == sorted(room)
    for b in range(made):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert (offsets[own] == np.cumsum(lengths[own]) - lengths[own]).all()


def test_near(spark, docs, none):
    data = [r[:2] for r in rows()]
    got = near.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute.components(data), key=key)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    # One row of each component that has words; rows without words all stay.
    wordless = sum(not brute.words(t) for _, t in data)
    linked = {c for (_, n, c) in brute.components(data) if n}
    assert kept.count() == wordless + len(linked)
    assert near.near_duplicates(none).count() == 0


def test_near_random(spark):
    """Chains, stars and cliques of variants, short texts, and a passage that half the texts share."""
    rng = random.Random(9)
    passage, data = prose(0, 40).split(), []
    for group in range(25):
        n = rng.choice([3, 5, 7, 9, 12, 25, 60, 200])
        base = prose(100 + group, n).split()
        for _ in range(rng.choice([1, 2, 8, 30])):
            w = list(base)
            for _ in range(rng.randrange(1 + max(1, n // 40))):
                w[rng.randrange(len(w))] = rng.choice("xyz") * 2
            if rng.random() < 0.5:
                w += passage
            data.append((len(data), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    got = near.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)).collect()
    want = brute.components(data)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert sum(c != i for i, _, c in want) > 50


def test_near_crowd(spark, monkeypatch):
    """Many variants of one text, half of which link with nothing, under the same keys."""
    rng, data = random.Random(11), []
    base = prose(0, 150).split()
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    monkeypatch.setattr(near, "BLOCK", 5_000)
    got = near.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)).collect()
    want = brute.components(data)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert 50 < sum(c == i for i, _, c in want) < 350


def test_near_rounds_take_few_shuffles(spark):
    """Leaders of a key come with its rows, and a round's documents meet their links once."""
    data = []
    for g in range(40):
        base = prose(g, 60).split()
        for i in range(6):
            data.append((10 * g + i, " ".join([*base[: 60 - 2 * i], *(f"w{g}x{i}x{j}" for j in range(2 * i))])))
    spark.sparkContext.setJobGroup("near-rounds", "near")
    try:
        got = near.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute.components(data)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-rounds"))
    assert jobs < 90


def test_near_crowd_of_short_texts(spark):
    """Texts on one template, of six shingles each, most of which link with nothing, under the template's keys."""
    data = [(i, f"a{i} b{i} c d e f g h i j" if i % 50 else f"a{i} c d e f g h i j k{i % 100} l m n") for i in range(100_000)]
    got = near.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").repartition(16))
    linked = {r["doc_id"]: r["component_id"] for r in got.filter("doc_id <> component_id").collect()}
    assert linked == {i: i % 100 for i in range(100, 100_000, 50)}


def test_near_cells_are_bounded():
    """A cell of many short sets is judged without a matrix of longs of all its pairs."""
    import tracemalloc

    rng = np.random.default_rng(0)
    sets = [np.sort(np.append(np.arange(4), rng.integers(10, 2**60, 2)).astype(np.uint64)) for _ in range(near.DOCS_IN_BLOCK)]
    sets[900] = sets[3]
    tracemalloc.start()
    got = near._reached(list(enumerate(sets)), [])
    crossed = near._reached(list(enumerate(sets[:500])), [(i + 500, s) for i, s in enumerate(sets[500:])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == crossed.to_pylist() == [{"a": 3, "b": 900}]
    assert peak < 16 * near.DOCS_IN_BLOCK**2


def test_buckets_grow_with_the_words(spark, monkeypatch):
    """More words make more buckets, not larger ones, and the results stay."""
    data = [(i, prose(i // 3, 120)) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)
    most: list[int] = []

    def answered(asked, answer, label):
        sizes = asked.groupBy("bucket").agg(F.sum(F.length("a") / 8).alias("n")).collect()
        most.append(max((r["n"] for r in sizes), default=0))
        return chunks.answered(asked, answer, label)

    monkeypatch.setattr(chunks, "BUCKET_WORDS", 100)
    monkeypatch.setattr(near, "answered", answered)
    monkeypatch.setattr(substring, "answered", answered)
    got = near.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute.components(data)
    got = substring.remove_repeats(df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], (r["text"] or "").encode()) for r in got) == brute.repeats(data)
    assert len(most) == 3 and max(most) < 100


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf_dir, docs, none, name, step):
    """Every stage takes odd rows and empty tables; all but the last return the columns of their input."""
    out, empty = step(spark, docs, sf_dir), step(spark, none, sf_dir)
    assert empty.count() == 0 and out.count() > 0
    if name != "packing":
        assert empty.columns == out.columns == docs.columns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(list("ab\n\t ü") + ["c" * 70]), max_size=40).map("".join)), max_size=6))
def test_words(texts):
    found = Words(pa.array(["zz ", *texts, "x"], pa.string()).slice(1, len(texts)))
    got = [[found.data[found.start[j] : found.end[j]].tobytes() for j in range(found.first[i], found.first[i + 1])] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    seen = {}
    for j in range(len(found.start)):
        word = found.data[found.start[j] : found.end[j]].tobytes()
        assert seen.setdefault(word, found.hash[j]) == found.hash[j]
    assert len(set(seen.values())) == len(seen)


def test_checksums():
    assert brute.crc_ids([1, 2]) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_pieces_encoded_side_by_side_are_those_encoded_alone():
    from sparkscope.llm.encoder import Pieces, WordLevel, WordPieces

    path = public_tokenizers.path("word_bpe_49k.json")
    match, rng = WordLevel(path).match, np.random.default_rng(5)
    letters = [*map(chr, range(33, 127)), *"'stvmredl'", "\x00", "\x1c", "\x7f"]
    strings = sorted({p for _ in range(3000) for p in match.findall("".join(rng.choice(letters, rng.integers(1, 12))).lower())} | {"</w>", "é", "a" * 500})
    side_by_side, alone = WordPieces(path), Pieces(path)
    assert side_by_side.raw(strings) == alone.raw(strings)
    calls = []
    side_by_side.tokenizer = type("T", (), {"encode_batch_fast": lambda self, x, **k: calls.append(len(x)) or alone.tokenizer.encode_batch_fast(x, **k)})()
    side_by_side.raw(["".join("abcdefghij"[int(c)] for c in f"{i:05d}") for i in range(5000)])
    assert sum(calls) == 2  # a call for thousands of pieces, not one sequence for each
