"""The operators' queries over the whole tables of the smallest scale, against SQL or plain Python."""

import base64
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import assert_same, connect
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sparkscope import llm
from llm import brute

llm.load()


def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


def rows_of(spark, sf_dir, name):
    return [r.asDict() for r in llm.QUERIES[name](spark, sf_dir).collect()]


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(llm.QUERIES[name](spark, sf_dir), connect(sf_dir), llm.SQL[name])


def test_registered():
    assert set(llm.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES)
    assert numbers == list(range(1, 14))


def test_op1(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want, start = [], 0
    for key, text, _ in documents(sf_dir):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), brute.crc_ids(ids)))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, sf_dir, "op1_token_files"))
    assert got == want


def test_op2(spark, sf_dir):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import hashlib

    want = []
    for key, text, _ in documents(sf_dir):
        ids = library.encode_ordinary(text or "")
        want.append((key, len(ids), brute.sha_ids(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, sf_dir, "op2_rank_bpe"))
    assert got == want


def test_op6(spark, sf_dir):
    docs = documents(sf_dir)
    want = brute.shards([(key, source) for key, _, source in docs])
    got = rows_of(spark, sf_dir, "op6_interleaved_shards")
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want
    texts = {key: (text or "").encode() for key, text, _ in docs}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_op9(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = {key: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for key, text, _ in documents(sf_dir)}
    got = rows_of(spark, sf_dir, "op9_packed_sequences")
    check_packed(got, ids)


def check_packed(got, ids, window=4096):
    """Every id lies in one piece, sequences have no gaps, and little room is left."""
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[key])
            at += r["length"]
            assert r["ids_crc32"] == brute.crc_ids(ids[key][r["start"] : at])
        assert at == len(ids[key])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= total / window * 1.02 + 1


def test_op10(spark, sf_dir):
    want = sorted(brute.components([(key, text) for key, text, _ in documents(sf_dir)]))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(spark, sf_dir, "op10_shingle_join"))
    assert got == want


def test_op8_on_held_out_labels(spark):
    """Models fitted on the labelled documents of one table judge those of another."""
    from sparkscope.llm import quality

    near, far = "/root/testdata/sf0.1", "/root/testdata/sf0.01"
    read = lambda d, n: spark.read.parquet(f"{d}/{n}.parquet")
    docs = read(near, "documents")
    judged = quality.classify(read(far, "documents"), quality.fit(docs, read(near, "labels")))
    found = judged.join(read(far, "labels"), "doc_id").select("kept", "quality", "toxic").toPandas()
    good = (found.quality == 1) & (found.toxic == 0)
    assert found.kept[good].mean() > 0.97
    assert found.kept[~good].mean() < 0.1


def test_pipeline_is_its_stages(spark, sf_dir):
    """run() gives what the operators give one after the other; ids of every kept text are packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = sorted(before.items())
        if name == "exact_dedup":
            assert after == {max(k for k, t in rows if t == text): text for _, text in rows}
        elif name == "near_dedup":
            assert set(after) == {c for _, _, c in brute.components(rows)}
        elif name == "substring_dedup":
            want = {k: kept.decode() for k, _, _, kept in brute.repeats(rows)}
            assert after == want
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        else:
            assert set(after) <= set(before)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in after.items()}
    got = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in corpus_pipeline.run(spark, sf_dir).collect()]
    check_packed(got, ids)
    assert np.array([r["length"] for r in got]).max() <= 4096


def test_op8_is_its_models_row_by_row(spark, sf_dir):
    """Ratios, scores and kept rows of op8, and the rows the stage keeps, against sums in plain Python over the models' weights."""
    import pyarrow as pa

    from sparkscope.llm import quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert models
    weights = [dict(zip(m.bucket.tolist(), m.weight.tolist())) for m in models]
    want, noise = {}, {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel("doc_id", 5).alias("g")).collect()}
    for key, text, _ in documents(sf_dir):
        grams = [m.kind.grams(pa.array([text], pa.string()))[1].tolist() for m in models]
        # Nothing known about a text is nothing against it.
        silent = lambda w, own: not any(w.get(g) for g in own)
        ratio = min(max(-m.cut, 0) if silent(w, own) else sum(w.get(g, 0.0) for g in own) - m.cut for m, w, own in zip(models, weights, grams))
        want[key] = (ratio, ratio * quality.SHARPNESS + noise[key])
    k = sum(ratio >= 0 for ratio, _ in want.values())
    kept = set(sorted(want, key=lambda i: -want[i][1])[:k])
    assert 0 < k < len(want)
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op8_importance_resampling")}
    assert set(got) == set(want)
    for key, r in got.items():
        assert (r["log_ratio"], r["score"]) == pytest.approx(want[key], abs=1e-6)
    assert {key for key, r in got.items() if r["kept"]} == kept
    stage = dict(corpus_pipeline.STAGES)["quality_classifier"]
    assert {r["doc_id"] for r in stage(spark, docs, sf_dir).collect()} == kept


def test_op12(spark, sf_dir):
    """Whole table against plain counts; the smallest scale has few phrases that frequent, so the next one is read too."""
    rows = duckdb.sql("SELECT text, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want = brute.collocations(rows)
    assert len(want) > 50
    assert sorted(map(tuple, llm.QUERIES["op12_collocations"](spark, "/root/testdata/sf0.01").collect())) == want


def test_op13(spark, sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").fetchall()
    n, deviation, values, explained = brute.whitened([[int(np.floor(float(c) * 1024)) + 100_000 for c in v] for _, v in rows])
    got = llm.QUERIES["op13_whitened"](spark, sf_dir).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 8 * len(rows) and set(got.n) == {n}
    for c, own in got.groupby("component"):
        assert own.vec_id.tolist() == [key for key, _ in rows] and own.deviation.tolist() == deviation
        sign = np.sign(own.whitened.to_numpy() @ values[:, c - 1])
        assert np.abs(own.whitened * sign - values[:, c - 1]).max() < 1e-9
        assert own.explained.to_numpy() == pytest.approx(explained[c - 1], rel=1e-9)
    assert 0 <= got.identity_error.max() < 1e-9
