"""Quality classifier: importance weights from hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import ROW, Words, mix, named, numbered, offsets_of, pieces_of, plain, positions, stage, table, without

#: Labelled documents of each class that the models are fitted on, at most, and the share of
#: them that only sets the cuts.
SAMPLE, HELD = 4_000, 3
#: Raw documents in the fit for which a bucket has one count in either model from the start (at least one).
PER_COUNT = 300
#: Log ratios are multiplied by this before the Gumbel noise (standard, times 1) is added.
SHARPNESS = 8.0
#: What the share of target texts that a cut rejects weighs against the share of raw text that it accepts.
LOST = 4.0
ADDED = ("log_ratio", "score", "kept")


def _classes() -> np.ndarray:
    """A class for each byte: lower case 1, upper case 2, digit 3, . 4, comma 5, ! 6, other marks 7, beyond ASCII 8."""
    out = np.full(256, 7, np.uint64)
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 8
    out[ord(".")], out[ord(",")], out[ord("!")] = 4, 5, 6
    return out


_CLASS = _classes()


def style_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket (18 bits) of words, pairs of words, and triples of word forms.

    Words are lower-cased (A-Z). A form says how a word begins and ends, and whether it repeats
    one of the two words before it in the same text.
    """
    words = Words(column, lower=True)
    n = len(words.hash)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if not n:
        return doc, np.zeros(0, np.int64)
    at, data = offsets_of(column)
    raw = data[int(at[0]) : int(at[-1])]
    first, last = words.start, words.end - 1
    shape = np.zeros(n, np.uint64)
    for place in (first, np.minimum(first + 1, last), np.maximum(last - 1, first), last):
        shape = shape * np.uint64(16) + _CLASS[raw[place]]
    same = np.zeros(n, np.uint64)
    for back in (1, 2):
        again = (words.hash[back:] == words.hash[:-back]) & (doc[back:] == doc[:-back])
        same[back:][again] |= np.uint64(back)
    form = (shape * np.uint64(4) + same) * np.uint64(4) + np.minimum(words.end - first, 3).astype(np.uint64)
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pairs = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])[two]
    forms = mix((form[:-2] << np.uint64(42)) ^ (form[1:-1] << np.uint64(20)) ^ form[2:] ^ np.uint64(1 << 63))[three]
    grams = np.concatenate([words.hash, pairs, forms]) >> np.uint64(46)
    return np.concatenate([doc, doc[1:][two], doc[2:][three]]), grams.astype(np.int64)


def word_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket (20 bits) of words without marks, and of their first 4 and 5 bytes."""
    words = Words(column, lower=True, bare=True)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    docs, grams = [doc], [mix(words.hash + np.uint64(7))]
    start = np.zeros(len(doc), np.uint64)
    for k in range(5):
        start = start * np.uint64(256) + data[words.start + k]
        if k >= 3:
            long = words.end - words.start > k
            docs.append(doc[long])
            grams.append(mix(start[long] + np.uint64((k + 1) * 10**15)))
    return np.concatenate(docs), (np.concatenate(grams) >> np.uint64(44)).astype(np.int64)


@dataclass(frozen=True)
class Kind:
    """A model of the target against one class of raw text, with its own n-grams.

    Buckets whose log ratio is smaller than ``least`` say nothing about the class and count 0.
    """

    raw: int
    grams: object
    buckets: int
    least: float


#: Class 0 is the target. Raw text comes as low quality (1) and as toxic text (2).
KINDS = (Kind(1, style_grams, 1 << 18, 1.2), Kind(2, word_grams, 1 << 20, 2.0))


@dataclass
class Model:
    kind: Kind
    bucket: np.ndarray
    weight: np.ndarray
    cut: float = 0.0

    def ratios(self, column: pa.Array) -> np.ndarray:
        """log p(text | target) - log p(text | raw), less the cut; not below 0 where no n-gram of the text tells the classes apart."""
        if not hasattr(self, "_dense"):
            self._dense = np.zeros(self.kind.buckets, np.float32)
            self._dense[self.bucket] = self.weight
        doc, gram = self.kind.grams(column)
        weight = self._dense[gram]
        ratio = np.bincount(doc, weights=weight, minlength=len(column)) - self.cut
        if self.cut > 0:
            silent = np.bincount(doc, weights=weight != 0, minlength=len(column)) == 0
            ratio[silent] = 0.0
        return ratio


def best_cut(target: np.ndarray, raw: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the least error; a lost target text counts ``LOST`` times."""
    values = np.unique(np.concatenate([target, raw]))
    if len(values) < 2 or not len(target) or not len(raw):
        return 0.0
    cuts = (values[1:] + values[:-1]) / 2
    error = LOST * np.searchsorted(np.sort(target), cuts) / len(target) + 1 - np.searchsorted(np.sort(raw), cuts) / len(raw)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(cuts[best[np.argmax(np.diff(values)[best])]])


def _scored(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    """Batches (number, text) to (number, ratio of each model)."""
    for batch in pieces_of(batches, "t", 2 << 20):
        own = [m.ratios(batch.column(1)) for m in models]
        ratios = np.column_stack(own) if own else np.zeros((batch.num_rows, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(models), pa.int32()), pa.array(ratios.ravel(), pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["r", "ratios"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> list[Model]:
    """One model per class of raw text, from at most ``SAMPLE`` labelled documents of each class.

    The sample is the rows with the smallest hashes of the id. n-grams are counted in tasks and
    added up by Spark; only the buckets that tell the classes apart (``least``) reach the
    driver. A share of the sample is held back and sets each model's cut. A class without
    labelled documents gives no model; null labels and labels without a document are left out.
    """
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    marked = labels.select(F.col(key).cast("bigint").alias("r"), kind.alias("class")).filter("r is not null and class is not null")
    spread = F.xxhash64(F.lit("sample"), "r")
    picks = [marked.filter(F.col("class") == c).orderBy(spread, "r").limit(SAMPLE) for c in range(len(KINDS) + 1)]
    chosen = picks[0]
    for more in picks[1:]:
        chosen = chosen.unionByName(more)
    texts = docs.select(F.col(key).cast("bigint").alias("r"), F.col(text).alias("t")).filter("t is not null")
    # At most 12,000 rows of two numbers are broadcast.
    sample = stage(texts.join(F.broadcast(chosen), "r").withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "r"), F.lit(HELD)) == 0), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [{c: np.zeros(k.buckets, np.int32) for c in (0, k.raw)} for k in KINDS]
        for batch in pieces_of(batches, "t", 2 << 20):
            classes = batch.column(1).to_numpy(zero_copy_only=False)
            for k, own in zip(KINDS, sums):
                doc, gram = k.grams(batch.column(0))
                for c, total in own.items():
                    total += np.bincount(gram[classes[doc] == c], minlength=k.buckets).astype(np.int32)
        for i, own in enumerate(sums):
            for c, total in own.items():
                some = np.flatnonzero(total)
                for at in range(0, len(some), 1 << 18):
                    part = some[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), i, np.int32)), pa.array(part), pa.array(np.full(len(part), c != 0)), pa.array(total[part].astype(np.int64))],
                        ["model", "bucket", "raw", "n"],
                    )

    # The sample is bounded, so a fixed number of tasks counts it.
    counted = sample.filter("not held").select("t", "class").repartition(4).mapInArrow(count, "model int, bucket bigint, raw boolean, n bigint")
    sides = [F.sum(F.when(side, F.col("n")).otherwise(0)).alias(name) for name, side in (("target", ~F.col("raw")), ("other", F.col("raw")))]
    counts = stage(counted.groupBy("model", "bucket").agg(*sides), "quality-counts")
    totals = {r["model"]: (r["t"], r["o"]) for r in counts.groupBy("model").agg(F.sum("target").alias("t"), F.sum("other").alias("o")).collect()}
    sizes = {r["class"]: r["count"] for r in sample.filter("not held").groupBy("class").count().collect()}
    models = []
    for i, k in enumerate(KINDS):
        prior = max(1.0, sizes.get(k.raw, 0) / PER_COUNT)
        target, other = totals.get(i, (0, 0))
        if not target or not other:
            continue
        # Both models are brought to the smaller number of n-grams, so unseen ones favour neither.
        least = min(target, other)
        weight = F.log(F.col("target") * F.lit(least / target) + prior) - F.log(F.col("other") * F.lit(least / other) + prior)
        rows = counts.filter(F.col("model") == i).select("bucket", weight.alias("w")).filter(F.abs("w") >= k.least).toPandas()
        models.append(Model(k, rows["bucket"].to_numpy(), rows["w"].to_numpy().astype(np.float32)))
    held = sample.filter("held").select(F.col("class").cast("bigint").alias("r"), "t")
    found = held.mapInArrow(lambda b: _scored(b, models), "r bigint, ratios array<double>").toPandas()
    for i, model in enumerate(models):
        ratio = np.array([x[i] for x in found["ratios"]])
        model.cut = best_cut(ratio[found["r"] == 0], ratio[found["r"] == model.kind.raw])
    return models


def gumbel(key: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of seed and id."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def classify(docs: DataFrame, models: list[Model], text: str = "text", key: str = "doc_id", seed: int = 5) -> DataFrame:
    """Every row of ``docs`` with log_ratio, score and kept.

    log_ratio is the smallest of the models' log importance weights (target against raw text,
    0 at the cut). k is the number of rows whose log ratio is not negative, and kept are the k rows
    with the largest ``SHARPNESS * log_ratio + Gumbel noise``: a sample without replacement
    whose weights are the importance weights to that power. The noise comes from a hash of seed
    and id. The k-th score is found by a range shuffle of (row, score), not on the driver.

    Texts without n-grams that tell the classes apart, null and empty ones among them, hold nothing against them: their
    ratio is never below 0. Null ids share one noise; rows that tie with the k-th score all stay. Without models all ratios are 0 and
    all rows stay. Input columns named like the added ones are replaced.
    """
    own, names = plain(without(docs, ADDED))
    rows = numbered(own, "quality-rows")
    scored = rows.select(F.col(ROW).alias("r"), F.col(names[text]).alias("t")).mapInArrow(lambda b: _scored(b, models), "r bigint, ratios array<double>")
    ratios = stage(scored.select("r", F.coalesce(F.array_min("ratios"), F.lit(0.0)).alias("log_ratio")), "quality-ratios")
    noisy = rows.select(F.col(ROW).alias("r"), gumbel(names[key], seed).alias("noise")).join(ratios, "r")
    score = (F.col("log_ratio") * SHARPNESS + F.col("noise")).alias("score")
    k = ratios.filter("log_ratio >= 0").count()
    placed = positions(noisy.select("r", "log_ratio", score), [F.col("score").desc(), F.col("r")], "_at", "quality-scores")
    bound = placed.filter(F.col("_at") == k - 1).select("score").first()
    decided = placed.select("r", "log_ratio", "score", (F.col("score") >= bound["score"] if bound else F.lit(False)).alias("kept"))
    return rows.join(decided, F.col(ROW) == F.col("r")).select(*named(names), *ADDED)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 5) -> DataFrame:
    """The rows that :func:`classify` keeps, with the columns of ``docs``.

    Only the scores are written: the k-th one is the bound, and the rows are scored once more as
    they pass. Rows that tie with the k-th score all stay.
    """
    models = fit(docs, labels, text, key)
    own, names = plain(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = list(names).index(text)
        for batch in pieces_of(batches, names[text], 2 << 20):
            ratio = np.min([m.ratios(batch.column(at)) for m in models], axis=0) if models else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], [*batch.schema.names, "_ratio"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields], "_ratio double"])
    scored = own.mapInArrow(score, schema).withColumn("_score", F.col("_ratio") * SHARPNESS + gumbel(names[key], seed))
    scores = stage(scored.select(F.col("_ratio").alias("log_ratio"), F.col("_score").alias("score")), "quality-scores")
    k = scores.filter("log_ratio >= 0").count()
    placed = positions(scores.select("score"), [F.col("score").desc()], "_at", "quality-order")
    bound = placed.filter(F.col("_at") == k - 1).select("score").first()
    return scored.filter(F.col("_score") >= bound["score"] if bound else F.lit(False)).select(*named(names))


@query("op8_importance_resampling")
def op8(spark, sf_dir):
    """Every document's log importance weight, its score, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *ADDED)
