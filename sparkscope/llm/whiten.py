"""Embedding whitening from an exact, bit-sliced scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import named, plain, stage, table, without
from sparkscope.llm.topk import usable

#: Rows whose bits are packed at once (a multiple of 64), and planes of other dimensions that one step takes on.
BLOCK, STEP = 8192, 128
ADDED = ("deviation", "whitened")


def whole(vector: str, scale: int = 1024, shift: int = 100_000) -> F.Column:
    """floor(scale * c) + shift of every component as an array of longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift)


def matrix(lists: pa.Array, width: int, shift: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros, which are ``shift`` here."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(sizes), width), shift, np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def planes(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit planes of non-negative rows: words [dimension, plane, row / 64], and how many planes there are."""
    bits = max(1, int(y.max(initial=0)).bit_length())
    rows, width = y.shape
    padded = np.zeros((-(-rows // 64) * 64, width), np.uint64)
    padded[:rows] = y.astype(np.uint64)
    out = np.empty((width, bits, len(padded) // 64), np.uint64)
    for b in range(bits):
        plane = (padded >> np.uint64(b)).astype(np.uint8) & 1
        out[:, b] = np.packbits(np.ascontiguousarray(plane.T), axis=1).view(np.uint64)
    return out, bits


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products of the integer columns of one block of rows.

    Columns are shifted by their minimum and cut into bit planes. The product sum of two columns is
    the sum over all pairs of planes of 2^(a+b) times the number of rows that have both bits,
    the popcount of an AND; the shift is taken out of the totals. Sums of plane pairs with the same a + b fit
    a long; they are weighted as Python integers, so no range of values overflows.
    """
    rows, width = x.shape
    low = x.min(0, initial=0) if not rows else x.min(0)
    packed, bits = planes(x - low)
    # Counts by a + b: the planes of one dimension at a time against those of all dimensions from it on.
    products = [[0] * width for _ in range(width)]
    ones = np.bitwise_count(packed).sum(2, dtype=np.int64)
    sums = [sum(int(ones[d, a]) << a for a in range(bits)) for d in range(width)]
    narrow = 2 * bits + rows.bit_length() < 62
    weights = np.array([[1 << (a + b) for b in range(bits)] for a in range(bits)], np.int64 if narrow else object)
    for d in range(width):
        for at in range(d, width, max(1, STEP // bits)):
            part = packed[at : at + max(1, STEP // bits)]
            both = np.bitwise_count(packed[d][:, None, None, :] & part[None]).sum(3, dtype=np.int64)
            counts = both.transpose(1, 0, 2)  # other dimension, own plane, its plane
            totals = (counts * weights).sum((1, 2)) if narrow else (counts.astype(object) * weights).sum((1, 2))
            for k, total in enumerate(totals):
                products[d][at + k] = int(total)
    low = [int(v) for v in low]
    for d in range(width):
        for e in range(d, width):
            products[d][e] += low[e] * sums[d] + low[d] * sums[e] + rows * low[d] * low[e]
    return [s + rows * m for s, m in zip(sums, low)], products


@dataclass
class Whitening:
    """Sums and components of a fit list. ``axes`` has one unit eigenvector a column, by falling ``values``."""

    rows: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    scale: int = 1024
    shift: int = 100_000

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def flat(self) -> np.ndarray:
        """Which components have no variance: their values are rounding errors of the others."""
        top = float(self.values[0]) if len(self.values) else 0.0
        return self.values <= max(top, 0.0) * 1e-13 * max(1, len(self.sums))


def eigen(rows: int, sums: list[int], products: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k first eigenvectors and values of the covariance (divisor n), centred in integers first."""
    width = len(sums)
    cov = np.zeros((width, width))
    for d in range(width):
        for e in range(d, width):
            cov[d, e] = cov[e, d] = (rows * products[d][e] - sums[d] * sums[e]) / (rows * rows)
    values, axes = np.linalg.eigh(cov)
    first = np.argsort(-values, kind="stable")[:k]
    return axes[:, first], values[first], float(np.trace(cov))


def _good(vectors: DataFrame, vector: str, scale: int, shift: int) -> DataFrame:
    return vectors.filter(usable(vector)).withColumn("_x", whole(vector, scale, shift))


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """The whitening of all usable vectors (neither null nor holding null or non-finite entries); None without any.

    Entries become floor(scale * c) + shift. Tasks give exact sums and products of blocks of ``BLOCK`` rows, summed in each task and then per
    pair of dimensions by partial aggregates; the driver gets one number a pair of dimensions, however many rows
    there are, and centres them as integers before it asks for eigenvectors.
    """
    own, names = plain(vectors)
    x = _good(own, names[vector], scale, shift).select("_x")
    width = x.agg(F.max(F.size("_x"))).first()[0]
    if not width:
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
        for batch in batches:
            values = matrix(batch.column(0), width, shift)
            for at in range(0, len(values), BLOCK):
                part = values[at : at + BLOCK]
                s, p = scatter(part)
                rows += len(part)
                sums = [a + b for a, b in zip(sums, s)]
                products = [[a + b for a, b in zip(u, v)] for u, v in zip(products, p)]
        if rows:
            pairs = [(-1, -1, rows), *[(d, -1, s) for d, s in enumerate(sums)]]
            pairs += [(d, e, products[d][e]) for d in range(width) for e in range(d, width)]
            i, j, total = zip(*pairs)
            # Sums may pass 64 bits: 30 bits and the rest, each exact as a decimal.
            high, low = [t >> 30 for t in total], [t & (2**30 - 1) for t in total]
            wide = pa.decimal128(38, 0)
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high).cast(wide) if max(map(abs, high)) < 2**63 else pa.array(high, wide), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "high", "low"])

    parts = x.mapInArrow(work, "i int, j int, high decimal(38,0), low bigint")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    totals = {(r["i"], r["j"]): (int(r["high"]) << 30) + int(r["low"]) for r in found}
    rows = totals[-1, -1]
    sums = [totals[d, -1] for d in range(width)]
    products = [[totals.get((d, e), 0) for e in range(width)] for d in range(width)]
    return Whitening(rows, sums, *eigen(rows, sums, products, k), scale, shift)


def squares(u: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of longs."""
    if float(np.abs(u).max(initial=0)) ** 2 * max(1, u.shape[1]) < 2**62:
        return (u * u).sum(1).tolist()
    high, low = u >> 31, u & (2**31 - 1)
    # Halves of 31 bits; their products are split once more, so that sums over dimensions stay below 2^63.
    terms = [(high * high, 62), (high * low, 32), (low * low, 0)]
    out = [0] * len(u)
    for term, shift in terms:
        up, down = (term >> 31).sum(1).tolist(), (term & (2**31 - 1)).sum(1).tolist()
        out = [o + (((a << 31) + b) << shift) for o, a, b in zip(out, up, down)]
    return out


def whiten(vectors: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with deviation decimal(38, 0) and whitened array<double>, one entry a component.

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2. A component without variance
    (a constant column, or fewer rows than dimensions) has no whitened form: its entries are null. Vectors shorter than the longest
    end in zeros; entries beyond a vector's fitted width are ignored. Null ids, repeated rows and ids are
    rows like others. Entries over about 2^53 / scale are out of reach. Without a model (no usable row) the result is empty.
    Input columns named like the added ones are replaced; all others are returned as they are.
    """
    own, names = plain(without(vectors, ADDED))
    scale, shift = (model.scale, model.shift) if model else (1, 0)
    good = _good(own, names[vector], scale, shift)
    if model is None:
        return good.filter(F.lit(False)).select(*named(names), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    width = len(model.sums)
    n, total = model.rows, np.array(model.sums, object)
    flat = model.flat()
    axes = model.axes[:, ~flat] / np.sqrt(model.values[~flat])
    schema = F.struct(*[F.col(c) for c in own.columns]).alias("row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), max(width, 1), shift)[:, :width] if len(batch) else np.zeros((0, width), np.int64)
            if n * float(np.abs(x).max(initial=0)) + float(max(map(abs, total))) < 2**62:
                u = x * n - total.astype(np.int64)
                deviation, centred = squares(u), u / n
            else:
                u = x.astype(object) * n - total
                deviation, centred = (u * u).sum(1).tolist(), (u / n).astype(np.float64)
            values = np.full((len(x), len(flat)), np.nan)
            values[:, ~flat] = centred @ axes
            lists = pa.ListArray.from_arrays(
                np.arange(len(x) + 1, dtype=np.int32) * len(flat), pa.array(values.ravel(), mask=np.tile(flat, len(x)))
            )
            # Two columns join the row as it is.
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(str, deviation), pa.string()), lists], ["row", "deviation", "whitened"])

    fields = own.schema.simpleString()
    out = good.select(schema, F.col("_x")).mapInArrow(work, f"row {fields}, deviation string, whitened array<double>")
    return out.select(
        *[F.col("row").getField(c).alias(old) for old, c in names.items()], F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened"
    )


def identity_error(whitened: DataFrame, column: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of all whitened rows, less the identity.

    Means and products of whitened entries are partial sums per pair of components; components without variance stay out.
    """
    parts = whitened.select(F.posexplode(column).alias("i", "a"), F.col(column).alias("w")).filter("a IS NOT NULL")
    pairs = parts.select("i", "a", F.posexplode("w").alias("j", "b")).filter("b IS NOT NULL AND i <= j")
    sums = pairs.groupBy("i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("p"), F.avg("a").alias("a"), F.avg("b").alias("b")).collect()
    return max((abs(r["p"] - r["a"] * r["b"] - (r["i"] == r["j"])) for r in sums), default=None)


@query("op13_whitened")
def op13(spark, sf_dir):
    """Eight whitened components of every usable embedding, with exact deviations."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    rows = stage(whiten(vectors, model).select("vec_id", "deviation", "whitened"), "whitened")
    error = identity_error(rows)
    explained = F.array(*[F.lit(v).cast("double") for v in (model.explained() if model else [])]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.rows if model else 0).cast("bigint").alias("n"),
        F.col("deviation").cast("bigint").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
