"""Exact top-k search by inner product, with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkscope.llm import query
from sparkscope.llm.common import stage, table

#: Pivots, vectors in a candidate block, queries in a query block, candidate blocks of a run, runs whose bounds are compared at once.
PIVOTS, BLOCK, QUERIES, RUN, PAIRED = 32, 1024, 256, 16, 256
#: Integer products below this add up exactly in double precision.
EXACT = 2**53


def whole(vector: str) -> F.Column:
    """floor(64 * x) of every component as an array of longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 64).cast("bigint"))


def usable(vector: str) -> F.Column:
    """Neither null nor holding null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros, which add nothing to a product."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 2**63:
        raise ValueError("inner products of these vectors don't fit a 64-bit integer")
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest one left."""
    left, out, far = list(range(1, len(pivots))), [0], distances(pivots, pivots)
    while left:
        out.append(min(left, key=lambda p: far[out[-1], p]))
        left.remove(out[-1])
    return pivots[out]


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id. ``least`` bounds what can still count from below."""

    def __init__(self, rows: np.ndarray, k: int, least: np.ndarray | None = None):
        self.rows, self.k = rows, k
        self.least = np.full(len(rows), -np.inf) if least is None else least
        self.score = np.full((len(rows), 0), 0, np.int64)
        self.of = np.full((len(rows), 0), 0, np.int64)
        self.have = np.zeros((len(rows), 0), bool)

    def floor(self) -> np.ndarray:
        """The k-th best score, or what is known of it where there are fewer."""
        if self.score.shape[1] < self.k:
            return self.least
        return np.maximum(self.least, np.where(self.have[:, self.k - 1], self.score[:, self.k - 1].astype(np.float64), -np.inf))

    def add(self, rows: np.ndarray, score: np.ndarray, of: np.ndarray, have: np.ndarray) -> None:
        score = np.concatenate([self.score[rows], score], 1)
        of = np.concatenate([self.of[rows], of], 1)
        have = np.concatenate([self.have[rows], have], 1)
        # Last key first: entries that are there, then high scores, then small ids.
        order = np.lexsort((of, -score, ~have), axis=1)[:, : self.k]
        width = max(order.shape[1], self.score.shape[1])
        if width > self.score.shape[1]:
            pad = ((0, 0), (0, width - self.score.shape[1]))
            self.score, self.of, self.have = np.pad(self.score, pad), np.pad(self.of, pad), np.pad(self.have, pad)
        self.score[rows, : order.shape[1]] = np.take_along_axis(score, order, 1)
        self.of[rows, : order.shape[1]] = np.take_along_axis(of, order, 1)
        self.have[rows, : order.shape[1]] = np.take_along_axis(have, order, 1)


def search(
    best: Best, queries: np.ndarray, to_pivots: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, table_: np.ndarray, step: int = 128
) -> int:
    """Go through one candidate block; returns how many products were evaluated.

    With p a pivot, the distance of q and x is at least |d(q, p) - d(x, p)|; the largest of these
    over all pivots bounds their product from above by (q.q + x.x - bound^2) / 2. Candidates are
    evaluated in the order of that bound; a query stops when the bound of its next one lies
    below its k-th score. A slack covers the rounding of the bounds, so none is lost.
    """
    own, theirs = (queries.astype(np.float64) ** 2).sum(1), (vectors.astype(np.float64) ** 2).sum(1)
    gap = np.zeros((len(queries), len(vectors)))
    for p in range(table_.shape[1]):
        np.maximum(gap, np.abs(to_pivots[:, p, None] - table_[None, :, p]), out=gap)
    upper = highest(own[:, None], theirs[None, :], gap)
    order = np.argsort(-upper, axis=1)
    done = 0
    for at in range(0, len(vectors), step):
        part = order[:, at : at + step]
        lead = np.take_along_axis(upper, part[:, :1], 1)[:, 0]
        left = np.flatnonzero(lead >= best.floor())
        if not len(left):
            break
        part = part[left]
        score = _chosen(queries[left], vectors, part)
        done += part.size
        best.add(left, score, ids[part], rows[part] != best.rows[left, None])
    return done


def highest(own: np.ndarray, theirs: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The highest product of vectors with these squared lengths that are at least ``gap`` apart, and a slack."""
    return (own + theirs - gap * gap) / 2 + 1 + 1e-9 * (own + theirs)


def _chosen(queries: np.ndarray, vectors: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Products of each query with its own choice of vectors."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound >= 2**63:
        raise ValueError("inner products of these vectors don't fit a 64-bit integer")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < EXACT else np.int64
    picked = vectors.astype(kind)[part]
    return np.matmul(picked, queries.astype(kind)[:, :, None])[:, :, 0].astype(np.int64)


class Run:
    """What bounds the products of the queries of one run with the candidates of another: ranges of pivot distances, greatest lengths."""

    def __init__(self, to_pivots: np.ndarray, squares: np.ndarray):
        far = to_pivots if len(to_pivots) else np.zeros((1, to_pivots.shape[1]))
        self.low, self.high, self.square = far.min(0), far.max(0), float(squares.max(initial=0))

    def tobytes(self) -> bytes:
        return np.concatenate([self.low, self.high, [self.square]]).tobytes()


def reach(queries: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The highest product of the queries of one run (a row of :class:`Run`) with the candidates of each other one."""
    width = len(queries) // 2
    gap = np.maximum(queries[:width] - runs[:, width : 2 * width], runs[:, :width] - queries[width : 2 * width])
    return highest(queries[-1], runs[:, -1], np.maximum(gap, 0).max(1, initial=0))


#: Rows of a run: its queries (0), its candidates (1), their bounds (2).
PACK = "run bigint, side int, b int, rows binary, ids binary, vectors binary, pivots binary"
ASKED = "run bigint, b int, rows binary, ids binary, vectors binary, pivots binary, floors binary, least double, found array<struct<row: bigint, query_id: bigint, vec_id: bigint, score: bigint>>"


def _found(best: Best, ids: np.ndarray) -> pa.ListArray:
    q, c = np.nonzero(best.have)
    columns = [best.rows[q], ids[q], best.of[q, c], best.score[q, c]]
    rows = pa.StructArray.from_arrays([pa.array(x) for x in columns], names=["row", "query_id", "vec_id", "score"])
    return pa.ListArray.from_arrays([0, len(q)], rows)


def _open(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
    return rows, ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), width), np.frombuffer(row["pivots"]).reshape(len(ids), -1)


def _met(batches: Iterator[pa.RecordBatch], key: str, width: int, k: int) -> Iterator[tuple[dict, Best, np.ndarray]]:
    """For each value of ``key``, its query blocks (side 0, first) with their best after all its candidate blocks (side 1)."""
    value, open_ = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row[key] != value:
                yield from ((head, best, ids) for head, best, ids, _, _ in open_)
                value, open_ = row[key], []
            rows, ids, matrix, to_pivots = _open(row, width)
            if row["side"] == 0:
                least = np.frombuffer(row["floors"]) if row.get("floors") else None
                open_.append((row, Best(rows, k, least), ids, matrix, to_pivots))
            else:
                for _, best, _, queries, own in open_:
                    search(best, queries, own, rows, ids, matrix, to_pivots)
    yield from ((head, best, ids) for head, best, ids, _, _ in open_)


def _runs(rows: DataFrame, pivots: np.ndarray, width: int, every: int) -> DataFrame:
    """The vectors in runs of neighbours, written: placed by their nearest pivot and the distance to it, cut into blocks."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_matrix(batch.column(1), width), pivots)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(far)), near])], [*batch.schema.names, "near", "far"])

    def one(run: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(held).combine_chunks()
        ids, matrix, at = own.column(0).to_numpy(), _matrix(own.column(1).combine_chunks(), width), own.column(2).to_numpy()
        far, squares = distances(matrix, pivots), (matrix.astype(np.float64) ** 2).sum(1)
        asked = np.flatnonzero(ids % every == 0)
        out = [(1, np.arange(a, min(a + BLOCK, len(ids)))) for a in range(0, len(ids), BLOCK)]
        out += [(0, asked[a : a + QUERIES]) for a in range(0, len(asked), QUERIES)]
        for b, (side, rows_) in enumerate(out):
            blobs = [x[rows_].tobytes() for x in (at, ids, matrix, far)]
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([side], pa.int32()), pa.array([b], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names)
        bounds = [Run(far, squares).tobytes(), Run(far[asked], squares[asked]).tobytes()]
        blobs = [b"", b"", *bounds]
        yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([2], pa.int32()), pa.array([0], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names)

    names = ["run", "side", "b", "rows", "ids", "vectors", "pivots"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, RUN * BLOCK - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == RUN * BLOCK:
                    yield from one(run, held)
                    run, held, n = run + 1, [], 0
        if held:
            yield from one(run, held)

    order = ["near", "far", "at"]
    near = rows.select("id", "v", "at").mapInArrow(placed, "id bigint, v array<bigint>, at bigint, near int, far double")
    return stage(near.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v", "at").mapInArrow(cut, PACK), "runs")


def _pairs(runs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(q, r): runs whose queries may find a better one among the candidates of another run, by their bounds alone; written.

    Bounds travel in packs of ``PAIRED`` runs, so a task holds one pack and streams through the queries' runs.
    """
    bounds = runs.filter("side = 2").select("run", F.col("vectors").alias("all"), F.col("pivots").alias("own"))
    packs = max(1, -(-bounds.count() // PAIRED))
    heads = asked.groupBy("run").agg(F.min("least").alias("least")).join(bounds.select("run", F.col("own").alias("bound")), "run")
    one = bounds.select(F.pmod(F.xxhash64("run"), F.lit(packs)).alias("pack"), F.lit(0).alias("side"), "run", F.col("all").alias("bound"), F.lit(0.0).alias("least"))
    two = heads.select(F.explode(F.sequence(F.lit(0), F.lit(packs - 1)).cast("array<bigint>")).alias("pack"), F.lit(1).alias("side"), "run", "bound", "least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, names, held = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    pack, names, held = row["pack"], [], []
                bound = np.frombuffer(row["bound"])
                if row["side"] == 0:
                    names.append(row["run"])
                    held.append(bound)
                    continue
                if isinstance(held, list):
                    held = np.array(held).reshape(len(names), -1)
                hit = [r for r, high in zip(names, reach(bound, held) if names else []) if high >= row["least"] and r != row["run"]]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array([row["run"]] * len(hit)), pa.array(hit)], ["q", "r"])

    both = one.unionByName(two).repartition("pack").sortWithinPartitions("pack", "side")
    return stage(both.mapInArrow(work, "q bigint, r bigint"), "pairs")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query with every other row: query_id, rank, vec_id, score.

    Components become floor(64 * x). Queries are the rows whose id is divisible by ``every``; every
    row but the query's own is a candidate. Equal scores go to the smaller id.

    Vectors lie in runs of neighbours with the table of their distances to a fixed number of pivots.
    The queries of a run first meet the candidates of their own run, which gives each a floor. The ranges of
    the runs' pivot distances then tell which other runs can hold anything at or above a floor; only those are
    shipped, by a shuffle on (run of the queries, run of the candidates), and searched block by block, best bound first. No
    side is broadcast; a task holds the queries of one run and streams through the blocks of another.
    Tasks give at most ``k`` rows a query; the best of them per query follow. Where vectors have no
    clusters the bounds exclude little and nearly every run is shipped to every other one. Copies of one vector that hold a
    large share of all rows only make ties, cut to ``k`` in each block.

    Null vectors, vectors with null or non-finite components and rows with a null id take no
    part; shorter vectors are filled with zeros. Rows with the same id are queries of their own, each with ranks from 1, and
    candidates of each other. Scores beyond 64 bits raise an error. An empty table gives an empty result.
    """
    good = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & usable("v"))
    rows = stage(good.select("id", whole("v").alias("v")).withColumn("at", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.col("id").alias("score"))
    # Pivots: the rows with the smallest hashes, a fixed number.
    found = rows.orderBy(F.xxhash64("at")).limit(PIVOTS).select("v").collect()
    pivots = chain(_matrix(pa.array([r["v"] for r in found], pa.list_(pa.int64())), width))
    runs = _runs(rows, pivots, width, every)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, best, ids in _met(batches, "run", width, k):
            floor = best.floor()
            blobs = [pa.array([row[c]], pa.binary()) for c in ("rows", "ids", "vectors", "pivots")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["run"]]), pa.array([row["b"]], pa.int32()), *blobs, pa.array([floor.tobytes()], pa.binary()), pa.array([float(floor.min())]), _found(best, ids)],
                ["run", "b", "rows", "ids", "vectors", "pivots", "floors", "least", "found"],
            )

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, best, ids in _met(batches, "cell", width, k):
            yield pa.RecordBatch.from_arrays([_found(best, ids)], ["found"])

    home = runs.filter("side < 2").repartition("run").sortWithinPartitions("run", "side", "b")
    asked = stage(home.mapInArrow(at_home, ASKED), "queries")
    pairs = _pairs(runs, asked, width)
    cell = F.concat_ws("/", "q", "r").alias("cell")
    left = pairs.join(asked, F.col("q") == F.col("run")).select(cell, F.lit(0).alias("side"), "b", "rows", "ids", "vectors", "pivots", "floors")
    right = pairs.join(runs.filter("side = 1"), F.col("r") == F.col("run")).select(
        cell, "side", "b", "rows", "ids", "vectors", "pivots", F.lit(None).cast("binary").alias("floors")
    )
    spread = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side", "b")
    schema = "found array<struct<row: bigint, query_id: bigint, vec_id: bigint, score: bigint>>"
    every_ = asked.select("found").unionByName(spread.mapInArrow(elsewhere, schema)).select(F.explode("found").alias("x")).select("x.*")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return every_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")


@query(
    "op3_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
               FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
    """,
)
def op3(spark, sf_dir):
    """The twenty best of every twentieth vector."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
