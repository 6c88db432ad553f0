"""Near-duplicate join on word shingles: parity sketches, compared block by block within size bands."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkscope.llm import query
from sparkscope.llm.chunks import ANSWER, DOCS, NOTE, answered, array_of, at_chunks, bucket_bits, by_bucket, chunked, in_set, messages, notes, unpack
from sparkscope.llm.common import Words, drop, mix, positions, recorded, shingle_hashes, stage, table
from sparkscope.operators import ordered
from sparkscope.operators.graph import components

WIDTH = 5
#: Two texts link when 100 * shared >= 80 * all shingles: when 5 * shared >= 4 * all.
SHARED, ALL = 5, 4
#: Documents under one key beyond which they are compared in blocks; shingles in a block; columns of a matrix.
CROWD, BLOCK, STRIP = 64, 65_536, 4096
#: Documents in a block; rows of a matrix that are judged at a time.
DOCS_IN_BLOCK, ROWS = 1024, 256
#: Keys are numbered from here on where they are nodes beside documents.
KEYS = 1 << 62
_U = np.uint64


def bands(limit: int = 1 << 40) -> np.ndarray:
    """The least set size of each band; a size and its largest partner lie in one band or in neighbours."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 8 // 5)))
    return np.array(out, np.int64)


_LEAST = bands()


class Shingles:
    """The shingle sets of a chunk's texts: ``hash[first[i]:first[i + 1]]`` is ascending and distinct."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        count = np.diff(words.first)
        long = shingle_hashes(words.hash, WIDTH)
        parts, sizes = [], np.zeros(len(count), np.int64)
        for i, (a, n) in enumerate(zip(words.first[:-1].tolist(), count.tolist())):
            if n >= WIDTH:
                own = np.sort(long[a : a + n - WIDTH + 1])
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            elif n:
                own = shingle_hashes(words.hash[a : a + n], n) ^ _U(n)
            else:
                continue
            sizes[i] = len(own)
            parts.append(own)
        self.size = sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.hash = np.concatenate(parts) if parts else np.zeros(0, _U)


class Sketches:
    """Parity sketches of some of a chunk's sets, one per (set, band) it may meet partners in.

    A band's sketch has a fixed number of 64-bit blocks. Every shingle flips bits of the one
    block its hash names (it XORs its hash into it), so two sketches differ in at most as many
    blocks as the sets differ in shingles. Partners differ in at most (n + m) / 9 shingles, and
    a sketch has more blocks than that: partners agree in at least ``need`` blocks that are not
    zero. Where too many blocks are zero for that, ``need`` is 0 and a key that all such sets of
    the band share stands in.
    """

    def __init__(self, sets: Shingles, chosen: np.ndarray):
        n = sets.size
        band = np.searchsorted(_LEAST, n, "right") - 1
        docs, own_bands = [], []
        for up in (0, 1):
            which = np.flatnonzero(chosen & (n > 0) & ((up == 0) | (n * SHARED // ALL >= _LEAST[band + 1])))
            docs.append(which)
            own_bands.append(band[which] + up)
        self.doc, self.band = np.concatenate(docs), np.concatenate(own_bands)
        size, most = n[self.doc], _LEAST[self.band + 1] - 1
        spare = 2 * most // 9 + 1
        blocks = spare + (spare + 9) // 10 + 2
        base = np.concatenate([[0], np.cumsum(blocks)])
        slot = np.repeat(np.arange(len(size)), size)
        token = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + sets.first[self.doc][slot]
        hash_ = sets.hash[token]
        block = ((hash_ >> _U(32)) * blocks[slot].astype(_U)) >> _U(32)
        held = np.zeros(int(base[-1]), _U)
        np.bitwise_xor.at(held, base[:-1][slot] + block.astype(np.int64), hash_)
        owner = np.repeat(np.arange(len(size)), blocks)
        some = np.flatnonzero(held)
        place = some - base[:-1][owner[some]]
        self.owner = owner[some]
        self.key = mix(held[some] ^ mix((self.band[self.owner].astype(_U) << _U(40)) | place.astype(_U)))
        zero = blocks - np.bincount(self.owner, minlength=len(size))
        # The most that a partner in this band can differ by.
        self.need = blocks - (size + np.minimum(most, size * SHARED // ALL)) // 9 - zero
        loose = np.flatnonzero(self.need <= 0)
        self.key = np.concatenate([self.key, mix(~mix(self.band[loose].astype(_U)))])
        self.owner = np.concatenate([self.owner, loose])


def _several(rows: list[dict]) -> list[tuple]:
    """Of each chunk's keys those that occur more than once anywhere, with the number of chunks."""
    sizes = [len(r["a"]) // 8 for r in rows]
    keys = array_of(rows, "a", _U)
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8))[:n] for r, n in zip(rows, sizes)])
    known, which = np.unique(keys, return_inverse=True)
    chunks = np.bincount(which, minlength=len(known))
    often = (chunks + np.bincount(which, weights=twice, minlength=len(known)) > 1)[which]
    out, at = [], 0
    for r, n in zip(rows, sizes):
        own = np.flatnonzero(often[at : at + n]) + at
        if len(own):
            out.append((r["chunk"], ANSWER, r["bucket"], keys[own], chunks[which[own]].astype(np.uint32), None))
        at += n
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def candidates(chunks: DataFrame, info: DataFrame, text: str) -> DataFrame:
    """A written table of two kinds of rows: (key, doc, n) and, for each such doc, (doc, n, shingles).

    Documents that link share at least one key. Of a sketch's blocks only those that another
    document has too can agree; a sketch that has fewer of them than it needs is out. Of the
    others all but ``need - 1`` are kept, the rarest first, in one order for all documents, so
    the blocks of passages that many texts share are the ones left out, and no link is lost.
    """
    bits = bucket_bits(chunks)

    def chosen(sets: Shingles, by: dict) -> tuple[np.ndarray, np.ndarray]:
        note = array_of(by[NOTE], "a", np.int64).reshape(-1, 3)
        order, mine = np.zeros(len(sets.size), np.int64), np.zeros(len(sets.size), bool)
        order[note[:, 0]], mine[note[:, 0]] = note[:, 1], note[:, 2] == 1
        return order, mine

    def ask(chunk: int, by: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        for row in by.get(DOCS, []):
            sets = Shingles(_column(unpack(row["a"]), text))
            keys, counts = np.unique(Sketches(sets, chosen(sets, by)[1]).key, return_counts=True)
            out: list[tuple] = []
            by_bucket(out, chunk, ANSWER, bits, keys, counts > 1)
            yield messages([(*x[:4], np.packbits(x[4]), None) for x in out])

    shared = answered(at_chunks([info, chunks], ask, chunks.schema), _several, "near-shared")

    def keep(chunk: int, by: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        known, often = array_of(by.get(ANSWER, []), "a", _U), array_of(by.get(ANSWER, []), "b", np.uint32)
        sort = np.argsort(known)
        known, often = known[sort], often[sort]
        for row in by.get(DOCS, []):
            sets = Shingles(_column(unpack(row["a"]), text))
            order, mine = chosen(sets, by)
            sketch = Sketches(sets, mine)
            live = in_set(sketch.key, known)
            key, owner = sketch.key[live], sketch.owner[live]
            if not len(key):
                continue
            rare = np.lexsort((key, often[np.searchsorted(known, key)], owner))
            key, owner = key[rare], owner[rare]
            count = np.bincount(owner, minlength=len(sketch.doc))
            rank = np.arange(len(key)) - (np.cumsum(count) - count)[owner]
            kept = rank < np.where(sketch.need > 0, count - sketch.need + 1, count)[owner]
            key, doc = key[kept], sketch.doc[owner[kept]]
            if not len(key):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(order[doc]), pa.array(sets.size[doc]), pa.nulls(len(key), pa.binary())], ["key", "doc", "n", "shingles"]
            )
            docs = np.unique(doc)
            blobs = pa.array([sets.hash[sets.first[d] : sets.first[d + 1]].tobytes() for d in docs.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(docs), pa.int64()), pa.array(order[docs]), pa.array(sets.size[docs]), blobs], ["key", "doc", "n", "shingles"])

    return stage(at_chunks([info, shared, chunks], keep, "key bigint, doc bigint, n bigint, shingles binary"), "near-candidates")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their whole sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_buffer(), _U), np.frombuffer(two.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                shared = int(in_set(x, y).sum())
                links.append(SHARED * shared >= ALL * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(links, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    side = lambda name: sets.select(F.col("doc").alias(name), F.col("shingles").alias(f"s_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b")
    return both.mapInArrow(work, "a bigint, b bigint")


def linked(candidates_: DataFrame) -> DataFrame:
    """doc and component (both order numbers) of all documents that link with another.

    Documents under one key are not compared all with all. In each round some of them, more in
    every round, are leaders; each document is compared with the leaders of its keys unless
    links join both to one document already. Leaders are then done, and so is a key whose
    remaining documents are all joined to one. The rounds end when no key has two documents
    left, so every pair under a key has either been compared or joined.
    """
    sets = candidates_.filter("key is null")
    members = candidates_.filter("key is not null").select("key", "doc", "n", F.col("doc").alias("joined"))
    found: list[DataFrame] = []
    leaders_per_key, before = 1, []
    while True:
        with recorded() as made:
            members = stage(_led(members, leaders_per_key), "near-members")
        if members.isEmpty():
            break
        if found:
            many = members.filter(F.col("size") > CROWD)
            if not many.isEmpty():
                found.append(stage(crowded(many, sets), "near-crowds"))
            members = members.filter(F.col("size") <= CROWD)
        met = members.select("doc", "n", "joined", F.explode("leaders").alias("l")).filter("joined <> l.joined and 5 * least(n, l.n) >= 4 * greatest(n, l.n)")
        pairs = met.select(F.least("doc", "l.doc").alias("a"), F.greatest("doc", "l.doc").alias("b")).distinct()
        found.append(stage(verified(pairs, sets), "near-links"))
        left = members.filter(~F.array_contains("leaders.doc", F.col("doc"))).select("key", "doc", "n")
        members = left.join(_joined(reduce(DataFrame.unionByName, found)), "doc", "left").select("key", "doc", "n", F.coalesce("joined", "doc").alias("joined"))
        # Written, as both the keys' leaders and their documents are taken from it; then the round's other tables can go.
        with recorded() as left_:
            members = stage(members, "near-left")
        drop(sets.sparkSession, before + made)
        before = left_
        leaders_per_key *= 4
    if not found:
        return candidates_.select("doc", F.col("doc").alias("component")).limit(0)
    return components(reduce(DataFrame.unionByName, found)).select(F.col("node").alias("doc"), "component")


def _led(members: DataFrame, leaders: int) -> DataFrame:
    """``members`` of the keys whose documents are not all joined to one, with the key's size and its leaders.

    A key's documents fall in ``leaders`` slots by their hash, and the smallest of each slot leads.
    """
    first = [F.min("doc").alias("doc"), F.min_by("n", "doc").alias("n"), F.min_by("joined", "doc").alias("j")]
    many = [F.count(F.lit(1)).alias("size"), F.min("joined").alias("low"), F.max("joined").alias("high")]
    lead = F.struct("doc", "n", F.col("j").alias("joined"))
    if leaders == 1:
        keys = members.groupBy("key").agg(*many, *first).withColumn("leaders", F.array(lead))
    else:
        slots = members.groupBy("key", F.pmod(F.xxhash64("doc", F.lit(leaders)), F.lit(leaders)).alias("slot")).agg(*many, *first)
        keys = slots.groupBy("key").agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(lead).alias("leaders"))
    return members.join(keys.filter("size > 1 and low <> high").select("key", "size", "leaders"), "key")


def crowded(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (document, smallest document it reaches within a cell) among documents under crowded keys.

    Documents that crowded keys connect form a crowd. A crowd is sorted by set size and cut into
    blocks of about ``BLOCK`` shingles and at most ``DOCS_IN_BLOCK`` documents; a cell is a pair
    of blocks whose sizes allow links. A task holds one cell, multiplies the incidence matrices
    of its two blocks for the exact sizes of all intersections, and returns at most one row per
    document, never the pairs.
    """
    # Keys are nodes, too, above all documents; keys that meet there only widen a crowd.
    edges = members.select(F.col("doc").alias("a"), F.expr(f"shiftrightunsigned(key, 2) | {KEYS}L").alias("b"))
    crowds = components(edges).filter(F.col("node") < KEYS).select(F.col("node").alias("doc"), F.col("component").alias("crowd"))
    docs = members.select("doc", "n").distinct().join(crowds, "doc")
    # A document weighs so much at least that a block's weight bounds its documents too.
    weighed = docs.withColumn("weight", F.greatest("n", F.lit(-(-BLOCK // DOCS_IN_BLOCK)).cast("bigint")))
    placed = ordered.cumulative(weighed, ["crowd"], ["n", "doc"], "weight", "before", "whole")
    blocks = stage(placed.select("crowd", "doc", "n", F.expr(f"before div {BLOCK}").alias("block")), "near-blocks")
    spans = stage(blocks.groupBy("crowd", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "near-spans")
    one = spans.select("crowd", F.col("block").alias("i"), F.col("high").alias("most"))
    two = spans.select("crowd", F.col("block").alias("j"), F.col("low").alias("least"))
    cells = one.join(two, "crowd").filter(f"i <= j and {SHARED} * most >= {ALL} * least").select("crowd", "i", "j")
    ends = F.array_distinct(F.array("i", "j"))
    wanted = cells.select("crowd", "i", F.concat_ws("/", "crowd", "i", "j").alias("cell"), F.explode(ends).alias("block"))
    rows = sets.join(blocks.select("doc", "crowd", "block"), "doc").join(wanted, ["crowd", "block"]).select("cell", "doc", "shingles", (F.col("block") != F.col("i")).alias("other"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [])
        for batch in batches:
            for name, doc, blob, other in zip(*(c.to_pylist() for c in batch.columns)):
                if name != cell and held[0]:
                    yield _reached(*held)
                    held = ([], [])
                cell = name
                held[other].append((doc, np.frombuffer(blob, _U)))
        if held[0]:
            yield _reached(*held)

    return rows.repartition("cell").sortWithinPartitions("cell", "doc").mapInArrow(work, "a bigint, b bigint")


def _incidence(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set and place in ``known`` of all shingles that are known, by place."""
    all_, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    live = in_set(all_, known)
    row, column = row[live], np.searchsorted(known, all_[live])
    by = np.argsort(column, kind="stable")
    return row[by], column[by]


def _linking(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``one`` links with each of ``two``, a byte a pair."""
    same = one is two
    known, often = np.unique(np.concatenate(one), return_counts=True)
    # Only shingles that can meet count; they are numbered anew and taken in strips.
    known = known[often > 1] if same else known[in_set(known, np.unique(np.concatenate(two)))]
    sides = [_incidence(one, known)]
    sides.append(sides[0] if same else _incidence(two, known))
    shared = np.zeros((len(one), len(two)), np.int32)
    for at in range(0, len(known), STRIP):
        width = min(STRIP, len(known) - at)
        strips = []
        for (row, column), n in zip(sides, shared.shape):
            a, b = np.searchsorted(column, [at, at + width])
            strip = np.zeros((n, width), np.float32)
            strip[row[a:b], column[a:b] - at] = 1
            strips.append(strip)
        for a in range(0, len(one), ROWS):
            # A product counts to STRIP at most, which a float32 holds exactly.
            shared[a : a + ROWS] += (strips[0][a : a + ROWS] @ strips[1].T).astype(np.int32)
    n, m = (np.array([len(s) for s in side], np.int64) for side in (one, two))
    links = np.zeros(shared.shape, bool)
    for a in range(0, len(one), ROWS):
        part = shared[a : a + ROWS].astype(np.int64)
        links[a : a + ROWS] = SHARED * part >= ALL * (n[a : a + ROWS, None] + m[None, :] - part)
    return links


def _reached(one: list[tuple[int, np.ndarray]], two: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """(smallest document reached, document) by links within one block or, with ``two``, between two blocks."""
    same = not two
    two = one if same else two
    docs, others = (np.array([d for d, _ in side], np.int64) for side in (one, two))
    sets = [s for _, s in one]
    links = _linking(sets, sets if same else [s for _, s in two])
    if same:
        np.fill_diagonal(links, False)
    seen, met = np.zeros(len(docs), bool), np.zeros(len(others), bool)
    low: dict[int, int] = {}
    for row in np.flatnonzero(links.any(axis=1)).tolist():
        if seen[row]:
            continue
        # Breadth first between the two sides; every row and column is taken once.
        new, rows, columns = np.array([row]), [], []
        while len(new):
            seen[new] = True
            rows.append(new)
            reach = np.flatnonzero(links[new].any(axis=0) & ~met)
            met[reach] = True
            columns.append(reach)
            new = np.flatnonzero(links[:, reach].any(axis=1) & ~seen)
        whole = np.union1d(docs[np.concatenate(rows)], others[np.concatenate(columns)])
        low.update(dict.fromkeys(whole[1:].tolist(), int(whole[0])))
    return pa.RecordBatch.from_arrays([pa.array(list(low.values()), pa.int64()), pa.array(list(low), pa.int64())], ["a", "b"])


def _joined(links: DataFrame) -> DataFrame:
    """The smallest document that a document links to, or the smallest that one links to."""
    one = links.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("up"))
    two = one.select(F.col("doc").alias("up"), F.col("up").alias("top"))
    return one.join(two, "up", "left").select("doc", F.coalesce("top", "up").alias("joined"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's id (as ``key``), n_shingles, component_id, and ``first`` (the one row of its component to keep).

    A text's set holds its distinct runs of five words (A-Z lower-cased; words are runs of bytes
    other than ASCII white space); with one to four words, all of them as one run. Two rows
    link when their sets share at least four fifths of their union. component_id is the smallest
    id that links reach, the row itself included.

    Rows with equal sets are one class whose first row alone is compared. All counts, sets and
    texts are whole; links are verified on whole sets.

    Null texts and texts without words have no shingles and link with nothing. Null ids are
    smaller than others; equal ids come in the order of the written chunks. An empty table gives
    an empty result. Other columns are not returned.
    """
    chunks = chunked(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), text, "near-chunks")
    return _judged(chunks, text, key).drop("chunk", "at")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first row (smallest id) of every component of near duplicates, with the columns of ``docs``."""
    chunks = chunked(docs, text, "near-chunks")
    with recorded() as made:
        kept = stage(notes(_judged(chunks, text, key).filter("first").select("chunk", "at"), []), "near-kept")
    # Only the chunks and this last table are read from here on.
    drop(docs.sparkSession, made[:-1])

    def emit(chunk: int, by: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        at = array_of(by.get(NOTE, []), "a", np.int64)
        for row in by.get(DOCS, []):
            yield unpack(row["a"]).take(pa.array(at))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return at_chunks([kept, chunks], emit, schema)


def _judged(chunks: DataFrame, text: str, key: str) -> DataFrame:
    """The result of :func:`near_duplicates` with the place (chunk, at) of each row."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = unpack(row["a"])
                sets, n = Shingles(_column(own, text)), own.num_rows
                cut = zip(sets.first[:-1].tolist(), sets.first[1:].tolist())
                digests = [xxhash.xxh3_128_digest(sets.hash[a:b].tobytes()) if b > a else None for a, b in cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n)), _column(own, key).cast(pa.int64()), pa.array(sets.size), pa.array(digests, pa.binary())],
                    ["chunk", "at", "id", "n", "digest"],
                )

    rows = stage(chunks.mapInArrow(narrow, "chunk bigint, at bigint, id bigint, n bigint, digest binary"), "near-rows")
    ordered = stage(positions(rows, [F.col("id").asc_nulls_first(), F.col("chunk"), F.col("at")], "order", "near-order"), "near-ordered")
    classes = stage(ordered.filter("digest is not null").groupBy("digest").agg(F.min("order").alias("class")), "near-classes")
    firsts = classes.select(F.col("class").alias("order"), F.lit(1).alias("mine"))
    marked = ordered.join(firsts, "order", "left").select("chunk", "at", "order", F.coalesce("mine", F.lit(0)).alias("mine"))
    info = stage(notes(marked, ["order", "mine"]), "near-notes")
    joined = linked(candidates(chunks, info, text))
    # The component of each class, then the id of the component's first row; both have a row per class.
    named = classes.join(joined, F.col("class") == F.col("doc"), "left").select("digest", F.coalesce("component", "class").alias("root"))
    ids = ordered.select(F.col("order").alias("root"), F.col("id").alias("root_id"))
    roots = stage(named.join(ids, "root"), "near-roots")
    out = ordered.join(roots, "digest", "left")
    alone = F.col("root").isNull()
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("root_id")).alias("component_id"),
        (alone | (F.col("root") == F.col("order"))).alias("first"),
        "chunk",
        "at",
    )


@query("op10_shingle_join")
def op10(spark, sf_dir):
    """The near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
