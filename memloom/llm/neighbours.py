"""Most similar vectors for every vector (problem 3).

Several space-filling curves: each rotates the unit vectors at random, projects them to
some dimensions, cuts every dimension into equally filled intervals whose bounds are shifted from
curve to curve, and orders the cells along a Hilbert curve. The curves are cut
into blocks of neighbouring keys, one task's step each; inside, near positions are compared by matrix
products of 8-bit vectors. What several curves find is merged and ranked again by exact cosines.

Groups denser than the windows: a vector that meets DENSE others in its window on any curve marks its
neighbourhood. Leaders are chosen until every marked vector is near one; all pairs of a vector near a leader
and any other vector are then compared, in chunk pairs, where the triangle inequality says they can match.

The rotations are random; the interval and block bounds are fitted on at most SAMPLE vectors, the
first by a hash. Every vector is indexed on every curve.

Defined results
* only vectors of DIMENSIONS finite numbers, not all zero, count; null, short and unusable vectors have no neighbours;
* equal vectors are indexed once and expanded to their records; records repeated under one id count once;
* null ids are dropped; ties between neighbours go to the smaller id; fewer than k others give fewer than k rows;
* an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.expand import record_pairs
from memloom.session import cut, spread

DIMENSIONS = 64
#: Curves, projected dimensions and bits of each (their product is a key of 48 bits), and the seed.
CURVES, PROJECTED, BITS, SEED = 16, 24, 2, 7
SAMPLE = 131_072
#: Vectors of a block, and on which side of a vector how many are compared.
BLOCK, WINDOW = 20_000, 600
#: Matches in a vector's window from which its neighbourhood is compared whole, and the least cosine of a vector that a leader covers.
DENSE, COVER = 30, 0.8
#: Marked vectors that leaders are chosen from at a time, leaders that travel to the workers at a time (13 MB), and vectors of a chunk.
LEADERS, BROADCAST_LEADERS, CHUNK = 4_096, 50_000, 8_192
#: For k nearest: curves, share of all vectors compared on each curve, and the least and most vectors of a block; three blocks make a share.
NEAREST_CURVES, NEAREST_SHARE, NEAREST_BLOCKS = 16, 0.04, (1_024, 131_072)
#: Blocks of one task, about, and products held at a time.
BLOCKS_A_TASK, PRODUCTS = 8, 20_000_000
#: Cosines of 8-bit vectors err by less than this.
MARGIN = 0.02
FEW = 500_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of coordinates, by undoing the rotations of the curve bit by bit."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(d):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & q, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Orderings fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, total: int, curves: int, block: int) -> None:
        rng = np.random.default_rng(SEED)
        self.blocks = max(1, min(-(-total // block), SAMPLE // 8))
        self.cells = curves * self.blocks
        self.turns, self.steps, self.bounds = [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(DIMENSIONS, DIMENSIONS)))[0][:, :PROJECTED].astype(np.float32)
            width = 1 / (1 << BITS)
            levels = np.clip(np.arange(1, 1 << BITS)[:, None] * width + rng.uniform(-width / 2, width / 2, PROJECTED), 0.02, 0.98)
            flat = sample @ turn
            steps = np.stack([np.quantile(flat[:, j], levels[:, j]) for j in range(PROJECTED)], axis=1) if len(sample) else np.zeros_like(levels)
            self.turns.append(turn)
            self.steps.append(steps.astype(np.float32))
            keys = np.sort(self._keys(sample, turn, self.steps[-1]))
            cuts = np.linspace(0, len(keys), self.blocks + 1)[1:-1].astype(int)
            self.bounds.append(keys[cuts] if len(keys) else np.zeros(self.blocks - 1, np.int64))

    @staticmethod
    def _keys(unit: np.ndarray, turn: np.ndarray, steps: np.ndarray) -> np.ndarray:
        flat = unit @ turn
        return hilbert((flat[:, None, :] >= steps[None]).sum(axis=1), BITS)

    def place(self, unit: np.ndarray, vec: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(curve, block and position of every vector on it); a key so common that it fills several blocks is spread over them by the vector's hash."""
        for c, (turn, steps, bounds) in enumerate(zip(self.turns, self.steps, self.bounds, strict=True)):
            key = self._keys(unit, turn, steps)
            first, block = (np.searchsorted(bounds, key, side) for side in ("left", "right"))
            yield c, block - vec % np.maximum(1, block - first), key


def _unit(column: pa.Array) -> np.ndarray:
    v = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, DIMENSIONS).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _packed(unit: np.ndarray) -> pa.Array:
    """8 bits a dimension, scaled to the largest; the scale itself falls out again when the length is made 1."""
    small = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)
    return pa.Array.from_buffers(pa.binary(DIMENSIONS), len(small), [None, pa.py_buffer(np.ascontiguousarray(small).tobytes())]).cast(pa.binary())


def _unpacked(rows: list[pa.Array]) -> np.ndarray:
    v = np.frombuffer(b"".join(b"".join(r.to_pylist()) for r in rows), np.int8).reshape(-1, DIMENSIONS).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vectors(tables: list[DataFrame], key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Records (id, vec), and different vectors (vec, embedding, first, n, asked).

    Vectors are named by a hash and told apart by 128 bits; only copies are ever shuffled, without their numbers.
    """
    rows = reduce(DataFrame.unionByName, [t.select(F.col(key).alias("id"), F.col(vector).alias("embedding")) for t in tables])
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & (F.size("embedding") == DIMENSIONS)).filter(finite)
    rows = cut(rows.select("id", F.xxhash64("embedding").alias("vec"), F.xxhash64("embedding", F.lit(1)).alias("twin"), "embedding"), "vectors")
    named = rows.select("id", "vec", "twin").distinct().groupBy("vec", "twin")
    copies = cut(named.agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(_asked("id")).alias("any_asked")).filter("n > 1"), "copies")
    few = copies.limit(FEW + 1).count() <= FEW
    different = rows.join(F.broadcast(copies) if few else copies, ["vec", "twin"], "left").filter("first IS NULL OR id = first")
    one = (F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("any_asked", _asked("id")).alias("asked"))
    return rows.select("id", "vec"), different.select("vec", "embedding", F.col("id").alias("first"), *one)


def _asked(key: str):  # noqa: ANN202
    """The stated query set: ids whose hash is divisible by 50."""
    return F.pmod(F.xxhash64(key), F.lit(50)) == 0


def _fit(different: DataFrame, total: int, curves: int, block: int) -> Curves:
    size = min(SAMPLE, max(8_192, 8 * -(-total // block)))
    rows = different.orderBy(F.xxhash64("vec"), "vec").select("embedding").limit(size).toArrow().combine_chunks()["embedding"]
    some = [_unit(c) for c in rows.chunks if len(c)]
    return Curves(np.concatenate(some) if some else np.empty((0, DIMENSIONS), np.float32), total, curves, block)


def _by_block(work: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands every block over once it is complete; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            cell = b.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if cell[lo] != at and held:
                    yield from work(held)
                    held = []
                at = cell[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from work(held)

    return run


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _pairs_in(least: float) -> Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs within the windows; a vector with DENSE matches is given with itself, and its other pairs are left to ``_dense_pairs``."""

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec = np.concatenate([r.column("vec").to_numpy() for r in rows])
        unit = _unpacked([r.column("packed") for r in rows])
        met = np.zeros(len(vec), np.int64)
        for lo in range(0, len(vec), WINDOW):
            near = unit[lo : lo + 2 * WINDOW]
            i, j = np.nonzero(unit[lo : lo + WINDOW] @ near.T >= least - MARGIN)
            keep = j > i
            i, j = lo + i[keep], lo + j[keep]
            met += np.bincount(i, minlength=len(vec)) + np.bincount(j, minlength=len(vec)) if len(i) else 0
            keep = (met[i] < DENSE) & (met[j] < DENSE)
            if keep.any():
                yield _ordered(vec[i[keep]], vec[j[keep]])
        if (met >= DENSE).any():
            yield _ordered(vec[met >= DENSE], vec[met >= DENSE])

    return work


def _leaders(dense: DataFrame, curves: Curves) -> DataFrame:
    """(leader, embedding): vectors of ``dense`` so that every one has a cosine of at least COVER with some of them.

    Chosen block by block along one curve, so that what is alike meets; two blocks may choose leaders close to each other, which costs visits but loses nothing.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, vec = _unit(b.column("embedding")), b.column("vec")
            cell = next(curves.place(unit, vec.to_numpy()))[1].astype(np.int64)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(cell), vec, flat], ["cell", "vec", "embedding"])

    def choose(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, names = np.empty((0, DIMENSIONS), np.float32), []
        for whole in held:
            for b in (whole.slice(lo, LEADERS) for lo in range(0, whole.num_rows, LEADERS)):
                unit, vec = _unit(b.column("embedding")), b.column("vec").to_numpy()
                free = np.flatnonzero((unit @ leaders.T).max(axis=1, initial=-1) < COVER)
                while len(free):
                    one = unit[free[0]]
                    leaders, names = np.concatenate([leaders, one[None]]), [*names, vec[free[0]]]
                    free = free[1:][unit[free[1:]] @ one < COVER]
        flat = pa.FixedSizeListArray.from_arrays(pa.array(leaders.ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)), flat], ["leader", "embedding"])

    placed = dense.select("vec", "embedding").mapInArrow(rows, "cell bigint, vec bigint, embedding array<float>")
    return placed.repartition("cell").sortWithinPartitions("cell", "vec").mapInArrow(_by_block(choose), "leader bigint, embedding array<float>")


def _visits(different: DataFrame, leaders: DataFrame, reach: float) -> DataFrame:
    """(vec, leader, near, packed): every vector and the leaders of which its cosine is at least ``reach``; the leaders are read in blocks of BROADCAST_LEADERS."""

    def near_to(some: np.ndarray, names: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, PRODUCTS // max(1, len(some)))
            for whole in batches:
                for b in (whole.slice(lo, step) for lo in range(0, whole.num_rows, step)):
                    unit = _unit(b.column("embedding"))
                    near = unit @ some.T
                    i, j = np.nonzero(near >= reach)
                    if len(i):
                        at = pa.array(i)
                        yield pa.RecordBatch.from_arrays([b.column("vec").take(at), pa.array(names[j]), pa.array(near[i, j]), _packed(unit).take(at)], ["vec", "leader", "near", "packed"])

        return run

    found, block, rows = [], [], leaders.toLocalIterator(prefetchPartitions=True)
    while block := list(islice(rows, BROADCAST_LEADERS)):
        some, names = np.array([r.embedding for r in block], np.float32), np.array([r.leader for r in block], np.int64)
        found.append(cut(different.select("vec", "embedding").mapInArrow(near_to(some, names), "vec bigint, leader bigint, near float, packed binary"), "visits"))
    return reduce(DataFrame.unionByName, found)


def _dense_pairs(dense: DataFrame, different: DataFrame, curves: Curves, least: float) -> DataFrame:
    """(a, b): every pair of a vector of ``dense`` and any other that may reach ``least``.

    A vector belongs to the nearest leader that covers it, and visits every leader from which it is no further than that
    cover and the angle of ``least`` together; so it meets there all its matches that belong to it.
    """
    cover = COVER - 1e-5  # a leader itself is covered whatever the rounding
    visits = _visits(different, cut(_leaders(dense, curves), "leaders"), float(np.cos(np.arccos(cover) + np.arccos(least) + 1e-3)))
    home = visits.filter(F.col("near") >= cover).groupBy("vec").agg(F.max_by("leader", F.struct("near", "leader")).alias("home"))
    few = home.limit(FEW + 1).count() <= FEW
    visits = cut(visits.join(F.broadcast(home) if few else home, "vec", "left"), "homes")
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("int")
    sizes = cut(visits.groupBy("leader").agg(chunks(F.count_if(F.col("leader") == F.col("home"))).alias("rows"), chunks(F.count("*")).alias("columns")), "sizes")
    few = sizes.limit(FEW + 1).count() <= FEW
    sized = visits.join(F.broadcast(sizes) if few else sizes, "leader").withColumns({"r": F.pmod(F.col("vec"), F.col("rows")), "c": F.pmod(F.xxhash64("vec"), F.col("columns"))})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - F.lit(1).cast("bigint")))
    own = sized.filter("leader = home").withColumn("c", every("columns")).withColumn("visit", F.lit(False))
    guests = sized.withColumn("r", every("rows")).withColumn("visit", F.lit(True))
    both = own.unionByName(guests).select(F.xxhash64("leader", "r", "c").alias("cell"), "visit", "leader", F.coalesce("home", "leader").alias("home"), F.col("home").isNotNull().alias("covered"), "vec", "packed")

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit, covered = (np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r in held]).astype(bool) for k in ("visit", "covered"))
        leader, home, vec = (np.concatenate([r.column(k).to_numpy() for r in held]) for k in ("leader", "home", "vec"))
        unit = _unpacked([r.column("packed") for r in held])
        x, y = np.flatnonzero(~visit), np.flatnonzero(visit)
        for lo in range(0, len(x), 128):
            i, j = np.nonzero(unit[x[lo : lo + 128]] @ unit[y].T >= least - MARGIN)
            i, j = x[lo + i], y[j]
            # two that belong to leaders meet at both, or twice at one: the pair is given once
            keep = (vec[i] != vec[j]) & (~covered[j] | (leader[i] < home[j]) | ((leader[i] == home[j]) & (vec[i] < vec[j])))
            if keep.any():
                yield _ordered(vec[i[keep]], vec[j[keep]])

    return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(_by_block(work), "a bigint, b bigint")


def _exact(pairs: DataFrame, different: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the exact ``cosine``; the vectors they need are fetched once."""
    ids = pairs.select(F.col("a").alias("vec")).union(pairs.select("b")).distinct()
    few = pairs.limit(FEW + 1).count() <= FEW
    needed = cut(different.join(F.broadcast(ids) if few else ids, "vec", "left_semi").select("vec", "embedding"), "needed")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    largest = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    scaled = needed.withColumn("most", largest).select("vec", F.transform("embedding", lambda v: v.cast("double") / F.col("most")).alias("e"))
    scaled = scaled.withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e"))))
    x, y = (scaled.select(F.col("vec").alias(k), F.col("e").alias(f"e{k}"), F.col("norm").alias(f"n{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select(*pairs.columns, (dot(F.col("ea"), F.col("eb")) / (F.col("na") * F.col("nb"))).alias("cosine"))


def similar_pairs(tables: list[DataFrame], key: str = "id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id_a, id_b) of records whose vectors have at least this cosine."""
    members, different = vectors(tables, key, vector)
    curves = _fit(different, different.count(), CURVES, BLOCK)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(b.column("embedding"))
            packed = _packed(unit)
            for c, cell, key in curves.place(unit, b.column("vec").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array((cell + c * curves.blocks).astype(np.int64)), pa.array(key), b.column("vec"), packed], ["cell", "key", "vec", "packed"])

    placed = different.select("vec", "embedding").mapInArrow(rows, "cell bigint, key bigint, vec bigint, packed binary")
    # equal keys are in another order on every curve
    met = spread(placed, "cell", curves.cells // BLOCKS_A_TASK).sortWithinPartitions("cell", "key", F.xxhash64("cell", "vec")).mapInArrow(_by_block(_pairs_in(least)), "a bigint, b bigint")
    met = cut(met.distinct(), "met")
    marked = met.filter("a = b").select(F.col("a").alias("vec"))
    met = met.filter("a != b")
    few = marked.limit(FEW + 1).count() <= FEW
    if not marked.isEmpty():
        dense = different.join(F.broadcast(marked) if few else marked, "vec", "left_semi").select("vec", "embedding")
        met = cut(met.unionByName(_dense_pairs(dense, different, curves, least)).distinct(), "met_dense")
    pairs = cut(_exact(met, different).filter(F.col("cosine") >= least).select("a", "b"), "pairs")
    linked = pairs.select(F.col("a").alias("vec")).union(pairs.select("b")).union(different.filter("n > 1").select("vec")).distinct()
    few = linked.limit(FEW + 1).count() <= FEW
    of = cut(members.join(F.broadcast(linked) if few else linked, "vec", "left_semi").distinct(), "records")
    return record_pairs(pairs, of.withColumnRenamed("vec", "of"))


def nearest(tables: list[DataFrame], k: int = 10, key: str = "id", vector: str = "embedding", share: float = NEAREST_SHARE) -> DataFrame:
    """(id, neighbour_id, rank, cosine): the k most similar other records of every record of the query set."""
    members, different = vectors(tables, key, vector)
    total = different.count()
    block = round(min(max(share * total / 3, NEAREST_BLOCKS[0]), NEAREST_BLOCKS[1]))
    curves = _fit(different, total, NEAREST_CURVES, block)
    reach = max(1, ceil((share * total / block - 1) / 2 - 0.01))  # whatever the rounding of the block
    wanted = 2 * k

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(b.column("embedding"))
            packed, vec = _packed(unit), b.column("vec")
            ask = np.flatnonzero(b.column("asked").to_numpy(zero_copy_only=False))
            for c, cell, _ in curves.place(unit, vec.to_numpy()):
                cells, at, is_query = [cell], [np.arange(len(cell))], [np.zeros(len(cell), bool)]
                for off in range(-reach, reach + 1):  # queries, a fiftieth, visit the blocks around their own
                    there = cell[ask] + off
                    ok = (there >= 0) & (there < curves.blocks)
                    cells.append(there[ok])
                    at.append(ask[ok])
                    is_query.append(np.ones(int(ok.sum()), bool))
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.concatenate(cells) + c * curves.blocks).astype(np.int64)), pa.array(np.concatenate(is_query)), vec.take(take), packed.take(take)], ["cell", "ask", "vec", "packed"]
                )

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec = np.concatenate([r.column("vec").to_numpy() for r in held])
        ask = np.concatenate([r.column("ask").to_numpy(zero_copy_only=False) for r in held]).astype(bool)
        unit = _unpacked([r.column("packed") for r in held])
        data, own, out = unit[~ask], vec[~ask], []
        queries, names = unit[ask], vec[ask]
        n = min(wanted + 1, len(own))
        step = max(1, PRODUCTS // max(1, len(own)))
        for lo in range(0, len(queries) if n else 0, step):
            cosine = queries[lo : lo + step] @ data.T
            top = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
            out.append((np.repeat(names[lo : lo + step], n), own[top].ravel(), np.take_along_axis(cosine, top, axis=1).ravel()))
        if not out:
            return
        a, b, near = (np.concatenate(x) for x in zip(*out, strict=True))
        other = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(b[other]), pa.array(near[other].astype(np.float32))], ["a", "b", "near"])

    placed = different.select("vec", "embedding", "asked").mapInArrow(rows, "cell bigint, ask boolean, vec bigint, packed binary")
    met = spread(placed, "cell", curves.cells // BLOCKS_A_TASK).sortWithinPartitions("cell", "ask").mapInArrow(_by_block(work), "a bigint, b bigint, near float")
    best = Window.partitionBy("a").orderBy(F.desc("near"), "b")
    met = met.groupBy("a", "b").agg(F.max("near").alias("near")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= wanted).select("a", "b")
    exact = _exact(cut(met, "met"), different)
    # copies of a query's own vector are neighbours, too; of each vector the k + 1 smallest ids are enough
    own = different.filter("asked AND n > 1").select(F.col("vec").alias("a"), F.col("vec").alias("b"), F.lit(1.0).alias("cosine"))
    first = Window.partitionBy("vec").orderBy("id")
    few = members.distinct().join(different.filter("n > 1").select("vec"), "vec").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("vec", "id")
    some = different.filter("n = 1").select("vec", F.col("first").alias("id")).unionByName(few)
    asked = members.filter(_asked("id")).distinct().select(F.col("vec").alias("a"), "id")
    found = exact.unionByName(own).join(asked, "a").join(some.select(F.col("vec").alias("b"), F.col("id").alias("neighbour_id")), "b").filter("id != neighbour_id")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "neighbour_id", "rank", "cosine")
