"""Approximate nearest neighbours by shifted space-filling curves, with an exact completion.

Vectors are projected onto a few random orthonormal directions, and the cells of several Hilbert curves - each with
projection and shift of its own - give them sort keys. Spark range-partitions each curve by key and cuts it into
blocks of ``window`` rows. A query is compared with its own block and the two beside it on every curve; what these
windows find is merged and reranked on the original vectors.

On vectors of high intrinsic dimension windows of any fixed size miss neighbours, so the completion follows. The queries
are packed into chunks along the first curve and joined to its blocks; chunks and blocks carry centre and radius, and a
pair whose bound can't reach the least k-th score of the chunk is left out of the join. A block is compared with those
queries only whose own k-th score its bound (q.c + |q| r) may still beat. The result is then exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import n_partitions, stored

DIMS, BITS = 6, 10  # of a curve: 60-bit keys
GROUP_BLOCKS = 16  # of a join group of the completion
EPS = 1e-9  # of a bound or a matrix product against the exact score


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of coordinates below 2**bits) along the Hilbert curve.

    The coordinates are turned, bit by bit from the top, into the Gray code of the place: a set bit of an axis inverts
    the lower bits of the first axis, a clear one swaps them with the axis's own.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for axis in range(dims):
            high = (x[axis] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, np.uint64(0)) ^ swap
            if axis:
                x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    keys = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in range(dims):
            keys = keys << np.uint64(1) | (x[axis] >> np.uint64(b) & np.uint64(1))
    return keys


class Curve:
    """A projection and a shift, drawn from the seed; cells span four deviations to either side."""

    def __init__(self, size: int, seed: int, centre: np.ndarray, spread: float):
        rng = np.random.default_rng(seed)
        dims = min(DIMS, size)
        self.axes = np.linalg.qr(rng.standard_normal((size, dims)))[0]
        self.shift = rng.random(dims)
        self.centre, self.unit = centre, 9 * max(spread, 1e-12)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        place = (vectors - self.centre) @ self.axes / self.unit + 0.5
        cells = np.clip((place + self.shift / 16) * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_keys(cells, BITS).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, an array of floats or doubles as in the table) of the rows that take part: neither id nor vector null, no null or non-finite
    component, not zero, and of the commonest length (the longer of equally common ones)."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    v = F.col("embedding") if single else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    rows = rows.where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes[0] if sizes else 0))


#: vecs begins with the bytes of a component, 4 or 8.
BLOCKS = "curve int, part int, blk int, n int, ids binary, vecs binary"


def build_blocks(rows: DataFrame, *, curves: int, window: int, fit_rows: int, seed: int) -> DataFrame:
    """The curves' blocks, numbered along each curve by ``seq``. Centre and spread come from at most ``fit_rows`` rows."""
    spark = rows.sparkSession
    some = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").collect()], float)
    size = some.shape[1] if some.ndim == 2 else 0
    centre, spread = (some.mean(axis=0), float(some.std(axis=0).mean())) if size else (np.zeros(0), 1.0)
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"  # no component is rounded
    orders = [Curve(size, seed + c, centre, spread) for c in range(curves)] if size else []

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                raw = pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())
                for c, curve in enumerate(orders):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(vectors), c, np.int32)), pa.array(curve.keys(vectors)), batch.column(0), raw],
                        names=["curve", "key", "vec_id", "raw"],
                    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blk, curve = TaskContext.get().partitionId(), 0, -1
        ids: list[int] = []
        raws: list[bytes] = []

        def block() -> pa.RecordBatch:
            kinds = [pa.int32()] * 4 + [pa.binary()] * 2
            row = [curve, part, blk, len(ids), np.array(ids, "<i8").tobytes(), kind[-1:].encode() + b"".join(raws)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for c, i, raw in zip(*(batch.column(k).to_pylist() for k in ("curve", "vec_id", "raw"))):
                if ids and (c != curve or len(ids) >= window):
                    yield block()
                    blk, ids, raws = blk + 1, [], []
                curve = c
                ids.append(i)
                raws.append(raw)
        if ids:
            yield block()

    keyed = rows.mapInArrow(key, "curve int, key long, vec_id long, raw binary")
    order = ("curve", "key", "vec_id")
    cut_up = keyed.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(cut, BLOCKS)
    made = stored(cut_up, "blocks")  # read again wherever they are used; their numbers are a broadcast row a partition
    bases, total = [], 0
    for part, n in sorted(made.groupBy("part").agg(F.count("*")).collect()):  # a row for each partition
        bases.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return made.join(base, "part").withColumn("seq", F.col("base") + F.col("blk")).drop("base")


def _unpack(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    head, raw = vecs[:1], vecs[1:]
    return i, np.frombuffer(raw, f"<f{head.decode()}").astype(float).reshape(len(i), -1)


def _packed(v: np.ndarray) -> bytes:
    """Vectors as ``_unpack`` reads them, in single precision where that loses nothing."""
    single = v.astype("<f4")
    return b"4" + single.tobytes() if (single == v).all() else b"8" + v.astype("<f8").tobytes()


def _best(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None) -> list[tuple[int, int, float]]:
    """(query, vector, score): for each query its k best of the block, of those at or above ``least``.

    The product only preselects; scores and ties are decided on row sums that don't depend on the block."""
    near = q @ x.T
    near[qi[:, None] == xi[None, :]] = -np.inf
    if len(xi) > k:
        floor = np.partition(near, len(xi) - k, axis=1)[:, len(xi) - k]
    else:
        floor = np.full(len(qi), -np.inf)
    floor = floor if least is None else np.maximum(floor, least)
    floor = np.where(np.isfinite(floor), floor - EPS * (1 + np.abs(floor)), floor)
    out = []
    good = (near >= floor[:, None]) & (near > -np.inf)
    for r in np.flatnonzero(good.any(axis=1)).tolist():
        which = np.flatnonzero(good[r])
        scores = (x[which] * q[r]).sum(axis=1)
        for j in np.lexsort((xi[which], -scores))[:k].tolist():
            out.append((int(qi[r]), int(xi[which[j]]), float(scores[j])))
    return out


def _pairs(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


PAIRS = "query_id long, vec_id long, score double"


def windows(blocks: DataFrame, every: int, k: int) -> DataFrame:
    """Candidate pairs from each query's block and the two beside it, on every curve."""

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for r in batch.to_pylist():
                i, v = _unpack(r["ids"], r["vecs"])
                mine = i % every == 0
                if mine.any():
                    kept.append((r["curve"], r["seq"], i[mine].tobytes(), _packed(v[mine])))
            columns = list(zip(*kept)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["curve", "seq", "qids", "qvecs"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, q, xi, x = (batch.column(c)[r].as_py() for c in range(4))
                yield _pairs(_best(*_unpack(qi, q), *_unpack(xi, x), k, None))

    queries = blocks.select("curve", "seq", "ids", "vecs").mapInArrow(asks, "curve int, seq long, qids binary, qvecs binary")
    beside = queries.select("curve", F.explode(F.array(*(F.col("seq") + d for d in (-1, 0, 1)))).alias("seq"), "qids", "qvecs")
    met = beside.join(blocks.select("curve", "seq", "ids", "vecs"), ["curve", "seq"])
    return met.select("qids", "qvecs", "ids", "vecs").mapInArrow(compare, PAIRS)


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best pairs of each query, ties to the smaller vec_id."""
    single = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


CHUNK = "qids binary, qvecs binary, floors binary, qcentre array<double>, qradius double, floor double"


def query_chunks(blocks: DataFrame, found: DataFrame, every: int, k: int, chunk: int) -> DataFrame:
    """The queries in rows of at most ``chunk``, in the order of the first curve, each with what its k-th score is now."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                seq, ids, vecs = (batch.column(c)[r].as_py() for c in range(3))
                i, v = _unpack(ids, vecs)
                mine = np.flatnonzero(i % every == 0)
                rows = [i[mine], np.full(len(mine), seq), pa.array([v[m].tobytes() for m in mine.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["query_id", "seq", "raw"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                i, floors = part.column(0).to_numpy(), part.column(2).to_numpy()
                v = np.frombuffer(b"".join(part.column(1).to_pylist()), float).reshape(len(i), -1)
                centre = v.mean(axis=0)
                row = [i.tobytes(), _packed(v), floors.tobytes(), centre, float(np.sqrt(((v - centre) ** 2).sum(axis=1).max())), float(floors.min())]
                kinds = [pa.binary()] * 3 + [pa.list_(pa.float64()), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

    kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    least = F.when(F.col("n") == k, F.col("kth")).otherwise(F.lit(float("-inf")))
    single = blocks.where("curve = 0").select("seq", "ids", "vecs").mapInArrow(split, "query_id long, seq long, raw binary")
    asked = single.join(kth, "query_id", "left").select("query_id", "raw", F.coalesce(least, F.lit(float("-inf"))).alias("least"), "seq")
    order = ("seq", "query_id")
    ranged = asked.repartitionByRange(n_partitions(blocks.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("query_id", "raw", "least").mapInArrow(pack, CHUNK)


def completion(blocks: DataFrame, found: DataFrame, every: int, k: int, chunk: int) -> DataFrame:
    """Pairs that reach the k-th score of ``found``, from all blocks of the first curve.

    Blocks are dealt to groups of a fixed number. The chunks' centres, radii and floors alone go to every group; a chunk's
    vectors go to those groups only in which its bound over a whole block is open."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                seq, ids, vecs = (batch.column(c)[r].as_py() for c in range(3))
                x = _unpack(ids, vecs)[1]
                centre = x.mean(axis=0)
                row = [seq, ids, vecs, centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()))], names=["seq", "ids", "vecs", "centre", "radius"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qids, qvecs, floors, ids, vecs, centre, radius = (batch.column(c)[r].as_py() for c in range(7))
                (qi, q), (xi, x), floor = _unpack(qids, qvecs), _unpack(ids, vecs), np.frombuffer(floors, float)
                bound = q @ np.array(centre) + np.sqrt((q * q).sum(axis=1)) * radius
                open_ = np.flatnonzero(bound + EPS * (1 + np.abs(bound)) >= floor)
                for at in range(0, len(open_), 1024):
                    some = open_[at : at + 1024]
                    yield _pairs(_best(qi[some], q[some], xi, x, k, floor[some]))

    first = blocks.where("curve = 0").select("seq", "ids", "vecs")
    groups = max(n_partitions(blocks.sparkSession), -(-first.count() // GROUP_BLOCKS))
    told = first.mapInArrow(bounds, "seq long, ids binary, vecs binary, centre array<double>, radius double")
    told = told.withColumn("g", F.pmod("seq", F.lit(groups)))
    chunks = stored(query_chunks(blocks, found, every, k, chunk).withColumn("chunk", F.monotonically_increasing_id()), "queries")
    dot = "aggregate(zip_with(qcentre, centre, (a, b) -> a * b), 0D, (s, x) -> s + x)"
    length = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    most = F.expr(f"{dot} + {length.format('qcentre')} * radius + qradius * {length.format('centre')} + qradius * radius")
    is_open = most + F.lit(EPS) * (1 + F.abs(most)) >= F.col("floor")
    asked = chunks.select("chunk", "qcentre", "qradius", "floor").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    heads = told.select("g", "centre", "radius")
    sent = stored(heads.join(asked, "g").where(is_open).select("g", "chunk").distinct(), "open")
    met = told.join(sent.join(chunks, "chunk"), "g").where(is_open)
    return met.select("qids", "qvecs", "floors", "ids", "vecs", "centre", "radius").mapInArrow(compare, PAIRS)


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, curves: int = 6, window: int = 4096, fit_rows: int = 4096, seed: int = 5, exact: bool = True, chunk: int = 1024) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding)`` whose vec_id divides by ``every``: its k best others by inner product.

    Returns query_id, rank (from 1), vec_id, score (double, on the original vectors), ties to the smaller vec_id. Rows
    that ``usable`` leaves out take no part. Rows that share a vec_id are one candidate, by its best score, and one
    query, by its best pairs; none is its own candidate. A query with fewer candidates gets all. ``exact`` adds the completion; without
    it a query gets what the windows hold. An empty table gives no rows; other columns are ignored.
    """
    rows = stored(usable(vectors), "vectors")
    blocks = build_blocks(rows, curves=curves, window=window, fit_rows=fit_rows, seed=seed)
    found = stored(best_of(windows(blocks, every, k), k), "windows")
    if not exact:
        return found
    return best_of(found.select("query_id", "vec_id", "score").unionByName(completion(blocks, found, every, k, chunk)), k)
