"""Whitening by the exact characteristic polynomial of the integer scatter matrix.

Vectors become integers, and their scatter matrix ``A = n sum(x x') - S S'`` (the covariance times n squared) is summed without
rounding: tasks add up exact products of small blocks, and Spark adds the tasks' numbers limb by limb. The characteristic
polynomial of A is taken modulo many primes - each by reduction to Hessenberg form, the primes dealt over the cluster - and
put together by Chinese remaindering, beyond a bound that a matrix without negative eigenvalues can't exceed. All roots of
the polynomial are real, so the sign changes of its coefficients, shifted by a, count the roots above a; bisection on that
count isolates every root to some 96 bits, multiplicities included. Components are the null vectors of ``A - root``, by
inverse iteration in fixed-point numbers of ``BITS`` bits.

The driver holds the d x d matrix and the polynomial, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import stored

SCALE, OFFSET = 1024, 100_000
LIMB = 30  # bits of a limb of a task's sums
WIDEST = float(1 << 62)  # integers are clipped to this to either side
BITS = 256  # fixed-point bits of the inverse iteration
ROOT_BITS = 96  # of a root, relative to the trace
PRIMES_A_TASK = 8
MOST_DIMENSIONS = 1024


def finite_rows(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column that aren't null and hold no null or non-finite entry, of length ``size`` where it is given:
    their numbers, their lengths, and, with a size, the matrix of their entries."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    if size is None:
        return np.flatnonzero(good), lengths[good], np.empty((0, 0))
    rows = np.flatnonzero(good & (lengths == size))
    places = (ends[rows] - size)[:, None] + np.arange(size)
    return rows, lengths[rows], flat.reshape(-1, size)[rows] if len(flat) == size * len(lengths) else flat[places]


def entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) with entries that Arrow gives as floats or doubles."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    return vectors.select("vec_id", F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>"))


def commonest_length(vectors: DataFrame) -> int | None:
    """The commonest length of the finite vectors, the longer of equally common ones; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, count = np.unique(finite_rows(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(count)], names=["size", "count"])

    sizes = vectors.select("embedding").mapInArrow(run, "size long, count long").groupBy("size").agg(F.sum("count").alias("count"))
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first[0] if first else None


def integers(matrix: np.ndarray) -> np.ndarray:
    """floor(1024 c), without the offset, which moves no covariance. Numbers past 2**62 are clipped to it."""
    return np.clip(np.floor(matrix * SCALE), -WIDEST, WIDEST)


def exact(matrix: np.ndarray) -> np.ndarray:
    """Whole floats as Python integers."""
    return np.array([int(v) for v in matrix.ravel()], object).reshape(matrix.shape)


def products(y: np.ndarray) -> np.ndarray:
    """y' y in Python integers: by floats as long as these are exact, otherwise by integers."""
    peak = float(np.abs(y).max(initial=0.0))
    step = int((1 << 53) / max(1.0, peak * peak))
    if step == 0:
        whole = exact(y)
        return whole.T.dot(whole)
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), step):
        total = total + exact(y[at : at + step].T @ y[at : at + step])
    return total


def scatter(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums of floor(1024 c) and the matrix A, all in Python integers."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            y = integers(finite_rows(batch.column(0), size)[2])
            if len(y):
                n, sums, squares = n + len(y), sums + exact(y).sum(axis=0), squares + products(y)
        told = [n, *sums, *squares[upper]]
        at, limb, value = [], [], []
        for place, v in enumerate(told):
            sign, v, k = (-1 if v < 0 else 1), abs(v), 0
            while v:
                at.append(place), limb.append(k), value.append(sign * (v & (1 << LIMB) - 1))
                v, k = v >> LIMB, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], names=["at", "limb", "value"])

    parts = vectors.select("embedding").mapInArrow(run, "at long, limb int, value long")
    total = [0] * (1 + size + len(upper[0]))
    for at, limb, value in parts.groupBy("at", "limb").agg(F.sum("value")).collect():  # rows bounded by the dimensions
        total[at] += value << (LIMB * limb)
    n, sums = total[0], np.array(total[1 : size + 1], object)
    squares = np.zeros((size, size), object)
    squares[upper] = total[size + 1 :]
    squares = squares + np.triu(squares, 1).T
    return n, sums, n * squares - np.outer(sums, sums)


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (under 2**31; by the strong test to bases that are proof there)."""

    def prime(p: int) -> bool:
        d, r = p - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for base in (2, 3, 5, 7):
            x = pow(base, d, p)
            if x in (1, p - 1):
                continue
            if not any((x := x * x % p) == p - 1 for _ in range(r - 1)):
                return False
        return True

    found, p = [], top - 1 - top % 2
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 2
    return found


def characteristic_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, from the constant one up, of det(t - matrix) modulo the prime p, by Hessenberg reduction."""
    h, d = matrix.copy(), len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if i := below[0]:
            h[[m, m + i]] = h[[m + i, m]]
            h[:, [m, m + i]] = h[:, [m + i, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    # the leading minors' polynomials: each from those before, by the column's entries and the products below the diagonal
    leading = np.zeros((d + 1, d + 1), np.int64)
    leading[0, 0] = 1
    for m in range(1, d + 1):
        now = np.zeros(d + 1, np.int64)
        now[1:] = leading[m - 1, :-1]
        now = (now - h[m - 1, m - 1] * leading[m - 1]) % p
        down = 1
        for i in range(1, m):
            down = down * int(h[m - i, m - i - 1]) % p
            if not down:
                break
            now = (now - int(h[m - i - 1, m - 1]) * down % p * leading[m - i - 1]) % p
        leading[m] = now
    return leading[d]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, from the constant one up, of the characteristic polynomial of a symmetric integer matrix without negative
    eigenvalues; the primes are dealt over tasks."""
    d, trace = len(matrix), int(matrix.trace())
    # the mean of the products of k eigenvalues is at most the k-th power of their mean
    bound = max(math.comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound + 1).bit_length() // 30 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                told = characteristic_mod((matrix % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([told.tolist()], pa.list_(pa.int64()))], names=["p", "told"])

    tasks = -(-len(primes) // PRIMES_A_TASK)
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    out, modulus = [0] * (d + 1), 1
    for p, told in dealt.mapInArrow(run, "p long, told array<long>").collect():  # bounded by the dimensions
        inverse = pow(modulus % p, -1, p)
        out = [x + modulus * ((r - x) * inverse % p) for x, r in zip(out, told)]
        modulus *= p
    return [x - modulus if 2 * x > modulus else x for x in out]


def roots_above(polynomial: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots alone are above a, with their multiplicities: the sign changes of the
    polynomial shifted by a."""
    c = list(polynomial)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], trace: int, count: int) -> tuple[list[int], int]:
    """The largest roots, times two to a power, and the power. A root is the least whole number with fewer roots above."""
    power = max(0, ROOT_BITS - trace.bit_length())
    d = len(polynomial) - 1
    scaled = [c << power * (d - k) for k, c in enumerate(polynomial)]
    high, found = (trace << power) + 1, []
    for k in range(1, count + 1):
        low = -1
        while high - low > 1:
            middle = (low + high) // 2
            if roots_above(scaled, middle) < k:
                high = middle
            else:
                low = middle
        found.append(high)
    return found, power


def unit(v: np.ndarray) -> np.ndarray:
    """A fixed-point vector brought to length one."""
    return (v << BITS) // max(1, math.isqrt(int((v * v).sum())))


def null_vectors(matrix: np.ndarray, roots: list[int], power: int) -> np.ndarray:
    """A unit vector for each root, by inverse iteration; vectors of roots that agree to 2**-40 are kept orthogonal."""
    d, trace = len(matrix), int(matrix.trace())
    scaled, found = (matrix << BITS) // trace, []
    for k, root in enumerate(roots):
        m = scaled.copy()
        m[np.diag_indices(d)] -= (root << BITS) // (trace << power)
        order = list(range(d))
        for i in range(d - 1):  # m becomes its triangular factors, rows told by order
            best = max(range(i, d), key=lambda r: abs(m[r, i]))
            m[[i, best]], order[i], order[best] = m[[best, i]], order[best], order[i]
            if m[i, i]:
                m[i + 1 :, i] = (m[i + 1 :, i] << BITS) // m[i, i]
                m[i + 1 :, i + 1 :] -= np.outer(m[i + 1 :, i], m[i, i + 1 :]) >> BITS
        near = [found[j] for j in range(k) if (abs(roots[j] - root) << 40) <= trace << power]
        v = unit(np.array([(1 << BITS) + ((i + 1) * (k + 3) * 40503 % 65521 << BITS - 16) for i in range(d)], object))
        for _ in range(4):
            v = v[order]
            for i in range(1, d):
                v[i] -= int((m[i, :i] * v[:i]).sum()) >> BITS
            for i in range(d - 1, -1, -1):
                v[i] = ((v[i] - (int((m[i, i + 1 :] * v[i + 1 :]).sum()) >> BITS)) << BITS) // (m[i, i] or 1)
            v = unit(v)
            for other in near:
                v = unit(v - (other * int((v * other).sum() >> BITS) >> BITS))
        found.append(v)
    return np.array([[int(x) / (1 << BITS) for x in v] for v in found])


@dataclass(frozen=True)
class Whitening:
    """A fit: n, the sums of floor(1024 c), the components' unit vectors, their eigenvalues of A as floats, and the share that
    each explains."""

    size: int
    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def deviations(self, matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """n x - S as floats and the exact sums of its squares."""
        y = integers(matrix)
        peak = self.n * float(np.abs(y).max(initial=0.0)) + float(max(map(abs, self.sums), default=0))
        if peak * peak * self.size < 2.0**62 and peak < 2.0**53:
            off = self.n * y.astype(np.int64) - self.sums.astype(np.int64)
            return off.astype(float), (off * off).sum(axis=1).tolist()
        off = self.n * exact(y) - self.sums
        return off.astype(float), (off * off).sum(axis=1).tolist()

    def project(self, off: np.ndarray) -> np.ndarray:
        """Whitened components of n x - S; not a number where the eigenvalue is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(self.eigenvalues)
            return np.where(root > 0, off @ self.axes.T / root, np.nan)


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of all vectors ``(vec_id, embedding)`` with finite entries; None where there is none."""
    rows = entries(vectors)
    size = commonest_length(rows)
    if size is None:
        return None
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    n, sums, matrix = scatter(rows, size)
    trace, k = int(matrix.trace()) if size else 0, min(components, size)
    if not trace:
        return Whitening(size, n, sums, np.eye(k, size), np.zeros(k), np.full(k, np.nan))
    roots, power = largest_roots(characteristic(vectors.sparkSession, matrix), trace, k)
    axes = null_vectors(matrix, roots, power)
    return Whitening(size, n, sums, axes, np.array([r / (1 << power) for r in roots]), np.array([r / (trace << power) for r in roots]))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over the components that vary.

    Tasks give centred moments; their means are brought together first, and the moments moved to the mean of all.
    """
    live = np.flatnonzero(model.eigenvalues > 0)
    k = len(live)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moment = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            matrix = finite_rows(batch.column(0), model.size)[2]
            for at in range(0, len(matrix), 4096):
                w = model.project(model.deviations(matrix[at : at + 4096])[0])[:, live]
                own, gap = w.mean(axis=0), w.mean(axis=0) - mean
                moment += (w - own).T @ (w - own) + np.outer(gap, gap) * (n * len(w) / (n + len(w)))
                n, mean = n + len(w), mean + gap * (len(w) / (n + len(w)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([moment.ravel().tolist()])], names=["n", "mean", "moment"])

    parts = stored(rows.select("embedding").mapInArrow(run, "n long, mean array<double>, moment array<double>"), "moments")
    weighted = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    mean = [r[1] for r in weighted.orderBy("i").collect()]  # a number a component
    off = [F.get("mean", F.lit(i)) - mean[i] for i in range(k)]
    moved = F.array(*(F.get("moment", F.lit(i * k + j)) + F.col("n") * off[i] * off[j] for i in range(k) for j in range(k)))
    summed = parts.select("n", F.posexplode(moved).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    worst = summed.select(F.max(F.abs(F.col("v") / F.col("n") - F.when(F.col("at") % (k + 1) == 0, 1.0).otherwise(0.0)))).first()
    return worst[0]


WHITENED = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, components: int = 8) -> DataFrame:
    """A row for each finite vector of ``vectors(vec_id, embedding)`` and component: vec_id, component (from 1), n, deviation,
    deviation_exact, whitened, explained and identity_error.

    Vectors that are null or hold a null or non-finite entry take no part, and neither do those not of the commonest length
    (the longer of equally common ones). Null vec_ids and repeated rows take part, each as a row. A component that doesn't
    vary has a null whitened value and is left out of identity_error; where nothing varies explained is null. deviation is
    null where the exact number passes a long, deviation_exact where it passes 38 digits. Entries beyond 2**52 are clipped
    there. Vectors of fewer dimensions than components have that many; of none, no rows. An empty table gives no rows. Other columns are ignored.
    """
    rows = entries(vectors)
    model = fit(vectors, components)
    if model is None or not len(model.axes):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    error, k = identity_error(rows, model), len(model.axes)
    names = [part.split()[0] for part in WHITENED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, matrix = finite_rows(batch.column(1), model.size)
            ids = batch.column(0).take(pa.array(row))
            for at in range(0, len(row), 4096):
                off, squares = model.deviations(matrix[at : at + 4096])
                w, m = model.project(off), len(off)
                again = np.repeat(np.arange(m), k)
                deviation = pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()).take(pa.array(again))
                told = pa.array([v if v < 10**38 else None for v in squares], pa.decimal128(38, 0)).take(pa.array(again))
                columns = [
                    ids.slice(at, m).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation, told,
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, m), from_pandas=True), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, WHITENED)
