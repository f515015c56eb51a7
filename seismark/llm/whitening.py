"""Whitening of vectors with components from the exact characteristic polynomial of their scatter.

Vectors become integers, floor(64 x) + 1000000; each distinct one counts once. Tasks sum products exactly, which gives the
integer matrix M = n sum(x x') - S S' = n^2 V. Its characteristic polynomial is found modulo many primes, each in a task, by
Hessenberg reduction, and put together by Chinese remainders. All its roots are real, so Descartes' rule counts those above
a point exactly after a shift; bisection isolates the greatest ones to 2^-128 of their size. A component is the null space of
M - root, by inverse iteration with 320-bit fixed-point numbers; equal roots share one space, of which an orthonormal basis
is taken. Only sums, primes and roots, whose number depends on the dimension alone, pass through the driver.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; shorter vectors count as followed
by zeros, an empty one too; entries beyond 64 bits are cut to the range of a long; repeated vectors count once in the fit but
each row is returned, with null ids too; components without variance cannot be scaled and are left out, so that fewer than
``components`` come back where the rank is less; equal roots share a space in which any basis is right; a deviation beyond
38 digits is null; an empty table, or one with a single distinct vector, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

SCALE, COMPONENTS = 64, 16
#: Bits to which roots are isolated, relative to their size, and bits after the point in inverse iteration.
ROOT_BITS, POINT = 128, 320
#: A sum is carried as three limbs of this many bits.
_LIMB, _LIMBS = 60, 3


# --- exact sums


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.int64).reshape(-1, d)


def scatter_sums(y: np.ndarray) -> list[list[int]]:
    """The exact sums of products of the columns of ``y`` and a column of ones."""
    rows = np.concatenate([y, np.ones((len(y), 1), np.int64)], 1)
    most = max(int(np.abs(rows.astype(np.float64)).max()), 1) if len(rows) else 1
    step = (1 << 53) // (most * most)
    if not step:
        rows = rows.astype(object)
        return (rows.T @ rows).tolist()
    total = np.zeros((rows.shape[1],) * 2, object)
    for i in range(0, len(rows), step):
        part = rows[i : i + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total.tolist()


def _sum_rows(d: int):
    """(i, j, limbs) of one task's sums, i >= j; index d is the column of ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            total += np.array(scatter_sums(_matrix(batch.column("y"), d)), object)
        low = [(i, j, int(total[i, j])) for i in range(d + 1) for j in range(i + 1)]
        mask = (1 << _LIMB) - 1
        limbs = [[v >> _LIMB * k if k == _LIMBS - 1 else v >> _LIMB * k & mask for _, _, v in low] for k in range(_LIMBS)]
        named = {f"limb{k}": pa.array([Decimal(x) for x in limbs[k]], pa.decimal128(28, 0)) for k in range(_LIMBS)}
        yield pa.record_batch({"i": pa.array([i for i, _, _ in low], pa.int32()), "j": pa.array([j for _, j, _ in low], pa.int32())} | named)

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y, and n^2 times the covariance, all exact."""
    limbs = [f"limb{k}" for k in range(_LIMBS)]
    schema = "i int, j int, " + ", ".join(f"{c} decimal(28,0)" for c in limbs)
    rows = fit.mapInArrow(_sum_rows(d), schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect()
    sums = {(r.i, r.j): sum(int(r[c]) << _LIMB * k for k, c in enumerate(limbs)) for r in rows}
    n, s = sums.get((d, d), 0), [sums.get((d, j), 0) for j in range(d)]
    m = [[n * sums.get((max(i, j), min(i, j)), 0) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, m


# --- the characteristic polynomial


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` greatest primes below ``top`` (below 2^32), by the bases 2, 3, 5 and 7, which decide there."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, p)
            if x in (1, p - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                return False
        return p != 3215031751

    found, p = [], top - 1 - top % 2
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 2
    return found


def polynomial_modulo(m: list[list[int]], p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x I - m) modulo the prime p, by reduction to Hessenberg form."""
    h = np.array([[v % p for v in row] for row in m], np.int64)
    d = len(h)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        pivot = j + 1 + below[0]
        h[[j + 1, pivot]] = h[[pivot, j + 1]]
        h[:, [j + 1, pivot]] = h[:, [pivot, j + 1]]
        factor = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - factor[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * factor % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        weights, chain = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else 0
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (weights[:, None] * polys[: k + 1] % p).sum(0)) % p
    return polys[d]


def _residues(m: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column("prime").to_pylist()
            yield pa.record_batch({"prime": batch.column("prime"), "c": pa.array([polynomial_modulo(m, p).tolist() for p in primes], pa.list_(pa.int64()))})

    return run


def polynomial_bits(m: list[list[int]]) -> int:
    """Bits of the greatest coefficient at most: the kth is a sum of minors, at most C(d, k) (trace / d)^k for such matrices."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    return max((math.comb(d, k) * (trace // d + 1) ** k).bit_length() for k in range(d + 1)) + 2


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers nearest to zero with the given residues."""
    product = math.prod(residues)
    total = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        rest = product // p
        unit = rest * pow(rest, -1, p)
        total = [t + v * unit for t, v in zip(total, values, strict=True)]
    return [v - product if 2 * v > product else v for v in (t % product for t in total)]


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    primes = primes_below(1 << 31, polynomial_bits(m) // 30 + 1)
    frame = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    return remaindered({r.prime: r.c for r in frame.mapInArrow(_residues(m), "prime long, c array<long>").collect()})


# --- its greatest roots


def _scaled(c: list[int], s: int) -> list[int]:
    return [v << s * (len(c) - 1 - k) for k, v in enumerate(c)]


def _roots_above(c: list[int], a: int, s: int) -> int:
    """Number of roots above a / 2^s of a polynomial whose roots are all real: the sign changes after a shift."""
    c = _scaled(c, s)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(c: list[int], a: int, s: int) -> int:
    value = 0
    for k, v in enumerate(reversed(c)):
        value = value * a + (v << s * k)
    return (value > 0) - (value < 0)


def greatest_roots(c: list[int], count: int) -> list[tuple[int, int, int]]:
    """(a, s, multiplicity), falling: about a / 2^s each, of the greatest positive roots, ``count`` or a few more by multiplicity."""
    c = c[next(i for i, v in enumerate(c) if v) :]
    degree = len(c) - 1
    found, stack = [], [(0, 1 << max(-c[-2], 1).bit_length(), 0, degree, 0)] if degree else []
    while stack:
        low, high, s, above_low, above_high = stack.pop()
        if above_low == above_high or above_high >= count:
            continue
        if low and (high - low) << ROOT_BITS <= low:
            found.append((low + high, s + 1, above_low - above_high))
            continue
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        middle = (low + high) // 2
        if above_low - above_high == 1:
            between = above_high + (_sign(c, middle, s) * (-1) ** above_high < 0)
        else:
            between = _roots_above(c, middle, s)
        stack += [(low, middle, s, above_low, between), (middle, high, s, between, above_high)]
    return found


# --- components


def null_space(m: list[list[int]], a: int, s: int, k: int) -> np.ndarray:
    """An orthonormal basis, as rows, of the k-dimensional space that m - a / 2^s takes to (nearly) nothing."""
    d = len(m)
    size = max(max(abs(v) for row in m for v in row), 1).bit_length()
    b = np.array([[((m[i][j] << s) - (a if i == j else 0) << POINT) >> s + size for j in range(d)] for i in range(d)], object)
    order, pivots = np.arange(d), []
    for j in range(d):
        best = j + max(range(d - j), key=lambda i: abs(b[j + i, j]))
        b[[j, best]], order[[j, best]] = b[[best, j]], order[[best, j]]
        pivot = b[j, j] or 1
        pivots.append(pivot)
        if j + 1 < d:
            factor = (b[j + 1 :, j] << POINT) // pivot
            b[j + 1 :, j] = factor
            b[j + 1 :, j + 1 :] -= factor[:, None] * b[j, j + 1 :] >> POINT
    x = np.array([[(((i * i + 3 * i) * (2 * t + 3) + 7 * t * i + 1) % 1009 + 1 << POINT) // 1009 for t in range(k)] for i in range(d)], object)
    for _ in range(3):
        x = x[order]
        for j in range(d):
            x[j + 1 :] -= b[j + 1 :, j][:, None] * x[j] >> POINT
        for j in range(d - 1, -1, -1):
            x[j] = (x[j] << POINT) // pivots[j]
            x[:j] -= b[:j, j][:, None] * x[j] >> POINT
        for t in range(k):
            scale = max(max(abs(v) for v in x[:, t]).bit_length() - POINT, 0)
            x[:, t] = x[:, t] >> scale
            for _ in range(2):
                for u in range(t):
                    x[:, t] -= x[:, u] * (sum(x[:, u] * x[:, t]) >> POINT) >> POINT
            x[:, t] = (x[:, t] << POINT) // max(math.isqrt(sum(x[:, t] * x[:, t])), 1)
    basis = np.array([[v / (1 << POINT) for v in x[:, t]] for t in range(k)])
    return basis * np.where(basis[np.arange(k), np.abs(basis).argmax(1)] < 0, -1.0, 1.0)[:, None]


def _component_rows(m: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                basis = null_space(m, int(r["a"]), r["s"], r["k"])
                first = range(r["first"], r["first"] + len(basis))
                yield pa.record_batch({"component": pa.array(first, pa.int32()), "axis": pa.array(basis.tolist(), pa.list_(pa.float64()))})

    return run


# --- projections


def _offsets(y: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """y - S / n, and the exact sum of (n y - S)^2 of each row; wide integers where 64 bits would not do."""
    whole, rest = [v // n for v in s], [v % n for v in s]
    most = max(int(np.abs(y.astype(np.float64)).max()) if y.size else 0, max(abs(v) for v in whole)) * 2 + 2
    if (n * most) ** 2 * max(len(s), 1) < 1 << 63:
        near = y - np.array(whole, np.int64)
        exact = near * n - np.array(rest, np.int64)
        return near - np.array([r / n for r in rest]), (exact * exact).sum(1)
    near = y.astype(object) - np.array(whole, object)
    exact = near * n - np.array(rest, object)
    return near.astype(np.float64) - np.array([r / n for r in rest]), (exact * exact).sum(1)


def _project_rows(d: int, n: int, s: list[int], axes: np.ndarray, deviations: np.ndarray, shares: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(axes)
        for batch in batches:
            centred, square = _offsets(_matrix(batch.column("y"), d), n, s)
            held = [Decimal(int(v)) if v < 10**38 else None for v in square]
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(batch.num_rows), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    "deviation": pa.array(held, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(batch.num_rows), k))),
                    "whitened": pa.array((centred @ axes.T / deviations).ravel()),
                    "explained": pa.array(np.tile(shares, batch.num_rows)),
                }
            )

    return run


def _covariance_rows(d: int, n: int, s: list[int], axes: np.ndarray, deviations: np.ndarray):
    """(i, j, n, c, mi, mj) of each batch: products of whitened values, centred in the batch, and its means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.indices((len(axes), len(axes))).reshape(2, -1).astype(np.int32)
        for batch in batches:
            w = _offsets(_matrix(batch.column("y"), d), n, s)[0] @ axes.T / deviations
            mean = w.mean(0)
            c = (w - mean).T @ (w - mean)
            yield pa.record_batch({"i": pa.array(at[0]), "j": pa.array(at[1]), "n": pa.array(np.full(at.shape[1], len(w))), "c": pa.array(c.ravel()), "mi": pa.array(mean[at[0]]), "mj": pa.array(mean[at[1]])})

    return run


def _identity_error(fit: DataFrame, *model) -> float:
    parts = fit.mapInArrow(_covariance_rows(*model), "i int, j int, n long, c double, mi double, mj double")
    sums = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), (F.sum("c") + F.sum(F.expr("n * mi * mj"))).alias("c"), F.sum(F.expr("n * mi")).alias("a"), F.sum(F.expr("n * mj")).alias("b"))
    entry = F.expr("abs((c - a * b / n) / n - if(i = j, 1, 0))")
    return sums.agg(F.max(entry).alias("error")).first().error


_SCHEMA = "vec_id long, component int, deviation decimal(38,0), whitened double, explained double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row of ``vectors`` (vec_id, embedding) and component."""
    spark = vectors.sparkSession
    sound = vectors.where("embedding IS NOT NULL AND NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(double(v)) = double('inf'))")
    entries = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    plain = sound.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("y"))
    d = plain.agg(F.max(F.size("y"))).first()[0] or 0
    nothing = spark.createDataFrame([], _SCHEMA).withColumns({"n": F.lit(0).cast("long"), "identity_error": F.lit(0.0)})
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not d:
        return nothing.select(columns)
    plain = plain.withColumn("y", F.concat("y", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("y"))))
    fit = written(plain.select("y").distinct())
    n, s, m = scatter(fit, d)
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        return nothing.select(columns)
    roots = greatest_roots(characteristic_polynomial(spark, m), components)
    firsts = np.cumsum([1] + [k for _, _, k in roots])
    asked = spark.createDataFrame([(int(first), str(a), s_, k) for first, (a, s_, k) in zip(firsts, roots, strict=False)], "first int, a string, s int, k int")
    axes = {r.component: r.axis for r in asked.repartition(len(roots)).mapInArrow(_component_rows(m), "component int, axis array<double>").collect()}
    count = min(components, len(axes))
    values = [(a, s_) for a, s_, k in roots for _ in range(k)][:count]
    axis = np.array([axes[i + 1] for i in range(count)])
    deviations = np.array([math.sqrt(a / ((n * n) << s_)) for a, s_ in values])
    shares = np.array([a / (trace << s_) for a, s_ in values])
    error = _identity_error(fit, d, n, s, axis, deviations)
    rows = plain.mapInArrow(_project_rows(d, n, s, axis, deviations, shares), _SCHEMA)
    return rows.withColumns({"n": F.lit(n).cast("long"), "identity_error": F.lit(error)}).select(columns)
