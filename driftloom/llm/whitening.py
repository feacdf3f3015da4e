"""Embedding whitening (operator 13).

Method: exact characteristic polynomial. Vectors become integers, so their scatter is an integer
matrix. Its characteristic polynomial is computed modulo many primes (Hessenberg form, one prime a
Spark row) and put together by Chinese remaindering. All roots are real, so the sign changes of
the shifted polynomial count the roots above a point exactly, and bisection isolates each root to
``FRACTION`` binary places. A component is the null space of the scatter less that root, found by
inverse iteration in fixed-point integers.

What reaches the driver has the size of the scatter: dimension x dimension, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch, table
from driftloom.llm.vectors import finite_rows

#: Steps of the integer grid in one unit, and components given.
GRID, COMPONENTS = 256, 4
#: Binary places of a root, and of the fixed-point arithmetic beyond the scatter's own size.
FRACTION, GUARD = 160, 320
#: Bits of a limb and rows of a block, so that sums of limb products are exact in doubles.
LIMB, BLOCK = 20, 4096
_LOW = 60


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles l0, l1, .. with x = l0 + l1 * 2^LIMB + ..; only the last has a sign."""
    out = []
    while x.size and (x.max() >= 1 << LIMB or x.min() < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def _moments(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, hi, lo): a task's sums of x_i * x_j (i <= j), of x_j (i = -1) and of rows (i = j = -1), as hi * 2^60 + lo."""
    squares, sums, n = np.zeros((width, width), object), np.zeros(width, object), 0
    for batch in batches:
        whole = _matrix(batch.column(0), width)
        for at in range(0, len(whole), BLOCK):
            parts = _limbs(whole[at : at + BLOCK])
            n += len(parts[0])
            for a, one in enumerate(parts):
                sums += one.sum(axis=0).astype(np.int64).astype(object) << (LIMB * a)
                for b, two in enumerate(parts):
                    squares += (one.T @ two).astype(np.int64).astype(object) << (LIMB * (a + b))
    if not n:
        return
    told = [(-1, -1, n), *((-1, j, int(sums[j])) for j in range(width)), *((i, j, int(squares[i, j])) for i in range(width) for j in range(i, width))]
    i, j, value = zip(*told)
    wide = pa.decimal128(38, 0)
    parts = [pa.array([Decimal(v >> _LOW) for v in value], wide), pa.array([Decimal(v & ((1 << _LOW) - 1)) for v in value], wide)]
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *parts], ["i", "j", "hi", "lo"])


def scatter(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, A) of the integer vectors ``x``: how many, their sums, and n * sum(x x') - S S', exactly."""
    told = fit.select("x").mapInArrow(partial(_moments, width), "i int, j int, hi decimal(38,0), lo decimal(38,0)")
    n, sums, squares = 0, [0] * width, np.zeros((width, width), object)
    for r in told.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect():  # width^2 / 2 rows
        value = (int(r.hi) << _LOW) + int(r.lo)
        if r.j < 0:
            n = value
        elif r.i < 0:
            sums[r.j] = value
        else:
            squares[r.i, r.j] = squares[r.j, r.i] = value
    s = np.array(sums, object)
    return n, sums, n * squares - s[:, None] * s[None, :]


def primes_for(bits: int) -> list[int]:
    """The largest primes below 2^31, so many that their product has over ``bits`` bits."""
    small = [p for p in range(2, 46341) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    out, total, top, step = [], 0.0, 1 << 31, 1 << 16
    while total <= bits + 1:
        low, fine = top - step, np.ones(step, bool)
        for p in small:
            fine[-low % p :: p] = False
        for p in (low + np.flatnonzero(fine)[::-1]).tolist():
            out.append(p)
            total += math.log2(p)
            if total > bits + 1:
                break
        top = low
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, the constant first, of det(t I - a) modulo a prime below 2^31, by its Hessenberg form."""
    h, d = (a % p).astype(np.int64), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        times = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - times[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * times % p).sum(axis=1)) % p
    # found[k] is the polynomial of the leading k x k part.
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        row = np.r_[0, found[k - 1, :-1]] - h[k - 1, k - 1] * found[k - 1] % p
        down = 1
        for i in range(k - 1, 0, -1):
            down = down * int(h[i, i - 1]) % p
            if not down:
                break
            row -= h[i - 1, k - 1] * down % p * found[i - 1] % p
        found[k] = row % p
    return found[d]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients, the constant first, of det(t I - a) for a positive semidefinite integer matrix.

    With roots of at least 0 that sum to the trace, a coefficient is at most (1 + trace / d)^d.
    """
    d = len(a)
    bits = d * (1 + int(np.trace(a)) // d).bit_length() + 2
    primes, sent = primes_for(bits), spark.sparkContext.broadcast(a)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([polynomial_mod(sent.value, p).tolist() for p in own], pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), max(1, spark.sparkContext.defaultParallelism)))
    found = {r.p: r.c for r in rows.mapInArrow(residues, "p long, c array<long>").collect()}  # d + 1 numbers a prime
    sent.destroy()
    whole, out = math.prod(primes), [0] * (d + 1)
    for p in primes:
        rest = whole // p
        unit = rest * pow(rest, -1, p)
        for k, c in enumerate(found[p]):
            out[k] += c * unit
    return [c - whole if (c := x % whole) > whole // 2 else c for x in out]


def roots_above(poly: list[int], t: int) -> int:
    """How many roots, counted with multiplicity, of a polynomial with real roots only are above ``t``."""
    a = list(poly)
    for i in range(len(a) - 1):
        for j in range(len(a) - 2, i - 1, -1):
            a[j] += t * a[j + 1]
    signs = [c > 0 for c in a if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], most: int, fraction: int = FRACTION) -> list[int]:
    """The largest roots above 0 of a polynomial with real roots only, rounded up, times 2^fraction."""
    d = len(poly) - 1
    fine = [c << (fraction * (d - k)) for k, c in enumerate(poly)]  # its roots are 2^fraction times as large
    top, known = abs(poly[d - 1]), {}  # the roots sum to -poly[d - 1]

    def above(t: int) -> int:
        if t not in known:
            known[t] = roots_above(poly, t)
        return known[t]

    def sign(t: int) -> int:
        value = 0
        for c in reversed(fine):
            value = value * t + c
        return (value > 0) - (value < 0)

    out: list[int] = []
    for rank in range(1, min(most, above(0)) + 1):
        low, high = 0, top  # fewer than ``rank`` roots are above high, but not above low
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if above(mid) < rank else (mid, high)
        alone = above(low) - above(high) == 1
        low, high = low << fraction, high << fraction
        end = sign(high)
        if alone and end == 0:
            low = high - 1
        while high - low > 1:
            mid = (low + high) // 2
            if alone:
                at = sign(mid)
                low, high = (mid - 1, mid) if at == 0 else (low, mid) if at == end else (mid, high)
            else:
                low, high = (low, mid) if roots_above(fine, mid) < rank else (mid, high)
        out.append(high)
    return out


def _null_vector(a: np.ndarray, root: int, others: list[np.ndarray], scale: int, start: int) -> np.ndarray:
    """A vector of about 2^scale length in the null space of a - root / 2^FRACTION, across ``others``."""
    d = len(a)
    lu, order = a * (1 << scale), list(range(d))
    shift = (root << scale) >> FRACTION
    for i in range(d):
        lu[i, i] -= shift
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(lu[k + i, k]))
        if pivot != k:
            lu[[k, pivot]] = lu[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not lu[k, k]:
            lu[k, k] = 1
        for i in range(k + 1, d):
            lu[i, k] = (lu[i, k] << scale) // lu[k, k]
        if k + 1 < d:
            lu[k + 1 :, k + 1 :] -= (lu[k + 1 :, k : k + 1] * lu[k : k + 1, k + 1 :]) >> scale
    v = np.array([((i * i + start * 7919 + i * start) % 97 + 1) << scale for i in range(d)], object)
    for _ in range(4):
        y = v[order]
        for i in range(d):
            y[i] -= int((lu[i, :i] * y[:i]).sum()) >> scale if i else 0
        for i in range(d - 1, -1, -1):
            y[i] = ((y[i] - (int((lu[i, i + 1 :] * y[i + 1 :]).sum()) >> scale if i + 1 < d else 0)) << scale) // lu[i, i]
        for _ in range(2):
            length = math.isqrt(int((y * y).sum())) or 1
            y = np.array([(c << scale) // length for c in y], object)
            for other in others:
                y = y - ((int((y * other).sum()) * other) >> (2 * scale))
        length = math.isqrt(int((y * y).sum())) or 1
        v = np.array([(c << scale) // length for c in y], object)
    return v


def components(a: np.ndarray, roots: list[int]) -> np.ndarray:
    """Unit eigenvectors as columns, in the order of their roots; those of equal roots are any basis across each other."""
    scale, found, out = max(1, int(np.trace(a)).bit_length()) + GUARD, [], []
    for k, root in enumerate(roots):
        v = _null_vector(a, root, [w for r, w in zip(roots, found) if abs(r - root) <= 2], scale, k)
        found.append(v)
        out.append([int(c) / (1 << scale) for c in v])
    return np.array(out, float).reshape(len(roots), len(a)).T


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers, or Python's where these may not hold them."""
    far = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if far < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _projected(x: np.ndarray, n: int, sums: list[int], axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, whitened) of rows of x."""
    moved = _centred(x, n, sums)
    return moved, (moved / n).astype(np.float64) @ axes


class Whitening:
    """n, S, the dimension, axes (components over square roots of eigenvalues) and explained shares."""

    def __init__(self, spark: SparkSession, fit: DataFrame, width: int, most: int = COMPONENTS):
        self.n, self.sums, a = scatter(fit, width)
        trace = int(np.trace(a)) if width else 0
        poly = characteristic_polynomial(spark, a) if trace else [1]
        self.roots = largest_roots(poly, most) if trace else []
        values = [r / ((self.n * self.n) << FRACTION) for r in self.roots]
        self.axes = components(a, self.roots) / np.sqrt(np.array(values, float)) if self.roots else np.zeros((width, 0))
        self.explained = [r / (trace << FRACTION) for r in self.roots]
        self.width = width

    def identity_error(self, fit: DataFrame) -> float:
        """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
        n, sums, axes, width = self.n, self.sums, self.axes, self.width
        k = axes.shape[1]

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for batch in batches:
                white = _projected(_matrix(batch.column(0), width), n, sums, axes)[1]
                total += white.T @ white
            i, j = np.indices((k, k))
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "value"])

        if not k:
            return 0.0
        rows = fit.select("x").mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
        return max(abs(r.value / n - (r.i == r.j)) for r in rows)


def _squares(moved: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; null beyond 64 bits."""
    most = max(abs(int(moved.max(initial=0))), abs(int(moved.min(initial=0)))) if moved.size else 0
    if moved.dtype != object and most * most * moved.shape[1] < 1 << 63:
        return (moved * moved).sum(axis=1).tolist()
    return [s if (s := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in moved]


def whitened(df: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Each row with a finite vector and each component: (id_col, component, n, deviation, whitened, explained, identity_error).

    Null vectors and those with null or non-finite entries give no rows; shorter vectors are continued
    by zeros. Repeated rows are all given, and count once in the fit list. Null ids stay. There are as
    many components as eigenvalues above 0, so an empty table, or one with a single distinct vector,
    gives no rows. Of equal eigenvalues the components are any basis. Values beyond 64 bits go to the
    end of their range; a deviation beyond it is null. Other columns are not read.
    """
    spark = df.sparkSession
    rows, width = finite_rows(df, id_col, vector_col)
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * GRID)).alias("x"))
    fit = scratch.cut(rows.select("x").distinct(), "fit", release=True)
    told = Whitening(spark, fit, width, most)
    sent = spark.sparkContext.broadcast((told.n, told.sums, told.axes, told.explained, told.identity_error(fit), width))
    scratch.drop("fit")
    kind = rows.schema["id"].dataType

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, axes, explained, error, width = sent.value
        k = axes.shape[1]
        for batch in batches:
            if not k:
                continue
            x = _matrix(batch.column(1), width)
            moved, white = _projected(x, n, sums, axes)
            owner = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(_squares(moved), pa.int64()).take(pa.array(owner))
            arrays = [
                batch.column(0).take(pa.array(owner)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(owner), n, np.int64)),
                deviation, pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(owner), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(give, schema).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all of ``embeddings``."""
    return whitened(table(spark, sf_dir, "embeddings"), Scratch(spark, "whitening"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
