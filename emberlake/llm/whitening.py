"""Whitening of embeddings with components from the exact characteristic polynomial.

Vectors become integers x = floor(scale * c). The fit list holds every distinct x once; its
count n, sums S and products P are exact integers, and so is A = n * P - S S', which is n
squared times the covariance. The characteristic polynomial of A is computed modulo many
primes, a batch of primes in a task: A is brought to Hessenberg form modulo a prime and the
recurrence of Hessenberg matrices gives the coefficients. Chinese remaindering joins the
residues; the number of primes follows from a bound on the coefficients, so the polynomial
is exact.

All its roots are real, therefore the sign changes of the coefficients of f(x + t) count
the roots above t, with their multiplicity, without error. Bisection by that count isolates
each of the largest roots; an isolated one is refined by the sign of f, to ``BITS`` binary
digits after the point. Inverse iteration in decimals of more digits than that finds the
null vector of A minus the root; roots that coincide get an orthonormal set.

Whitened values, deviations and the share of the variance come from a pass over all rows.
The identity error is the largest entry of the whitened values' covariance minus the
identity, from A and the components that were used.

Each length of vectors is a space of its own, all fitted in one pass. Vectors that are null
or hold null, non-finite or, times ``scale``, no 64-bit entries are left out; empty vectors
and spaces without variance have no components and so no rows; components of variance zero
are not numbered. Repeated rows and repeated ids give rows of their own and count once in
the fit; null ids stay null; an empty table gives an empty result. Other columns are not
read. A deviation beyond 38 digits is null.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Binary digits of roots after the point, primes that a task takes, digits of a summed limb.
BITS, BATCH, LIMB = 128, 8, 32


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as rows of doubles) for each length in a column of lists."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, values[starts[rows][:, None] + np.arange(dim)]


def usable(df: DataFrame, vector_col: str, scale: float) -> DataFrame:
    """Rows whose vector is not empty and holds entries only that are finite and, scaled, fit 64 bits."""
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.withColumn("_v", F.col(vector_col).cast(kind))
    fits = F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * scale < 2.0**62), F.lit(False)))
    return rows.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & fits)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale).astype(np.int64)


def _packed(rows: DataFrame, scale: float) -> DataFrame:
    """One binary value per vector: bytes of an integer, then the integers; equal vectors have equal values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for at, values in matrices(batch.column("_v")):
                x = whole(values, scale)
                most = np.maximum(x.max(1), -1 - x.min(1))
                for width, least, limit in ((2, -1, 2**15), (4, 2**15, 2**31), (8, 2**31, 2**63)):
                    fit = np.flatnonzero((most >= least) & (most < limit))
                    head = bytes([width])
                    for i, row in zip(at[fit].tolist(), x[fit].astype(f"<i{width}")):
                        out[i] = head + row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["x"])

    return rows.select("_v").mapInArrow(pack, "x binary")


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers."""
    most = max(int(x.max()), -int(x.min()), 1)
    rows = 2**53 // (most * most)
    if not rows:
        big = x.astype(object)
        return big.T @ big
    total = np.zeros((x.shape[1],) * 2, object)
    for i in range(0, len(x), rows):
        part = x[i : i + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, place = (1 if value >= 0 else -1), abs(value), 0
    while rest:
        yield place, sign * (rest & (2**LIMB - 1))
        rest, place = rest >> LIMB, place + 1


@dataclass
class Scatter:
    """Count, sums and the integer matrix n * P - S S' of a fit list."""

    n: int
    sums: list[int]
    matrix: np.ndarray


def scatters(rows: DataFrame, scale: float) -> dict[int, Scatter]:
    """The exact scatter of the distinct vectors of every length.

    Each partition sends one number per pair of dimensions and limb, summed as 64-bit
    integers; the driver receives d * (d + 3) / 2 sums.
    """

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        products: dict[int, np.ndarray] = {}
        for frame in frames:
            kinds = pd.Series([(v[0], (len(v) - 1) // v[0]) for v in frame["x"]], dtype=object)
            for width, dim in set(kinds):
                raw = b"".join(v[1:] for v, kind in zip(frame["x"], kinds) if kind == (width, dim))
                x = np.frombuffer(raw, f"<i{width}").reshape(-1, dim).astype(np.int64)
                counts[dim] = counts.get(dim, 0) + len(x)
                sums[dim] = sums.get(dim, 0) + x.astype(object).sum(0)
                products[dim] = products.get(dim, 0) + exact_products(x)
        out = []
        for dim, n in counts.items():
            values = [(-1, -1, n), *((-1, i, int(s)) for i, s in enumerate(sums[dim]))]
            values += [(i, j, int(products[dim][i, j])) for i in range(dim) for j in range(i, dim)]
            out += [(dim, i, j, place, limb) for i, j, value in values for place, limb in limbs(value)]
        yield pd.DataFrame(out, columns=["dim", "i", "j", "place", "limb"])

    parts = _packed(rows, scale).distinct().mapInPandas(moments, "dim int, i int, j int, place int, limb long")
    totals: dict[int, dict] = {}
    for r in parts.groupBy("dim", "i", "j", "place").agg(F.sum("limb").alias("limb")).toLocalIterator():
        at = totals.setdefault(r["dim"], {})
        at[r["i"], r["j"]] = at.get((r["i"], r["j"]), 0) + (r["limb"] << (LIMB * r["place"]))
    out = {}
    for dim, at in totals.items():
        n, sums = at[-1, -1], [at.get((-1, i), 0) for i in range(dim)]
        matrix = np.empty((dim, dim), object)
        for i in range(dim):
            for j in range(i, dim):
                matrix[i, j] = matrix[j, i] = n * at.get((i, j), 0) - sums[i] * sums[j]
        out[dim] = Scatter(n, sums, matrix)
    return out


def is_prime(n: int) -> bool:
    """Exact below 3 * 10**9 with these bases."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product exceeds ``bound``."""
    out, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def hessenberg(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Similar Hessenberg matrices of ``a[k]`` modulo ``p[k]``."""
    a, p1, p2, k = a.copy(), p[:, None], p[:, None, None], np.arange(len(p))
    for m in range(a.shape[1] - 2):
        nonzero = a[:, m + 1 :, m] != 0
        pivot = m + 1 + nonzero.argmax(1)
        rows = a[k, pivot].copy()
        a[k, pivot] = a[:, m + 1]
        a[:, m + 1] = rows
        columns = a[k, :, pivot].copy()
        a[k, :, pivot] = a[:, :, m + 1]
        a[:, :, m + 1] = columns
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(a[:, m + 1, m], p)])
        u = a[:, m + 2 :, m] * inverse[:, None] % p1
        a[:, m + 2 :] = (a[:, m + 2 :] - u[:, :, None] * a[:, m + 1, None, :] % p2) % p2
        a[:, :, m + 1] = (a[:, :, m + 1] + (a[:, :, m + 2 :] * u[:, None, :] % p2).sum(2)) % p1
    return a


def residues(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - a[k]) modulo p[k], from the constant up."""
    h, p1, d = hessenberg(a, p), p[:, None], a.shape[1]
    polys = np.zeros((len(p), d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    # below[:, i] is the product of the subdiagonal entries from row i + 1 to row m.
    below = np.ones((len(p), d), np.int64)
    for m in range(d):
        if m:
            below[:, :m] = below[:, :m] * h[:, m, m - 1][:, None] % p1
        factors = h[:, : m + 1, m] * below[:, : m + 1] % p1
        mixed = (factors[:, :, None] * polys[:, : m + 1] % p[:, None, None]).sum(1)
        polys[:, m + 1, 1:] = polys[:, m, :-1]
        polys[:, m + 1] = (polys[:, m + 1] - mixed) % p1
    return polys[:, d]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix) for a positive semidefinite integer matrix, from the constant up.

    The k-th elementary symmetric function of nonnegative roots with sum T is at most
    C(d, k) * (T / d) ** k. Residues are computed by Spark tasks; the driver receives one
    number for each coefficient and prime.
    """
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    bound = max(-(-math.comb(d, k) * trace**k // d**k) for k in range(d + 1))
    primes = primes_beyond(2 * bound + 1)
    entries = matrix.tolist()

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch in frame["id"]:
                p = np.array(primes[batch * BATCH : (batch + 1) * BATCH], np.int64)
                a = np.array([[[v % int(q) for v in row] for row in entries] for q in p], np.int64)
                yield pd.DataFrame({"prime": p, "coefficients": list(residues(a, p))})

    batches = -(-len(primes) // BATCH)
    found = spark.range(0, batches, 1, batches).mapInPandas(solve, "prime long, coefficients array<long>").collect()
    total, product = [0] * (d + 1), 1
    for row in found:
        p, inverse = row["prime"], pow(product, -1, row["prime"])
        total = [t + product * ((r - t) * inverse % p) for t, r in zip(total, row["coefficients"])]
        product *= p
    return [t - product if 2 * t > product else t for t in total]


def roots_above(f: list[int], t: int, bits: int) -> int:
    """How many roots of the real-rooted ``f`` exceed t / 2**bits, with multiplicity."""
    while bits and t % 2 == 0:
        t, bits = t // 2, bits - 1
    d = len(f) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(f)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(f: list[int], t: int, bits: int) -> int:
    while bits and t % 2 == 0:
        t, bits = t // 2, bits - 1
    value = 0
    for i, v in enumerate(reversed(f)):
        value = value * t + (v << (bits * i))
    return (value > 0) - (value < 0)


def largest_roots(f: list[int], trace: int, count: int) -> list[int]:
    """The largest positive roots times 2**BITS, rounded up, by falling size; multiple roots repeat."""
    counts: dict[int, int] = {}

    def above(t: int) -> int:
        if t not in counts:
            counts[t] = roots_above(f, t, BITS)
        return counts[t]

    out = []
    for number in range(1, min(count, above(0)) + 1):
        # The root of this number lies in (low, high].
        low, high = 0, (trace + 1) << BITS
        sign = None
        while high - low > 1:
            middle = (low + high) // 2
            if sign is None and above(low) == number and above(high) == number - 1:
                # A simple root: f has one sign between it and high, the other below it.
                sign = sign_at(f, high, BITS)
                if not sign:
                    break
            if sign is None:
                over = above(middle) >= number
            else:
                over = sign_at(f, middle, BITS) == -sign
            low, high = (middle, high) if over else (low, middle)
        out.append(high)
    return out


def null_vectors(matrix: np.ndarray, roots: list[int]) -> list[np.ndarray]:
    """Orthonormal decimal vectors, each the null vector of ``matrix`` minus its root."""
    d, found = len(matrix), []
    with decimal.localcontext() as context:
        context.prec = 60 + 2 * len(str(roots[0] + 1))
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        tiny = Decimal(10) ** -(context.prec // 2)
        for root in roots:
            a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
            a[np.arange(d), np.arange(d)] -= Decimal(root) / 2**BITS
            order = list(range(d))
            for m in range(d):
                best = max(range(m, d), key=lambda i: abs(a[i, m]))
                a[[m, best]] = a[[best, m]]
                order[m], order[best] = order[best], order[m]
                if not a[m, m]:
                    a[m, m] = tiny
                if m + 1 < d:
                    a[m + 1 :, m] = a[m + 1 :, m] / a[m, m]
                    a[m + 1 :, m + 1 :] = a[m + 1 :, m + 1 :] - np.outer(a[m + 1 :, m], a[m, m + 1 :])
            y = np.array([Decimal((i * i * 31 + i * (7 + len(found)) + 11) % 97 + 1) for i in range(d)], object)
            for _ in range(4):
                for other in found:
                    y = y - other * (y @ other)
                y = y[order]
                for i in range(1, d):
                    y[i] -= a[i, :i] @ y[:i]
                for i in reversed(range(d)):
                    y[i] = (y[i] - (a[i, i + 1 :] @ y[i + 1 :] if i + 1 < d else 0)) / a[i, i]
                y = y / max(map(abs, y))
                y = y / (y @ y).sqrt()
            for other in found:
                y = y - other * (y @ other)
            found.append(y / (y @ y).sqrt())
    return found


@dataclass
class Whitening:
    """What a fit gives: count, sums, components as rows, eigenvalues, shares of the variance, identity error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def solved(spark: SparkSession, scatter: Scatter, count: int) -> Whitening | None:
    trace = int(sum(scatter.matrix.diagonal()))
    if not trace:
        return None
    roots = largest_roots(characteristic(spark, scatter.matrix), trace, count)
    vectors = null_vectors(scatter.matrix, roots)
    square = scatter.n**2
    with decimal.localcontext() as context:
        context.prec = 60 + 2 * len(str(roots[0] + 1))
        exact = [Decimal(r) / 2**BITS for r in roots]
        values = np.array([float(e / square) for e in exact])
        explained = np.array([float(e / trace) for e in exact])
        components = np.array([[float(v) for v in vector] for vector in vectors])
        used = np.array([[Decimal(v) for v in row] for row in components.tolist()], object)
        big = np.array([[Decimal(int(v)) for v in row] for row in scatter.matrix], object)
        scaled = [Decimal(v).sqrt() for v in values.tolist()]
        covariance = used @ big @ used.T
        error = max(abs(covariance[i, j] / square / (scaled[i] * scaled[j]) - (i == j)) for i in range(len(roots)) for j in range(len(roots)))
    return Whitening(scatter.n, scatter.sums, components, values, explained, float(error))


def fitted(df: DataFrame, count: int = 4, scale: float = 256.0, vector_col: str = "embedding") -> dict[int, Whitening]:
    """The whitening of every vector length that has variance."""
    found = {dim: solved(df.sparkSession, scatter, count) for dim, scatter in scatters(usable(df, vector_col, scale), scale).items()}
    return {dim: w for dim, w in found.items() if w}


def deviations(x: np.ndarray, fit: Whitening) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences n * x - S as doubles, and their exact sums of squares as multiples of 2**62 and rests."""
    most = fit.n * max(int(x.max()), -int(x.min()), 0) + max(map(abs, fit.sums))
    if most * most * x.shape[1] < 2**62:
        apart = x * fit.n - np.array(fit.sums, np.int64)
        return apart.astype(np.float64), np.zeros(len(x), np.int64), (apart * apart).sum(1)
    big = x.astype(object) * fit.n - np.array(fit.sums, object)
    squares = (big * big).sum(1)
    fits = [int(s) if s < 10**38 else None for s in squares]
    high = pa.array([None if s is None else s >> 62 for s in fits], pa.decimal128(38, 0))
    return big.astype(np.float64), high, np.array([0 if s is None else s & (2**62 - 1) for s in fits], np.int64)


def whitened(df: DataFrame, count: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, eigenvalue, explained, identity_error) of every usable row and component."""
    fits = fitted(df, count, scale, vector_col)
    rows = usable(df, vector_col, scale)
    kind = dict(df.dtypes)[id_col]
    names = ["vec_id", "component", "n", "high", "low", "whitened", "eigenvalue", "explained", "identity_error"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in matrices(batch.column("_v")):
                fit = fits.get(values.shape[1])
                if not fit:
                    continue
                apart, high, low = deviations(whole(values, scale), fit)
                k = len(fit.values)
                row, which = np.repeat(np.arange(len(at)), k), np.tile(np.arange(k), len(at))
                projected = apart / fit.n @ fit.components.T / np.sqrt(fit.values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(at[row])), pa.array((which + 1).astype(np.int32)), pa.array(np.full(len(row), fit.n)),
                        (high if isinstance(high, pa.Array) else pa.array(high).cast(pa.decimal128(38, 0))).take(pa.array(row)), pa.array(low[row]),
                        pa.array(projected.reshape(-1)), pa.array(fit.values[which]), pa.array(fit.explained[which]),
                        pa.array(np.full(len(row), fit.identity_error)),
                    ],
                    names,
                )

    out = rows.select(F.col(id_col).alias("_id"), "_v").mapInArrow(
        apply,
        f"vec_id {kind}, component int, n long, high decimal(38,0), low long, whitened double, eigenvalue double, explained double, identity_error double",
    )
    exact = F.expr("cast(high * 4611686018427387904bd + low as decimal(38,0))")
    return out.select("vec_id", "component", "n", exact.alias("deviation"), *names[5:])


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # Where a sum of squares does not fit a long, the contract's column is null; the operator has it.
    return out.select(
        "vec_id", "component", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "whitened", "explained", "identity_error"
    )


QUERIES = {"op13_whitening": op13_whitening}
