import numpy as np
import pytest
from fractions import Fraction
from decimal import Decimal

from emberlake.llm import whitening as W


def leverrier(a):
    """Characteristic polynomial in exact fractions, from the constant up."""
    d = len(a)
    a = [[Fraction(int(v)) for v in row] for row in a]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][l] * m[l][j] for l in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(a[i][l] * m[l][i] for i in range(d) for l in range(d)) / k)
    return [int(v) for v in reversed(c)]


def grams():
    random = np.random.default_rng(5)
    for d, rank in ((1, 1), (2, 2), (5, 5), (6, 3), (8, 8)):
        b = random.integers(-9, 10, (rank, d)).astype(object)
        yield b.T @ b
    yield np.array(np.diag([4, 4, 4, 1]).tolist(), object)
    yield np.array([[0, 0, 2], [0, 3, 0], [2, 0, 1]], object) @ np.array([[0, 0, 2], [0, 3, 0], [2, 0, 1]], object)


@pytest.mark.parametrize("matrix", list(grams()), ids=str)
def test_polynomial_roots_and_vectors(spark, matrix):
    f = W.characteristic(spark, matrix)
    assert f == leverrier(matrix)
    trace, exact = int(sum(matrix.diagonal())), np.linalg.eigvalsh(matrix.astype(float))[::-1]
    positive = [e for e in exact if e > 1e-9]
    roots = W.largest_roots(f, trace, 4)
    assert len(roots) == min(4, len(positive))
    np.testing.assert_allclose([r / 2**W.BITS for r in roots], positive[:4], rtol=1e-12)
    vectors = W.null_vectors(matrix, roots)
    for i, v in enumerate(vectors):
        rest = matrix.astype(float) @ v.astype(float) - roots[i] / 2**W.BITS * v.astype(float)
        assert np.abs(rest).max() < 1e-9 * max(1, trace)
        assert all(abs(v @ w - (i == j)) < Decimal("1e-24") for j, w in enumerate(vectors))


def test_polynomial_when_pivots_vanish_modulo_a_prime():
    p = np.array([2, 3, 5, 7], np.int64)
    random = np.random.default_rng(0)
    for _ in range(50):
        b = random.integers(-3, 4, (5, 5)).astype(object)
        a = b.T @ b
        got = W.residues(np.array([a % int(q) for q in p], np.int64), p)
        assert got.tolist() == [[c % int(q) for c in leverrier(a)] for q in p]


def brute(rows, count, scale=256):
    x = {i: [int(np.floor(scale * float(c))) for c in v] for i, (_, v) in enumerate(rows)
         if v and all(c is not None and np.isfinite(c) and abs(c * scale) < 2**62 for c in v)}
    out = []
    for dim in {len(v) for v in x.values()}:
        mine = {i: v for i, v in x.items() if len(v) == dim}
        fit = np.array(sorted(set(map(tuple, mine.values()))), object).reshape(-1, dim)
        n, sums = len(fit), fit.sum(0)
        centred = fit.astype(float) - (sums / n).astype(float)
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        for i, v in mine.items():
            deviation = sum((n * a - b) ** 2 for a, b in zip(v, sums))
            for k in range(min(count, dim)):
                if values[k] > 1e-9 * max(values[0], 1e-300) and values[0] > 1e-12:
                    w = (np.array(v, float) - (sums / n).astype(float)) @ vectors[:, k] / np.sqrt(values[k])
                    out.append((str(rows[i][0]), k + 1, n, deviation, abs(w), values[k] / values.sum()))
    return sorted(out, key=lambda r: (r[0], r[1], r[3], r[4]))


def run(spark, rows, kind="double", count=3):
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], f"vec_id long, embedding array<{kind}>, n double, component string").repartition(3)
    found = W.whitened(df, count).collect()
    assert all(r.identity_error <= 1e-9 for r in found)
    got = [(str(r.vec_id), r.component, r.n, None if r.deviation is None else int(r.deviation), abs(r.whitened), r.explained) for r in found]
    return sorted(got, key=lambda r: (r[0], r[1], r[3], r[4])), brute(rows, count)


def same(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_brute_force(spark, kind):
    random = np.random.default_rng(2)
    rows = [(i, (random.normal(size=7).astype(np.float32) * [1, 2, 3, 4, 5, 6, 7]).tolist()) for i in range(90)]
    same(*run(spark, rows + rows[:20], kind))


def test_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 1.0]), (5, [1e300, 1.0]),
            (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [-0.001, 5.0]), (None, [3.0, 1.0]), (8, [9.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0])]
    same(*run(spark, rows))
    assert run(spark, [])[0] == []
    assert run(spark, [(1, [0.5, 0.5])])[0] == []


def test_wide_integers_stay_exact(spark):
    random = np.random.default_rng(4)
    rows = [(i, (random.normal(size=3) * [1e9, 3e6, 1.0]).tolist()) for i in range(40)]
    got, want = run(spark, rows, count=2)
    assert [r[:4] for r in got] == [r[:4] for r in want]


def test_sign_is_the_same_for_all_rows(spark):
    rows = [(i, [float(i), 2.0 * i]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    values = [r.whitened for r in W.whitened(df, 1).orderBy("vec_id").collect()]
    assert values == sorted(values) or values == sorted(values, reverse=True)


def test_query_on_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    found = W.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    got = sorted(((str(r.vec_id), r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=lambda r: r[:2])
    want = sorted(brute(rows, 4), key=lambda r: r[:2])
    same(got, want)
