import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import topk as T


def brute(rows, is_query, k):
    usable = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = set()
    for q, v in usable.items():
        if is_query(q):
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(found)}
    return out


def run(df, k=5):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in T.top_k(df, F.col("vec_id") % 5 == 0, k).collect()}


@pytest.mark.parametrize("k", [1, 5, 200])
def test_equals_brute_force_with_ties(spark, monkeypatch, k):
    monkeypatch.setattr(T, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(T, "QUERY_ROWS", 7)
    monkeypatch.setattr(T, "FAN_IN", 2)
    random = np.random.default_rng(1)
    rows = [(i, (random.integers(-2, 3, 6) / 2).tolist()) for i in range(150)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k) == brute(rows, lambda i: i % 5 == 0, k)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [None, 1.0]), (15, [float("nan"), 0.0]), (20, []), (25, [1.0, 2.0, 3.0]), (1, [1e6, -1e6]), (2, [1e15, 1e15]), (None, [1.0, 1.0]), (3, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows] + [(3, [1.0, 2.0], 8)], "vec_id long, embedding array<double>, score int")
    assert run(df) == brute(rows, lambda i: i % 5 == 0, 5)
    assert run(df.limit(0)) == set()


def test_products_beyond_doubles():
    q, c = np.array([[3e15, 1.0]]), np.array([[3e15, 7.0], [1.0, 1.0]])
    assert T.scores(q, c).tolist() == [[2**63 - 1, 3 * 10**15 + 1]]
