import numpy as np
import pytest

from emberlake.llm import embedding_dedup as E


def brute(rows):
    """rows: (id, vector) of usable vectors of one length."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {i: (int(h.sum()), int(c), bool(i == c)) for i, h, c in zip(ids, hit, label)}


def clustered(n, dim, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, dim))
    return [(i, (centres[random.integers(12)] + random.normal(size=dim) * random.choice([0.03, 0.2, 2])).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim,leaf", [(24, 64), (3, 2048)])
def test_links_equal_brute_force(spark, monkeypatch, dim, leaf):
    monkeypatch.setattr(E, "LEAF", leaf)
    rows = clustered(400, dim, dim) + [(1000 + i, [1.0] * dim) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_copies(df).collect()} == brute(rows)


def test_leaves_do_not_follow_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 50)
    rows = [(i, v, 1) for i, v in clustered(430, 12, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies long")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            leaves = E._sequence(df, 12, 0.32, "<f8")
            seen.append((sorted(tuple(np.frombuffer(r.ids, np.int64)) for r in leaves.collect()), E._leaf_pairs(leaves, 13, 0.32).count()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and sorted(map(len, seen[0][0])) == [30] + [50] * 8


def test_unusable_vectors_link_with_nothing(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 1.0]), (8, [1e-300, 1e-300]), (9, [1e300, 1e300]), (10, [1.0, 1.0, 1.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, copies int, lead string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_copies(df).collect()}
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)}, 7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False)}


def test_empty_table(spark):
    assert E.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_skipping_never_underestimates():
    random = np.random.default_rng(0)
    x = E.unit(random.normal(size=(200, 20)))
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    z = E.reduced(x, turn)
    near, true = np.linalg.norm(z[:, None] - z[None], axis=2), np.linalg.norm(x[:, None] - x[None], axis=2)
    assert (near <= true + 1e-9).all()
