import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from emberlake.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_scores(rows):
    seen = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    return [(len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t))) for _, t in rows]


def check(got, rows):
    want = {i: w for (i, _), w in zip(rows, base_scores(rows))}
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held_out(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r.score) and r.score <= 0


def test_base_is_exact_and_the_model_is_better_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op7_lm(spark, sf).collect()
    assert len(got) == len(rows)
    check(got, rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and np.mean([r.score > r.base_score for r in out]) > 0.9


def test_counts_of_words_outside_the_dictionary_are_exact(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 5)
    rows = [(i, " ".join(f"w{(i * j) % 9}" for j in range(i % 6 + 1))) for i in range(60)] + [(100, None), (101, ""), (None, "W1 w1"), (102, "new words only"), (103, "x" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    cond = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    check(lm.score(df, cond).collect(), rows)
    check(lm.score(df.unionByName(df.filter("doc_id = 102")), cond).filter("doc_id <> 102").collect(), [*rows, (102, "new words only")])


def test_probabilities_of_all_units_sum_to_one():
    share = np.array([0.1, 0.4, 0.3, 0.2])
    head = lm.Head({b"a": 0, b"b": 1}, np.array([3, 2]), 1, 10, 7)
    model = lm.train(lm.Model.start(share), share, np.array([[0, 0, 2], [2, 0, 3], [3, 2, 1]]), np.array([3.0, 2.0, 2.0]), 0.02, 0, 50)
    scorer = lm.Scorer(model, head)
    for one in range(4):
        for two in range(4):
            x = np.array([[one, two, u] for u in range(4)])
            assert math.isclose((10 ** scorer.logs(x)).sum(), 1, rel_tol=1e-5)
    assert head.rare() == (10 - 1 - 5, 7 - 1 - 2)


def test_training_finds_the_observed_shares():
    random = np.random.default_rng(0)
    true = random.dirichlet(np.ones(6) * 0.5, size=6)
    grams = np.array([[a, 0, u] for a in range(6) for u in range(6)])
    weight = (true * 1000).ravel()
    share = weight.reshape(6, 6).sum(0) / weight.sum()
    head = lm.Head({bytes([97 + i]): i for i in range(4)}, np.ones(4), 1, 10, 7)
    model = lm.train(lm.Model.start(share), share, grams, weight, 0.05, 0, 800)
    got = 10 ** lm.Scorer(model, head).logs(grams)
    assert np.abs(got.reshape(6, 6) - true).max() < 0.05


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(df, F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert lm.score(df.limit(0), F.lit(False)).count() == 0


def test_every_trigram_enters_a_gradient():
    """However rare a context is and however few the steps, its vector is learned."""
    n = 3000
    grams = np.array([[k, k, (k + 1) % n] for k in range(n)])
    weight = np.ones(n)
    weight[0] = 1e9
    start = lm.Model.start(np.full(n, 1 / n))
    model = lm.train(start, np.full(n, 1 / n), grams, weight, 0.02, 0, 1)
    assert (model.context != start.context.astype(np.float32)).any(1).all()


def test_turns_weigh_counts():
    mass = np.array([1e6, 50.0, 1.0, 1.0, 3.0])
    for least in (1, 4, 1000):
        turn, load = lm.turns(mass, least, np.random.default_rng(0))
        often = np.bincount(turn, minlength=5)
        assert len(turn) >= least and often.min() >= 1 and np.allclose(often * load / len(turn), mass / mass.sum())
