import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import language as L

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = {r.doc_id: r for r in L.op2_language(spark, "/root/testdata/sf0.01").collect()}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0} == set(held) and len(got) == len(true)
    assert np.mean([got[i].lang_pred == true[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def kernel(a, b):
    x, y = L.grams(a), L.grams(b)
    both = [len(np.intersect1d(p, q)) / np.sqrt(len(p) * len(q)) for p, q in zip(x, y)]
    return sum(both) / L.LONGEST


def test_products_are_kernel_values():
    texts = ["The cat sat", "the CAT, sat!", "un chat noir", "a"]
    x, some = L.presence(texts)
    assert some.all() and np.allclose(x @ x.T, [[kernel(a, b) for b in texts] for a in texts], atol=1e-5)
    assert np.isclose(x[0] @ x[1], 1, atol=1e-5)


@pytest.fixture(scope="module")
def model():
    return L.fit(["the cat sat on the mat and the dog", "this is the house that jack built"] * 3 + ["le chat est sur la table et le chien", "dans la maison de la rue"] * 3, ["en"] * 6 + ["fr"] * 6)


def test_texts_without_letters_are_und(spark, model):
    rows = [(1, None, "z"), (2, "", "z"), (3, "12 34 !", "z"), (None, "the cat and the dog", "z"), (5, "le chien dans la rue " * 3000, "z"), (5, "le chien", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in L.identify(df, model).collect()))
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "fr"), (5, "fr")]
    assert sorted(r.doc_id or 0 for r in L.accepted(df, model).collect()) == [0, 5, 5]


def test_unlike_texts_are_rejected(model):
    langs, scores = L.predictions(["你好世界 我们", "привет мир"], model)
    assert max(scores) < L.REJECTED


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert L.learn(df, F.lit(True)) is None
    assert {(r.lang_pred, r.score) for r in L.identify(df, None).collect()} == {("und", 0.0)}
    assert L.identify(df.limit(0), None).count() == 0


def test_every_language_is_learned(spark):
    """The rarest of many languages too."""
    random = np.random.default_rng(3)
    rows = []
    for k in range(80):
        words = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(random.permutation(words)), f"l{k:02}") for i in range(4 if k < 70 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(df, F.lit(True))
    assert model.languages == [f"l{k:02}" for k in range(80)]
    assert L.predictions([t for _, t, _ in rows], model)[0] == [y for _, _, y in rows]


def test_ids_and_repeats_do_not_steer_what_is_learned(spark):
    rows = [(i, f"{w} {i} der die das und" if i % 2 else f"{w} {i} the and of to", "de" if i % 2 else "en") for i, w in enumerate(["haus", "house"] * 20)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = spark.createDataFrame([(1000 - i, t, y) for i, t, y in rows] + [(5000 + i, *rows[0][1:]) for i in range(500)], "doc_id long, text string, lang string")
    a, b = L.learn(one, F.lit(True)), L.learn(other, F.lit(True))
    assert a.languages == b.languages and (a.columns == b.columns).all() and np.allclose(a.weights, b.weights, atol=1e-5)
