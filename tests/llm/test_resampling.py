import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import resampling as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, min_words, longest, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, longest)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out, fit = [], []
    for key, text in rows:
        words, found = runs(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(words), len(found), weight, score, None])
        if len(words) >= min_words:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0], r[2]))
    for n, row in enumerate(fit[: percent * len(fit) // 100]):
        row[5] = n + 1
    return sorted(map(str, map(tuple, out)))


def run(spark, rows, target, kind="long", **given):
    options = {"percent": 30, "min_words": 3, "longest": 2, "buckets": 50, "seed": 7} | given
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], f"doc_id {kind}, text string, score int, rank string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(str(tuple(r)) for r in R.resampled(df, goal, **options).collect()), brute(rows, target, **options)


def texts(n, seed=0):
    random = np.random.default_rng(seed)
    words = ["Ab", "é", "x1", "wörd", "the", "of", "Zed", "q", "中文"]
    return [" ".join(random.choice(words, random.integers(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("finish, chunk, longest", [(4096, 1 << 20, 1), (1, 3, 2), (2, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, finish, chunk, longest):
    monkeypatch.setattr(R, "FINISH", finish)
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = list(enumerate(texts(300)))
    got, want = run(spark, rows, texts(20, 1), longest=longest)
    assert got == want


def test_ties_repeats_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "FINISH", 1)
    monkeypatch.setattr(R, "SLICE", 16)
    rows = [(1, "a b c d")] * 40 + [(2, None), (3, ""), (None, "the of the of"), (4, "--"), (5, "w" * 5000 + " b c"), (6, "lorem ipsum " * 4000)]
    for percent in (0, 10, 50, 100):
        got, want = run(spark, rows, [None, "", "a b"], percent=percent)
        assert got == want


def test_empty_tables(spark):
    assert run(spark, [], [])[0] == []
    got, want = run(spark, list(enumerate(texts(30))), [])
    assert got == want


def test_text_ids_order_ties(spark):
    rows = [(x, "a b c") for x in ("b", "a", None, "c")]
    got, _ = run(spark, rows, ["a"], kind="string", percent=50)
    assert sum("None)" not in r for r in got) == 2


def test_cutoff_is_the_exact_key(spark, monkeypatch):
    monkeypatch.setattr(R, "FINISH", 3)
    monkeypatch.setattr(R, "CHUNK", 7)
    random = np.random.default_rng(3)
    keys = [(int(random.integers(0, 4)), int(random.integers(0, 9)), 1, i) for i in range(500)]
    df = spark.createDataFrame(keys, "_low long, _id long, n_features long, _row long").repartition(5)
    for wanted in (1, 2, 250, 499, 500):
        assert R.cutoff(df, wanted, 500) == sorted(keys)[wanted - 1]
    assert R.cutoff(df, 0, 500) is None


def test_no_sort_of_all_rows(spark):
    df = R.weighed(spark.createDataFrame([(1, "a")], "doc_id long, text string"), np.zeros(5, np.int64), 1, 1, "doc_id", "text")
    assert "Exchange" not in df.filter(F.col("n_words") > 0)._jdf.queryExecution().executedPlan().toString()
