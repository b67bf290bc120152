import math
from collections import defaultdict

import pytest

from emberlake.llm import mixing as M


def rows_of(spark, n=600):
    rows = [(i, " ".join(["w"] * (i % 7)), "hot" if i % 3 else f"s{i % 5}") for i in range(n)]
    rows += [(None, "a b c", None), (n, None, None), (n + 1, "", "empty"), (0, "w w", "s0"), (0, "w w", "s0")]
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, _key int, weight double")


def per_source(found):
    out = defaultdict(list)
    for r in found:
        out[r.doc.source].append(r)
    return out


def words(r):
    return len((r.doc.text or "").split())


def key(r):
    x = (r.doc.doc_id or 0) % M.PRIME
    size = len((r.doc.text or "").encode())
    t = (x * 48271 + size * 7919 + 12345) % M.PRIME
    return (t * t % M.PRIME * 69621 + t) % M.PRIME, r.doc.doc_id is not None, r.doc.doc_id or 0, size


def brute(group, budget):
    """Copies by a plain walk over the permutation."""
    total = sum(map(words, group))
    full, rest = divmod(budget, total) if total else (1, 0)
    out, run = {}, 0
    for r in sorted(group, key=key):
        run += words(r)
        out[key(r)] = int(full) + (rest > 1e-9 * total and run <= rest)
    return out


@pytest.mark.parametrize("options", [{"max_epochs": 2.0}, {"max_epochs": 1.0}, {"max_epochs": None, "target_entropy": 0.9}, {"max_epochs": None, "target_entropy": 0.9, "budget": 700}])
def test_copies_follow_the_budgets(spark, options):
    found = per_source(M.mix(rows_of(spark), **options).collect())
    weight = {s: g[0].weight for s, g in found.items()}
    total = {s: sum(map(words, g)) for s, g in found.items()}
    assert math.isclose(sum(weight.values()), 1, abs_tol=1e-6) and weight["empty"] == 0
    for s, group in found.items():
        if not total[s]:
            assert {r.copies for r in group} == {1}
            continue
        budget = group[0].epochs * total[s]
        want = brute(group, budget)
        taken = sum(words(r) * r.copies for r in group)
        repeated = {k for k in want if sum(key(r) == k for r in group) > 1}
        assert all(r.copies == want[key(r)] for r in group if key(r) not in repeated)
        assert budget - 20 <= taken <= budget + 1e-3
    if options.get("max_epochs"):
        live = [g[0].epochs for s, g in found.items() if total[s]]
        assert min(live) == 1 and max(live) <= options["max_epochs"] + 1e-6
    if options.get("target_entropy"):
        w = [x for x in weight.values() if x]
        assert math.isclose(-sum(x * math.log(x) for x in w) / math.log(len(w)), 0.9, abs_tol=1e-3)


def test_mixed_rows_keep_their_columns(spark):
    df = rows_of(spark)
    out = M.mixed(df, max_epochs=2.0)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in M.mix(df, max_epochs=2.0).collect()) > df.count()


def test_one_source_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], "doc_id long, text string, source string")
    assert [r.copies for r in M.mix(df).collect()] == [1, 1]
    assert M.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.plan(df, max_epochs=2.0, target_entropy=0.5)


def test_no_python_in_the_plan(spark):
    text = M.mix(rows_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
