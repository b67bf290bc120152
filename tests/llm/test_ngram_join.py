import random

import pytest

from emberlake.llm import ngram_join as N

random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(400)]


def text(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def edited(t, times):
    words = t.split()
    for _ in range(times):
        words[random.randrange(len(words))] = random.choice(VOCABULARY)
    return " ".join(words)


def shingles(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    label = [r[0] for r in rows]
    moved = True
    while moved:
        new = [min([label[i]] + [label[j] for j in linked[i]]) for i in range(len(rows))]
        moved, label = new != label, new
    return {rows[i][0]: (len(linked[i]), label[i], label[i] == rows[i][0]) for i in range(len(rows))}


def corpus():
    base, passage = text(120), text(40)
    docs = [text(random.randint(1, 150)) for _ in range(40)]
    docs += [edited(base, random.randint(0, 4)) for _ in range(90)]  # one large group, more than one chunk
    docs += [base.upper(), base, base]
    docs += [f"{passage} {text(60)}" for _ in range(40)]  # a passage that many documents share
    docs += ["a b c d", "A  b\tc\nd", "one", "one", "", "  ", "é " * 4, text(9000)]
    docs.append(edited(docs[-1], 300))
    return [(i, t) for i, t in enumerate(docs)]


def test_links_and_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, digest string")
    got = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in N.classes(df).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_ties(spark):
    same = text(30)
    rows = [(None, same), (5, same), (3, same), (3, same), (3, edited(same, 0)), (7, None), (8, None), (9, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_links, r.class_id, r.kept) for r in N.classes(df).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 0, None, True)], key=str)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in N.deduplicated(df).collect())
    assert kept == [(False, 3, same), (False, 7, ""), (False, 8, ""), (False, 9, ""), (True, 0, "")]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.classes(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y")], "doc_id long, text string, digest int, doc string")
    out = N.deduplicated(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_depth_reaches_the_target(threshold):
    d = N.depth_for(threshold, 0.99)
    assert 1 - (1 - threshold**d) ** N.TREES >= 0.99 or d == 1


def test_word_hashes_separate_words():
    powers = N.Powers()
    a, b = N.word_hashes(b" one TWO  three", powers), N.word_hashes(b"three\ttwo one", powers)
    assert a.tolist() == b.tolist()[::-1] and len(set(a.tolist())) == 3 and not len(N.word_hashes(b" \n", powers))


def test_lower_thresholds_equal_brute_force(spark):
    """Bounds on sketch bits and sizes follow the threshold."""
    rows = []
    for k in range(60):
        base = text(100)
        rows += [base, " ".join(base.split()[: 62 + k % 8])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [shingles(t) for t in rows]
    want = {i: sum(len(s & t) / len(s | t) >= 0.6 for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)}
    assert sum(want.values()) > 100
    assert {r.doc_id: r.n_links for r in N.classes(df, 0.6).collect()} == want


def test_thresholds_out_of_reach_are_errors():
    assert (N.possible_bits(0.8), N.possible_bits(0.6), N.depth_for()) == (51, 85, 6)
    for threshold in (0.1, 0.0, 1.5):
        with pytest.raises(ValueError):
            N.depth_for(threshold)


def test_registered_query_keeps_its_broadcasts_small(spark):
    import __spark_entry__ as contract

    contract.queries()["op1_ngram_join"](spark, "/root/testdata/sf0.001")
    limits = [spark.conf.get(f"spark.sql.{k}") for k in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold")]
    assert limits == ["256KB", "256KB"]
