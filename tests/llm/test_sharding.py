import zlib

from emberlake.llm import sharding as S


def test_positions_are_a_permutation_and_reproducible(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).toDF("x")
        got = [r.x for r in S.permute(df, "x", n, 3).collect()]
        assert sorted(got) == list(range(n))
        assert sorted(got) == sorted(r.x for r in S.permute(df, "x", n, 3).collect())
        back = {r.k: r.x for r in S.permute(S.permute(spark.range(n).selectExpr("id AS k", "id AS x"), "x", n, 3), "x", n, 3, inverse=True).collect()}
        assert all(k == x for k, x in back.items())


def test_counts_slots_and_lookup(spark):
    rows = [(i % 50 if i % 7 else None, None if i % 11 == 0 else "é" * (i % 5), "z", 1) for i in range(331)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, _copies int")
    got = S.shards(df, 24).collect()
    assert sorted(r.row_number for r in got) == list(range(331))
    for k in range(24):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots))) and len(slots) in (331 // 24, 331 // 24 + 1)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    at = spark.createDataFrame([(r.shard, r.slot, r.row_number) for r in got], "shard int, slot long, want long")
    assert all(r.row_number == r.want for r in S.row_number_at(at, 24, 331).collect())


def test_order_is_shuffled_and_seeded(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(500)], "doc_id long, text string")
    one, two = ({r.doc_id: r.position for r in S.shards(df, 24, seed=s).collect()} for s in (0, 1))
    assert one != two and sum(abs(one[i] - i) < 5 for i in one) < 50


def test_empty_table(spark):
    assert S.shards(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0
