"""Conflict lists of a trace equal the cut pair list, without pairs."""

from pyspark.sql import functions as F

from emberlake.plans import quality


def test_lists_equal_the_first_of_all_pairs(spark):
    rows = [(f"r{i * 7919 % 100:02d}", i % 3, ["official_closure", "insufficient_data", "reduced_visibility"][i * i % 7 % 3], i * 31 % 13) for i in range(100)]
    rows += [rows[1], rows[2], ("same", 1, "official_closure", 5), ("same", 1, "insufficient_data", 5), ("lone", None, "official_closure", 1)]
    df = spark.createDataFrame(rows, "id string, road_segment_id long, kind string, observed_us long").repartition(4)
    stamp = F.lit("2024-01-01").cast("timestamp")
    pairs = [(r.resource_id, r.conflicting_resource_id) for r in quality.road_conflicts(df).collect()]
    assert len(pairs) > 300
    want: dict = {}
    for a, b in pairs:
        for side in {a, b} if a != b else {a}:
            want.setdefault(side, []).append((a, b))
    found = quality.newest_road_conflicts(df, stamp, 10)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: sorted((c.resource_id, c.conflicting_resource_id) for c in r.conflicts) for r in found.collect()}
    want.pop("same"), got.pop("same")  # one id on both sides meets itself
    assert got == {k: sorted(v)[:10] for k, v in want.items()}


def test_lists_meet_their_records_without_another_shuffle(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["record_trace"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not [line for line in dealt if "hashpartitioning(id#" in line or "hashpartitioning(source_id#" in line]
