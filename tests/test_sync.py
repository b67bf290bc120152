from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlake.functions import geo
from emberlake.operators import kilometers, road_cover
from emberlake.operators import snapshot_sync as S
from emberlake.plans import enrichment, replay

NOW = datetime(2026, 7, 1)


# ----- one snapshot, three tables -----

def record(spark, rows):
    """rows: hash, number of lines, strategy."""
    df = spark.createDataFrame(rows, "deduplication_hash string, n int, strategy string")
    return df.withColumns({
        "source_id": F.lit(1), "external_id": F.concat(F.lit("x"), "deduplication_hash"), "kind": F.lit("CARRETERAS CORTADAS"), "title": F.lit("new"), "road_ref": F.lit("N-1"),
        "paths": F.array_repeat(F.array(geo.xy(F.lit(0.0), F.lit(0.0)), geo.xy(F.lit(1.0), F.lit(1.0)), geo.xy(F.lit(2.0), F.lit(2.0))), F.col("n")),
        "observed_at": F.lit(None).cast("timestamp"), "expires_at": F.lit(None).cast("timestamp"), "metadata": F.create_map(F.lit("v"), F.lit("2")),
    }).drop("n")


def tables(spark):
    empty = record(spark, []).limit(0)
    out = S.sync_restrictions(empty, *[spark.createDataFrame([], s) for s in schemas()], 1, F.lit(NOW))
    return [t.drop("_action") for t in out[:3]]


def schemas():
    path = "array<struct<x:double,y:double>>"
    common = "source_id int, external_id string, deduplication_hash string, observed_at timestamp, expires_at timestamp, metadata map<string,string>"
    return [f"{common}, name string, restriction_type string, strategy string, paths array<{path}>", f"{common}, road_segment_id string, kind string, explanation string",
            f"{common}, name string, road_ref string, road_class string, segment_index int, path {path}"]


def step(spark, rows, before):
    out = S.sync_restrictions(record(spark, rows), *before, 1, F.lit(NOW))
    names = ("zones", "incidents", "segments")
    found = {n: {r.deduplication_hash: r for r in getattr(out, n).collect()} for n in names}
    after = [spark.createDataFrame(getattr(out, n).drop("_action").collect(), s) for n, s in zip(names, schemas())]
    return found, after


def test_snapshots_follow_each_other(spark):
    found, state = step(spark, [("a", 2, "cnig_local_road_network"), ("b", 1, S.RAW_STRATEGY), ("c", 0, S.RAW_STRATEGY)], tables(spark))
    assert set(found["zones"]) == {"restriction:a", "restriction:b"} and set(found["segments"]) == {"segment:a:0", "segment:a:1", "segment:b:0"}
    assert {r._action for t in found.values() for r in t.values()} == {"inserted"}
    # a loses a line and comes back raw, b is missing.
    found, state = step(spark, [("a", 1, S.RAW_STRATEGY)], state)
    assert {k: r._action for k, r in found["segments"].items()} == {"segment:a:0": "reactivated", "segment:a:1": "expired", "segment:b:0": "expired"}
    zone = found["zones"]["restriction:a"]
    assert zone.strategy == "cnig_local_road_network" and len(zone.paths) == 2 and found["zones"]["restriction:b"].expires_at == NOW
    assert found["incidents"]["incident:b"].expires_at == NOW
    # b returns with more lines, a surplus segment comes back.
    found, state = step(spark, [("a", 2, S.RAW_STRATEGY), ("b", 3, "previous_road_geometry_reuse")], state)
    assert {k: r._action for k, r in found["segments"].items() if k.startswith("segment:b")} == {"segment:b:0": "reactivated", "segment:b:1": "inserted", "segment:b:2": "inserted"}
    assert all(r.expires_at is None for t in found.values() for r in t.values()) and len(found["zones"]["restriction:b"].paths) == 3
    # The same snapshot again changes nothing but says so.
    again, _ = step(spark, [("a", 2, S.RAW_STRATEGY), ("b", 3, "previous_road_geometry_reuse")], state)
    assert {k: r.asDict() | {"_action": ""} for k, r in again["segments"].items()} == {k: r.asDict() | {"_action": ""} for k, r in found["segments"].items()}


def test_rows_of_other_sources_stay(spark):
    _, state = step(spark, [("a", 1, S.RAW_STRATEGY)], tables(spark))
    out = S.sync_restrictions(record(spark, []), *state, 2, F.lit(NOW))
    assert [r._action for t in out[:3] for r in t.collect()] == ["kept"] * 3


# ----- replay -----

HEADER = "latitude,longitude,acq_date,acq_time,satellite,confidence,frp"


def test_second_replay_changes_nothing(spark):
    rows = [
        ("u1", f"{HEADER}\n40,-3,2026-07-01,0110,N,n,1.0\n40,-3,2026-07-01,0110,N,n,1.0\n41,-3,2026-07-01,0110,N,n,1.0\n10,-3,2026-07-01,0110,N,n,1.0\n"),
        ("u2", f"{HEADER}\n41,-3,2026-07-01,0110,N,n,1.0\n42,-3,2026-07-01,0110,\"N,1\",n,"), ("u3", "latitude,longitude\n40,-3\n"), ("u4", HEADER), ("u5", ""), ("u6", f"{HEADER},frp\n1,2,3,4,5,6,7,8"), ("u0", None),
    ]
    df = spark.createDataFrame(rows, "url string, payload string").withColumn("fetched_at", F.lit(NOW) + F.expr("make_interval(0,0,0,0,0,int(substr(url, 2)))"))
    ledger, target = spark.createDataFrame([], replay.LEDGER), spark.createDataFrame([], "deduplication_hash string")
    first = replay.replay_detections(df.unionByName(df.withColumn("url", F.concat("url", F.lit("-copy")))), ledger, target)
    got = {r.url: (r.status, r.received, r.discarded, r.duplicated, r.persisted) for r in first.ledger.collect()}
    assert got == {"u1": ("completed", 4, 1, 1, 2), "u2": ("completed", 2, 0, 1, 1), **{u: ("failed", 0, 0, 0, 0) for u in ("u3", "u4", "u5", "u6")}}
    assert sorted(r.satellite for r in first.detections.collect()) == ["N", "N", "N,1"]
    assert {r.url for r in first.dead.collect()} == {"u3", "u4", "u5", "u6"}
    second = replay.replay_detections(df, ledger.unionByName(first.ledger), target.unionByName(first.detections.select("deduplication_hash")))
    assert second.detections.count() == 0 and {r.url for r in second.ledger.collect()} == {"u3", "u4", "u5", "u6"}


# ----- kilometre posts, lines in reach, enrichment -----

@pytest.mark.parametrize("k, width", [(1, 2.0), (3, 0.5), (2, 100.0)])
def test_nearest_numbers_equal_brute_force(spark, k, width):
    posts = [("R", float(n)) for n in (0, 1, 1, 2.5, 7, 40, 41, 41, 90.5)] + [("S", 5.0)]
    asked = [("R", km) for km in (-3.0, 0.0, 0.5, 3.0, 24.0, 41.0, 500.0)] + [("S", 6.0), ("T", 1.0), ("R", None)]
    p = spark.createDataFrame([(r, n, (n, 0.0)) for r, n in posts], "road_key string, post_km double, post struct<x:double,y:double>")
    found = kilometers.nearest_numbers(spark.createDataFrame(asked, "road_key string, km double"), p, k, width=width)
    want = []
    for road, km in asked:
        gaps = sorted(abs(n - km) for r, n in posts if r == road and km is not None)
        want += [(road, km, n) for r, n in posts if r == road and km is not None and abs(n - km) <= gaps[min(k, len(gaps)) - 1]]
    assert sorted((r.road_key, r.km, r.post_km) for r in found.collect()) == sorted(want)


def test_lines_cross_the_box_without_a_point_in_it(spark):
    at = lambda *p: [(float(x), float(y)) for x, y in p]
    lines = [("across", at((-1, 0.02), (1, 0.02)), 2), ("diagonal", at((-1, 1), (1, -1)), 2), ("beside", at((-1, 0.2), (1, 0.2)), 2), ("corner", at((0, 0.2), (0.2, 0)), 2), ("own", at((-1, 0.02), (1, 0.02)), 1)]
    df = spark.createDataFrame([("R", *row) for row in lines], "road_key string, segment_id string, path array<struct<x:double,y:double>>, source_id int")
    query = spark.createDataFrame([(1, "R", 1, (0.0, 0.0), (0.03, 0.0))], "query_id int, road_key string, source_id int, start struct<x:double,y:double>, end struct<x:double,y:double>")
    assert {r.segment_id for r in road_cover.lines_in_reach(query, df).collect()} == {"across", "diagonal"}
    assert {r.segment_id for r in road_cover.lines_in_reach(query, df.drop("source_id")).collect()} == {"across", "diagonal", "own"}


def test_enrichment_counts_and_segments(spark):
    from emberlake.registry import enrichment as E

    sf = "/root/testdata/sf0.001"
    out = enrichment.enrich_zones(E.zones(spark, sf), E.network(spark, sf), E.posts(spark, sf), E.local_lines(spark, sf), F.lit(NOW), limit=40)
    counts = out.counts.first()
    assert counts.selected == 40 == counts.enriched + counts.pending and counts.enriched > 0
    assert out.segments.count() == counts.enriched and out.zones.filter("enrichment_status = 'completed'").count() == counts.enriched
    assert all(r.deduplication_hash.startswith("segment:") for r in out.segments.collect())
