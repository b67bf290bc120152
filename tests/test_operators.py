import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlake.functions import geo
from emberlake.operators import dedupe, expectations, merge, roads
from emberlake.operators.components import connected_components
from emberlake.operators.dissolve import dissolve_cells
from emberlake.operators.grid_join import link_points
from emberlake.operators.skew import hot_keys, salted_join
from emberlake.plans import areas, quality


def haversine(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (a[1], a[0], b[1], b[0]))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def detections(spark, rows):
    df = spark.createDataFrame(rows, "id string, longitude double, latitude double, seconds long")
    return df.withColumn("observed_at", F.timestamp_seconds("seconds"))


def brute_links(rows):
    out = set()
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if b[3] - a[3] <= 180 * 60 and haversine((a[1], a[2]), (b[1], b[2])) <= 2500:
                out.add((a[0], b[0]))
    return out


def random_points(seed, n, hot=0):
    rng = random.Random(seed)
    rows = [(f"d{i:04d}", rng.uniform(-3.1, -2.9), rng.uniform(39.9, 40.1), rng.randrange(0, 40_000)) for i in range(n)]
    return rows + [(f"h{i:04d}", -3.0 + rng.uniform(0, 1e-3), 40.0, 1000 + i) for i in range(hot)]


def links(df):
    return {(r.first_id, r.second_id) for r in link_points(df, id_col="id", lon="longitude", lat="latitude", time="observed_at").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_every_pair_test(spark, seed):
    rows = random_points(seed, 150)
    assert links(detections(spark, rows)) == brute_links(rows)


def test_links_far_north_and_at_the_edges(spark):
    rows = [("a", 10.0, 69.9, 0), ("b", 10.06, 69.9, 10_800), ("c", 10.0, 69.9, 10_801), ("d", 10.0, -69.92, 5), ("e", 10.05, -69.92, 6)]
    assert links(detections(spark, rows)) == brute_links(rows) == {("a", "b"), ("b", "c"), ("d", "e")}


def test_hot_buckets_are_salted_without_changing_the_result(spark):
    rows = random_points(3, 60, hot=60)
    spark.conf.set("emberlake.skew.rowsPerTask", "20")
    try:
        df = detections(spark, rows)
        assert hot_keys(df.withColumn("k", F.substring("id", 1, 1)), ["k"]).collect()
        assert links(df) == brute_links(rows)
    finally:
        spark.conf.unset("emberlake.skew.rowsPerTask")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    probe = spark.range(300).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.col("id").alias("p"))
    build = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z")], "k long, b string")
    spark.conf.set("emberlake.skew.rowsPerTask", "10")
    try:
        got = sorted(map(tuple, salted_join(probe, build, ["k"], F.col("p"), how).collect()), key=str)
    finally:
        spark.conf.unset("emberlake.skew.rowsPerTask")
    assert got == sorted(map(tuple, probe.join(build, ["k"], how).collect()), key=str)


def test_plans_have_no_nested_loops(spark):
    df = detections(spark, random_points(5, 20))
    plan = link_points(df, id_col="id", lon="longitude", lat="latitude", time="observed_at")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in parent}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=25))
def test_components_match_union_find(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == closure(edges)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    spark.conf.set("emberlake.skew.rowsPerTask", "15")
    try:
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    finally:
        spark.conf.unset("emberlake.skew.rowsPerTask")
    assert got == closure(edges)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=20))
def test_dissolved_area_is_the_number_of_cells(spark, cells):
    df = spark.createDataFrame([("g", c, r, 0.5, 0.5) for c, r in cells], "g string, c long, r long, hc double, hr double")
    rings = dissolve_cells(df, "g", "c", "r", "hc", "hr").select(F.explode("rings").alias("ring"))
    assert rings.agg(F.sum(geo.ring_area(F.col("ring")))).first()[0] == pytest.approx(len(cells))


def test_dissolve_ring_has_one_hole_and_overlaps_merge(spark):
    cells = [("g", c, r, 0.5, 0.5) for c in range(3) for r in range(3) if (c, r) != (1, 1)]
    cells += [("wide", 0, 0, 0.75, 0.5), ("wide", 1, 0, 0.75, 0.5), ("far", 0, 0, 0.5, 0.5), ("far", 5, 5, 0.5, 0.5), ("corner", 0, 0, 0.5, 0.5), ("corner", 1, 1, 0.5, 0.5)]
    out = dissolve_cells(spark.createDataFrame(cells, "g string, c long, r long, hc double, hr double"), "g", "c", "r", "hc", "hr").collect()
    by = {}
    for row in out:
        by.setdefault(row.g, []).append([len(r) for r in row.rings])
    assert by["g"] == [[5, 5]] and by["wide"] == [[5]] and sorted(by["far"]) == [[5], [5]] and sorted(by["corner"]) == [[5], [5]]
    assert next(r.outer_area for r in out if r.g == "wide") == pytest.approx(2.5)


def ring_of_detections(spark, degrees=12.0, spacing=400.0, skip_centre=True):
    rows = []
    for c in range(3):
        for r in range(3):
            if skip_centre and (c, r) == (1, 1):
                continue
            x, y = c * spacing, r * spacing
            a = math.radians(degrees)
            east, north = x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)
            rows.append((f"det-{c}{r}", -3.0 + east / (111_320 * math.cos(math.radians(40))), 40.0 + north / 111_320, 1_700_000_000 + c * 10 + r))
    return detections(spark, rows).withColumns({"sensor": F.lit("VIIRS"), "scan_km": F.lit(None).cast("double"), "track_km": F.lit(None).cast("double")})


def test_rotated_ring_becomes_one_polygon_with_a_hole(spark):
    out = areas.detection_areas(ring_of_detections(spark)).collect()
    assert len(out) == 1
    area = out[0]
    assert (area.detections, area.cells, area.geometry.kind, len(area.geometry.parts), len(area.geometry.parts[0])) == (8, 8, "POLYGON", 1, 2)
    assert area.angle_degrees == pytest.approx(12.0, abs=0.2) and area.width == pytest.approx(400, abs=2) and len(area.id) < 40
    assert area.area_m2 == pytest.approx(8 * 400 * 400, rel=0.01)


def test_days_and_families_do_not_mix(spark):
    rows = [("a", -3.0, 40.0, 0), ("b", -3.0, 40.001, 10), ("c", -3.0, 40.0, 90_000), ("d", -3.0, 40.0, 20)]
    df = detections(spark, rows).withColumns({"sensor": F.when(F.col("id") == "d", "MODIS").otherwise("VIIRS"), "scan_km": F.lit(None).cast("double"), "track_km": F.lit(None).cast("double")})
    grouped = areas.group_detections(areas.detection_points(df)).groupBy("group").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert sorted(r.ids for r in grouped.collect()) == [["a", "b"], ["c"], ["d"]]


def test_dedupe(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 3, "c")], "k string, o int, v string")
    assert {r.v for r in dedupe.keep_first(df, ["k"], ["o"]).collect()} == {"a", "c"}
    assert {r.v for r in dedupe.keep_last(df, ["k"], ["o"]).collect()} == {"b", "c"}
    stamped = spark.createDataFrame([("k", None, 1, "old"), ("k", "2026-01-01", 2, "new"), ("k", "2026-01-01", 3, "tie")], "k string, t string, o int, v string").withColumn("t", F.col("t").cast("timestamp"))
    assert dedupe.keep_latest(stamped, ["k"], "t", "o").first().v == "new"
    assert tuple(dedupe.duplicate_counts(df, ["k"]).first()) == (3, 2, 1)
    assert [r.v for r in dedupe.only_new(df, df.filter("k = 'k'"), "k").collect()] == ["c"]


def test_upsert_is_idempotent_and_bumps_versions(spark):
    schema = "id string, deduplication_hash string, version int, metadata map<string,string>, extra string"
    target = spark.createDataFrame([("a", "1", 3, {"osint": "x", "old": "y"}, "e"), ("b", "1", 1, {}, "e")], schema)
    source = spark.createDataFrame([("a", "2", {"new": "z"}), ("b", "1", {}), ("c", "1", {})], "id string, deduplication_hash string, metadata map<string,string>")
    out = merge.upsert(target, source, ["id"], "deduplication_hash", {"metadata": merge.keep_map_keys(["osint"])})
    rows = {r.id: r for r in out.collect()}
    assert [(k, rows[k]._action, rows[k].version) for k in "abc"] == [("a", "updated", 4), ("b", "duplicate", 1), ("c", "inserted", 1)]
    assert rows["a"].metadata == {"new": "z", "osint": "x"} and rows["a"].extra == "e"
    again = merge.upsert(out.drop("_action"), source, ["id"], "deduplication_hash")
    assert tuple(merge.action_counts(again).first()) == (0, 0, 3, 0)


def test_snapshot_versions_hold_the_state_before_the_change(spark):
    parents = spark.createDataFrame([("i", 3, "active", "t"), ("j", 1, "active", "u")], "id string, version int, status string, title string")
    rows, bumped = merge.snapshot_versions(parents, parents.filter("id = 'i'"), "id", "plan_update")
    assert [(r.incident_id, r.version) for r in rows.collect()] == [("i", 3)]
    assert {r.id: r.version for r in bumped.collect()} == {"i": 4, "j": 1}


def test_expectations_name_the_broken_rule(spark):
    df = spark.createDataFrame([("a", "official", "m", 0.5), ("b", "estimated", None, 1.5), ("c", "estimated", "m", 0.2)], "id string, provenance string, model_execution_id string, risk_score double")
    good, bad = expectations.split(df, expectations.forecast_rules())
    assert [r.id for r in good.collect()] == ["c"]
    assert sorted((r.id, r.rule) for r in bad.collect()) == [("a", "forecast_never_official"), ("b", "forecast_has_model_execution"), ("b", "risk_score_in_unit_interval")]


def test_road_conflicts_and_existing_ones(spark):
    df = spark.createDataFrame([("a", 1, "official_closure", 10), ("b", 1, "insufficient_data", 20), ("c", 2, "official_closure", 5), ("d", 1, "reduced_visibility", 7)], "id string, road_segment_id long, kind string, observed_us long")
    out = quality.road_conflicts(df)
    assert [(r.resource_id, r.conflicting_resource_id) for r in out.collect()] == [("b", "a")]
    assert quality.road_conflicts(df, existing=out).count() == 0


def segment_rows(spark, rows):
    df = spark.createDataFrame(rows, "segment_id string, name string, code string, pts array<array<double>>")
    return df.withColumn("path", F.transform("pts", lambda p: geo.xy(p[0], p[1]))).drop("pts")


def request(spark, start, end, road="N-1"):
    row = [("q", road, 1, start, end, None, None, None)]
    df = spark.createDataFrame(row, "query_id string, road_key string, source_id int, s array<double>, e array<double>, kilometer_range string, first_km double, last_km double")
    return df.withColumn("start", geo.xy(F.col("s")[0], F.col("s")[1])).withColumn("end", geo.xy(F.col("e")[0], F.col("e")[1])).drop("s", "e")


def points(value):
    return [(round(p.x, 6), round(p.y, 6)) for p in value]


def test_shortest_route_takes_the_short_side(spark):
    segs = segment_rows(spark, [
        ("a", "N-1", None, [[0.0, 0.0], [0.01, 0.0]]), ("b", "N-1", None, [[0.02, 0.0], [0.01, 0.0]]),
        ("c", "n-1", None, [[0.0, 0.0], [0.0, 0.05], [0.02, 0.05], [0.02, 0.0]]), ("z", "N-2", "N-9", [[9.0, 9.0], [9.1, 9.0]]),
    ])
    out = roads.shortest_routes(request(spark, [0.0, 0.001], [0.02, 0.001]), roads.road_keys(segs)).collect()
    assert points(out[0].path) == [(0.0, 0.0), (0.01, 0.0), (0.02, 0.0)]


def test_merge_section_and_cascade(spark):
    segs = segment_rows(spark, [("a", "N-1", None, [[0.0, 0.0], [0.01, 0.0]]), ("b", "N-1", None, [[0.03, 0.0], [0.01, 0.0]]), ("c", "N-1", None, [[0.03, 0.0], [0.04, 0.01]])])
    merged = roads.merge_lines(roads.road_keys(segs))
    assert merged.count() == 1 and merged.select(F.size("path")).first()[0] == 4
    cut = roads.line_sections(request(spark, [0.005, 0.001], [0.02, 0.001]), merged).first()
    assert sorted(points(cut.path)) == [(0.005, 0.0), (0.01, 0.0), (0.02, 0.0)]
    known = roads.match_roads(request(spark, [0.0, 0.001], [0.04, 0.011]), segs).first()
    assert known.strategy == "cnig_local_road_network" and len(known.paths[0]) == 4
    other = roads.match_roads(request(spark, [0.0, 0.001], [0.04, 0.011], road="N-7"), segs).first()
    assert other.strategy == "nap_datex_coordinates" and other.paths is None


def test_sampled_route_follows_the_nearest_candidate(spark):
    q = request(spark, [0.0, 0.0], [0.03, 0.0])
    c = spark.createDataFrame([("q", 0, 3, 0.0), ("q", 0, 3, 5.0), ("q", 1, 3, 0.015), ("q", 1, 3, 5.015), ("q", 2, 3, 0.03), ("q", 2, 3, 5.03)], "query_id string, sample int, samples int, x double")
    c = c.withColumn("point", geo.xy(F.col("x"), F.lit(0.0)))
    assert points(roads.sampled_routes(q, c).first().path) == [(0.0, 0.0), (0.015, 0.0), (0.03, 0.0)]


def test_nearest_km_post_prefers_number_then_place(spark):
    posts = spark.createDataFrame([("n-1", "10", 1.0), ("N-1", "10,0", 2.0), ("N-1", "x", 0.0), ("N-1", "11", 0.0)], "name string, number string, x double").withColumn("point", geo.xy(F.col("x"), F.lit(0.0)))
    ask = spark.createDataFrame([("q", "N-1", "a", 10.2, 1.9)], "query_id string, road_key string, which string, km double, nx double").withColumn("near", geo.xy(F.col("nx"), F.lit(0.0)))
    assert roads.nearest_km_posts(ask, posts).first().post.x == 2.0


def test_links_cross_the_180th_meridian(spark):
    from emberlake.operators.grid_join import link_points

    rows = [("a", 179.999, 10.0), ("b", -179.999, 10.0), ("c", 0.0, 10.0), ("d", 180.0, 10.0), ("e", -180.0, 10.0), ("f", 179.9, 89.9), ("g", -179.9, 89.9)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double").withColumn("t", F.lit("2026-01-01").cast("timestamp"))
    got = {(r.first_id, r.second_id) for r in link_points(df, id_col="id", lon="lon", lat="lat", time="t", max_distance_m=500).collect()}
    assert got == {("a", "b"), ("a", "d"), ("a", "e"), ("b", "d"), ("b", "e"), ("d", "e"), ("f", "g")}


def test_a_well_compressed_cut_is_not_broadcast_by_its_file_size(spark):
    """A few hundred kilobytes of files may be tens of megabytes in memory, which would pass through the driver."""
    from emberlake.session import cut_lineage

    key = F.concat(F.lit("2024-01-01|viirs|" * 8), (F.col("id") % 50).cast("string"))
    rows = cut_lineage(spark.range(100_000).select("id", key.alias("g"), key.alias("h")), "repeated")
    plan = rows.join(rows.select("id", F.col("g").alias("k")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_components_leave_fewer_edges_every_round(spark, monkeypatch):
    from emberlake.operators import components

    left, cut = [], components.cut_lineage

    def counted(df, label):
        out = cut(df, label)
        if label == "live-edges":
            left.append(out.count())
        return out

    monkeypatch.setattr(components, "cut_lineage", counted)
    edges = [(i, i + 1) for i in range(600)] + [(1000, i) for i in range(1001, 1200)] + [(2000, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == closure(edges)
    assert left[-1] == 0 and all(b < a for a, b in zip(left, left[1:])) and sum(left[1:]) <= 2 * left[0]


def test_rectangles_are_measured_like_other_shapes(spark):
    from pyspark.sql import functions as F

    from emberlake.functions import geo
    from emberlake.operators.distance import with_distance

    boxes = [(0.0, 40.0, 0.1, 40.1), (0.05, 40.05, 0.2, 40.2), (0.12, 40.0, 0.13, 40.3), (0.3, 40.02, 0.31, 40.04), (0.0, 40.101, 0.1, 40.12), (0.02, 40.02, 0.03, 40.03)]
    rows = spark.createDataFrame([(i, j, *a, *b) for i, a in enumerate(boxes) for j, b in enumerate(boxes)], "i int, j int, " + ", ".join(f"{s}{k} double" for s in "ab" for k in range(4)))
    shaped = rows.select("i", "j", geo.box(*[F.col(f"a{k}") for k in range(4)]).alias("a"), geo.box(*[F.col(f"b{k}") for k in range(4)]).alias("b"))
    assert shaped.filter(geo.rectangle(F.col("a")).isNull()).count() == 0
    general = F.transform("a.parts", lambda rings: F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1))))
    bent = shaped.withColumn("a", F.struct(F.col("a.kind"), general.alias("parts")))
    assert bent.filter(geo.rectangle(F.col("a")).isNotNull()).count() == 0
    quick = {(r.i, r.j): r.m for r in with_distance(shaped, "a", "b", "m", 50_000.0).collect()}
    slow = {(r.i, r.j): r.m for r in with_distance(bent, "a", "b", "m", 50_000.0).collect()}
    assert quick == pytest.approx(slow, abs=1e-6)


def test_routes_end_around_their_goal_not_at_the_end_of_the_road(spark, monkeypatch):
    from pyspark.sql import functions as F

    from emberlake.functions import geo
    from emberlake.operators import roads

    rounds, cut = [], roads.cut_lineage
    monkeypatch.setattr(roads, "cut_lineage", lambda df, label: (rounds.append(label), cut(df, label))[1])
    x = F.col("id") / 100.0
    lines = spark.range(25).select(F.lit("N-1").alias("road_key"), F.col("id").alias("segment_id"), F.array(geo.xy(x, F.lit(40.0)), geo.xy(x + 0.01, F.lit(40.0))).alias("path"))
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit("N-1").alias("road_key"), geo.xy(F.lit(0.021), F.lit(40.0)).alias("start"), geo.xy(F.lit(0.039), F.lit(40.0)).alias("end"))
    found = roads.shortest_routes(asked, lines).collect()
    assert [round(p.x, 4) for p in found[0].path] == [0.02, 0.03, 0.04]
    assert rounds.count("routes") <= 5
