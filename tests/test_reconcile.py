import pytest
from pyspark.sql import functions as F

from emberlake.functions import geo
from emberlake.plans import osint
from emberlake.plans import reconcile as R

AS_OF = "2026-07-28 00:00:00"


def perimeters(spark, rows):
    """rows: (id, lon, lat, half, area, commune, province, day)"""
    df = spark.createDataFrame(rows, "id string, lon double, lat double, h double, area_hectares double, commune string, province string, day string")
    return df.withColumns({
        "incident_id": F.concat(F.lit("fire-"), "id"), "observed_at": F.col("day").cast("timestamp"), "xmin": F.col("lon") - F.col("h"), "ymin": F.col("lat") - F.col("h"),
        "xmax": F.col("lon") + F.col("h"), "ymax": F.col("lat") + F.col("h"), "firedate": F.col("day"), "lastupdate": F.col("day"),
        "hashtags": F.array().cast("array<string>"), "affected_locations": F.array().cast("array<string>"),
    }).withColumn("geometry", geo.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))).drop("lon", "lat", "h", "day")


def publications(spark, rows):
    """rows: (id, text, places, lon or None, lat, day)"""
    df = spark.createDataFrame(rows, "id string, title string, place_names array<string>, lon double, lat double, day string")
    df = df.withColumns({"body": F.col("title"), "source_type": F.lit("official")})
    out = osint.classify_publications(df).withColumns({
        "original_text": F.col("title"), "published_at": F.col("day").cast("timestamp"), "review_status": F.lit("accepted"), "multi_incident_summary": F.lit(False),
        "incident_id": F.lit(None).cast("string"), "ends_at": F.lit(None).cast("timestamp"), "authority": F.lit("A"), "url": F.concat(F.lit("u/"), "id"), "confidence": F.lit(0.9),
        "geometry": F.when(F.col("lon").isNotNull(), geo.box(F.col("lon") - 0.005, F.col("lat") - 0.005, F.col("lon") + 0.005, F.col("lat") + 0.005)),
    })
    return out.drop("lon", "lat", "day", "body")


def detections(spark, rows):
    df = spark.createDataFrame(rows, "id string, longitude double, latitude double, day string")
    return df.withColumns({"observed_at": F.col("day").cast("timestamp"), "frp_mw": F.lit(2.0), "incident_id": F.lit(None).cast("string")}).drop("day")


PERIMETERS = [
    ("p1", -0.25, 39.90, 0.01, 500.0, "Artana", "Castelló", "2026-07-25"), ("p2", -0.235, 39.91, 0.004, 50.0, "Onda", "Castelló", "2026-07-26"),
    ("p3", -0.22, 39.915, 0.003, 20.0, "Onda", "Castelló", "2026-07-27"), ("q1", -6.50, 42.00, 0.01, 900.0, "Larouco", "Ourense", "2026-07-25"),
    ("old", -0.25, 39.90, 0.01, 10.0, "Artana", "Castelló", "2026-05-01"),
]


def test_groups_are_transitive_and_lead_by_area(spark):
    out = {r.perimeter_id: (r.primary_id, r.reasons) for r in R.group_perimeters(perimeters(spark, PERIMETERS)).collect()}
    assert {k: v[0] for k, v in out.items()} == {"p1": "p1", "p2": "p1", "p3": "p1", "q1": "q1", "old": "old"}
    assert out["p2"][1] == ["same_province", "adjacent_1500m", "simultaneous_2d"] and out["p1"][1] == []


def test_a_pile_of_copies_is_one_group(spark):
    copies = [(f"c{i:03d}", -1.0, 40.0, 0.01, 5.0, "X", "P", "2026-07-20") for i in range(60)] + [("n", -1.0, 40.0, 0.01, 5.0, None, None, "2026-07-20")]
    out = R.group_perimeters(perimeters(spark, copies)).groupBy("primary_id").count().collect()
    assert sorted((r.primary_id, r["count"]) for r in out) == [("c000", 60), ("n", 1)]


def test_publications_match_by_each_kind_of_evidence(spark):
    fires = perimeters(spark, PERIMETERS).withColumn("hashtags", F.when(F.col("id") == "q1", F.array(F.lit("#IFLarouco"))).otherwise(F.col("hashtags")))
    pubs = publications(spark, [
        ("tag", "Seguim a #iflarouco", [], None, None, "2026-07-26"), ("place", "Incendi forestal", ["ARTANA"], None, None, "2026-07-26"),
        ("text", "Incendi forestal prop de Larouco #IFAltre", [], None, None, "2026-07-26"), ("space", "Incendi forestal", [], -6.5, 42.0, "2026-07-26"),
        ("late", "Incendi forestal", ["Larouco"], None, None, "2026-08-20"), ("other", "Activa el pla per inundació", ["Artana"], None, None, "2026-07-26"),
        ("weak", "Incendi forestal a Larouco", [], None, None, "2026-07-26"),
    ])
    got = {r.publication_id: (r.perimeter_id, r.score) for r in R.match_publications(pubs, fires).collect()}
    assert got == {"tag": ("q1", 165), "place": ("p1", 90), "text": ("q1", 65), "space": ("q1", 70)}


def test_detections_go_to_the_newest_fire_nearby(spark):
    d = detections(spark, [("near", -0.25, 39.93, "2026-07-25"), ("early", -0.25, 39.9, "2026-07-20"), ("far", -0.25, 40.2, "2026-07-25"), ("both", -0.235, 39.91, "2026-07-26")])
    got = {r.detection_id: r.perimeter_id for r in R.link_detections_to_fires(d, perimeters(spark, PERIMETERS)).collect()}
    assert got == {"near": "p3", "both": "p3"}


@pytest.fixture(scope="module")
def result(spark):
    pubs = publications(spark, [
        ("a", "Incendi forestal al municipi d'Artana #IFArtana", ["Artana"], None, None, "2026-07-26"), ("b", "Incendio extinguido #IFArtana", ["Artana"], None, None, "2026-07-27"),
        ("c", "Bon dia", [], None, None, "2026-07-27"),
    ])
    d = detections(spark, [("x", -0.25, 39.9, "2026-07-25"), ("y", -0.22, 39.915, "2026-07-27"), ("z", 3.0, 39.9, "2026-07-27")])
    return R.reconcile_recent(perimeters(spark, PERIMETERS), pubs, d, AS_OF)


def test_reconciliation_end_to_end(result):
    fires = {r.fire_id: r for r in result["fires"].collect()}
    assert set(fires) == {"fire-p1", "fire-q1"}
    one = fires["fire-p1"]
    assert (one.title, one.status, one.area_ha, one.grouped_perimeter_count) == ("Incendi #IFArtana - Artana / Onda", "controlled", 570.0, 3)
    assert one.firms_detection_count == 2 and one.osint_publication_count == 2 and one.extinction_confirmed and one.hashtags == ["#IFArtana"]
    assert one.affected_locations == ["Artana", "Onda"] and fires["fire-q1"].status == "reported"
    metrics = result["metrics"].first()
    assert (metrics.canonical_incidents, metrics.merged_incidents, metrics.linked_detections) == (2, 2, 2)


def test_reconciliation_children_follow(result):
    assert {r.id: r.incident_id for r in result["publications"].collect()} == {"a": "fire-p1", "b": "fire-p1", "c": None}
    assert {r.id: r.incident_id for r in result["detections"].collect()} == {"x": "fire-p1", "y": "fire-p1", "z": None}
    assert result["evidence"].count() == 2


def test_a_refreshed_fire_has_the_union_of_its_perimeters_and_tells_them(spark, result):
    fires = {r.fire_id: r for r in result["fires"].collect()}
    assert fires["fire-p1"].effis_perimeter_ids == ["p1", "p2", "p3"] and fires["fire-p1"].geometry.kind == "MULTIPOLYGON"
    told = {r.id: (r.fire_id, r.canonical_title, r.grouped_perimeter_count) for r in result["perimeter_metadata"].collect()}
    assert told["p3"] == ("fire-p1", "Incendi #IFArtana - Artana / Onda", 3) and told["q1"][0] == "fire-q1"
    over = perimeters(spark, [("a", 0.0, 40.0, 0.01, 5.0, "X", "P", "2026-07-25"), ("b", 0.01, 40.0, 0.01, 5.0, "X", "P", "2026-07-25"), ("c", 1.0, 40.0, 0.01, 5.0, "X", "P", "2026-07-25")])
    told = [("n", "Incendi forestal", [], None, None, "2026-07-26")]
    pubs = publications(spark, told).withColumns({"incident_id": F.lit("f"), "instructions": F.lit("Confineu-vos"), "es_alert_message": F.lit("m")})
    fire = R.refresh_fires(over.withColumn("incident_id", F.lit("f")), pubs, detections(spark, [("x", 0.0, 40.0, "2026-07-25")])).first()
    # Two overlapping squares are one polygon of five corners, closed; the far one stays apart.
    assert sorted(len(rings[0]) for rings in fire.geometry.parts) == [5, 5] and fire.geometry.parts[0][0][2].x == pytest.approx(0.02)
    assert (fire.instructions, fire.es_alert_message) == ("Confineu-vos", "m")


def test_empty_publication_incidents_are_hidden(spark):
    inc = spark.createDataFrame([("i", True, "", False), ("j", True, "", False), ("k", True, "EFFIS", False), ("l", False, "", False)], "id string, osint boolean, canonical_source string, hidden boolean")
    pubs = spark.createDataFrame([("p", "i")], "id string, incident_id string")
    assert {r.id for r in R.hide_empty(inc, pubs).filter("hidden").collect()} == {"j"}


def test_fires_far_away_stand_for_all_of_their_name_and_time(spark):
    from emberlake.functions import geo

    day, none = 86_400.0, F.array().cast("array<string>")
    pubs = spark.createDataFrame([("p", "incendi a sant joan", 100 * day)], "pub_id string, text string, pub_at double").withColumns(
        {"pub_geometry": geo.point(F.lit(0.0), F.lit(40.0)), "pub_tags": none, "pub_places": F.array(F.lit("sant joan"))})
    fires = spark.range(400).select(
        F.concat(F.lit("per-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("perimeter_id"), F.lit("sant joan").alias("commune"), F.lit("girona").alias("province"),
        (F.lit(86 * day) + F.floor(F.col("id") / 10) * day).alias("fire_at"), none.alias("fire_tags"), none.alias("fire_places"),
        F.when(F.col("id") == 7, geo.box(F.lit(0.01), F.lit(40.0), F.lit(0.02), F.lit(40.01))).otherwise(geo.box(F.lit(5.0), F.lit(40.0), F.lit(5.1), F.lit(40.1))).alias("fire_geometry"))
    got = sorted(r.perimeter_id for r in R.match_candidates(pubs, fires).collect())
    assert got == ["per-0007", "per-0170", "per-0280"]
