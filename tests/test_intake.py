from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlake.plans import civil, osint

T0 = datetime(2026, 7, 1, 12)


def publications(spark, rows):
    """rows: id, hours after the start, place or None, title, kind of source, authority."""
    schema = "id string, published_at timestamp, place string, title string, source_type string, authority string"
    df = spark.createDataFrame([(i, T0 + timedelta(hours=h), p, t, s, a) for i, h, p, t, s, a in rows], schema)
    return df.withColumns({
        "body": F.lit(""), "url": F.concat(F.lit("https://e.org/"), "id"), "external_id": F.col("id"), "reliability": F.lit(1.0),
        "locations": F.when(F.col("place").isNotNull(), F.array("place")),
    })


@pytest.fixture
def nothing(spark):
    stored = spark.createDataFrame([], "deduplication_hash string")
    incidents = spark.createDataFrame([], "id string, risk_type string, observed_at timestamp, affected_locations array<string>, summary string, title string, multi_incident_summary boolean")
    return stored, incidents, spark.createDataFrame([("Morella",), ("Sagunt",)], "name string")


FIRE = "Incendi forestal a la serra"


def test_two_reports_of_a_new_fire_open_one_incident(spark, nothing):
    rows = [("a", 0, "Morella", FIRE, "reliable_media", "x"), ("b", 1, "Morella", FIRE, "reliable_media", "y"), ("c", 2, "Sagunt", FIRE, "reliable_media", "y"),
            ("d", 24 * 7.5 + 1, "Morella", FIRE, "reliable_media", "z"), ("e", 24 * 16, "Morella", FIRE, "reliable_media", "z")]
    out, opened = osint.ingest_publications(publications(spark, rows), *nothing)
    got = {r.id: r.incident_id for r in out.collect()}
    assert got["a"] == got["b"] and len({got["a"], got["c"], got["d"], got["e"]}) == 4
    assert {r.opened_by for r in opened.collect()} == {"a", "c", "d", "e"}


def test_a_stored_incident_takes_later_reports(spark, nothing):
    stored, incidents, places = nothing
    known = spark.createDataFrame([("inc-1", "wildfire", T0 - timedelta(days=2), ["morella"], None, "t", False)], incidents.schema)
    out, opened = osint.ingest_publications(publications(spark, [("a", 0, "Morella", FIRE, "official", "x")]), stored, known, places)
    assert [r.incident_id for r in out.collect()] == ["inc-1"] and opened.count() == 0


def test_copies_through_a_gateway_are_the_same_publication(spark, nothing):
    df = publications(spark, [("a", 0, "Morella", FIRE, "official", "x"), ("b", 1, "Morella", FIRE, "official", "x")]).withColumn("canonical_url", F.lit("https://x.com/u/status/1"))
    out, _ = osint.ingest_publications(df, *nothing)
    assert [r.id for r in out.collect()] == ["a"]


def test_witnesses_are_promoted_from_the_third_on(spark):
    rows = [(str(i), T0 + timedelta(minutes=i), "inc", a, s) for i, (a, s) in enumerate([("x", "individual"), ("x", "individual"), ("y", "individual"), ("z", "multiple_witnesses"), ("x", "individual"), ("w", "official")])]
    df = spark.createDataFrame(rows, "id string, published_at timestamp, incident_id string, authority string, source_type string").withColumns({"evidence_rank": F.lit(4), "confidence": F.lit(0.3)})
    got = {r.id: (r.source_type, r.evidence_rank) for r in osint.promote_witnesses(df).collect()}
    assert got == {"0": ("individual", 4), "1": ("individual", 4), "2": ("individual", 4), "3": ("multiple_witnesses", 4), "4": ("multiple_witnesses", 3), "5": ("official", 4)}


def test_equal_rows_do_not_cancel_in_a_fingerprint(spark):
    one, two = spark.createDataFrame([(1,), (1,)], "v int"), spark.createDataFrame([(2,), (2,)], "v int")
    assert civil.fingerprint(one).collect() != civil.fingerprint(two).collect()


def test_assignment_takes_the_newest_incident_by_place_or_two_words(spark):
    pubs = [("a", "fire", T0, ["X"], "Foc"), ("b", "fire", T0, ["X", "Y"], "Foc"), ("c", "fire", T0, [], "serra gran barranc"), ("d", "fire", T0, [], "serra llunyana"), ("e", "flood", T0, ["X"], "Foc")]
    p = spark.createDataFrame(pubs, "id string, risk_type string, published_at timestamp, place_names array<string>, title string")
    rows = [(f"i{n}", "fire", T0 - timedelta(hours=n), ["x"], "res", False) for n in range(200)]
    rows += [("old", "flood", T0 - timedelta(days=8), ["x"], "res", False), ("z", "fire", T0, ["X"], "res", False), ("y", "fire", T0 + timedelta(hours=1), ["Y"], "barranc serra", False), ("m", "fire", T0 + timedelta(hours=9), ["Y"], "res", True)]
    i = spark.createDataFrame(rows, "id string, risk_type string, observed_at timestamp, affected_locations array<string>, title string, multi_incident_summary boolean").withColumn("summary", F.lit(None).cast("string"))
    out = osint.assign_to_incidents(p, i)
    assert dict(map(tuple, out.collect())) == {"a": "z", "b": "y", "c": "y"}
    # Incidents fold to a row per key before the join: no join sees an incident.
    assert "incident_id" not in "".join(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
