import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlake.functions import dates, geo, metadata, scoring, sql, text, units
from emberlake.plans.sessions import activity_sessions


@pytest.fixture(scope="module")
def functions(spark):
    return sql.register(spark)


TWINS = {
    "haversine_m(a, b, c, d)": lambda: geo.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")),
    "equirect_m(a, b, c, d)": lambda: geo.equirect_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")),
    "detection_confidence(s)": lambda: units.detection_confidence(F.col("s")),
    "positive_number(s)": lambda: units.positive(F.col("s")),
    "comma_number(s)": lambda: units.number(F.col("s")),
    "squeezed(s)": lambda: text.collapse(F.col("s")),
    "road_ref(s)": lambda: text.road_ref(F.col("s")),
    "icao24(s)": lambda: text.icao24(F.col("s")),
    "madrid_day(t)": lambda: dates.madrid_day(F.col("t")),
    "publication_hash(s, s)": lambda: text.publication_hash(F.col("s"), F.col("s")),
    "road_incident_kind(s)": lambda: units.road_incident_kind(F.col("s")),
    "evidence_rank(s)": lambda: scoring.evidence_rank(F.col("s")),
}


def test_sql_functions_equal_their_column_twins(spark, functions):
    assert sorted(functions) == sorted(name.split("(")[0] for name in TWINS)
    texts = ["l", "N", "h", "101", "-3", "1,5", " 2.5 ", "", None, "N-120 a", "4ca2F0", "4c a2f0x", "https://e.org/a/#x", "https://e.org/a//", "Carreteras cortadas", "tráfico LENTO", "official", "individual", "a \t b  c"]
    rows = [(float(i), float(i % 7), 40.0, -3.0 + i, t, datetime(2026, 1 + i % 12, 28, 22 + i % 2, 30)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, s string, t timestamp")
    got = df.select(*[F.expr(e).alias(f"x{i}") for i, e in enumerate(TWINS)]).collect()
    want = df.select(*[make().alias(f"x{i}") for i, make in enumerate(TWINS.values())]).collect()
    for g, w in zip(got, want):
        assert [pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for v in w] == list(g)


def test_metadata_values(spark):
    docs = ['{"a": {"b": [1, "x", null]}, "t": true, "n": 3, "d": 2.5, "big": 123456789012, "s": "text", "z": null}', "[]", "no json", None, '{"t": "true", "n": "3", "d": 2}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, j string")
    fields = {"t": ("$.t", "boolean", False), "n": ("$.n", "long", -1), "d": ("$.d", "double", None), "s": ("$.s", "string", "-"), "z": ("$.z", "string", "none"), "x": ("$.a.b[1]", "string", None), "o": ("$.a", "string", None), "big": ("$.big", "long", 0), "tt": ("$.t", "string", None)}
    got = [tuple(r)[2:] for r in metadata.promoted(df, "j", fields).orderBy("id").collect()]
    assert json.loads(got[0][6]) == {"b": [1, "x", None]}
    assert got[0][:6] + got[0][7:] == (True, 3, 2.5, "text", "none", "x", 123456789012, "true")
    assert got[1] == got[2] == got[3] == (False, -1, None, "-", "none", None, None, 0, None)
    assert got[4] == (False, -1, 2.0, "-", "none", None, None, 0, "true")


def test_a_session_ends_with_the_gap(spark):
    rows = [("a", "2026-01-01 00:00:00", 1.0), ("a", "2026-01-01 02:59:59", 5.0), ("a", "2026-01-01 05:59:59", None), ("a", "2026-01-01 09:00:00", 2.0), ("b", None, 1.0), (None, "2026-01-01 00:00:00", 3.0)]
    df = spark.createDataFrame(rows, "k string, t string, frp_mw double").withColumn("observed_at", F.col("t").cast("timestamp"))
    got = {(r.k, str(r.first_at), str(r.last_at), r.detections, r.frp_mw) for r in activity_sessions(df, ["k"]).collect()}
    assert got == {("a", "2026-01-01 00:00:00", "2026-01-01 05:59:59", 3, 5.0), ("a", "2026-01-01 09:00:00", "2026-01-01 09:00:00", 1, 2.0), (None, "2026-01-01 00:00:00", "2026-01-01 00:00:00", 1, 3.0)}
