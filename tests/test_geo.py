import math
import random

import pytest
from pyspark.sql import functions as F

from emberlake.functions import geo


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def path(*pts):
    return F.array(*[geo.xy(F.lit(float(x)), F.lit(float(y))) for x, y in pts])


def square(x0, y0, x1, y1):
    return geo.box(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1))


def test_haversine(spark):
    args = [F.lit(v) for v in (40.4, -3.7, 40.401, -3.701)]
    assert one(spark, geo.haversine_m(*args)) == pytest.approx(139.7668, abs=1e-3)


def test_point_in_polygon_with_hole(spark):
    ring, hole = path((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), path((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    poly = geo.geometry("POLYGON", F.array(F.array(ring, hole)))
    inside = lambda x, y: one(spark, geo.in_geometry(F.lit(x), F.lit(y), poly))
    assert inside(3.0, 3.0) and not inside(1.5, 1.5) and not inside(5.0, 1.0)


def test_distances(spark):
    a, b, c = square(0.0, 0.0, 1.0, 1.0), square(2.0, 0.0, 3.0, 1.0), square(0.5, 0.5, 2.5, 0.7)
    assert one(spark, geo.geometry_distance_m(a, b)) == pytest.approx(111_320 * math.cos(math.radians(1)), rel=1e-6)
    assert one(spark, geo.geometry_distance_m(a, c)) == 0.0
    assert one(spark, geo.point_to_geometry_m(F.lit(0.5), F.lit(0.5), a)) == 0.0
    assert one(spark, geo.intersects_box(c, 0.9, 0.6, 0.95, 0.65)) is True
    assert one(spark, geo.intersects_box(a, 5.0, 5.0, 6.0, 6.0)) is False


def test_with_distance_agrees_with_the_plain_expression(spark):
    from emberlake.operators.distance import with_distance

    rng = random.Random(7)
    rows = []
    for i in range(60):
        x, y, u, v = rng.uniform(0, 0.3), rng.uniform(40, 40.3), rng.uniform(0, 0.3), rng.uniform(40, 40.3)
        rows.append((i, x, y, u, v))
    df = spark.createDataFrame(rows, "i int, x double, y double, u double, v double")
    df = df.withColumn("a", geo.box(F.col("x"), F.col("y"), F.col("x") + 0.05, F.col("y") + 0.03)).withColumn("b", geo.box(F.col("u"), F.col("v"), F.col("u") + 0.02, F.col("v") + 0.06))
    plain = df.select("i", geo.geometry_distance_m(F.col("a"), F.col("b")).alias("m")).collect()
    staged = {r.i: r.m for r in with_distance(df, "a", "b", "m", 10_000.0).collect()}
    for r in plain:
        if r.m > 10_000:
            assert staged[r.i] is None
        else:
            assert staged[r.i] == pytest.approx(r.m, abs=1e-6)


def test_area_and_centroid(spark):
    ring = path((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))
    assert one(spark, geo.ring_area(ring)) == 8.0
    c = one(spark, geo.polygon_centroid(F.array(ring, path((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))))
    assert (c.x, c.y) == (3.0, 1.0)


def test_text_forms(spark):
    assert one(spark, geo.wkt(geo.line(path((1, 2), (3, 4))))) == "LINESTRING(1.0 2.0, 3.0 4.0)"
    assert one(spark, geo.geojson(geo.point(F.lit(1.0), F.lit(2.0)))) == '{"type":"Point","coordinates":[1.0,2.0]}'
    back = one(spark, geo.wkt(geo.parse_area(F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]],[[5,5]]]}'))))
    assert back == "POLYGON((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))"
    assert one(spark, geo.wkt(geo.parse_line(F.lit('{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[2,2],[3,3]]]}')))) == "LINESTRING(0.0 0.0, 1.0 0.0)"
    assert one(spark, geo.parse_line(F.lit('{"type":"Point","coordinates":[0,0]}'))) is None
    assert one(spark, geo.polygon_text_bbox(F.lit("41.25,0.5 41.75,1.25"))) == "0.500000,41.250000,1.250000,41.750000"
    assert one(spark, geo.polygon_text_bbox(F.lit("41.25,x"))) is None


def test_projected_to_degrees(spark):
    p = one(spark, geo.utm30_to_lonlat(F.lit(500_000.0), F.lit(4_427_757.22)))
    assert p.x == pytest.approx(-3.0, abs=1e-9) and p.y == pytest.approx(40.0, abs=1e-5)
    q = one(spark, geo.utm30_to_lonlat(F.lit(421_300.5), F.lit(4_512_080.25)))
    assert q.x == pytest.approx(-3.932, abs=0.02) and q.y == pytest.approx(40.756, abs=0.02)


def test_routes(spark):
    line = path((0, 0), (0.1, 0), (0.2, 0))
    good = geo.plausible_route(line, geo.xy(F.lit(0.0), F.lit(0.01)), geo.xy(F.lit(0.2), F.lit(0.0)))
    far = geo.plausible_route(line, geo.xy(F.lit(0.0), F.lit(0.2)), geo.xy(F.lit(0.2), F.lit(0.0)))
    assert one(spark, good) is True and one(spark, far) is False
    joined = one(spark, geo.join_paths(F.array(path((0, 0), (1, 0)), path((1, 0), (2, 0)))))
    assert [(p.x, p.y) for p in joined] == [(0, 0), (1, 0), (2, 0)]
