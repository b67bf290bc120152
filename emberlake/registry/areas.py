"""Registered detection-area queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import ctes, load
from emberlake.functions import geo
from emberlake.plans import areas

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


_POINTS = ctes("detections").replace("WITH detections", "WITH RECURSIVE detections", 1) + """, pt AS (
  SELECT *, CAST(CAST(observed_at AS DATE) AS STRING) AS "day", lower(sensor) AS family,
    CASE sensor WHEN 'MODIS' THEN 1000e0 ELSE 375e0 END AS nominal FROM detections),
p AS (SELECT *, CASE WHEN scan_km > 0 THEN scan_km * 1000 ELSE nominal END AS scan_m, CASE WHEN track_km > 0 THEN track_km * 1000 ELSE nominal END AS track_m FROM pt),
q AS (SELECT *, CASE family WHEN 'modis' THEN 1500e0 ELSE greatest(650e0, greatest(scan_m, track_m) * 1.45e0) END AS radius_m FROM p),
links AS (SELECT a.id AS s, b.id AS t FROM q a JOIN q b ON a."day" = b."day" AND a.family = b.family AND a.id <> b.id
  AND abs(a.latitude - b.latitude) < 0.1 AND abs(a.longitude - b.longitude) < 0.15
  WHERE sqrt(pow((b.longitude - a.longitude) * 111320e0 * cos(radians((a.latitude + b.latitude) / 2)), 2) + pow((b.latitude - a.latitude) * 111320e0, 2)) <= greatest(a.radius_m, b.radius_m)),
reach(id, other) AS (SELECT id, id FROM q UNION SELECT r.id, l.t FROM reach r JOIN links l ON r.other = l.s),
comp AS (SELECT id, min(other) AS first_id FROM reach GROUP BY 1)"""


@register("detection_groups", _POINTS + """
SELECT first_id, count(*) AS detections, min(observed_us) AS oldest_us, max(observed_us) AS newest_us FROM comp JOIN q USING (id) GROUP BY 1""")
def detection_groups(spark: SparkSession, sf: str) -> DataFrame:
    grouped = areas.group_detections(areas.detection_points(load(spark, sf, "detections")))
    return grouped.groupBy("group").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("detections"),
        F.min(F.unix_micros("observed_at")).alias("oldest_us"), F.max(F.unix_micros("observed_at")).alias("newest_us"),
    ).drop("group")


@register("detection_grid", _POINTS + """,
g AS (SELECT q.*, first_id, avg(longitude) OVER w AS lon0, avg(latitude) OVER w AS lat0, median(scan_m) OVER w AS scan_mid, median(track_m) OVER w AS track_mid
  FROM comp JOIN q USING (id) WINDOW w AS (PARTITION BY first_id)),
x AS (SELECT *, (longitude - lon0) * 111320e0 * greatest(cos(radians(lat0)), 0.1e0) AS x, (latitude - lat0) * 111320e0 AS y FROM g),
pr AS (SELECT a.first_id, b.x - a.x AS dx, b.y - a.y AS dy, least(a.scan_m, a.track_m) AS pixel, greatest(a.radius_m, b.radius_m) AS reach
  FROM x a JOIN x b ON a.first_id = b.first_id AND a.id < b.id),
near AS (SELECT *, sqrt(dx * dx + dy * dy) AS m FROM pr WHERE sqrt(dx * dx + dy * dy) <= reach),
ang AS (SELECT first_id, atan2(sum(sin(4 * atan2(dy, dx))), sum(cos(4 * atan2(dy, dx)))) / 4 AS t FROM near WHERE m >= pixel * 0.55e0 GROUP BY 1),
a2 AS (SELECT first_id, CASE WHEN t < -1e-9 THEN t + pi() / 2 ELSE greatest(t, 0e0) END AS t FROM ang),
tr AS (SELECT near.first_id, abs(dx * cos(coalesce(t, 0)) + dy * sin(coalesce(t, 0))) AS h, abs(-dx * sin(coalesce(t, 0)) + dy * cos(coalesce(t, 0))) AS v FROM near LEFT JOIN a2 USING (first_id)),
sp AS (SELECT first_id, median(h) FILTER (h > 100 AND h > v * 1.8e0) AS hs, median(v) FILTER (v > 100 AND v > h * 1.8e0) AS vs FROM tr GROUP BY 1)
SELECT first_id, round(greatest(any_value(scan_mid), CASE any_value(family) WHEN 'viirs' THEN 400e0 ELSE 1000e0 END, coalesce(any_value(hs), any_value(scan_mid))), 2) AS width,
  round(greatest(any_value(track_mid), CASE any_value(family) WHEN 'viirs' THEN 400e0 ELSE 1000e0 END, coalesce(any_value(vs), any_value(track_mid))), 2) AS height
FROM g LEFT JOIN sp USING (first_id) GROUP BY 1""")
def detection_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = areas.oriented_grid(areas.group_detections(areas.detection_points(load(spark, sf, "detections"))))
    return grid.groupBy("group").agg(
        F.min("id").alias("first_id"), F.round(F.first("width"), 2).alias("width"), F.round(F.first("height"), 2).alias("height")
    ).drop("group")


@register("detection_areas")
def detection_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Dissolved footprint of every detection group."""
    out = areas.detection_areas(load(spark, sf, "detections"))
    return out.select(
        "id", "family", "detections", "cells", "area_m2", "footprint_shape", F.round("angle_degrees", 4).alias("angle_degrees"),
        F.col("geometry.kind").alias("kind"), F.size("geometry.parts").alias("parts"), geo.point_count(F.col("geometry")).alias("points"),
    )


@register("detection_pins")
def detection_pins(spark: SparkSession, sf: str) -> DataFrame:
    pins = areas.detection_pins(areas.detection_areas(load(spark, sf, "detections")))
    return pins.select("id", "detections", F.round("pin.x", 6).alias("lon"), F.round("pin.y", 6).alias("lat"))


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "detections").select(
        F.floor(F.col("longitude") * 10).cast("long").alias("column"), F.floor(F.col("latitude") * 10).cast("long").alias("row")
    ).distinct()


@register("merged_footprint", ctes("detections") + """,
c AS (SELECT DISTINCT CAST(floor(longitude * 10) AS BIGINT) AS x, CAST(floor(latitude * 10) AS BIGINT) AS y FROM detections),
e AS (SELECT count(*) AS n FROM c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS v(dx, dy) WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.x = c.x + dx AND o.y = c.y + dy))
SELECT round(CAST(count(*) AS DOUBLE), 3) AS area_cells, round(CAST(any_value(e.n) AS DOUBLE), 3) AS edge_cells, CAST(min(x) AS DOUBLE) - 0.5e0 AS west, CAST(max(y) AS DOUBLE) + 0.5e0 AS north
FROM c, e""")
def merged_footprint(spark: SparkSession, sf: str) -> DataFrame:
    """Union of all visible cells from its polygons: area with holes subtracted, length of all rings, two sides of its extent."""
    rings = areas.merged_footprint(lattice(spark, sf)).select(F.explode("rings").alias("ring"))
    steps = F.transform("ring", lambda p, i: F.coalesce(geo.degrees_between(p, F.get("ring", i + 1)), F.lit(0.0)))
    return rings.agg(
        F.round(F.sum(geo.ring_area(F.col("ring"))), 3).alias("area_cells"), F.round(F.sum(F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)), 3).alias("edge_cells"),
        F.min(F.array_min(F.transform("ring", lambda p: p["x"]))).alias("west"), F.max(F.array_max(F.transform("ring", lambda p: p["y"]))).alias("north"),
    )
