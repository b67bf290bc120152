"""Detection areas: connected groups, oriented grid, dissolved footprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import fixed, geo, units
from emberlake.operators.components import connected_components
from emberlake.operators.dissolve import dissolve_cells
from emberlake.operators.dedupe import top_rows
from emberlake.operators.grid_join import Box, grid_join, padded
from emberlake.operators.skew import salted_join
from emberlake.session import cut_lineage

MPD = fixed.METERS_PER_DEGREE


def detection_points(detections: DataFrame) -> DataFrame:
    """(id, longitude, latitude, day, family, scan_m, track_m, radius_m, observed_at)."""
    usable = detections.filter(units.valid_lonlat(F.col("longitude"), F.col("latitude")))
    return usable.select(
        "id", "longitude", "latitude", "observed_at", F.coalesce(F.to_date("observed_at").cast("string"), F.lit("unknown")).alias("day"),
        units.sensor_family(F.col("sensor")).alias("family"), units.pixel_meters(F.col("sensor"), F.col("scan_km")).alias("scan_m"),
        units.pixel_meters(F.col("sensor"), F.col("track_km")).alias("track_m"),
        units.connect_radius(F.col("sensor"), F.col("scan_km"), F.col("track_km")).alias("radius_m"),
    )


def place_pairs(points: DataFrame) -> DataFrame:
    """(a_place, b_place, ...) of distinct places of one day and sensor family within reach of each other.

    Detections at the same coordinates are one place with their largest radius, so
    repeated detections of a spot never pair with each other.
    """
    places = points.groupBy("day", "family", "longitude", "latitude").agg(F.max("radius_m").alias("radius_m"))
    places = places.withColumn("place", F.concat_ws("|", "day", "family", F.col("longitude").cast("string"), F.col("latitude").cast("string")))
    cols = ["place", "longitude", "latitude", "radius_m"]
    a = places.select("day", "family", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = places.select("day", "family", *[F.col(c).alias(f"b_{c}") for c in cols])
    # max(r1, r2) <= r1 + r2: both boxes grow by their own radius.
    pairs = grid_join(
        a, b, padded(Box.point("a_longitude", "a_latitude"), F.col("a_radius_m")), padded(Box.point("b_longitude", "b_latitude"), F.col("b_radius_m")),
        cell_m=4_000.0, keys=["day", "family"], spread="a_place",
    ).filter(F.col("a_place") < F.col("b_place"))
    distance = geo.equirect_m(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    return pairs.withColumn("distance_m", distance).filter(F.col("distance_m") <= F.greatest("a_radius_m", "b_radius_m"))


def group_detections(points: DataFrame) -> DataFrame:
    """Points with their connected group: same day, same family, chained within the larger of two radii."""
    place = F.concat_ws("|", "day", "family", F.col("longitude").cast("string"), F.col("latitude").cast("string"))
    keyed = points.withColumn("place", place)
    edges = place_pairs(points).select(F.col("a_place").alias("src"), F.col("b_place").alias("dst"))
    comp = connected_components(edges).select(F.col("node").alias("place"), F.col("component").alias("group"))
    # A place without a neighbour is a group of its own; no round needs to see it.
    return salted_join(keyed, comp, ["place"], F.col("id"), "left").withColumn("group", F.coalesce("group", "place"))


def project(grouped: DataFrame) -> DataFrame:
    """Metres around the mean of each group, with the group's medians and first point as anchor."""
    stats = grouped.groupBy("group").agg(
        F.avg("longitude").alias("lon0"), F.avg("latitude").alias("lat0"), F.count(F.lit(1)).alias("detections"),
        F.percentile("scan_m", 0.5).alias("scan_mid"), F.percentile("track_m", 0.5).alias("track_mid"),
        F.min("observed_at").alias("oldest_detection_at"), F.max("observed_at").alias("newest_detection_at"),
        F.min_by(F.struct("id", "longitude", "latitude"), "id").alias("first"),
    ).withColumn("kx", MPD * F.greatest(F.cos(F.radians("lat0")), F.lit(0.1)))
    return salted_join(grouped, stats, ["group"], F.col("id")).withColumns(
        {
            "x": (F.col("longitude") - F.col("lon0")) * F.col("kx"), "y": (F.col("latitude") - F.col("lat0")) * MPD,
            "x0": (F.col("first.longitude") - F.col("lon0")) * F.col("kx"), "y0": (F.col("first.latitude") - F.col("lat0")) * MPD,
        }
    )


def group_pairs(projected: DataFrame) -> DataFrame:
    """Place pairs of a group within reach, weighted by the detections at both ends."""
    spots = projected.groupBy("group", "day", "family", "longitude", "latitude", "radius_m", "scan_m", "track_m").agg(
        F.min("id").alias("id"), F.first("x").alias("x"), F.first("y").alias("y"), F.count(F.lit(1)).alias("n")
    )
    cols = ["id", "longitude", "latitude", "radius_m", "n", "scan_m", "track_m", "x", "y"]
    a = spots.select("day", "family", "group", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = spots.select("day", "family", "group", *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = grid_join(
        a, b, padded(Box.point("a_longitude", "a_latitude"), F.col("a_radius_m")), padded(Box.point("b_longitude", "b_latitude"), F.col("b_radius_m")),
        cell_m=4_000.0, keys=["day", "family", "group"], spread="a_id",
    ).filter(F.col("a_id") < F.col("b_id"))
    return pairs.select(
        "group", (F.col("b_x") - F.col("a_x")).alias("dx"), (F.col("b_y") - F.col("a_y")).alias("dy"),
        F.least("a_scan_m", "a_track_m").alias("pixel"), F.greatest("a_radius_m", "b_radius_m").alias("reach"), (F.col("a_n") * F.col("b_n")).alias("weight"),
    ).filter(F.hypot("dx", "dy") <= F.col("reach"))


def grid_angle(pairs: DataFrame) -> DataFrame:
    """(group, angle): circular mean of pair directions modulo a quarter turn."""
    quarter = math.pi / 2
    theta = F.pmod(F.atan2("dy", "dx"), F.lit(quarter))
    sums = pairs.filter(F.hypot("dx", "dy") >= F.col("pixel") * 0.55).groupBy("group").agg(
        F.sum(F.cos(theta * 4) * F.col("weight")).alias("c"), F.sum(F.sin(theta * 4) * F.col("weight")).alias("s")
    )
    raw = F.atan2("s", "c") / 4
    # Rounding noise around zero must not turn an axis-aligned grid by a quarter.
    return sums.select("group", F.when(raw < -1e-9, raw + quarter).otherwise(F.greatest(raw, F.lit(0.0))).alias("angle"))


def grid_spacing(pairs: DataFrame, angles: DataFrame) -> DataFrame:
    """(group, horizontal, vertical): median spacing along and across the grid axis."""
    turned = pairs.join(angles, "group", "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))
    along = F.abs(F.col("dx") * F.cos("angle") + F.col("dy") * F.sin("angle"))
    across = F.abs(-F.col("dx") * F.sin("angle") + F.col("dy") * F.cos("angle"))
    # Equal spacings are counted before the median, whose state is one entry per distinct value.
    rows = turned.select("group", along.alias("h"), across.alias("v"), "weight").groupBy("group", "h", "v").agg(F.sum("weight").alias("weight"))
    middle = lambda value, other: F.percentile(
        F.when((F.col(value) > 100) & (F.col(value) > F.col(other) * 1.8), F.col(value)), 0.5, F.col("weight").cast("long")
    )
    return rows.groupBy("group").agg(middle("h", "v").alias("horizontal"), middle("v", "h").alias("vertical"))


def oriented_grid(grouped: DataFrame) -> DataFrame:
    """Every point with its group's grid (angle, spacing, cell size) and its column and row."""
    projected = cut_lineage(project(grouped), "projected")
    pairs = cut_lineage(group_pairs(projected), "group-pairs")
    angles = grid_angle(pairs)
    grid = grid_spacing(pairs, angles)
    joined = projected.join(angles, "group", "left").join(grid, "group", "left").withColumns(
        {
            "angle": F.coalesce("angle", F.lit(0.0)), "horizontal": F.coalesce("horizontal", "scan_mid"), "vertical": F.coalesce("vertical", "track_mid"),
        }
    )
    least = units.minimum_cell(F.col("family"))
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    cos, sin = F.cos("angle"), F.sin("angle")
    js_round = lambda v: F.floor(v + 0.5).cast("long")
    return joined.withColumns(
        {
            "width": F.greatest("scan_mid", least, "horizontal"), "height": F.greatest("track_mid", least, "vertical"),
            "column": js_round((dx * cos + dy * sin) / F.col("horizontal")), "row": js_round((-dx * sin + dy * cos) / F.col("vertical")),
        }
    )


GRID = ["angle", "horizontal", "vertical", "width", "height", "lon0", "lat0", "kx", "x0", "y0"]


def _to_lonlat(p: Column) -> Column:
    x = F.col("x0") + p["x"] * F.col("horizontal") * F.cos("angle") - p["y"] * F.col("vertical") * F.sin("angle")
    y = F.col("y0") + p["x"] * F.col("horizontal") * F.sin("angle") + p["y"] * F.col("vertical") * F.cos("angle")
    return F.struct((F.col("lon0") + x / F.col("kx")).alias("x"), (F.col("lat0") + y / MPD).alias("y"))


def label_cells(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """(group, column, row): the occupied cell nearest to the centroid of the largest polygon, inside it when possible.

    The only cell of a group needs no polygon.
    """
    lone = cells.groupBy("group").agg(F.min("column").alias("column"), F.min("row").alias("row"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    cells = cells.join(lone, "group", "left_anti")
    polygons = polygons.join(lone, "group", "left_anti")
    biggest = top_rows(polygons, ["group"], [F.col("outer_area").desc(), F.col("rings").asc()]).select("group", "rings", geo.ring_centroid(F.col("rings")[0]).alias("target"))
    rows = salted_join(cells, biggest, ["group"], F.col("column"))
    inside = geo.in_polygon(F.col("column").cast("double"), F.col("row").cast("double"), F.col("rings"))
    gap = F.hypot(F.col("column") - F.col("target.x"), F.col("row") - F.col("target.y"))
    order = F.struct((~inside).alias("outside"), F.round(gap, 9).alias("gap"), "column", "row")
    return lone.unionByName(rows.groupBy("group").agg(F.min_by(F.struct("column", "row"), order).alias("c")).select("group", "c.*"))


def detection_areas(detections: DataFrame) -> DataFrame:
    """One row per group: counts, span, grid, area, label point and dissolved geometry in degrees."""
    grid = cut_lineage(oriented_grid(group_detections(detection_points(detections))), "grid")
    cells = grid.groupBy("group", "column", "row").agg(*[F.first(c).alias(c) for c in ("width", "height", "horizontal", "vertical")]).withColumns(
        {
            "half_col": F.greatest(F.col("width") / F.col("horizontal") / 2, F.lit(0.5)),
            "half_row": F.greatest(F.col("height") / F.col("vertical") / 2, F.lit(0.5)),
        }
    )
    polygons = cut_lineage(dissolve_cells(cells, "group", "column", "row", "half_col", "half_row"), "dissolved")
    label = label_cells(cut_lineage(cells.select("group", "column", "row"), "cells"), polygons).select("group", F.struct(F.col("column").cast("double").alias("x"), F.col("row").cast("double").alias("y")).alias("label"))
    head = grid.groupBy("group").agg(
        *[F.first(c).alias(c) for c in [*GRID, "family", "detections", "oldest_detection_at", "newest_detection_at", "first"]],
        F.countDistinct("column", "row").alias("cells"),
    )
    parts = polygons.groupBy("group").agg(F.array_sort(F.collect_list("rings")).alias("parts"))
    full = head.join(parts, "group").join(label, "group")
    placed = F.transform("parts", lambda rings: F.transform(rings, lambda ring: F.transform(ring, _to_lonlat)))
    kind = F.when(F.size("parts") == 1, "POLYGON").otherwise("MULTIPOLYGON")
    return full.select(
        "group", F.concat(F.lit("firms-"), F.md5(F.concat_ws("|", F.lit("group"), "family", "first.id", F.col("detections").cast("string")))).alias("id"),
        "family", "detections", "oldest_detection_at", "newest_detection_at", "cells",
        F.when(F.col("detections") > 1, "wildfire_detection_group").otherwise("fire_detection").alias("data_type"),
        F.when(F.col("detections") > 1, "firms_oriented_grid_union").otherwise("nasa_firms_pixel_square").alias("footprint_shape"),
        F.floor(F.col("cells") * F.col("width") * F.col("height") + 0.5).cast("long").alias("area_m2"),
        "width", "height", F.degrees("angle").alias("angle_degrees"), _to_lonlat(F.col("label")).alias("label_point"),
        geo.geometry(kind, placed).alias("geometry"),
    )


def area_points(detections: DataFrame) -> DataFrame:
    """(group, id, longitude, latitude, observed_at, footprint_m, radius_m): the detections behind every area, as rows."""
    grouped = group_detections(detection_points(detections))
    return grouped.select("group", "id", "longitude", "latitude", "observed_at", F.greatest("scan_m", "track_m").alias("footprint_m"), "radius_m")


def merged_footprint(cells: DataFrame) -> DataFrame:
    """Union of all visible axis-aligned cells (column, row on one shared lattice) as polygons."""
    half = cells.select(F.lit("all").alias("layer"), "column", "row", F.lit(0.5).alias("half_col"), F.lit(0.5).alias("half_row")).distinct()
    return dissolve_cells(half, "layer", "column", "row", "half_col", "half_row")


def detection_pins(areas: DataFrame) -> DataFrame:
    """Pin position: label point moved so that the two sensors do not cover each other."""
    shift = F.when(F.col("family") == "modis", -170.0).when(F.col("family") == "viirs", 170.0).otherwise(0.0)
    return areas.select("id", "detections", geo.offset(F.col("label_point"), shift, shift).alias("pin"))
