"""Geometry as nested arrays and measures as Column expressions.

A geometry is ``struct<kind, parts: array<array<array<struct<x, y>>>>>``: parts
hold rings (polygons) or a single path (lines, points). Predicates are exact on
the plane; metres come from haversine (point to point) or a local
equirectangular projection (edges).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions import fixed

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(POINT)))),
    ]
)
INFINITE = float("inf")


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str | Column, parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), parts.alias("parts"))


def point(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), geometry("POINT", F.array(F.array(F.array(xy(lon, lat))))))


def line(path: Column) -> Column:
    """LINESTRING of a path of two or more points, else null."""
    return F.when(F.size(path) >= 2, geometry("LINESTRING", F.array(F.array(path))))


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    ring = F.array(xy(west, south), xy(east, south), xy(east, north), xy(west, north), xy(west, south))
    return geometry("POLYGON", F.array(F.array(ring)))


def points(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def point_count(geom: Column) -> Column:
    return F.size(points(geom))


def bbox(geom: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax)."""
    xs = F.transform(points(geom), lambda p: p["x"])
    ys = F.transform(points(geom), lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def bbox_gap_m(a: Column, b: Column) -> Column:
    """Lower bound of the metres between anything inside two bounding boxes."""
    dx = F.greatest(b["xmin"] - a["xmax"], a["xmin"] - b["xmax"], F.lit(0.0))
    dy = F.greatest(b["ymin"] - a["ymax"], a["ymin"] - b["ymax"], F.lit(0.0))
    steepest = F.greatest(F.abs(a["ymin"]), F.abs(a["ymax"]), F.abs(b["ymin"]), F.abs(b["ymax"]))
    return F.hypot(dx * F.cos(F.radians(steepest)), dy) * (fixed.METERS_PER_DEGREE * 0.999)


def rectangle(geom: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of a single point or upright rectangle, else null; no lambda runs for it."""
    ring = F.get(F.get(geom["parts"], F.lit(0)), F.lit(0))
    p = [F.get(ring, F.lit(i)) for i in range(5)]
    x, y = [v["x"] for v in p], [v["y"] for v in p]
    one = (F.size(geom["parts"]) == 1) & (F.size(F.get(geom["parts"], F.lit(0))) == 1)
    lone = (geom["kind"] == "POINT") & one & (F.size(ring) == 1) & x[0].isNotNull() & y[0].isNotNull()
    single = (geom["kind"] == "POLYGON") & one & (F.size(ring) == 5)
    across = (y[0] == y[1]) & (x[1] == x[2]) & (y[2] == y[3]) & (x[3] == x[0])
    along = (x[0] == x[1]) & (y[1] == y[2]) & (x[2] == x[3]) & (y[3] == y[0])
    closed = (x[4] == x[0]) & (y[4] == y[0]) & (x[0] != x[2]) & (y[0] != y[2])
    extent = F.struct(
        F.least(x[0], x[2]).alias("xmin"), F.least(y[0], y[2]).alias("ymin"),
        F.greatest(x[0], x[2]).alias("xmax"), F.greatest(y[0], y[2]).alias("ymax"),
    )
    spot = F.struct(x[0].alias("xmin"), y[0].alias("ymin"), x[0].alias("xmax"), y[0].alias("ymax"))
    return F.when(lone, spot).when(single & (across | along) & closed, extent)


def rectangle_gap_m(a: Column, b: Column) -> Column:
    """Metres between two upright rectangles: zero when they meet, else the smallest corner-to-side distance."""

    def corner(x: Column, y: Column, r: Column) -> Column:
        dx = F.greatest(r["xmin"] - x, x - r["xmax"], F.lit(0.0)) * (fixed.METERS_PER_DEGREE * F.cos(F.radians(y)))
        return F.hypot(dx, F.greatest(r["ymin"] - y, y - r["ymax"], F.lit(0.0)) * fixed.METERS_PER_DEGREE)

    meet = (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    gaps = [corner(p[x], p[y], q) for p, q in ((a, b), (b, a)) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    return F.when(meet, 0.0).otherwise(F.least(*gaps))


def is_areal(geom: Column) -> Column:
    return geom["kind"].isin("POLYGON", "MULTIPOLYGON", "GEOMETRYCOLLECTION")


def edges(ring: Column) -> Column:
    """Consecutive point pairs of a path; a lone point is an edge onto itself."""
    size = F.size(ring)
    return F.when(
        size >= 2,
        F.zip_with(
            F.slice(ring, F.lit(1), size - 1), F.slice(ring, F.lit(2), size - 1),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        ),
    ).otherwise(F.transform(ring, lambda p: F.struct(p.alias("a"), p.alias("b"))))


def all_edges(geom: Column) -> Column:
    return F.flatten(F.transform(F.flatten(geom["parts"]), edges))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray casting."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.aggregate(edges(ring), F.lit(False), lambda inside, e: inside != F.coalesce(crosses(e), F.lit(False)))


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(x, y, rings[0]) & ~F.exists(holes, lambda h: in_ring(x, y, h))


def in_geometry(x: Column, y: Column, geom: Column) -> Column:
    return is_areal(geom) & F.exists(geom["parts"], lambda rings: in_polygon(x, y, rings))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * fixed.EARTH_RADIUS_M * F.asin(F.sqrt(a))


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    mean = F.radians((lat1 + lat2) / 2)
    return F.hypot(
        (lon2 - lon1) * fixed.METERS_PER_DEGREE * F.cos(mean), (lat2 - lat1) * fixed.METERS_PER_DEGREE
    )


def segment_m(lon: Column, lat: Column, edge: Column) -> Column:
    """Metres from a point to an edge, projected around the point."""
    kx = fixed.METERS_PER_DEGREE * F.cos(F.radians(lat))
    ky = F.lit(fixed.METERS_PER_DEGREE)
    ax, ay = (edge["a"]["x"] - lon) * kx, (edge["a"]["y"] - lat) * ky
    dx, dy = (edge["b"]["x"] - edge["a"]["x"]) * kx, (edge["b"]["y"] - edge["a"]["y"]) * ky
    t = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(ax + t * dx, ay + t * dy)


def point_to_geometry_m(lon: Column, lat: Column, geom: Column) -> Column:
    """Zero inside an area, else metres to the nearest edge."""
    nearest = F.array_min(F.transform(all_edges(geom), lambda e: segment_m(lon, lat, e)))
    return F.when(in_geometry(lon, lat, geom), 0.0).otherwise(nearest)


def _side(e: Column, p: Column) -> Column:
    a, b = e["a"], e["b"]
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def edges_cross(e: Column, f: Column) -> Column:
    """Proper crossing of two edges (touching counts through the vertex distance)."""
    return (_side(e, f["a"]) * _side(e, f["b"]) < 0) & (_side(f, e["a"]) * _side(f, e["b"]) < 0)


def overlaps(a: Column, b: Column) -> Column:
    """A vertex of one inside the other, or two edges crossing (mere touching not included)."""
    ba, bb = bbox(a), bbox(b)
    near = (
        (ba["xmin"] <= bb["xmax"]) & (bb["xmin"] <= ba["xmax"]) & (ba["ymin"] <= bb["ymax"]) & (bb["ymin"] <= ba["ymax"])
    )
    inside = F.exists(points(a), lambda p: in_geometry(p["x"], p["y"], b)) | F.exists(
        points(b), lambda p: in_geometry(p["x"], p["y"], a)
    )
    crossing = F.exists(all_edges(a), lambda e: F.exists(all_edges(b), lambda f: edges_cross(e, f)))
    return near & (inside | crossing)


def intersects(a: Column, b: Column) -> Column:
    return overlaps(a, b) | (vertex_gap_m(a, b) == 0)


def intersects_box(geom: Column, west: float, south: float, east: float, north: float) -> Column:
    """Exact envelope intersection; the cheap bounding test comes first."""
    b = bbox(geom)
    near = (b["xmin"] <= east) & (b["xmax"] >= west) & (b["ymin"] <= north) & (b["ymax"] >= south)
    vertex = F.exists(points(geom), lambda p: p["x"].between(west, east) & p["y"].between(south, north))
    frame = box(F.lit(west), F.lit(south), F.lit(east), F.lit(north))
    corner = in_geometry(F.lit(west), F.lit(south), geom)
    crossing = F.exists(all_edges(geom), lambda e: F.exists(all_edges(frame), lambda f: edges_cross(e, f)))
    return near & (vertex | corner | crossing)


def vertex_gap_m(a: Column, b: Column) -> Column:
    def one_way(p: Column, q: Column) -> Column:
        return F.array_min(
            F.transform(
                points(p), lambda v: F.array_min(F.transform(all_edges(q), lambda e: segment_m(v["x"], v["y"], e)))
            )
        )

    return F.least(one_way(a, b), one_way(b, a))


def geometry_distance_m(a: Column, b: Column) -> Column:
    """Zero when the geometries meet, else the smallest vertex-to-edge distance."""
    return F.when(overlaps(a, b), 0.0).otherwise(vertex_gap_m(a, b))


def degrees_between(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def path_to_point_deg(path: Column, p: Column) -> Column:
    """Degrees from a point to the nearest vertex; an empty path is far away."""
    return F.coalesce(F.array_min(F.transform(path, lambda v: degrees_between(v, p))), F.lit(999.0))


def path_length_deg(path: Column) -> Column:
    return F.aggregate(edges(path), F.lit(0.0), lambda s, e: s + degrees_between(e["a"], e["b"]))


def path_length_m(path: Column) -> Column:
    return F.aggregate(
        edges(path), F.lit(0.0),
        lambda s, e: s + haversine_m(e["a"]["y"], e["a"]["x"], e["b"]["y"], e["b"]["x"]),
    )


def plausible_route(path: Column, start: Column, end: Column, short: bool = False) -> Column:
    """Length and end-point checks of a matched route."""
    factor, slack, reach = (6, 0.04, 0.01) if short else (35, 0.35, 0.05)
    direct = degrees_between(start, end)
    return (
        (direct > 0)
        & (path_length_deg(path) <= F.greatest(direct * factor, direct + slack))
        & (path_to_point_deg(path, start) <= reach)
        & (path_to_point_deg(path, end) <= reach)
    )


def join_paths(paths: Column) -> Column:
    """Concatenate paths, dropping the repeated joint between neighbours."""
    return F.aggregate(
        F.slice(paths, F.lit(2), F.greatest(F.size(paths) - 1, F.lit(0))),
        F.get(paths, F.lit(0)),
        lambda acc, p: F.concat(acc, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))),
    )


def ring_moments(ring: Column) -> Column:
    """struct(area2, cx, cy): twice the signed area and the unscaled centroid sums."""
    zero = F.struct(F.lit(0.0).alias("area2"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def add(acc: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct(
            (acc["area2"] + cross).alias("area2"),
            (acc["cx"] + (a["x"] + b["x"]) * cross).alias("cx"),
            (acc["cy"] + (a["y"] + b["y"]) * cross).alias("cy"),
        )

    return F.aggregate(edges(ring), zero, add)


def ring_area(ring: Column) -> Column:
    return ring_moments(ring)["area2"] / 2


def ring_centroid(ring: Column) -> Column:
    m = ring_moments(ring)
    return F.when(m["area2"] != 0, xy(m["cx"] / (3 * m["area2"]), m["cy"] / (3 * m["area2"])))


def polygon_centroid(rings: Column) -> Column:
    """Area-weighted centroid with holes counted negative."""
    weighted = F.transform(
        rings,
        lambda r, i: F.struct(
            (F.when(i == 0, 1.0).otherwise(-1.0) * F.abs(ring_area(r))).alias("w"), ring_centroid(r).alias("c")
        ),
    )
    sums = F.aggregate(
        F.filter(weighted, lambda s: s["c"].isNotNull()),
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda acc, s: F.struct(
            (acc["w"] + s["w"]).alias("w"),
            (acc["x"] + s["c"]["x"] * s["w"]).alias("x"),
            (acc["y"] + s["c"]["y"] * s["w"]).alias("y"),
        ),
    )
    return F.when(sums["w"] != 0, xy(sums["x"] / sums["w"], sums["y"] / sums["w"])).otherwise(rings[0][0])


def geometry_centroid(geom: Column) -> Column:
    """Centroid of a point, polygon, or the largest part of a multipolygon."""
    sized = F.transform(geom["parts"], lambda p, i: F.struct(F.abs(ring_area(p[0])).alias("a"), (-i).alias("i"), p.alias("p")))
    return F.when(geom["kind"] == "POINT", geom["parts"][0][0][0]).when(
        is_areal(geom), polygon_centroid(F.array_max(sized)["p"])
    )


def _coord(p: Column) -> Column:
    return F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))


def _path_text(path: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(path, _coord), ", "), F.lit(")"))


def _rings_text(rings: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(rings, _path_text), ", "), F.lit(")"))


def wkt(geom: Column) -> Column:
    parts, kind = geom["parts"], geom["kind"]
    paths = F.array_join(F.transform(F.flatten(parts), _path_text), ", ")
    polygons = F.array_join(F.transform(parts, _rings_text), ", ")
    return (
        F.when(kind.isin("POINT", "LINESTRING"), F.concat(kind, _path_text(parts[0][0])))
        .when(kind == "MULTILINESTRING", F.concat(kind, F.lit("("), paths, F.lit(")")))
        .when(kind == "POLYGON", F.concat(kind, _rings_text(parts[0])))
        .otherwise(F.concat(F.lit("MULTIPOLYGON("), polygons, F.lit(")")))
    )


def geojson(geom: Column) -> Column:
    """GeoJSON text of a geometry."""
    pair = lambda p: F.array(p["x"], p["y"])
    path = lambda r: F.transform(r, pair)
    parts, kind = geom["parts"], geom["kind"]

    def doc(name: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit(name).alias("type"), coordinates.alias("coordinates")))

    return (
        F.when(kind == "POINT", doc("Point", pair(parts[0][0][0])))
        .when(kind == "LINESTRING", doc("LineString", path(parts[0][0])))
        .when(kind == "MULTILINESTRING", doc("MultiLineString", F.transform(F.flatten(parts), path)))
        .when(kind == "POLYGON", doc("Polygon", F.transform(parts[0], path)))
        .when(geom.isNotNull(), doc("MultiPolygon", F.transform(parts, lambda rings: F.transform(rings, path))))
    )


def clean_ring(ring: Column) -> Column:
    """Finite points only, closed, null when fewer than three points are left."""
    finite = F.filter(
        ring,
        lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
        & (F.abs(p["x"]) < INFINITE) & (F.abs(p["y"]) < INFINITE),
    )
    closed = F.when(F.get(finite, F.lit(0)) == F.try_element_at(finite, F.lit(-1)), finite).otherwise(
        F.concat(finite, F.slice(finite, 1, 1))
    )
    return F.when((F.size(finite) >= 3) & (F.size(closed) >= 4), closed)


def clean_polygons(parts: Column) -> Column:
    """Drop broken rings, then polygons without rings."""
    rings = F.transform(parts, lambda p: F.filter(F.transform(p, clean_ring), lambda r: r.isNotNull()))
    return F.filter(rings, lambda p: F.size(p) > 0)


# GeoJSON coordinate depth decides the part structure of each kind.
DEPTHS = {"Point": 0, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def _coords(text: Column, depth: int) -> Column:
    return F.from_json(F.get_json_object(text, "$.coordinates"), "array<" * (depth + 1) + "double" + ">" * (depth + 1))


def _pairs(path: Column) -> Column:
    return F.transform(F.filter(path, lambda c: F.size(c) >= 2), lambda c: xy(c[0], c[1]))


def parse_line(text: Column) -> Column:
    """GeoJSON LineString, or the first line of a MultiLineString, as LINESTRING."""
    kind = F.get_json_object(text, "$.type")
    path = F.when(kind == "LineString", _pairs(_coords(text, 1))).when(
        kind == "MultiLineString", _pairs(F.get(_coords(text, 2), F.lit(0)))
    )
    return line(path)


def parse_lines(text: Column) -> Column:
    """GeoJSON LineString or MultiLineString as an array of paths with two or more points."""
    kind = F.get_json_object(text, "$.type")
    paths = F.when(kind == "LineString", F.array(_pairs(_coords(text, 1)))).when(
        kind == "MultiLineString", F.transform(_coords(text, 2), _pairs)
    )
    return F.filter(paths, lambda p: F.size(p) >= 2)


def area_steps(text: Column) -> dict[str, Column]:
    """Kind and cleaned parts of a GeoJSON Polygon or MultiPolygon; other kinds have no parts."""
    kind = F.get_json_object(text, "$.type")
    polygons = F.when(kind == "Polygon", F.array(F.transform(_coords(text, 2), _pairs))).when(
        kind == "MultiPolygon", F.transform(_coords(text, 3), lambda p: F.transform(p, _pairs))
    )
    return {"kind": kind, "parts": clean_polygons(polygons)}


def area_of(kind: Column, parts: Column) -> Column:
    """Geometry of what ``area_steps`` gives, null without parts."""
    name = F.when(kind == "Polygon", "POLYGON").otherwise("MULTIPOLYGON")
    return F.when(F.size(parts) > 0, geometry(name, parts))


def parse_area(text: Column) -> Column:
    """GeoJSON Polygon or MultiPolygon as a cleaned geometry, else null."""
    return area_of(**area_steps(text))


def polygon_text_bbox(text: Column) -> Column:
    """"lat,lon lat,lon ..." to "west,south,east,north" with six decimals; bad text is null."""
    pairs = F.split(F.trim(text), r"\s+")
    lats = F.transform(pairs, lambda p: F.get(F.split(p, ",", 2), F.lit(0)).try_cast("double"))
    lons = F.transform(pairs, lambda p: F.get(F.split(p, ",", 2), F.lit(1)).try_cast("double"))
    good = F.forall(lats, lambda v: v.isNotNull()) & F.forall(lons, lambda v: v.isNotNull())
    return F.when(
        good, F.format_string("%.6f,%.6f,%.6f,%.6f", F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))
    )


def padded_bbox_text(b: Column, pad: float = 0.03) -> Column:
    return F.format_string(
        "%.6f,%.6f,%.6f,%.6f",
        F.greatest(F.lit(-180.0), b["xmin"] - pad), F.greatest(F.lit(-90.0), b["ymin"] - pad),
        F.least(F.lit(180.0), b["xmax"] + pad), F.least(F.lit(90.0), b["ymax"] + pad),
    )


def utm30_to_lonlat(easting: Column, northing: Column) -> Column:
    """ETRS89 / UTM zone 30N metres to degrees (inverse transverse Mercator series)."""
    axis, flattening, scale = 6378137.0, 1 / 298.257222101, 0.9996
    n = flattening / (2 - flattening)
    radius = axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = northing / (scale * radius), (easting - 500_000.0) / (scale * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) - 3.0
    return xy(lon, F.degrees(lat))


def offset(p: Column, east_m: Column, north_m: Column) -> Column:
    """Move a point by metres."""
    kx = fixed.METERS_PER_DEGREE * F.greatest(F.cos(F.radians(p["y"])), F.lit(0.1))
    return xy(p["x"] + east_m / kx, p["y"] + north_m / fixed.METERS_PER_DEGREE)
