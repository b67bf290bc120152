"""Numeric parsing and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.functions import fixed
from emberlake.functions.text import clean


def number(col: Column) -> Column:
    """Float with comma or point decimals; anything else is null."""
    return F.replace(clean(col), F.lit(","), F.lit(".")).try_cast("double")


def tagged_number(col: Column) -> Column:
    """Like ``number`` but tolerates a tonne suffix ("3.5t")."""
    return F.trim(F.replace(F.replace(clean(col), F.lit("t"), F.lit("")), F.lit(","), F.lit("."))).try_cast("double")


def positive(col: Column) -> Column:
    value = col.try_cast("double")
    return F.when(value > 0, value)


def detection_confidence(code: Column) -> Column:
    """l/n/h letters or a 0-100 number to [0, 1]."""
    numeric = code.try_cast("double")
    return (
        F.when(F.lower(code) == "l", 0.4)
        .when(F.lower(code) == "n", 0.6)
        .when(F.lower(code) == "h", 0.85)
        .when(numeric.isNotNull(), F.greatest(F.lit(0.0), F.least(numeric / 100.0, F.lit(1.0))))
    )


def dms(col: Column) -> Column:
    """Decimal degrees from decimal text or packed degrees-minutes-seconds with a hemisphere."""
    text = clean(col)
    hemisphere = F.upper(F.right(text, F.lit(1)))
    digits = F.substring(text, F.lit(1), F.length(text) - 1)
    north_south = hemisphere.isin("N", "S") & digits.rlike(r"^\d{4,}$")
    east_west = hemisphere.isin("E", "W") & digits.rlike(r"^\d{5,}$")

    def part(start: int, length: int) -> Column:
        return F.coalesce(F.substring(digits, start, length).try_cast("double"), F.lit(0.0))

    value = F.when(north_south, part(1, 2) + part(3, 2) / 60 + part(5, 9) / 3600).when(
        east_west, part(1, 3) + part(4, 2) / 60 + part(6, 9) / 3600
    )
    signed = F.when(hemisphere.isin("S", "W"), -value).otherwise(value)
    return F.coalesce(text.try_cast("double"), signed)


def compass(col: Column) -> Column:
    text = F.upper(clean(col))
    named = F
    for point, degrees in fixed.COMPASS.items():
        named = named.when(text == point, degrees)
    return F.coalesce(named.otherwise(F.lit(None).cast("double")), number(col))


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float] = fixed.SPAIN_BBOX) -> Column:
    west, south, east, north = bbox
    return lon.between(west, east) & lat.between(south, north)


def valid_lonlat(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def sensor_family(sensor: Column) -> Column:
    low = F.lower(F.coalesce(sensor, F.lit("")))
    return F.when(F.contains(low, F.lit("modis")), "modis").when(F.contains(low, F.lit("viirs")), "viirs").otherwise("other")


def pixel_meters(sensor: Column, km: Column) -> Column:
    """Pixel side from scan or track size, else the nominal size of the sensor."""
    family = sensor_family(sensor)
    nominal = F.when(family == "modis", 1000.0).when(family == "viirs", 375.0).otherwise(500.0)
    return F.coalesce(positive(km) * 1000.0, nominal)


def connect_radius(sensor: Column, scan_km: Column, track_km: Column) -> Column:
    family = sensor_family(sensor)
    largest = F.greatest(pixel_meters(sensor, scan_km), pixel_meters(sensor, track_km))
    return F.when(family == "modis", 1500.0).when(family == "viirs", F.greatest(F.lit(650.0), largest * 1.45)).otherwise(750.0)


def minimum_cell(family: Column) -> Column:
    return F.when(family == "viirs", 400.0).when(family == "modis", 1000.0).otherwise(500.0)


def plan_level(phase: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(phase, F.lit(""))))
    has = lambda t: F.contains(low, F.lit(t))
    return (
        F.when(has("emerg"), "red")
        .when(has("alert") & ~has("pre"), "orange")
        .when(has("prealert") | has("avis") | has("avís"), "yellow")
    )


def alert_level(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return (
        F.when(low.isin("amarillo", "yellow"), "yellow")
        .when(low.isin("naranja", "orange"), "orange")
        .when(low.isin("rojo", "red"), "red")
    )


def severity_level(severity: Column) -> Column:
    return (
        F.when(severity == "Moderate", "yellow").when(severity == "Severe", "orange").when(severity == "Extreme", "red")
    )


def notice_level(level: Column, severity: Column) -> Column:
    low = F.lower(F.coalesce(level, severity, F.lit("")))
    return F.when(low.isin("yellow", "orange", "red"), low)


def label(col: Column, labels: dict[str, str]) -> Column:
    """Label of a code; unknown codes pass through, empty is null."""
    out = F.when((col == "") | col.isNull(), F.lit(None).cast("string"))
    for code, text in labels.items():
        out = out.when(col == code, text)
    return out.otherwise(col)


def traffic_category(values: Column) -> Column:
    low = F.lower(values)
    out = F
    for name, tokens in fixed.TRAFFIC_CATEGORIES:
        hit = F.contains(low, F.lit(tokens[0]))
        for token in tokens[1:]:
            hit = hit | F.contains(low, F.lit(token))
        out = out.when(hit, name)
    return out.otherwise(fixed.TRAFFIC_CATEGORY_DEFAULT)


def road_incident_kind(kind: Column, stem: bool = False) -> Column:
    """Closure / slow traffic / unknown from the category text; ``stem`` matches word stems."""
    low = F.lower(kind)
    closed = ("cortad", "restring") if stem else ("cortadas", "restringida")
    return (
        F.when(F.contains(low, F.lit(closed[0])) | F.contains(low, F.lit(closed[1])), "official_closure")
        .when(F.contains(low, F.lit("lento")), "reduced_visibility")
        .otherwise("insufficient_data")
    )


def general_number(col: Column) -> Column:
    """Six significant digits without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", col), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def kilometer_range(points: Column) -> Column:
    """"PK a - b" over the numeric kilometre points, "PK a" when they coincide."""
    values = F.filter(F.transform(points, lambda p: p.try_cast("double")), lambda v: v.isNotNull())
    low, high = F.array_min(values), F.array_max(values)
    return F.when(low == high, F.concat(F.lit("PK "), general_number(low))).when(
        low.isNotNull(), F.concat(F.lit("PK "), general_number(low), F.lit(" - "), general_number(high))
    )


def kilometer_bounds(points: Column, text_range: Column) -> Column:
    """struct(first, last) from kilometre points, else from the numbers of a range text."""
    listed = F.filter(
        F.transform(points, lambda p: F.replace(p, F.lit(","), F.lit(".")).try_cast("double")), lambda v: v.isNotNull()
    )
    parsed = F.transform(
        F.regexp_extract_all(F.coalesce(text_range, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)),
        lambda p: F.replace(p, F.lit(","), F.lit(".")).try_cast("double"),
    )
    values = F.when(F.size(F.coalesce(listed, F.array())) >= 2, listed).otherwise(parsed)
    return F.when(
        F.size(values) >= 2, F.struct(F.array_min(values).alias("first"), F.array_max(values).alias("last"))
    )


def kilometer_samples(first: Column, last: Column, step: float) -> Column:
    """Sample positions from first to last at a fixed step, the last one always included."""
    width = max(step, 0.1)
    sign = F.when(last >= first, 1.0).otherwise(-1.0)
    span = F.abs(last - first)
    inner = F.greatest(F.ceil(F.round(span / width, 9)) - 1, F.lit(0)).cast("int")
    grid = F.transform(F.sequence(F.lit(0), inner), lambda i: F.when(i == 0, first).otherwise(F.round(first + sign * i * width, 3)))
    return F.when(F.element_at(grid, -1) == last, grid).otherwise(F.array_append(grid, last))


def sample_worthy(distance_km: Column, cause: Column, record_type: Column, kind: Column) -> Column:
    cause, record_type, kind = (F.lower(F.coalesce(c, F.lit(""))) for c in (cause, record_type, kind))
    has = lambda c, t: F.contains(c, F.lit(t))
    valuable = (
        has(cause, "ambiental") | has(record_type, "environment") | has(cause, "incendi") | has(cause, "fire")
        | has(kind, "cortadas") | has(kind, "restringida")
    )
    return (distance_km >= 2) & (distance_km <= 90) & valuable


def canonical_hash(external_id: Column, payload: Column) -> Column:
    """sha-256 of an id and a payload struct in canonical JSON."""
    return F.sha2(F.concat(external_id, F.lit("|"), F.to_json(payload)), 256)


def compact_map(entries: dict[str, Column]) -> Column:
    """map<string,string> of the non-null entries, keys sorted."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), entries[k].cast("string").alias("v")) for k in sorted(entries)])
    return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))


def overlay(base: Column, top: Column, keep: Column | None = None) -> Column:
    """Map merge where ``top`` wins; with ``keep``, the listed keys of ``base`` win instead."""
    if keep is None:
        rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k))
        return F.map_concat(rest, top)
    kept = F.map_filter(base, lambda k, v: F.array_contains(keep, k))
    rest = F.map_filter(top, lambda k, v: ~F.map_contains_key(kept, k))
    return F.map_concat(rest, kept)


def drop_keys(col: Column, keys: list[str]) -> Column:
    return F.map_filter(col, lambda k, v: ~k.isin(keys))
