"""What a serving query selects: a region, a span of time, properties of records, one page.

Each part knows how to narrow a DataFrame, so the parts combine freely and the
optimizer sees plain predicates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import dates, fixed, geo, units

BOXED = {"xmin", "ymin", "xmax", "ymax"}
MAX_ROWS, MAX_RADIUS_M = 200, 250_000
ORDERS = {"updated": "updated_at", "observed": "observed_at", "confidence": "confidence"}
PERIODS = ("current", "year", "historic")
#: Hours for which an estimate counts as current, by kind of record.
CURRENT_HOURS = {"fire_perimeter": 90 * 24}


def _check(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


@dataclass(frozen=True)
class Box:
    """An envelope in degrees."""

    west: float
    south: float
    east: float
    north: float

    def __post_init__(self) -> None:
        _check(-180 <= self.west < self.east <= 180, "an envelope runs from west to east inside -180 to 180")
        _check(-90 <= self.south < self.north <= 90, "an envelope runs from south to north inside -90 to 90")

    @classmethod
    def read(cls, text: str) -> Box:
        parts = text.split(",")
        _check(len(parts) == 4, f"an envelope has four numbers, not {len(parts)}")
        return cls(*map(float, parts))

    def keep(self, df: DataFrame) -> DataFrame:
        """Records that meet the envelope: comparisons a scan can skip row groups with, then the exact shape."""
        if not BOXED <= set(df.columns):
            return df.filter(units.in_bbox(F.col("longitude"), F.col("latitude"), (self.west, self.south, self.east, self.north)))
        across = (F.col("xmin") <= self.east) & (F.col("xmax") >= self.west)
        near = df.filter(across & (F.col("ymin") <= self.north) & (F.col("ymax") >= self.south))
        return near.filter(geo.intersects_box(F.col("geometry"), self.west, self.south, self.east, self.north)) if "geometry" in df.columns else near


@dataclass(frozen=True)
class Circle:
    """A point in degrees and a distance in meters."""

    latitude: float
    longitude: float
    meters: float

    def __post_init__(self) -> None:
        _check(abs(self.latitude) <= 90 and abs(self.longitude) <= 180, "a centre lies inside 90 degrees of latitude and 180 of longitude")
        _check(1 <= self.meters <= MAX_RADIUS_M, f"a radius is 1 to {MAX_RADIUS_M} meters")

    def keep(self, df: DataFrame) -> DataFrame:
        """Records within the distance: a padded envelope first, the exact distance after."""
        dy = self.meters * 1.01 / fixed.METERS_PER_DEGREE
        dx = dy / max(0.01, math.cos(math.radians(min(89.0, abs(self.latitude) + dy))))
        x, y = F.lit(float(self.longitude)), F.lit(float(self.latitude))
        west, south, east, north = self.longitude - dx, self.latitude - dy, self.longitude + dx, self.latitude + dy
        if BOXED <= set(df.columns):
            near = df.filter((F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south))
            return near.filter(geo.point_to_geometry_m(x, y, F.col("geometry")) <= self.meters)
        near = df.filter(units.in_bbox(F.col("longitude"), F.col("latitude"), (west, south, east, north)))
        return near.filter(geo.haversine_m(y, x, F.col("latitude"), F.col("longitude")) <= self.meters)


@dataclass(frozen=True)
class Span:
    """Bounds of the observation time, perimeter periods, and whether outdated records stay."""

    since: str | None = None
    until: str | None = None
    periods: frozenset[str] = frozenset()
    outdated: bool = False

    def __post_init__(self) -> None:
        _check(self.periods <= set(PERIODS), f"periods are {', '.join(PERIODS)}")

    def keep(self, df: DataFrame, data_type: str, now: Column) -> DataFrame:
        observed = F.col("observed_at")
        if data_type == "fire_perimeter" and self.periods:
            week, year = now - dates.span(days=7), now - dates.span(days=365)
            # "year" shares its younger edge with "current".
            tests = {"current": observed >= week, "year": observed.between(year, week), "historic": observed < year}
            hit = F.lit(False)
            for name in sorted(self.periods):
                hit = hit | tests[name]
            df = df.filter(hit)
        if self.since:
            df = df.filter(observed >= dates.ts(self.since))
        if self.until:
            df = df.filter(observed <= dates.ts(self.until))
        if self.outdated:
            return df
        if {"provenance", "observed_at"} <= set(df.columns):
            df = df.filter((F.col("provenance") != "estimated") | observed.isNull() | (observed >= current_cutoff(data_type, now)))
        return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)) if "expires_at" in df.columns else df


@dataclass(frozen=True)
class Selection:
    """Region, time and properties of the wanted records; parts that a table has no columns for don't apply."""

    region: Box | Circle | None = None
    span: Span = field(default_factory=Span)
    state: str | None = None
    publisher: str | None = None
    place: str | None = None
    confidence_from: float | None = None

    def __post_init__(self) -> None:
        _check(self.confidence_from is None or 0 <= self.confidence_from <= 1, "confidence lies between 0 and 1")
        for text in (self.publisher, self.place):
            _check(text is None or 2 <= len(text) <= 120, "search texts have 2 to 120 characters")

    def keep(self, df: DataFrame, data_type: str, sources: DataFrame, as_of: str) -> DataFrame:
        has = set(df.columns)
        if data_type == "incident":
            df = df.filter(F.col("merged_into").isNull() & ~F.coalesce(F.col("hidden"), F.lit(False)))
        df = self.span.keep(df, data_type, dates.ts(as_of))
        if self.state and "status" in has:
            df = df.filter(F.col("status") == self.state)
        if self.confidence_from is not None and "confidence" in has:
            df = df.filter(F.col("confidence") >= self.confidence_from)
        if self.place and "metadata_json" in has:
            df = df.filter(F.contains(F.lower("metadata_json"), F.lit(self.place.lower())))
        if self.publisher and "source_id" in has:
            named = F.col("name").ilike(f"%{self.publisher}%") | F.col("authority").ilike(f"%{self.publisher}%")
            df = df.join(sources.filter(named).select("source_id"), "source_id", "left_semi")
        return self.region.keep(df) if self.region else df


@dataclass(frozen=True)
class Page:
    """Rows ``skip`` + 1 to ``skip`` + ``rows`` in a stable order, newest or surest first."""

    order: str = "updated"
    rows: int = 50
    skip: int = 0

    def __post_init__(self) -> None:
        _check(self.order in ORDERS, f"orders are {', '.join(ORDERS)}")
        _check(1 <= self.rows <= MAX_ROWS, f"a page has 1 to {MAX_ROWS} rows")
        _check(self.skip >= 0, "a page starts at row 0 or later")

    def cut(self, df: DataFrame) -> DataFrame:
        key = ORDERS[self.order] if ORDERS[self.order] in df.columns else "updated_at"
        return df.orderBy(F.col(key).desc_nulls_last(), F.col("id").desc()).offset(self.skip).limit(self.rows)


def current_cutoff(data_type: str, as_of: Column) -> Column:
    """Oldest observation time at which an estimate still counts as current."""
    return as_of - dates.span(hours=CURRENT_HOURS.get(data_type, 12))
