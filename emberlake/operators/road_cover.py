"""Lines of a road near a place, by the grid cells that lines and places cover.

A line covers the cells of its edges, a request those of its box. The two meet on equal
(road, cell), so a request never meets the whole of its road; exact tests follow on the
distinct pairs, and geometry is fetched for these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import geo

#: Degrees per cell, and around the ends of a request.
CELL, PAD = 0.1, 0.05


def _cells(west: Column, south: Column, east: Column, north: Column, cell: float) -> Column:
    at = lambda v: F.floor(v / cell).cast("long")
    columns = F.sequence(at(west), at(east))
    return F.flatten(F.transform(columns, lambda x: F.transform(F.sequence(at(south), at(north)), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def path_cells(path: Column, pad: float = 0.0, cell: float = CELL) -> Column:
    """Distinct cells that the boxes of a path's edges cover, each box grown by ``pad``."""

    def of(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return _cells(F.least(a["x"], b["x"]) - pad, F.least(a["y"], b["y"]) - pad, F.greatest(a["x"], b["x"]) + pad, F.greatest(a["y"], b["y"]) + pad, cell)

    return F.array_distinct(F.flatten(F.transform(geo.edges(path), of)))


def request_box(start: Column, end: Column, pad: float = PAD) -> dict[str, Column]:
    return {
        "west": F.least(start["x"], end["x"]) - pad, "south": F.least(start["y"], end["y"]) - pad,
        "east": F.greatest(start["x"], end["x"]) + pad, "north": F.greatest(start["y"], end["y"]) + pad,
    }


def path_meets_box(path: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """A path and a box share a point: boxes overlap and the corners are not all on one side of the edge."""

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]
        near = (F.least(a["x"], b["x"]) <= east) & (F.greatest(a["x"], b["x"]) >= west) & (F.least(a["y"], b["y"]) <= north) & (F.greatest(a["y"], b["y"]) >= south)
        side = lambda x, y: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        corners = [side(x, y) for x in (west, east) for y in (south, north)]
        return near & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.exists(geo.edges(path), meets)


def lines_in_reach(queries: DataFrame, lines: DataFrame, pad: float = PAD, cell: float = CELL) -> DataFrame:
    """(query_id, segment_id, path, start, end): lines of the request's road that meet the padded box of its ends.

    Where lines carry ``source_id``, only those of another source than the request's; lines
    and requests of unknown source meet nothing then.
    """
    other = "source_id" in lines.columns
    source = ["source_id"] if other else []
    box = request_box(F.col("start"), F.col("end"), pad)
    asked = queries.select("query_id", "road_key", *source, F.explode(_cells(*[box[c] for c in ("west", "south", "east", "north")], cell)).alias("cell"))
    covered = lines.select("road_key", "segment_id", *[F.col(c).alias("line_source") for c in source], F.explode(path_cells(F.col("path"), cell=cell)).alias("cell"))
    pairs = asked.join(covered, ["road_key", "cell"])
    if other:
        pairs = pairs.filter(F.col("line_source") != F.col("source_id"))
    pairs = pairs.select("query_id", "road_key", "segment_id").distinct()
    full = pairs.join(lines.select("road_key", "segment_id", "path"), ["road_key", "segment_id"]).join(queries.select("query_id", "start", "end"), "query_id")
    return full.filter(path_meets_box(F.col("path"), *[box[c] for c in ("west", "south", "east", "north")])).drop("road_key")
