"""Exact union of lattice rectangles as polygons with holes.

Groups of a bounded number of rectangles are dissolved inside tasks, many at a time
(``operators.rectangles``). Rectangles of a larger group are cut along the coordinate lines
that bound them, equal pieces are kept once, and edges shared by two pieces cancel. What is
left is the boundary, chained into rings by repeated pairwise merging; these steps are joins
and aggregations on (group, coordinate) keys. Both ways give the same rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import fixed, geo
from emberlake.operators.grid_join import Box, grid_join
from emberlake.operators.rectangles import dissolved
from emberlake.operators.skew import salted_join
from emberlake.session import cut_lineage, drop_cut

#: Parts of a cell that bounds are rounded to.
SCALE = 1_000
#: Rectangles of a group that one task dissolves; larger groups are spread over tasks.
TASK_CELLS = 200_000


def lattice_rectangles(cells: DataFrame, group: str, col: str, row: str, half_col: str, half_row: str) -> DataFrame:
    """(g, l, r, b, t): rectangles, bounds in thousandths of a cell."""
    mil = lambda c: F.round(c * SCALE).cast("long")
    return cells.select(
        F.col(group).alias("g"), mil(F.col(col) - F.col(half_col)).alias("l"), mil(F.col(col) + F.col(half_col)).alias("r"),
        mil(F.col(row) - F.col(half_row)).alias("b"), mil(F.col(row) + F.col(half_row)).alias("t"),
    )


def unit_pieces(rects: DataFrame) -> DataFrame:
    """(g, x0, x1, y0, y1): elementary rectangles on the micro-lattice of every group.

    A half span of one half is a plain lattice; larger spans overlap and are cut at every
    foreign bound they cover.
    """
    scale = SCALE

    # Bounds can only fall inside a rectangle at offsets set by the span, so every
    # rectangle lists its own cuts: neighbours at whole cells left and right of it.
    def cuts(lo: str, hi: str) -> Column:
        width = F.col(hi) - F.col(lo)
        steps = F.floor(width / scale).cast("long")
        inner = F.flatten(
            F.transform(
                F.sequence(F.lit(0).cast("long"), steps),
                lambda k: F.array(F.col(lo) + k * scale, F.col(hi) - k * scale),
            )
        )
        return F.array_sort(F.array_distinct(F.filter(inner, lambda v: v.between(F.col(lo), F.col(hi)))))

    def spans(name: str) -> Column:
        c = F.col(name)
        n = F.size(c)
        return F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    split = rects.distinct().withColumn("xs", cuts("l", "r")).withColumn("ys", cuts("b", "t"))
    return (
        split.select("g", F.explode(spans("xs")).alias("x"), "ys").select("g", "x", F.explode(spans("ys")).alias("y"))
        .select("g", F.col("x.a").alias("x0"), F.col("x.b").alias("x1"), F.col("y.a").alias("y0"), F.col("y.b").alias("y1"))
        .distinct()
    )


def boundary_edges(pieces: DataFrame) -> DataFrame:
    """Directed boundary edges (interior on the left): edges met from both sides cancel."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    loops = [("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0")]
    directed = pieces.select(
        "g", F.explode(F.array(*[F.struct(corner(a, b).alias("s"), corner(c, d).alias("e")) for a, b, c, d in loops])).alias("d")
    ).select("g", "d.*")
    forward = F.struct("s") < F.struct("e")
    keyed = directed.select(
        "g", F.when(forward, F.col("s")).otherwise(F.col("e")).alias("p"), F.when(forward, F.col("e")).otherwise(F.col("s")).alias("q"),
        F.when(forward, 1).otherwise(-1).alias("turn"),
    )
    kept = keyed.groupBy("g", "p", "q").agg(F.sum("turn").alias("turn")).filter("turn <> 0")
    return kept.select(
        "g", F.when(F.col("turn") > 0, F.col("p")).otherwise(F.col("q")).alias("s"), F.when(F.col("turn") > 0, F.col("q")).otherwise(F.col("p")).alias("e")
    )


def chain_rings(edges: DataFrame) -> DataFrame:
    """Directed edges (g, s, e) to closed rings (g, ring).

    Each edge is first tied to the one edge that follows it (where two cells only
    touch at a corner the sharpest left turn keeps them apart), then pointers double
    their reach every round.
    """
    out = edges.select("g", "s", "e", F.atan2(F.col("e.y") - F.col("s.y"), F.col("e.x") - F.col("s.x")).alias("a"))
    nxt = out.select("g", F.col("s").alias("e"), F.col("e").alias("e2"), F.col("a").alias("a2"))
    turn = F.pmod(F.col("a2") - F.col("a") + F.lit(3.141592653589793), F.lit(6.283185307179586))
    w = Window.partitionBy("g", "s", "e").orderBy(turn.desc())
    succ = out.join(nxt, ["g", "e"]).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    edge_id = lambda a, b: F.struct(F.col(a).alias("s"), F.col(b).alias("e"))
    # Label every edge with the smallest edge of its ring and its step from there by pointer doubling.
    state = succ.select("g", edge_id("s", "e").alias("id"), edge_id("e", "e2").alias("next")).withColumns(
        {"low": F.least("id", "next"), "jump": F.lit(1).cast("long"), "at": F.when(F.col("next") < F.col("id"), F.lit(1)).otherwise(F.lit(0)).cast("long")}
    )
    state = cut_lineage(state, "ring-links")
    while True:
        ahead = state.select(
            "g", F.col("id").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"), F.col("at").alias("far_at"), F.col("jump").alias("far_jump")
        )
        grown = state.join(ahead, ["g", "next"]).select(
            "g", "id", F.col("far").alias("next"), F.least("low", "far_low").alias("low"),
            F.when(F.col("far_low") < F.col("low"), F.col("jump") + F.col("far_at")).otherwise(F.col("at")).alias("at"),
            (F.col("jump") + F.col("far_jump")).alias("jump"), (F.col("far_low") < F.col("low")).alias("moved"),
        )
        before, state = state, cut_lineage(grown, "ring-links")
        drop_cut(before)
        if not state.agg(F.count_if("moved")).first()[0]:
            break
    # ``at`` counts steps to the smallest edge, so descending order walks the ring behind it; that edge itself comes first.
    place = F.when(F.col("at") > 0, -F.col("at")).otherwise(F.lit(-(2**62)))
    ring = F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col("id"))))
    rings = state.groupBy("g", "low").agg(ring.alias("r"))
    corners = F.transform("r", lambda s: F.struct((s["id"]["s"]["x"] / 1000.0).alias("x"), (s["id"]["s"]["y"] / 1000.0).alias("y")))
    return rings.select("g", corners.alias("open"))


def straighten(rings: DataFrame) -> DataFrame:
    """Close rings and drop the corners where the direction does not change."""
    n = F.size("open")
    prev = lambda i: F.get(F.col("open"), F.pmod(i - 1, n))
    follow = lambda i: F.get(F.col("open"), F.pmod(i + 1, n))

    def bends(p, i):
        a, b = prev(i), follow(i)
        return (p["x"] - a["x"]) * (b["y"] - p["y"]) != (p["y"] - a["y"]) * (b["x"] - p["x"])

    kept = rings.withColumn("bent", F.filter("open", bends))
    return kept.select("g", F.concat("bent", F.slice("bent", 1, 1)).alias("ring"))


def _spread(rects: DataFrame) -> DataFrame:
    """(g, outer_area, rings) of groups of any size, by joins and rounds over all edges."""
    rings = cut_lineage(straighten(chain_rings(boundary_edges(unit_pieces(rects)))), "rings")
    measured = rings.select("g", "ring", geo.ring_area(F.col("ring")).alias("area"))
    outer = measured.filter("area > 0").select("g", F.col("ring").alias("outer"), F.col("area").alias("outer_area"))
    holes = measured.filter("area < 0").select("g", F.col("ring").alias("hole"))
    probe = F.struct(
        ((F.col("hole")[0]["x"] + F.col("hole")[1]["x"]) / 2).alias("x"), ((F.col("hole")[0]["y"] + F.col("hole")[1]["y"]) / 2).alias("y")
    )
    # The smallest outer ring around a hole owns it; candidates meet on a coarse grid.
    points = holes.withColumn("p", probe).select("g", "hole", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    xs, ys = F.transform("outer", lambda v: v["x"]), F.transform("outer", lambda v: v["y"])
    sized = outer.select(
        "g", "outer", "outer_area", F.array_min(xs).alias("wx"), F.array_min(ys).alias("sy"), F.array_max(xs).alias("ex"), F.array_max(ys).alias("ny")
    )
    around = grid_join(
        points, sized, Box.point("px", "py"), Box(F.col("wx"), F.col("sy"), F.col("ex"), F.col("ny")),
        cell_m=64 * fixed.METERS_PER_DEGREE, keys=["g"], left_points=True, spread="px",
    )
    home = (
        around.filter(geo.in_ring(F.col("px"), F.col("py"), F.col("outer")))
        .groupBy("g", "hole").agg(F.min_by("outer", "outer_area").alias("outer"))
        .groupBy("g", "outer").agg(F.sort_array(F.collect_list("hole")).alias("holes"))
    )
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return outer.join(home, ["g", "outer"], "left").select("g", "outer_area", F.concat(F.array("outer"), F.coalesce("holes", none)).alias("rings"))


def dissolve_cells(cells: DataFrame, group: str, col: str, row: str, half_col: str, half_row: str, task_cells: int = TASK_CELLS) -> DataFrame:
    """(group, outer_area, rings): polygons in cell units, outer ring first, holes after it.

    A group of more than ``task_cells`` rectangles is spread over the tasks.
    """
    rects = cut_lineage(lattice_rectangles(cells, group, col, row, half_col, half_row), "rectangles")
    large = cut_lineage(rects.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_cells).select("g"), "large-groups")
    kind = rects.schema["g"].dataType.simpleString()
    in_tasks = lambda rows: rows.repartition("g").sortWithinPartitions("g").mapInArrow(
        dissolved(SCALE), f"g {kind}, outer_area double, rings array<array<struct<x:double,y:double>>>"
    )
    if not large.limit(1).count():
        return in_tasks(rects).withColumnRenamed("g", group)
    out = in_tasks(rects.join(large, "g", "left_anti")).unionByName(_spread(salted_join(rects, large, ["g"], F.col("l"), "left_semi")))
    return out.withColumnRenamed("g", group)
