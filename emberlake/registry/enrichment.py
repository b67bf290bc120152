"""Registered road enrichment: roads with branches and gaps, stored routes, kilometre posts and local lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import base
from emberlake.functions import geo
from emberlake.operators import kilometers, road_cover
from emberlake.plans import enrichment

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


# Every part is a road of its own; its number modulo 6 says what is known about it:
# 0 a network with a branch, 1 a network with a gap, 2 stored routes, 3 kilometre posts, 4 local lines, 5 nothing.
def _part() -> Column:
    return F.col("p_partkey")


def _x0(p: Column) -> Column:
    return -9.0 + p % 100 * 0.12


def _y0(p: Column) -> Column:
    return 36.0 + F.floor(p / 100) * 0.3


def _path(p: Column, *points: tuple) -> Column:
    return F.array(*[geo.xy(F.round(_x0(p) + x, 6), F.round(_y0(p) + y, 6)) for x, y in points])


def _ref(p: Column) -> Column:
    return F.concat(F.lit("E-"), p.cast("string"))


def network(spark: SparkSession, sf: str) -> DataFrame:
    p = _part()
    lines = [
        (0, "a", (0, 0), (0.01, 0.002), (0.02, 0)), (0, "b", (0.02, 0), (0.03, -0.002), (0.04, 0)), (0, "branch", (0.02, 0), (0.02, 0.02), (0.02, 0.04)),
        (1, "a", (0, 0), (0.02, 0)), (1, "b", (0.03, 0), (0.035, 0.001), (0.04, 0)),
    ]
    rows = [F.when(p % 6 == c, F.struct(F.lit(n).alias("n"), _path(p, *points).alias("path"))) for c, n, *points in lines]
    out = base(spark, sf, "part").select("p_partkey", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("l"))
    return out.select(F.concat_ws(":", p.cast("string"), "l.n").alias("segment_id"), _ref(p).alias("name"), F.lit(None).cast("string").alias("code"), "l.path")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """A post every kilometre from 0 to 6; every fourth road lacks number 3."""
    p = _part()
    rows = base(spark, sf, "part").filter(p % 6 == 3).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).filter((F.col("k") != 3) | (p % 4 != 1))
    return rows.select(_ref(p).alias("name"), F.concat(F.col("k").cast("string"), F.lit(",0")).alias("number"),
                       geo.xy(F.round(_x0(p) + F.col("k") * 0.01, 6), F.round(_y0(p) + F.col("k") % 2 * 0.001, 6)).alias("point"))


def local_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines of different sources, of one source on every fifth road."""
    p = _part()
    two = F.array(
        F.struct(F.lit("n").alias("n"), (p % 10).alias("source_id"), _path(p, (0.04, 0), (0.02, 0.001), (0, 0)).alias("path")),
        F.struct(F.lit("p").alias("n"), F.when(p % 5 == 0, p % 10).otherwise((p + 3) % 10).alias("source_id"), _path(p, (0, 0.01), (0.04, 0.01)).alias("path")),
    )
    rows = base(spark, sf, "part").filter(p % 6 == 4).select("p_partkey", F.explode(two).alias("l"))
    return rows.select(F.concat_ws(":", p.cast("string"), "l.n").alias("segment_id"), _ref(p).alias("name"), F.lit(None).cast("string").alias("code"), "l.path", "l.source_id")


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """One restriction per order on one of 2000 roads; some expired, some with a route already."""
    o = F.col("o_orderkey")
    p = o % 2000
    done = o % 5 == 0
    source = F.when(done, F.floor(o / 5) % 10).otherwise(o % 10).cast("long")
    at = lambda x, y: geo.xy(F.round(_x0(p) + x, 6), F.round(_y0(p) + y, 6))
    straight = F.array(at(F.lit(0.0), o % 10 * 0.001), F.when((p % 6 == 0) & (o % 2 == 0), at(F.lit(0.02), F.lit(0.04))).otherwise(at(F.lit(0.04), F.lit(0.0))))
    route = F.array(at(F.lit(0.0), F.lit(0.0)), at(F.lit(0.02), 0.003 + o % 3 * 0.001), at(F.lit(0.04), F.lit(0.0)))
    return base(spark, sf, "orders").select(
        o.alias("id"), source.alias("source_id"), F.when(o % 13 != 0, _ref(p)).alias("road_ref"), F.when(done, "cnig_local_road_network").otherwise(enrichment.WAITING).alias("strategy"),
        F.when(o % 7 == 0, F.col("o_orderdate").cast("timestamp")).alias("expires_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (o % 4).cast("int").alias("attempts"),
        F.array().cast("array<string>").alias("kilometer_points"), F.when((p % 6).isin(2, 3), "PK 1 - 4").alias("kilometer_range"),
        F.when(done & (p % 6 == 2), route).otherwise(straight).alias("path"), F.lit("Incendi").alias("cause"), F.lit("").alias("record_type"), F.lit("").alias("kind"),
        F.concat(F.lit("restriction:"), o.cast("string")).alias("deduplication_hash"),
    )


_ZONES = """z AS (SELECT o_orderkey AS id, o_orderkey % 2000 AS p, o_orderkey % 2000 % 6 AS c, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey // 5 % 10 ELSE o_orderkey % 10 END AS src,
  o_orderkey % 5 = 0 AS done, o_orderkey % 13 <> 0 AS named, o_orderkey % 7 = 0 AS expired, o_orderdate AS stamp, o_orderkey % 2000 IN (SELECT p_partkey FROM part) AS known FROM orders)"""


@register("enriched_roads", f"""WITH {_ZONES},
queue AS (SELECT * FROM z WHERE NOT done AND NOT expired AND named),
old AS (SELECT p, src, arg_max(id % 3, (stamp, id % 3)) AS bow FROM z WHERE done AND c = 2 AND named GROUP BY 1, 2),
hit AS (SELECT q.id, CASE
    WHEN c IN (0, 1) AND known THEN 'cnig_local_road_network' WHEN bow IS NOT NULL AND c = 2 THEN 'previous_road_geometry_reuse' WHEN c = 3 AND known THEN 'dgt_pk_waypoint_routing'
    WHEN c = 4 AND known AND (q.src <> q.p % 10 OR (q.p % 5 <> 0 AND q.src <> (q.p + 3) % 10)) THEN 'road_ref_network_match' ELSE 'nap_datex_coordinates' END AS strategy, bow
  FROM queue q LEFT JOIN old ON old.p = q.p AND old.src = q.src)
SELECT z.id, coalesce(strategy, CASE WHEN done THEN 'cnig_local_road_network' ELSE 'nap_datex_coordinates' END) AS strategy,
  CAST(z.id % 4 + CASE WHEN strategy IS NULL THEN 0 ELSE 1 END AS INT) AS attempts,
  CASE WHEN strategy IS NULL THEN '' WHEN strategy = 'nap_datex_coordinates' THEN 'pending' ELSE 'completed' END AS status,
  CAST(CASE strategy WHEN 'cnig_local_road_network' THEN CASE WHEN c = 0 THEN 5 ELSE 2 END WHEN 'previous_road_geometry_reuse' THEN 3
    WHEN 'dgt_pk_waypoint_routing' THEN CASE WHEN p % 4 = 1 THEN 3 ELSE 4 END WHEN 'road_ref_network_match' THEN CASE WHEN src <> p % 10 THEN 3 ELSE 2 END
    ELSE CASE WHEN done AND c = 2 THEN 3 ELSE 2 END END AS INT) AS points,
  round(CASE strategy
    WHEN 'cnig_local_road_network' THEN CASE WHEN c = 1 THEN 0.02 WHEN z.id % 2 = 0 THEN 2 * sqrt(0.0001 + 0.000004) + 0.04 ELSE 4 * sqrt(0.0001 + 0.000004) END
    WHEN 'previous_road_geometry_reuse' THEN 2 * sqrt(0.0004 + pow(0.003 + bow * 0.001, 2))
    WHEN 'dgt_pk_waypoint_routing' THEN CASE WHEN p % 4 = 1 THEN sqrt(0.0001 + 0.000001) + 0.02 ELSE 3 * sqrt(0.0001 + 0.000001) END
    WHEN 'road_ref_network_match' THEN CASE WHEN src <> p % 10 THEN 2 * sqrt(0.0004 + 0.000001) ELSE 0.04 END
    ELSE CASE WHEN done AND c = 2 THEN 2 * sqrt(0.0004 + pow(0.003 + z.id % 3 * 0.001, 2))
      WHEN c = 0 AND z.id % 2 = 0 THEN sqrt(0.0004 + pow(0.04 - z.id % 10 * 0.001, 2)) ELSE sqrt(0.0016 + pow(z.id % 10 * 0.001, 2)) END END, 4) AS degrees
FROM z LEFT JOIN hit ON hit.id = z.id""")
def enriched_roads(spark: SparkSession, sf: str) -> DataFrame:
    """Every restriction after one enrichment run over the whole queue."""
    out = enrichment.enrich_zones(zones(spark, sf), network(spark, sf), posts(spark, sf), local_lines(spark, sf), F.lit("2024-02-01").cast("timestamp"))
    return out.zones.select(
        "id", "strategy", "attempts", F.coalesce("enrichment_status", F.lit("")).alias("status"), F.size("path").alias("points"), F.round(geo.path_length_deg(F.col("path")), 4).alias("degrees")
    )


@register("lines_of_other_sources", f"""WITH {_ZONES},
lines AS (SELECT p_partkey AS p, 'n' AS n, p_partkey % 10 AS src FROM part WHERE p_partkey % 6 = 4
  UNION ALL SELECT p_partkey, 'p', CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 10 ELSE (p_partkey + 3) % 10 END FROM part WHERE p_partkey % 6 = 4)
SELECT id, z.p || ':' || n AS segment_id FROM z JOIN lines ON lines.p = z.p WHERE named AND lines.src <> z.src""")
def lines_of_other_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Local lines in reach of every restriction, those of its own source left out."""
    from emberlake.operators.roads import road_keys

    asked = enrichment.requests(zones(spark, sf).filter(F.col("road_ref").isNotNull()))
    return road_cover.lines_in_reach(asked, road_keys(local_lines(spark, sf))).select(F.col("query_id").alias("id"), "segment_id")


@register("kilometre_candidates", f"""WITH {_ZONES},
s AS (SELECT id, p, unnest([1, 2, 3, 4]) AS km FROM z WHERE c = 3 AND known AND named)
SELECT id, CAST(km - 1 AS INT) AS sample, 4 AS samples, round(-9e0 + p % 100 * 0.12e0 + km * 0.01e0, 6) AS x, round(36e0 + p // 100 * 0.3e0 + km % 2 * 0.001e0, 6) AS y FROM s WHERE km <> 3 OR p % 4 <> 1""")
def kilometre_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Posts at the kilometre samples of every restriction with a kilometre range."""
    asked = enrichment.requests(zones(spark, sf).filter(F.col("road_ref").isNotNull()))
    found = kilometers.sample_candidates(asked, posts(spark, sf))
    return found.select(F.col("query_id").alias("id"), "sample", "samples", F.round("point.x", 6).alias("x"), F.round("point.y", 6).alias("y"))
