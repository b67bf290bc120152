"""Road enrichment of restrictions: queue, matching by all strategies, recorded attempts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import units
from emberlake.operators import roads
from emberlake.operators.kilometers import sample_candidates
from emberlake.session import cut_lineage

WAITING = "nap_datex_coordinates"


class Enrichment(NamedTuple):
    """zones: all zones after the run; segments: new paths of road segments by hash; counts: selected, enriched, pending."""

    zones: DataFrame
    segments: DataFrame
    counts: DataFrame


def requests(queue: DataFrame) -> DataFrame:
    """Road requests of zones with a line of two points or more and a road."""
    bounds = units.kilometer_bounds(F.col("kilometer_points"), F.col("kilometer_range"))
    return queue.filter(F.size("path") >= 2).withColumn("_km", bounds).select(
        F.col("id").alias("query_id"), F.upper("road_ref").alias("road_key"), "source_id", F.col("path")[0].alias("start"), F.element_at("path", -1).alias("end"),
        "kilometer_range", F.col("_km.first").alias("first_km"), F.col("_km.last").alias("last_km"), "cause", "record_type", "kind",
    )


def enrich_zones(
    zones: DataFrame, network: DataFrame, posts: DataFrame, local_lines: DataFrame, as_of: Column, road_ref: str | None = None, limit: int | None = None, step_km: float = 1.0
) -> Enrichment:
    """Give waiting restrictions a road-following geometry.

    ``zones`` has id, source_id, road_ref, strategy, expires_at, updated_at, attempts,
    kilometer_points, kilometer_range, path, cause, record_type, kind, deduplication_hash.
    The queue is matched by network route or section, stored route, kilometre samples and
    local lines of other sources, in this order. Every queued zone gets one more attempt; a
    zone without a usable line stays pending. ``limit`` bounds a run; None takes the queue.
    """
    queue = cut_lineage(roads.enrichment_queue(zones, network, road_ref, limit).drop("road_key", "known_road"), "road-queue")
    asked = cut_lineage(requests(queue), "road-requests")
    distance = F.abs(F.col("last_km") - F.col("first_km"))
    worthy = units.sample_worthy(distance, F.col("cause"), F.col("record_type"), F.col("kind"))
    samples = cut_lineage(sample_candidates(asked, posts, worthy, step_km), "road-samples")
    stored = zones.withColumn("road_ref", F.upper("road_ref"))
    matches = roads.match_roads(asked, network, posts, stored, samples, local_lines)
    # A queued zone without a request was tried in vain.
    tried = queue.select(F.col("id").alias("query_id")).join(matches, "query_id", "left").withColumn("strategy", F.coalesce("strategy", F.lit(WAITING)))
    tried = cut_lineage(tried, "road-matches")
    done = F.col("strategy") != WAITING
    base = F.regexp_replace("deduplication_hash", "^restriction:", "")
    segments = tried.filter(done).join(queue.select(F.col("id").alias("query_id"), base.alias("base")), "query_id").filter("base <> ''").select(
        F.concat(F.lit("segment:"), "base", F.lit(":0")).alias("deduplication_hash"), F.col("paths")[0].alias("path"), "strategy"
    )
    counts = tried.agg(F.count(F.lit(1)).alias("selected"), F.count_if(done).alias("enriched"), F.count_if(~done).alias("pending"))
    return Enrichment(roads.record_attempts(zones, tried, as_of), segments, counts)
