"""One complete snapshot against three tables: restriction zones, road incidents, road segments.

All three tables and the snapshot become rows of (kind, base hash, position) and meet in a
single full join; one rule set then says for every row whether it is inserted, reactivated,
expired or kept. A zone and an incident have position 0, the segments of a restriction are
numbered in the order of their external ids.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import units
from emberlake.operators.merge import RAW_STRATEGY

ROAD_CLASS = "nap_datex_affected_road"
COMMON = ["source_id", "external_id", "deduplication_hash", "observed_at", "expires_at", "metadata"]
ZONE = [*COMMON, "name", "restriction_type", "strategy", "paths"]
INCIDENT = [*COMMON, "road_segment_id", "kind", "explanation"]
SEGMENT = [*COMMON, "name", "road_ref", "road_class", "segment_index", "path"]


class ChangeSet(NamedTuple):
    """Next states with ``_action`` (inserted, reactivated, expired, kept) and the counts of the run."""

    zones: DataFrame
    incidents: DataFrame
    segments: DataFrame
    counts: DataFrame


def _base(kind: str, prefix: str) -> Column:
    text = F.col("deduplication_hash")
    if kind == "segment":
        return F.regexp_extract(text, f"^{prefix}segment:(.*):[0-9]+$", 1)
    return F.regexp_replace(text, f"^{prefix}{kind}:", "")


def _current(table: DataFrame, kind: str, prefix: str, columns: list[str]) -> DataFrame:
    rows = table.select(*columns).withColumn("_base", _base(kind, prefix)).withColumn("_part", F.lit(kind))
    if kind == "segment":
        # A window per restriction: as many rows as its geometry has parts.
        return rows.withColumn("_pos", F.row_number().over(Window.partitionBy("_base").orderBy("external_id")) - 1)
    return rows.withColumn("_pos", F.lit(0))


def _wanted(records: DataFrame, prefix: str) -> DataFrame:
    """Rows of all three kinds that the snapshot asks for."""
    digest = lambda kind: F.concat(F.lit(f"{prefix}{kind}:"), "base")
    own = records.withColumnRenamed("deduplication_hash", "base")
    title = F.col("title")
    shared = ["source_id", "observed_at", "expires_at", "base", "_known"]
    zone = own.select(
        *shared, F.lit("restriction").alias("_part"), F.lit(0).alias("_pos"), F.concat("external_id", F.lit(":restriction")).alias("external_id"), digest("restriction").alias("deduplication_hash"),
        "metadata", title.alias("name"), F.col("kind").alias("restriction_type"), "strategy", "paths",
    )
    incident = own.select(
        *shared, F.lit("incident").alias("_part"), F.lit(0).alias("_pos"), F.concat("external_id", F.lit(":incident")).alias("external_id"), digest("incident").alias("deduplication_hash"),
        "metadata", F.concat("external_id", F.lit(":segment:0")).alias("road_segment_id"), units.road_incident_kind(F.col("kind"), stem=prefix != "").alias("kind"), title.alias("explanation"), "strategy",
    )
    segment = own.select("*", F.posexplode("paths").alias("_pos", "path")).select(
        *shared, F.lit("segment").alias("_part"), "_pos", F.concat("external_id", F.lit(":segment:"), F.col("_pos").cast("string")).alias("external_id"),
        F.concat(digest("segment"), F.lit(":"), F.col("_pos").cast("string")).alias("deduplication_hash"),
        F.map_concat("metadata", F.create_map(F.lit("segment_index"), F.col("_pos").cast("string"))).alias("metadata"), title.alias("name"), "road_ref",
        F.lit(ROAD_CLASS).alias("road_class"), F.col("_pos").alias("segment_index"), "path", "strategy",
    )
    return zone.unionByName(incident, allowMissingColumns=True).unionByName(segment, allowMissingColumns=True).withColumnRenamed("base", "_base")


def sync_restrictions(
    records: DataFrame, zones: DataFrame, incidents: DataFrame, segments: DataFrame, source_id: object, as_of: Column, prefix: str = ""
) -> ChangeSet:
    """Bring three tables in line with the complete snapshot ``records`` of one source.

    ``records`` has source_id, external_id, deduplication_hash, kind, title, road_ref, paths,
    observed_at, expires_at, metadata (map) and strategy, one row per hash. A hash that has a
    zone already is reactivated in all tables: an enriched geometry and its metadata are only
    replaced by another enriched one, missing segments are added, surplus ones expire. Other
    hashes are inserted if they have a line. Rows of the source that the snapshot lacks expire,
    those of other sources stay. The tables carry the columns ``ZONE``, ``INCIDENT``, ``SEGMENT``.
    """
    stored = zones.select(_base("restriction", prefix).alias("deduplication_hash")).distinct().withColumn("_known", F.lit(True))
    marked = records.join(stored, "deduplication_hash", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    # A new restriction without a line is not stored.
    marked = marked.filter(F.col("_known") | (F.size("paths") > 0))
    wanted = _wanted(marked, prefix)
    current = (
        _current(zones, "restriction", prefix, ZONE).unionByName(_current(incidents, "incident", prefix, INCIDENT), allowMissingColumns=True)
        .unionByName(_current(segments, "segment", prefix, SEGMENT), allowMissingColumns=True)
    )
    keys = ["_part", "_base", "_pos"]
    columns = sorted((set(ZONE) | set(INCIDENT) | set(SEGMENT)))
    side = lambda df, name, more: df.select(*keys, F.struct(*columns, *more).alias(name))
    # A surplus segment belongs to a restriction that is reactivated, whoever owns it.
    again = marked.filter("_known").select(F.col("deduplication_hash").alias("_base"), F.lit(True).alias("_again"))
    both = side(current, "t", []).join(side(wanted, "s", ["_known"]), keys, "full").join(again, "_base", "left")
    t, s = F.col("t"), F.col("s")
    gone = (t["source_id"] == source_id) | ((F.col("_part") == "segment") & F.coalesce("_again", F.lit(False)))
    action = (
        F.when(t.isNull() & (~s["_known"] | (F.col("_part") == "segment")), "inserted").when(t.isNull(), "absent")
        .when(s.isNotNull(), "reactivated").when(F.coalesce(gone, F.lit(False)), "expired").otherwise("kept")
    )
    rows = both.withColumn("_action", action).filter("_action <> 'absent'")
    rich = s["strategy"] != RAW_STRATEGY
    replaced = {
        "expires_at": F.lit(None).cast("timestamp"),
        "name": s["name"], "restriction_type": s["restriction_type"], "explanation": s["explanation"], "road_ref": s["road_ref"], "road_class": s["road_class"],
        "strategy": F.when(rich, s["strategy"]).otherwise(t["strategy"]), "paths": F.when(rich, s["paths"]).otherwise(t["paths"]), "path": F.when(rich, s["path"]).otherwise(t["path"]),
        "metadata": F.when((F.col("_part") == "restriction") & ~rich, t["metadata"]).otherwise(s["metadata"]), "segment_index": s["segment_index"],
    }
    new, back = F.col("_action") == "inserted", F.col("_action") == "reactivated"
    out = [
        F.when(new, s[c]).when(back, replaced[c] if c in replaced else t[c])
        .when(F.col("_action") == "expired", as_of if c == "expires_at" else t[c]).otherwise(t[c]).alias(c)
        for c in columns
    ]
    changed = rows.select("_part", "_action", *out)
    part = lambda kind, names: changed.filter(F.col("_part") == kind).select(*names, "_action")
    count = lambda a: F.count_if(F.col("_action") == a).alias(a)
    counts = changed.groupBy(F.col("_part").alias("kind")).agg(*[count(a) for a in ("inserted", "reactivated", "expired", "kept")])
    return ChangeSet(part("restriction", ZONE), part("incident", INCIDENT), part("segment", SEGMENT), counts)
