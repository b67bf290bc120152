"""Live emergency aircraft: positions matched to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import dates
from emberlake.operators.dedupe import top_rows
from emberlake.operators.skew import broadcast_if_small


def match_aircraft(positions: DataFrame, registry: DataFrame) -> DataFrame:
    """Positions with their registered aircraft: by transponder address, else by registration or callsign."""
    fields = ["id", "icao24", "registration", "operator", "model"]
    pick = lambda key, name: registry.filter(F.col(key) != "").groupBy(F.col(key).alias(name)).agg(
        F.max_by(F.struct(*fields), "id").alias(f"_{name}")
    )
    by_address = broadcast_if_small(pick("icao_key", "icao_key"))
    by_name = broadcast_if_small(pick("registration_key", "call_key"))
    joined = positions.join(by_address, "icao_key", "left").join(by_name, "call_key", "left")
    return joined.withColumn("aircraft", F.coalesce("_icao_key", "_call_key")).filter("aircraft IS NOT NULL").withColumn("by_address", F.col("_icao_key").isNotNull()).drop("_icao_key", "_call_key")


def live_aircraft(positions: list[DataFrame], registry: DataFrame, as_of: str) -> DataFrame:
    """One row per aircraft, newest position first source first; of equal times the fastest, then by place."""
    rows = None
    for rank, df in enumerate(positions):
        tagged = df.withColumn("source_rank", F.lit(rank))
        rows = tagged if rows is None else rows.unionByName(tagged)
    matched = match_aircraft(rows, registry)
    key = F.concat(F.lit("aircraft-"), F.col("aircraft.id"), F.lit("-"), F.coalesce(F.nullif("icao24", F.lit("")), F.col("call_key")))
    one = top_rows(matched.withColumn("feature_id", key), ["feature_id"], [F.col("source_rank").asc(), F.col("observed_at").desc(), F.col("velocity_mps").desc(), F.col("longitude").asc(), F.col("latitude").asc()])
    known = F.col("by_address") & (F.col("source_rank") == 0)
    return one.withColumns(
        {
            "age_seconds": F.greatest(F.lit(0).cast("long"), dates.age_seconds(F.col("observed_at"), dates.ts(as_of))),
            "confidence": F.when(F.col("source_name") == "Airplanes.live", 0.78).when(known, 0.82).otherwise(0.64),
            "confidence_category": F.when((F.col("source_name") == "Airplanes.live") | known, "high").otherwise("medium"),
            "title": F.concat(F.coalesce("aircraft.registration", "callsign"), F.lit(" · "), F.coalesce("aircraft.operator", F.lit(""))),
        }
    )
