"""Satellite detections from CSV feeds with differing headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import dates, fixed, units
from emberlake.sources.raw import require_columns


def read_csv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of one CSV path per source, ``firms_source`` first, all columns as text."""
    out = None
    for source, path in paths.items():
        df = spark.read.csv(path, header=True, inferSchema=False).withColumn("firms_source", F.lit(source))
        df = df.select("firms_source", *[c for c in df.columns if c != "firms_source"])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return require_columns(out, fixed.DETECTION_REQUIRED)


def normalize(rows: DataFrame, bbox=fixed.SPAIN_BBOX, keep: list[str] = (), raw: list[str] | None = None) -> DataFrame:
    """Typed detections inside the region; rows without coordinates are dropped.

    Columns of ``keep`` are passed on; ``raw`` names those that make up the metadata (all by default).
    """
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    digest = F.sha2(F.concat_ws("|", *[have(c) for c in ("firms_source", "satellite", "instrument", "latitude", "longitude", "acq_date", "acq_time")]), 256)
    optional = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    typed = rows.select(
        *keep,
        F.col("firms_source").alias("source"), F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        dates.acquisition(F.col("acq_date"), F.col("acq_time")).alias("observed_at"), "satellite", F.coalesce(optional("instrument"), F.col("firms_source")).alias("sensor"),
        units.detection_confidence(F.col("confidence")).alias("confidence"), F.col("frp").try_cast("double").alias("frp_mw"),
        optional("scan").alias("scan_km"), optional("track").alias("track_km"),
        F.to_json(F.struct(*(raw or rows.columns))).alias("metadata_json"), digest.alias("deduplication_hash"),
    )
    return typed.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & units.in_bbox(F.col("longitude"), F.col("latitude"), bbox))
