"""Functions for SQL users: the Column functions whose definition is one SQL expression.

``register`` makes them temporary functions of a session. Their bodies stay inside the
optimizer like the Column functions; tests hold each against its Column twin.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from emberlake.functions import fixed
from emberlake.functions.text import SPACES

#: name: (parameters, result, body)
FUNCTIONS = {
    "haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                    f"2 * {fixed.EARTH_RADIUS_M!r}D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"),
    "equirect_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                   f"hypot((lon2 - lon1) * {fixed.METERS_PER_DEGREE!r}D * cos(radians((lat1 + lat2) / 2)), (lat2 - lat1) * {fixed.METERS_PER_DEGREE!r}D)"),
    "detection_confidence": ("code STRING", "DOUBLE",
                             "CASE lower(code) WHEN 'l' THEN 0.4D WHEN 'n' THEN 0.6D WHEN 'h' THEN 0.85D ELSE CASE WHEN try_cast(code AS DOUBLE) IS NOT NULL THEN greatest(0D, least(try_cast(code AS DOUBLE) / 100, 1D)) END END"),
    "positive_number": ("value STRING", "DOUBLE", "CASE WHEN try_cast(value AS DOUBLE) > 0 THEN try_cast(value AS DOUBLE) END"),
    "comma_number": ("value STRING", "DOUBLE", "try_cast(replace(nullif(trim(value), ''), ',', '.') AS DOUBLE)"),
    "squeezed": ("value STRING", "STRING", "trim(regexp_replace(value, '" + SPACES.replace("\\", "\\\\") + "', ' '))"),
    "road_ref": ("value STRING", "STRING", "regexp_replace(upper(coalesce(value, '')), '[^A-Z0-9]', '')"),
    "icao24": ("value STRING", "STRING",
               r"CASE WHEN lower(regexp_replace(upper(coalesce(value, '')), '[^\\p{L}\\p{N}]', '')) RLIKE '^[0-9a-f]{6}$' THEN lower(regexp_replace(upper(coalesce(value, '')), '[^\\p{L}\\p{N}]', '')) ELSE '' END"),
    "madrid_day": ("moment TIMESTAMP", "DATE", "to_date(from_utc_timestamp(moment, 'Europe/Madrid'))"),
    "publication_hash": ("url STRING, normalized STRING", "STRING", "sha2(concat(rtrim('/', substring_index(url, '#', 1)), '|', normalized), 256)"),
    "road_incident_kind": ("kind STRING", "STRING",
                           "CASE WHEN contains(lower(kind), 'cortadas') OR contains(lower(kind), 'restringida') THEN 'official_closure' WHEN contains(lower(kind), 'lento') THEN 'reduced_visibility' ELSE 'insufficient_data' END"),
    "evidence_rank": ("source_type STRING", "INT", "CASE source_type WHEN 'official' THEN 1 WHEN 'reliable_media' THEN 2 WHEN 'multiple_witnesses' THEN 3 ELSE 4 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create or replace all functions in the session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
