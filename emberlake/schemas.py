"""Table schemas: shared lineage columns plus the columns of each table, as DDL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.geo import GEOMETRY

AUDIT = "id string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
LINEAGE = (
    "source_id string, external_id string, provenance string, observed_at timestamp, published_at timestamp, received_at timestamp, expires_at timestamp, "
    "verification_status string, confidence double, version int, metadata map<string,string>, deduplication_hash string"
)
SPATIAL = "original_crs string, xmin double, ymin double, xmax double, ymax double"

PLACES = "array<struct<name:string,kind:string,matched:boolean,ine_code:string,national_code:string>>"

LINEAGE_TABLES = {
    "incidents": "title string, status string, summary string",
    "fire_detections": "latitude double, longitude double, sensor string, satellite string, frp_mw double, incident_id string",
    "fire_perimeters": "incident_id string, area_hectares double, perimeter_kind string",
    "official_notices": "incident_id string, title string, body string, url string, severity string",
    "evacuation_zones": "incident_id string, name string, zone_kind string, instruction string",
    "restriction_zones": "incident_id string, name string, zone_kind string, restriction_type string",
    "road_segments": "name string, road_ref string, road_class string, surface string, width_meters double, access string, max_weight_tons double, incline string",
    "road_incidents": "road_segment_id string, incident_id string, kind string, explanation string",
    "weather_observations": "station_id string, wind_speed_kph double, wind_direction_degrees double, wind_gust_kph double, temperature_celsius double, humidity_percent double, precipitation_mm double",
    "weather_forecasts": "municipality_id string, forecast_for timestamp, horizon_hours int, wind_speed_kph double, wind_direction_degrees double, wind_gust_kph double, temperature_celsius double, humidity_percent double, precipitation_mm double",
    "smoke_forecasts": "incident_id string, model_execution_id string, horizon_hours int, intensity string, uncertainty double, visibility_impact string",
    "risk_forecasts": "incident_id string, model_execution_id string, risk_type string, risk_score double, category string",
}
SPATIAL_TABLES = set(LINEAGE_TABLES) - {"official_notices", "road_incidents"}

PLAIN_TABLES = {
    "data_sources": f"{AUDIT}, name string, source_type string, authority string, base_url string, attribution string, update_frequency string, reliability_score double, expected_delay_seconds int",
    "data_ingestion_runs": f"{AUDIT}, source_id string, connector_name string, status string, started_at timestamp, finished_at timestamp, received bigint, discarded bigint, duplicates bigint, persisted bigint",
    "incident_versions": f"{AUDIT}, incident_id string, version int, status string, title string, snapshot string, change_reason string",
    "emergency_publications": (
        f"{AUDIT}, source_id string, incident_id string, external_id string, deduplication_hash string, url string, source_type string, authority string, language string, title string, "
        "original_text string, event_type string, risk_type string, action_state string, es_alert_status string, published_at timestamp, starts_at timestamp, ends_at timestamp, instructions string, "
        f"es_alert_message string, locations {PLACES}, geometry_inference_method string, spatial_precision string, evidence_rank int, confidence double, review_status string, review_notes string, "
        "reviewed_by string, reviewed_at timestamp"
    ),
    "model_executions": f"{AUDIT}, model_name string, model_version string, input_hash string, started_at timestamp, finished_at timestamp, status string",
    "confidence_assessments": "resource_type string, resource_id string, algorithm_version string, calculated_at timestamp, confidence double, category string, factors map<string,double>, penalties map<string,double>, warnings array<string>",
    "data_conflicts": "conflict_type string, resource_type string, resource_id string, conflicting_resource_type string, conflicting_resource_id string, severity string, detected_at timestamp, explanation string",
    "observation_links": "resource_type string, resource_id string, related_resource_type string, related_resource_id string, relation_kind string, confidence double, explanation string, distance_meters double, minutes_apart double",
}

TABLES = [*LINEAGE_TABLES, *PLAIN_TABLES]


def schema(table: str) -> T.StructType:
    """Full schema of a table; spatial tables carry a geometry and its bounding box."""
    if table in PLAIN_TABLES:
        out = T.StructType.fromDDL(PLAIN_TABLES[table])
        return out.add("geometry", GEOMETRY) if table == "emergency_publications" else out
    out = T.StructType.fromDDL(f"{AUDIT}, {LINEAGE}, {LINEAGE_TABLES[table]}")
    if table not in SPATIAL_TABLES:
        return out
    for field in T.StructType.fromDDL(SPATIAL):
        out = out.add(field)
    return out.add("geometry", GEOMETRY)


def record_id(source: Column, external_id: Column) -> Column:
    """Identifier that a repeated run computes again."""
    return F.sha2(F.concat_ws("|", source, external_id), 256)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows in the shape of a table: missing columns are null, others are cast, extra ones dropped."""
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema(table)
        ]
    )
