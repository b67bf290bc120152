"""Domain tables derived from the driver's parquet tables.

Each adapter is one SELECT that Spark and DuckDB both understand, so a query and
its SQL check start from identical rows. Identifiers drive everything; time grows
with the identifiers (every block of ids is a later month), so more data means a
longer archive rather than a denser one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import geo
from emberlake.operators.stage import spread

AS_OF = "2024-01-31 00:00:00"
BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC
DAY_US = 86_400_000_000

SPARK = {"UM": "unix_micros", "MT": "timestamp_micros"}
DUCK = {"UM": "epoch_us", "MT": "make_timestamp"}

SOURCES = """
SELECT s_suppkey AS source_id, s_name AS name, n_name AS authority,
       'https://example.org/source/' || CAST(s_suppkey AS STRING) AS base_url,
       n_name || ' open data' AS attribution,
       (s_suppkey % 10) / 10e0 AS reliability_score
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

DETECTIONS = """
SELECT event_id, 'det-' || lpad(CAST(event_id AS STRING), 12, '0') AS id,
       event_id % 10 AS source_id, user_id, us AS observed_us, {MT}(us) AS observed_at,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE us + (event_id % 50) * 1800000000 END AS published_us,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE us + (event_id % 90) * 1200000000 END AS received_us,
       35.5e0 + ((user_id * 37) % 90) / 10e0 + (event_id % 7) / 250e0 AS latitude,
       -10e0 + ((user_id * 53) % 145) / 10e0 + (event_id % 11) / 250e0 AS longitude,
       CASE WHEN event_id % 3 = 0 THEN 'MODIS' ELSE 'VIIRS' END AS sensor,
       CASE WHEN event_id % 3 = 0 THEN 'Terra' ELSE 'N20' END AS satellite,
       CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 101 AS STRING) WHEN event_id % 3 = 0 THEN 'l'
            WHEN event_id % 3 = 1 THEN 'n' ELSE 'h' END AS confidence_code,
       value AS frp_mw,
       CASE WHEN event_id % 4 = 0 THEN (event_id % 7) / 10e0 END AS scan_km,
       CASE WHEN event_id % 4 = 0 THEN (event_id % 5) / 10e0 END AS track_km,
       CASE event_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'observed' WHEN 2 THEN 'estimated' ELSE 'unverified' END AS provenance,
       CASE WHEN event_id % 10 = 0 THEN 'inc-' || CAST(event_id % 1500 AS STRING) END AS incident_id,
       props AS metadata_json
FROM (SELECT *, {UM}(CAST(ts AS TIMESTAMP)) + CAST(floor(event_id / 10000e0) AS BIGINT) * 30 * 86400000000 AS us FROM {events}) e
"""

PERIMETERS = """
SELECT k AS orderkey, 'per-' || lpad(CAST(k AS STRING), 12, '0') AS id, 'effis:' || CAST(k AS STRING) AS external_id,
       k % 10 AS source_id, lon - h AS xmin, lat - h AS ymin, lon + h AS xmax, lat + h AS ymax,
       (k % 10 + 2) * (k % 10 + 2) * 5e0 AS area_hectares,
       'Commune ' || CAST(c % 40 AS STRING) AS commune, 'Província ' || CAST(c % 8 AS STRING) AS province,
       CASE WHEN c % 5 = 0 THEN '#IFCommune' || CAST(c % 40 AS STRING) END AS hashtag,
       us AS observed_us, {MT}(us) AS observed_at, us + (k % 5) * 86400000000 AS updated_us,
       CASE k % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'observed' WHEN 2 THEN 'estimated' ELSE 'unverified' END AS provenance,
       (k % 100) / 100e0 AS confidence
FROM (SELECT o_orderkey AS k, o_custkey AS c,
             35.5e0 + ((o_custkey * 37) % 90) / 10e0 + (o_orderkey % 7) / 250e0 AS lat,
             -10e0 + ((o_custkey * 53) % 145) / 10e0 + (o_orderkey % 11) / 250e0 AS lon,
             0.002e0 + (o_orderkey % 10) / 1000e0 AS h,
             1704067200000000 + (o_orderkey % 30) * 86400000000
               + CAST(floor(o_orderkey / 15000e0) AS BIGINT) * 30 * 86400000000 AS us
      FROM {orders}) o
"""

INCIDENTS = """
SELECT o_orderkey AS orderkey, 'inc-' || CAST(o_orderkey AS STRING) AS id, o_orderkey % 10 AS source_id,
       'Incendi - Commune ' || CAST(o_custkey % 40 AS STRING) AS title,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'controlled' ELSE 'reported' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Resum ' || o_orderpriority END AS summary,
       us AS observed_us, {MT}(us) AS observed_at, us + (o_orderkey % 7) * 3600000000 AS updated_us,
       CASE WHEN o_orderkey % 9 = 0 THEN us + 86400000000 END AS expires_us,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 100) / 100e0 END AS confidence,
       CASE o_orderkey % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'observed' WHEN 2 THEN 'estimated' ELSE 'unverified' END AS provenance,
       35.5e0 + ((o_custkey * 37) % 90) / 10e0 AS latitude, -10e0 + ((o_custkey * 53) % 145) / 10e0 AS longitude,
       o_orderkey % 2 = 0 AS osint, o_orderkey % 6 = 0 AS canonical_fire,
       o_orderkey % 17 = 0 AS hidden, CASE WHEN o_orderkey % 19 = 0 THEN 'inc-' || CAST(o_orderkey - 1 AS STRING) END AS merged_into,
       'Commune ' || CAST(o_custkey % 40 AS STRING) AS commune, 'Província ' || CAST(o_custkey % 8 AS STRING) AS province,
       o_totalprice / 1000e0 AS area_hectares,
       CASE WHEN o_orderkey % 2 = 0 THEN us END AS restriction_started_us,
       CASE WHEN o_orderkey % 4 = 0 THEN us + (o_orderkey % 50) * 3600000000 END AS ended_us,
       CAST(1 + o_orderkey % 3 AS INT) AS version
FROM (SELECT *, 1704067200000000 + (o_orderkey % 30) * 86400000000
               + CAST(floor(o_orderkey / 15000e0) AS BIGINT) * 30 * 86400000000 AS us FROM {orders}) o
"""

ROAD_INCIDENTS = """
SELECT 'ri-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING)
         || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS id,
       l_partkey AS road_segment_id, l_suppkey % 10 AS source_id,
       CASE l_returnflag WHEN 'R' THEN 'official_closure' WHEN 'N' THEN 'insufficient_data' ELSE 'reduced_visibility' END AS kind,
       {UM}(CAST(l_shipdate AS TIMESTAMP)) AS observed_us, l_quantity AS severity
FROM {lineitem}
"""

ROAD_SEGMENTS = """
SELECT p_partkey AS id, 'N-' || CAST(p_partkey % 500 AS STRING) AS road_ref, p_name AS name,
       'road ' || p_type AS road_class, p_brand AS surface, p_partkey % 10 AS source_id,
       -6e0 + (p_partkey % 500) / 100e0 + CAST(floor(p_partkey / 500e0) AS BIGINT) / 100e0 AS lon0,
       40e0 + (p_partkey % 500) / 200e0 AS lat0
FROM {part}
"""

PUBLICATIONS = """
SELECT doc_id, 'pub-' || CAST(doc_id AS STRING) AS id, doc_id % 10 AS source_id, place, title,
       title || '. ' || text AS original_text, text AS body,
       'https://example.org/p/' || CAST(doc_id AS STRING) || '/#top' AS url,
       CASE doc_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'reliable_media' WHEN 2 THEN 'individual' ELSE 'multiple_witnesses' END AS source_type,
       'authority ' || CAST(doc_id % 17 AS STRING) AS authority,
       us AS published_us, {MT}(us) AS published_at, 'inc-' || CAST(doc_id % 700 AS STRING) AS incident_id,
       CASE WHEN doc_id % 23 = 0 THEN 'rejected' WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'accepted' END AS review_status
FROM (SELECT *, CASE doc_id % 8
          WHEN 0 THEN 'Incendi forestal al municipi de ' || place || ' #IF' || replace(place, ' ', '')
          WHEN 1 THEN 'Ordre de confinament a la zona de ' || place || '. Confineu-vos a casa'
          WHEN 2 THEN 'Levantado el confinamiento en ' || place
          WHEN 3 THEN 'Activa el pla INFOCAT a ' || place
          WHEN 4 THEN 'Se ha enviado ES-Alert. ES-Alert: "Incendio cerca de ' || place || ', permanezca en su casa"'
          WHEN 5 THEN 'Incendio controlado en ' || place
          WHEN 6 THEN 'Nota informativa ' || place
          ELSE 'Alerta por riesgo de inundación y riada en ' || place END AS title
      FROM (SELECT *, 'Commune ' || CAST(doc_id % 40 AS STRING) AS place,
                   1704067200000000 + (doc_id * 37 % 43200) * 60000000
                     + CAST(floor(doc_id / 1000e0) AS BIGINT) * 30 * 86400000000 AS us FROM {documents}) d) p
"""

ASSESSMENTS = """
SELECT 'incident' AS resource_type, 'inc-' || CAST(l_orderkey AS STRING) AS resource_id,
       {UM}(CAST(l_shipdate AS TIMESTAMP)) + l_linenumber AS calculated_us, l_partkey, l_suppkey, l_linenumber,
       round(l_discount * 10e0, 4) AS confidence,
       CASE WHEN l_discount >= 0.08e0 THEN 'high' WHEN l_discount >= 0.05e0 THEN 'medium' ELSE 'low' END AS category,
       CASE WHEN l_returnflag = 'R' THEN 'data is stale' END AS warning
FROM {lineitem}
"""

ALL = {
    "sources": SOURCES, "detections": DETECTIONS, "perimeters": PERIMETERS, "incidents": INCIDENTS,
    "road_incidents": ROAD_INCIDENTS, "road_segments": ROAD_SEGMENTS, "publications": PUBLICATIONS,
    "assessments": ASSESSMENTS,
}
BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(name: str) -> str:
    """Adapter SQL for the check engine."""
    return ALL[name].format(**DUCK, **{t: t for t in BASE_TABLES}).strip()


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({duck(n)})" for n in names)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Adapter as a DataFrame over the parquet files of ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE_TABLES}
    df = spark.sql(ALL[name].format(**SPARK, **tables))
    # Text work per row is heavy; a single-split file would keep it on one core.
    return spread(df) if name == "publications" else df


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def perimeter_geometry(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("geometry", geo.box(c("xmin"), c("ymin"), c("xmax"), c("ymax")))
