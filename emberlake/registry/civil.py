"""Registered civil and serving queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import AS_OF, ctes, load, perimeter_geometry
from emberlake.functions import scoring, units
from emberlake.operators import dedupe, expectations
from emberlake.plans import civil
from emberlake.plans.selection import Box, Circle, Page, Selection, Span

QUERIES, ORACLE = {}, {}
NOW = f"TIMESTAMP '{AS_OF}'"
NOW_US = f"epoch_us({NOW})"
CODE = """CASE lower(confidence_code) WHEN 'l' THEN 0.4e0 WHEN 'n' THEN 0.6e0 WHEN 'h' THEN 0.85e0
          ELSE greatest(0e0, least(CAST(confidence_code AS DOUBLE) / 100e0, 1e0)) END"""
BBOX = (-5.0, 38.0, 1.0, 42.0)


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def stamp(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "detections").withColumn("confidence", units.detection_confidence(F.col("confidence_code")))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "incidents")
    return df.withColumns(
        {
            "updated_at": F.timestamp_micros("updated_us"), "expires_at": F.timestamp_micros("expires_us"),
            "restriction_started_at": F.timestamp_micros("restriction_started_us"), "ended_at": F.timestamp_micros("ended_us"),
            "metadata_json": F.to_json(F.struct("commune", "province")),
        }
    )


def perimeters(spark: SparkSession, sf: str) -> DataFrame:
    return perimeter_geometry(load(spark, sf, "perimeters")).withColumn("updated_at", F.timestamp_micros("updated_us"))


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    """Assessments of incidents and, under the event numbers, of detections."""
    rows = load(spark, sf, "assessments")
    of_detections = rows.withColumns({"resource_type": F.lit("fire_detection"), "resource_id": F.concat(F.lit("det-"), F.lpad(F.replace("resource_id", F.lit("inc-"), F.lit("")), 12, "0"))})
    return rows.unionByName(of_detections).withColumns(
        {
            "calculated_at": F.timestamp_micros("calculated_us"),
            "warnings": F.when(F.col("warning").isNotNull(), F.array("warning")).otherwise(F.array().cast("array<string>")),
        }
    )


@register("detections_unique", ctes("detections") + f"""
SELECT sha256(concat_ws('|', sensor, satellite, CAST(user_id AS STRING), CAST(floor(observed_us / 86400e6) AS BIGINT))) AS digest,
       min(id) AS first_id, count(*) AS copies,
       round(arg_min({CODE}, id), 4) AS confidence
FROM detections GROUP BY 1""")
def detections_unique(spark: SparkSession, sf: str) -> DataFrame:
    day = F.floor(F.col("observed_us") / 86400e6).cast("string")
    df = detections(spark, sf).withColumn("digest", F.sha2(F.concat_ws("|", "sensor", "satellite", F.col("user_id").cast("string"), day), 256))
    return df.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.round(F.min_by("confidence", "id"), 4).alias("confidence"))


@register("detection_duplicates", ctes("detections") + """
SELECT CAST(count(*) AS BIGINT) AS received, CAST(count(DISTINCT sensor || '|' || CAST(user_id AS STRING)) AS BIGINT) AS unique_rows,
       CAST(count(*) - count(DISTINCT sensor || '|' || CAST(user_id AS STRING)) AS BIGINT) AS duplicates FROM detections""")
def detection_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.duplicate_counts(load(spark, sf, "detections"), ["sensor", "user_id"])


@register("detections_in_bbox", ctes("detections", "sources", "assessments") + f""", d AS (
  SELECT *, {CODE} AS confidence FROM detections
  WHERE longitude BETWEEN {BBOX[0]} AND {BBOX[2]} AND latitude BETWEEN {BBOX[1]} AND {BBOX[3]})
SELECT d.id, s.name AS source_name, s.authority AS source_authority, d.provenance, round(coalesce(a.assessed, d.confidence), 4) AS confidence, a.category AS confidence_category,
       greatest(0, CAST(trunc(({NOW_US} - observed_us) / 1e6) AS BIGINT)) AS age_seconds,
       NOT (provenance = 'estimated' AND observed_us < {NOW_US} - 12 * 3600000000) AS is_current,
       concat_ws(',', a.warning, CASE WHEN provenance = 'estimated' AND observed_us < {NOW_US} - 12 * 3600000000 THEN 'old_estimate_not_current' END) AS warnings,
       CASE WHEN scan_km > 0 THEN scan_km END AS scan_km, CASE WHEN track_km > 0 THEN track_km END AS track_km
FROM d LEFT JOIN sources s ON d.source_id = s.source_id LEFT JOIN (
  SELECT 'det-' || lpad(replace(resource_id, 'inc-', ''), 12, '0') AS id, confidence AS assessed, category, warning,
    row_number() OVER (PARTITION BY resource_id ORDER BY calculated_us DESC, confidence DESC, category DESC, coalesce(warning, '') DESC) AS nth FROM assessments) a
  ON a.id = d.id AND a.nth = 1
WHERE d.confidence >= 0.5""")
def detections_in_bbox(spark: SparkSession, sf: str) -> DataFrame:
    """Detections in an envelope with lineage: the flagship query."""
    wanted = Selection(region=Box(*BBOX), confidence_from=0.5, span=Span(outdated=True))
    found = civil.served(detections(spark, sf), wanted, "fire_detection", load(spark, sf, "sources"), assessments(spark, sf), AS_OF)
    out = civil.detection_properties(found)
    return out.select(
        "id", F.col("source.name").alias("source_name"), F.col("source.authority").alias("source_authority"), "provenance",
        F.round("confidence", 4).alias("confidence"), "confidence_category", "age_seconds", "is_current",
        F.array_join("warnings", ",").alias("warnings"), "scan_km", "track_km",
    )


@register("detection_page", ctes("detections") + f"""
SELECT id, {CODE} AS confidence, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at FROM detections
WHERE (provenance <> 'estimated' OR observed_us >= {NOW_US} - 12 * 3600000000)
ORDER BY {CODE} DESC NULLS LAST, id DESC LIMIT 100 OFFSET 50""")
def detection_page(spark: SparkSession, sf: str) -> DataFrame:
    df = Selection().keep(detections(spark, sf), "fire_detection", load(spark, sf, "sources"), AS_OF)
    return Page(order="confidence", rows=100, skip=50).cut(df).select("id", "confidence", stamp("observed_at"))


@register("detection_timeline", ctes("detections") + f"""
SELECT strftime(date_trunc('minute', observed_at), '%Y-%m-%d %H:%M:%S') AS observed_at, count(*) AS "count"
FROM detections WHERE {CODE} >= 0.5 GROUP BY 1""")
def detection_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return civil.detection_timeline(detections(spark, sf), min_confidence=0.5).select(stamp("observed_at"), "count")


# Summer time: from the last Sunday of March to the last Sunday of October, 01:00 UTC.
_SUMMER = """(SELECT *, make_timestamp(year(m), 3, 31, 1, 0, 0.0) - to_days(CAST(isodow(make_date(year(m), 3, 31)) % 7 AS INT)) AS s0,
                     make_timestamp(year(m), 10, 31, 1, 0, 0.0) - to_days(CAST(isodow(make_date(year(m), 10, 31)) % 7 AS INT)) AS s1 FROM t)"""


@register("detection_local_days", ctes("detections") + f""", t AS (
  SELECT date_trunc('minute', observed_at) AS m, count(*) AS n FROM detections GROUP BY 1)
SELECT strftime(m + CASE WHEN m >= s0 AND m < s1 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d') AS "day",
       count(*) AS moments, CAST(sum(n) AS BIGINT) AS detections,
       strftime(min(m), '%Y-%m-%d %H:%M:%S') AS observed_from, strftime(max(m) + INTERVAL 59 SECOND, '%Y-%m-%d %H:%M:%S') AS observed_to
FROM {_SUMMER} GROUP BY 1""")
def detection_local_days(spark: SparkSession, sf: str) -> DataFrame:
    days = civil.local_days(civil.detection_timeline(detections(spark, sf)))
    return days.select(F.col("day").cast("string").alias("day"), "moments", "detections", stamp("observed_from"), stamp("observed_to"))


@register("detections_visible_week", ctes("detections") + f"""
SELECT id, CAST(least(7, greatest(0, CAST({NOW} AS DATE) - CAST(observed_at AS DATE))) AS INT) AS age_days,
       round(greatest(0.08e0, 1 - least(7, greatest(0, CAST({NOW} AS DATE) - CAST(observed_at AS DATE))) / 7e0 * 0.86e0), 4) AS age_opacity
FROM detections WHERE ({NOW_US} - observed_us) / 1e6 < 7 * 86400""")
def detections_visible_week(spark: SparkSession, sf: str) -> DataFrame:
    df = civil.visible_detections(load(spark, sf, "detections"), AS_OF)
    return df.select("id", "age_days", F.round("age_opacity", 4).alias("age_opacity"))


@register("detections_near_point", ctes("detections") + """
SELECT id, round(m, 2) AS distance_meters FROM (
  SELECT id, 2 * 6371000e0 * asin(sqrt(pow(sin(radians(latitude - 40e0) / 2), 2)
    + cos(radians(40e0)) * cos(radians(latitude)) * pow(sin(radians(longitude - -3.5e0) / 2), 2))) AS m FROM detections) d
WHERE m <= 120000""")
def detections_near_point(spark: SparkSession, sf: str) -> DataFrame:
    from emberlake.functions.geo import haversine_m

    near = Circle(40.0, -3.5, 120_000).keep(load(spark, sf, "detections"))
    return near.select("id", F.round(haversine_m(F.lit(40.0), F.lit(-3.5), F.col("latitude"), F.col("longitude")), 2).alias("distance_meters"))


@register("incidents_current", ctes("incidents", "sources") + f"""
SELECT i.id, i.status, i.provenance, greatest(0, CAST(trunc(({NOW_US} - observed_us) / 1e6) AS BIGINT)) AS age_seconds,
       CASE WHEN restriction_started_us IS NOT NULL
            THEN greatest(0, CAST(trunc((coalesce(ended_us, {NOW_US}) - restriction_started_us) / 1e6) AS BIGINT)) ELSE -1 END AS duration_seconds
FROM incidents i
WHERE merged_into IS NULL AND NOT hidden AND status = 'active'
  AND i.source_id IN (SELECT source_id FROM sources WHERE name ILIKE '%nation_1%' OR authority ILIKE '%nation_1%')
  AND confidence >= 0.25 AND (provenance <> 'estimated' OR observed_us >= {NOW_US} - 12 * 3600000000)
  AND (expires_us IS NULL OR expires_us > {NOW_US})
  AND observed_us BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-12-31')""")
def incidents_current(spark: SparkSession, sf: str) -> DataFrame:
    from emberlake.functions import dates

    sources = load(spark, sf, "sources")
    wanted = Selection(state="active", publisher="nation_1", confidence_from=0.25, span=Span(since="2024-01-05", until="2024-12-31"))
    kept = wanted.keep(incidents(spark, sf), "incident", sources, AS_OF)
    now = dates.ts(AS_OF)
    return kept.select(
        "id", "status", "provenance", F.greatest(F.lit(0).cast("long"), dates.age_seconds(F.col("observed_at"), now)).alias("age_seconds"),
        F.coalesce(dates.duration_seconds(F.col("restriction_started_at"), F.col("ended_at"), now), F.lit(-1)).alias("duration_seconds"),
    )


@register("incidents_by_municipality", ctes("incidents") + """
SELECT id, title FROM incidents WHERE merged_into IS NULL AND NOT hidden AND commune ILIKE '%commune 3%'""")
def incidents_by_municipality(spark: SparkSession, sf: str) -> DataFrame:
    wanted = Selection(place="commune 3", span=Span(outdated=True))
    return wanted.keep(incidents(spark, sf), "incident", load(spark, sf, "sources"), AS_OF).select("id", "title")


@register("incidents_ordered_by_area", ctes("incidents") + """
SELECT id, area_hectares FROM incidents""")
def incidents_ordered_by_area(spark: SparkSession, sf: str) -> DataFrame:
    return civil.ordered_incidents(incidents(spark, sf), "area").select("id", "area_hectares")


@register("perimeters_by_period", ctes("perimeters") + f"""
SELECT id, CASE WHEN trunc((x - observed_us) / 1e6) >= 365 * 86400 THEN 'historic'
                WHEN trunc((x - observed_us) / 1e6) < 7 * 86400 THEN 'current' ELSE 'year' END AS perimeter_period
FROM (SELECT *, epoch_us(TIMESTAMP '2024-02-05') AS x FROM perimeters) p
WHERE observed_us BETWEEN x - 365 * 86400000000 AND x - 7 * 86400000000 OR observed_us < x - 365 * 86400000000""")
def perimeters_by_period(spark: SparkSession, sf: str) -> DataFrame:
    as_of = "2024-02-05 00:00:00"
    wanted = Selection(span=Span(periods=frozenset({"year", "historic"}), outdated=True))
    kept = wanted.keep(perimeters(spark, sf), "fire_perimeter", load(spark, sf, "sources"), as_of)
    return kept.select("id", scoring.perimeter_period(F.col("observed_at"), F.lit(as_of).cast("timestamp")).alias("perimeter_period"))


@register("perimeters_in_bbox", ctes("perimeters") + f"""
SELECT id, area_hectares FROM perimeters WHERE xmin <= {BBOX[2]} AND xmax >= {BBOX[0]} AND ymin <= {BBOX[3]} AND ymax >= {BBOX[1]}""")
def perimeters_in_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return Box(*BBOX).keep(perimeters(spark, sf)).select("id", "area_hectares")


@register("latest_assessments", ctes("assessments") + """
SELECT resource_id AS id, confidence, category, coalesce(warning, '') AS warnings FROM (SELECT *,
  row_number() OVER (PARTITION BY resource_id ORDER BY calculated_us DESC, confidence DESC, category DESC, coalesce(warning, '') DESC) AS nth FROM assessments) WHERE nth = 1""")
def latest_assessments(spark: SparkSession, sf: str) -> DataFrame:
    out = civil.latest_assessments(assessments(spark, sf), "incident")
    return out.select("id", "_assessment.confidence", "_assessment.category", F.array_join("_assessment.warnings", ",").alias("warnings"))


@register("source_rollup", ctes("incidents", "sources") + """
SELECT coalesce(s.name, s.authority, 'Font no informada') AS name, max(updated_us) AS updated_us, count(*) AS "count",
       bool_or(provenance = 'estimated') AS warning
FROM incidents i LEFT JOIN sources s USING (source_id) GROUP BY 1""")
def source_rollup(spark: SparkSession, sf: str) -> DataFrame:
    items = incidents(spark, sf).join(
        load(spark, sf, "sources").select("source_id", F.col("name").alias("source_name"), F.col("authority").alias("source_authority")), "source_id", "left"
    ).withColumn("warnings", F.array().cast("array<string>"))
    return civil.source_rollup(items).select("name", F.unix_micros("updated").alias("updated_us"), "count", "warning")


@register("item_labels", ctes("incidents") + """
SELECT id, title AS label, CASE WHEN osint AND coalesce(summary, '') <> '' AND summary <> title THEN trim(summary) ELSE '' END AS description
FROM incidents""")
def item_labels(spark: SparkSession, sf: str) -> DataFrame:
    items = incidents(spark, sf).withColumns({"data_type": F.lit("incident"), "source_name": F.lit("x"), "source_authority": F.lit("y")})
    return civil.item_labels(items).select("id", "label", F.coalesce("description", F.lit("")).alias("description"))


@register("requests_over_limit", """
SELECT user_id AS client, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS "minute", count(*) AS requests, count(*) > 1 AS over_limit
FROM events GROUP BY 1, 2""")
def requests_over_limit(spark: SparkSession, sf: str) -> DataFrame:
    log = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("client"), F.col("ts").alias("at"))
    return civil.access_over_limit(log, 1).select("client", stamp("minute"), "requests", "over_limit")


@register("expectation_failures", ctes("detections") + """
SELECT rule, count(*) AS rows_failed, min(id) AS first_id FROM (
  SELECT id, 'forecast_never_official' AS rule FROM detections WHERE provenance = 'official'
  UNION ALL SELECT id, 'forecast_has_model_execution' FROM detections WHERE incident_id IS NULL
  UNION ALL SELECT id, 'risk_score_in_unit_interval' FROM detections WHERE frp_mw / 100e0 > 1) v GROUP BY 1""")
def expectation_failures(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "detections").select("id", "provenance", F.col("incident_id").alias("model_execution_id"), (F.col("frp_mw") / 100.0).alias("risk_score"))
    _, dead = expectations.split(df, expectations.forecast_rules())
    return dead.groupBy("rule").agg(F.count(F.lit(1)).alias("rows_failed"), F.min("id").alias("first_id"))


@register("layer_union", ctes("incidents", "perimeters") + """
SELECT layer, provenance, count(*) AS items FROM (SELECT 'incidents' AS layer, provenance FROM incidents UNION ALL
  SELECT 'perimeters', provenance FROM perimeters) u GROUP BY 1, 2""")
def layer_union(spark: SparkSession, sf: str) -> DataFrame:
    layers = civil.layer_union({"incidents": incidents(spark, sf), "perimeters": perimeters(spark, sf)})
    return layers.groupBy("layer", "provenance").agg(F.count(F.lit(1)).alias("items"))


@register("risk_layer", ctes("incidents", "sources") + """
SELECT id, CASE WHEN name ILIKE '%x.com/%' OR base_url ILIKE '%nitter%' OR name ILIKE '%x @%' THEN 'social' ELSE 'high' END AS category
FROM incidents JOIN sources USING (source_id) WHERE osint AND NOT canonical_fire
UNION ALL SELECT id, 'forecast' FROM incidents WHERE NOT osint""")
def risk_layer(spark: SparkSession, sf: str) -> DataFrame:
    from emberlake.functions import geo

    rows = incidents(spark, sf).join(
        load(spark, sf, "sources").select("source_id", F.col("name").alias("source_name"), F.col("base_url").alias("source_url")), "source_id"
    ).withColumn("geometry", geo.point(F.col("longitude"), F.col("latitude")))
    risk = rows.filter("NOT osint").withColumn("category", F.lit("forecast")).select("id", "category")
    return civil.risk_layer(risk, rows).select("id", "category")


@register("content_fingerprint", ctes("incidents") + """
SELECT count(*) AS rows, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT))::BIGINT AS first_sum, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT))::BIGINT AS second_sum
FROM (SELECT sha256('{"id":"' || id || '","status":"' || status || '","title":"' || title || '"}') AS h FROM incidents)""")
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return civil.fingerprint(load(spark, sf, "incidents").select("id", "status", "title"))


@register("incident_geojson", ctes("incidents") + """
SELECT id, '{"type":"Feature","id":"' || id || '","geometry":null,"properties":{"id":"' || id || '","status":"' || status || '","title":"' || title || '"}}' AS feature
FROM incidents""")
def incident_geojson(spark: SparkSession, sf: str) -> DataFrame:
    return civil.geojson_features(load(spark, sf, "incidents").select("id", "status", "title"))
