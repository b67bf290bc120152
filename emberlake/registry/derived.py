"""Queries for operators on single records: parsers of text rows, derived columns, keep rules, version rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import AS_OF, base, ctes, load
from emberlake.functions import dates, fixed, scoring, units
from emberlake.functions import text as X
from emberlake.operators import dedupe, merge
from emberlake.plans import civil
from emberlake.sources import detections as detection_rows
from emberlake.sources import feeds, raw, weather

QUERIES, ORACLE = {}, {}
NOW = f"TIMESTAMP '{AS_OF}'"


def register(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


def text_of(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


W, S, E, N = fixed.SPAIN_BBOX


@register("csv_detections", ctes("detections") + f""", t AS (
  SELECT *, CAST(CAST(latitude AS DECIMAL(9,4)) AS STRING) AS lat, CAST(CAST(longitude AS DECIMAL(9,4)) AS STRING) AS lon,
    strftime(observed_at, '%Y-%m-%d') AS d, ltrim(strftime(observed_at, '%H%M'), '0') AS hm FROM detections)
SELECT sha256(concat_ws('|', 'feed', satellite, sensor, lat, lon, d, hm)) AS deduplication_hash, CAST(lat AS DOUBLE) AS latitude, CAST(lon AS DOUBLE) AS longitude,
  strftime(date_trunc('minute', observed_at), '%Y-%m-%d %H:%M:%S') AS observed_at,
  CASE confidence_code WHEN 'l' THEN 0.4e0 WHEN 'n' THEN 0.6e0 WHEN 'h' THEN 0.85e0 ELSE greatest(0e0, least(CAST(confidence_code AS DOUBLE) / 100e0, 1e0)) END AS confidence
FROM t WHERE CAST(lon AS DOUBLE) BETWEEN {W} AND {E} AND CAST(lat AS DOUBLE) BETWEEN {S} AND {N}""")
def csv_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Detections written as text rows of the feed and normalized again."""
    plain = lambda c: F.col(c).cast("decimal(9,4)").cast("string")
    rows = load(spark, sf, "detections").select(
        F.lit("feed").alias("firms_source"), "satellite", F.col("sensor").alias("instrument"), plain("latitude").alias("latitude"), plain("longitude").alias("longitude"),
        F.date_format("observed_at", "yyyy-MM-dd").alias("acq_date"), F.ltrim(F.date_format("observed_at", "HHmm"), F.lit("0")).alias("acq_time"),
        F.col("confidence_code").alias("confidence"), F.col("frp_mw").cast("string").alias("frp"),
    )
    out = detection_rows.normalize(raw.require_columns(rows, ["latitude", "longitude"]))
    return out.select("deduplication_hash", "latitude", "longitude", text_of("observed_at"), "confidence")


@register("parsed_dates", ctes("incidents") + f"""
SELECT id, strftime(date_trunc('minute', observed_at), '%Y-%m-%d %H:%M:%S') AS phase, strftime(date_trunc('second', observed_at), '%Y-%m-%d %H:%M:%S') AS mail,
  CASE WHEN orderkey % 5 = 0 THEN '{AS_OF}' ELSE strftime(date_trunc('day', observed_at), '%Y-%m-%d %H:%M:%S') END AS written FROM incidents""")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Times written the way the feeds write them and read back; impossible dates fall back."""
    rows = load(spark, sf, "incidents")
    at, now = F.col("observed_at"), F.lit(AS_OF).cast("timestamp")
    note = F.when(F.col("orderkey") % 5 == 0, "Publicat el 31/02/2024 a les 10 h").otherwise(F.concat(F.lit("Actualizado: "), F.date_format(at, "d/M/yyyy"), F.lit(".")))
    return rows.select(
        "id", dates.plan_phase(F.date_format(at, "dd/MM/yyyy HH:mm")).alias("phase"),
        dates.rfc2822(F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("mail"), dates.published_in_text(note, now).alias("written"),
    ).select("id", text_of("phase"), text_of("mail"), text_of("written"))


@register("active_notices", ctes("incidents") + f"""
SELECT id, CASE WHEN orderkey % 4 = 0 THEN 'red' ELSE 'orange' END AS alert_level, title AS area
FROM incidents WHERE expires_us IS NULL OR orderkey % 18 = 0 OR make_timestamp(expires_us) >= {NOW}""")
def active_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Notices of incidents with an open, unreadable or future expiry."""
    expires = F.when(F.col("orderkey") % 18 == 0, "soon").otherwise(F.date_format(F.timestamp_micros("expires_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    meta = units.compact_map({"alert_level": F.when(F.col("orderkey") % 4 == 0, "red"), "area": F.col("title"), "expires": expires})
    rows = load(spark, sf, "incidents").select(
        "id", F.col("id").alias("incident_id"), "title", F.col("summary").alias("body"), F.lit("u").alias("url"), F.lit("orange").alias("severity"), meta.alias("metadata"),
        F.timestamp_micros("updated_us").alias("updated_at"),
    )
    return civil.active_notices(civil.notice_properties(rows), AS_OF).select("id", "alert_level", "area")


@register("incident_details", ctes("incidents") + f"""
SELECT id, CASE WHEN restriction_started_us IS NOT NULL THEN greatest(0, CAST(trunc((coalesce(ended_us, epoch_us({NOW})) - restriction_started_us) / 1e6) AS BIGINT)) END AS duration_seconds,
  CASE WHEN orderkey % 3 = 0 AND trunc((epoch_us({NOW}) - updated_us) / 1e6) <= 3 * 86400 THEN strftime(observed_at, '%Y-%m-%d %H:%M:%S') END AS final_date,
  coalesce(orderkey % 3 = 0 AND trunc((epoch_us({NOW}) - updated_us) / 1e6) <= 3 * 86400, false) AS extinction_confirmed,
  CASE WHEN orderkey % 7 = 0 THEN orderkey % 5 ELSE 0 END AS firms_detection_count, CASE WHEN orderkey % 6 = 0 THEN 2 ELSE 0 END AS merged_incident_count
FROM incidents""")
def incident_details(spark: SparkSession, sf: str) -> DataFrame:
    """Derived incident columns: duration, confirmed end, counts with defaults."""
    k = F.col("orderkey")
    rows = load(spark, sf, "incidents").withColumns({
        "restriction_started_at": F.timestamp_micros("restriction_started_us"), "ended_at": F.timestamp_micros("ended_us"),
        "extinction_confirmed": k % 3 == 0, "confirmed_extinction_at": F.col("observed_at"),
        "lastupdate": F.date_format(F.timestamp_micros("updated_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "hashtags": F.lit(None).cast("array<string>"),
        "firms_detection_count": F.when(k % 7 == 0, k % 5), "merged_incident_ids": F.when(k % 6 == 0, F.array(F.lit("a"), F.lit("b"))),
        "evidence_sources": F.lit(None).cast("array<string>"),
    })
    out = civil.incident_properties(rows, AS_OF)
    return out.select("id", "duration_seconds", text_of("final_date"), "extinction_confirmed", "firms_detection_count", F.col("merged_incident_count").cast("long").alias("merged_incident_count"))


@register("incident_history", ctes("incidents") + """
SELECT id || '-v' || CAST(v AS STRING) AS id, id AS incident_id, v AS version, 'official_or_observed_version' AS provenance, title
FROM incidents, unnest(range(1, version + 1)) AS u(v)""")
def incident_history(spark: SparkSession, sf: str) -> DataFrame:
    """Version rows of every incident in the public timeline shape."""
    rows = load(spark, sf, "incidents").withColumn("v", F.explode(F.sequence(F.lit(1), F.col("version"))))
    versions = rows.select(
        F.concat("id", F.lit("-v"), F.col("v").cast("string")).alias("id"), F.col("observed_at").alias("created_at"), F.col("id").alias("incident_id"),
        F.col("v").cast("long").alias("version"), "status", "title", F.lit("update").alias("change_reason"),
    )
    return civil.incident_timeline(versions).select("id", "incident_id", "version", "provenance", "title")


@register("restriction_details", ctes("road_incidents") + """
SELECT id, CASE WHEN kind = 'official_closure' THEN kind END AS cause, 'PK ' || CAST(CAST(severity AS BIGINT) AS STRING) AS kilometer_range, CAST(NULL AS STRING) AS channel
FROM road_incidents""")
def restriction_details(spark: SparkSession, sf: str) -> DataFrame:
    """Restriction columns taken out of the metadata map."""
    meta = units.compact_map({"cause": F.when(F.col("kind") == "official_closure", F.col("kind")), "kilometer_range": F.concat(F.lit("PK "), F.col("severity").cast("long").cast("string"))})
    rows = load(spark, sf, "road_incidents").select(
        "id", F.col("id").alias("incident_id"), F.col("kind").alias("name"), F.lit("road").alias("zone_kind"), F.lit("closure").alias("restriction_type"), meta.alias("metadata"), F.lit(None).cast("timestamp").alias("expires_at")
    )
    return civil.restriction_properties(rows).select("id", "cause", "kilometer_range", "channel")


@register("municipality_matches", ctes("incidents") + """
SELECT name, match_rank FROM (SELECT DISTINCT commune AS name, CASE WHEN lower(commune) = 'commune 1' THEN 0 WHEN lower(commune) LIKE 'commune 1%' THEN 1 ELSE 2 END AS match_rank
FROM incidents WHERE contains(lower(commune), 'commune 1')) ORDER BY match_rank, name LIMIT 8""")
def municipality_matches(spark: SparkSession, sf: str) -> DataFrame:
    """First eight municipalities for a search text: exact, prefix, inner matches."""
    from emberlake.functions import geo

    boundaries = load(spark, sf, "incidents").groupBy(F.col("commune").alias("name")).agg(F.min("longitude").alias("x"), F.min("latitude").alias("y"))
    shaped = boundaries.withColumn("geometry", geo.box(F.col("x"), F.col("y"), F.col("x") + 0.1, F.col("y") + 0.1))
    return civil.municipality_lookup(shaped, "Commune 1").select("name", "match_rank")


@register("kilometer_values", """
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 2 AS a, l_quantity / 2 + (l_linenumber - 1) / 4 AS b FROM lineitem),
t AS (SELECT *, CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS STRING) ELSE rtrim(CAST(CAST(a AS DECIMAL(9,2)) AS STRING), '0') END AS ta,
  CASE WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS STRING) ELSE rtrim(CAST(CAST(b AS DECIMAL(9,2)) AS STRING), '0') END AS tb FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a = b THEN 'PK ' || ta ELSE 'PK ' || ta || ' - ' || tb END AS text, a AS first_km, b AS last_km,
  CASE WHEN a = b THEN 1 ELSE CAST(ceil((b - a) / 0.5) AS BIGINT) + 1 END AS samples FROM t""")
def kilometer_values(spark: SparkSession, sf: str) -> DataFrame:
    """Range text, bounds and half-kilometre samples of kilometre points."""
    rows = base(spark, sf, "lineitem").withColumn("a", F.col("l_quantity") / 2).withColumn("b", F.col("a") + (F.col("l_linenumber") - 1) / 4)
    points = F.array(F.col("b").cast("string"), F.lit("x"), F.col("a").cast("string"))
    bounds = units.kilometer_bounds(points, F.lit(None).cast("string"))
    out = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", units.kilometer_range(points).alias("text"), bounds.alias("k"))
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "text", F.col("k.first").alias("first_km"), F.col("k.last").alias("last_km"),
        F.size(units.kilometer_samples(F.col("k.first"), F.col("k.last"), 0.5)).cast("long").alias("samples"),
    )


@register("road_reference_lists", ctes("road_segments") + """
SELECT id, CASE WHEN id % 3 = 0 THEN replace(road_ref, '-', '') || ',A7' ELSE replace(road_ref, '-', '') END AS tokens, id % 3 = 0 AS on_a7 FROM road_segments""")
def road_reference_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of delimited road references and whether one stands alone in the list."""
    listed = F.when(F.col("id") % 3 == 0, F.concat(F.lower("road_ref"), F.lit(";a-7 "), "road_ref")).otherwise(F.concat("road_ref", F.lit("")))
    return load(spark, sf, "road_segments").select(
        "id", F.array_join(X.road_ref_tokens(listed), ",").alias("tokens"), X.matches_road_ref(listed, F.lit("A-7")).alias("on_a7")
    )


@register("evidence_of_publications", ctes("publications") + """
SELECT id, r AS evidence_rank, round(least(1, CASE r WHEN 1 THEN 0.96 WHEN 2 THEN 0.78 WHEN 3 THEN 0.62 ELSE 0.30 END * (doc_id % 10 + 1) / 10), 6) AS confidence,
  CASE WHEN r = 1 AND doc_id % 2 = 0 THEN 'accepted' ELSE 'pending' END AS review
FROM (SELECT *, CASE source_type WHEN 'official' THEN 1 WHEN 'reliable_media' THEN 2 WHEN 'multiple_witnesses' THEN 3 ELSE 4 END AS r FROM publications)""")
def evidence_of_publications(spark: SparkSession, sf: str) -> DataFrame:
    """Rank, confidence and review state by the kind of source."""
    rank = scoring.evidence_rank(F.col("source_type"))
    event = F.when(F.col("doc_id") % 2 == 0, "evacuation_order").otherwise("es_alert_received")
    return load(spark, sf, "publications").select(
        "id", rank.cast("int").alias("evidence_rank"), F.round(scoring.evidence_confidence(rank, (F.col("doc_id") % 10 + 1) / 10), 6).alias("confidence"), scoring.review_status(rank, event).alias("review")
    )


@register("catalogue_sources", """
SELECT s_name AS name, round(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE (s_suppkey % 10) / 10 END, 4) AS reliability FROM supplier WHERE s_suppkey % 4 <> 1""")
def catalogue_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One catalogue document per supplier read as sources; disabled ones left out."""
    k = F.col("s_suppkey")
    doc = F.to_json(F.array(F.struct(F.col("s_name").alias("name"), F.lit("u").alias("url"), F.when(k % 4 == 1, False).when(k % 4 == 2, True).alias("enabled"), F.when(k % 3 != 0, (k % 10) / 10).alias("reliability"))))
    rows = base(spark, sf, "supplier").select(F.lit("catalogue").alias("url"), doc.alias("payload"))
    return feeds.catalogue(rows).select("name", F.round("reliability", 4).alias("reliability"))


@register("intake_batches", ctes("publications") + """
SELECT 'pub' AS kind, id AS key FROM publications WHERE doc_id % 9 <> 0 UNION ALL SELECT 'payload_is_json', url FROM publications WHERE doc_id % 9 = 0""")
def intake_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of normalized publications; what is no list of records becomes a dead letter."""
    record = F.array(F.struct(F.col("id").alias("external_id"), "title", F.col("body").alias("text"), "url"))
    rows = load(spark, sf, "publications").select("url", F.when(F.col("doc_id") % 9 == 0, "{broken").otherwise(F.to_json(record)).alias("payload"))
    good, bad = feeds.intake(rows)
    return good.select(F.lit("pub").alias("kind"), F.col("external_id").alias("key")).unionByName(bad.select(F.col("rule").alias("kind"), F.col("url").alias("key")))


@register("alert_index_links", ctes("publications") + """
SELECT 'https://example.org/a/' || CAST(doc_id % 200 AS STRING) || '.XML' AS link FROM publications WHERE doc_id % 2 = 0 GROUP BY 1""")
def alert_index_links(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct document links of feed indexes."""
    ending = F.when(F.col("doc_id") % 2 == 0, F.concat((F.col("doc_id") % 200).cast("string"), F.lit(".XML"))).otherwise("page.html")
    doc = F.concat(F.lit("<rss><channel><item><title>t</title><link>https://example.org/a/"), ending, F.lit("</link></item></channel></rss>"))
    rows = load(spark, sf, "publications").select("url", doc.alias("payload"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"))
    return weather.alert_links(rows)


@register("latest_events", """
SELECT user_id, max(event_id) AS last_id, arg_max(event_id, (epoch_us(ts), -event_id)) AS latest_id FROM events GROUP BY 1""")
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    """Keep-last by id and keep-latest by time, earlier id at ties, per user."""
    rows = base(spark, sf, "events").select("user_id", "event_id", "ts")
    last = dedupe.keep_last(rows, ["user_id"], ["event_id"]).select("user_id", F.col("event_id").alias("last_id"))
    latest = dedupe.keep_latest(rows, ["user_id"], "ts", "event_id").select("user_id", F.col("event_id").alias("latest_id"))
    return last.join(latest, "user_id")


@register("versioned_incidents", ctes("incidents") + """
SELECT id, version + CASE WHEN orderkey % 4 = 0 THEN 1 ELSE 0 END AS version, CASE WHEN orderkey % 4 = 0 THEN version END AS kept_version, orderkey % 5 = 0 AS deleted FROM incidents""")
def versioned_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Version rows before a change, bumped parents and soft deletion."""
    rows = load(spark, sf, "incidents").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    kept, bumped = merge.snapshot_versions(rows, rows.filter(F.col("orderkey") % 4 == 0), "id", "test")
    gone = merge.soft_delete(bumped, rows.filter(F.col("orderkey") % 5 == 0), "id", F.lit(AS_OF).cast("timestamp"))
    old = kept.select(F.col("incident_id").alias("id"), F.col("version").alias("kept_version"))
    return gone.join(old, "id", "left").select("id", "version", "kept_version", F.col("deleted_at").isNotNull().alias("deleted"))


@register("refreshed_metadata", ctes("incidents") + """
SELECT id, CASE WHEN orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS notes, 'new' AS area, CASE WHEN orderkey % 2 = 0 THEN 'kept' END AS extra FROM incidents""")
def refreshed_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata maps merged on refresh: listed keys of the stored map survive, others are replaced."""
    k = F.col("orderkey")
    old = units.compact_map({"notes": F.when(k % 3 == 0, "old"), "area": F.lit("old"), "extra": F.when(k % 2 == 0, "kept")})
    new = units.compact_map({"notes": F.lit("new"), "area": F.lit("new")})
    out = load(spark, sf, "incidents").select("id", old.alias("o"), new.alias("n"))
    return out.select("id", merge.keep_map_keys(["notes", "extra"])(F.col("o"), F.col("n")).alias("m")).select("id", F.col("m")["notes"].alias("notes"), F.col("m")["area"].alias("area"), F.col("m")["extra"].alias("extra"))


@register("payload_hashes", ctes("incidents") + """
SELECT id, sha256(id || '|{"status":"' || status || '","title":"' || title || '"}') AS digest FROM incidents""")
def payload_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of an id and its canonical payload."""
    return load(spark, sf, "incidents").select("id", units.canonical_hash(F.col("id"), F.struct("status", "title")).alias("digest"))
