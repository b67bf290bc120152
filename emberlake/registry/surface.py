"""Registered sessions, metadata values and SQL functions with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import AS_OF, DAY_US, base, ctes, load
from emberlake.functions import metadata, sql
from emberlake.plans import civil
from emberlake.plans.sessions import activity_sessions
from emberlake.registry.civil import _SUMMER
from emberlake.registry.osint import sql_normal
from emberlake.registry.streams import days_spanned, halves, played
from emberlake.streaming import jobs

QUERIES, ORACLE = {}, {}


def register(name: str, sql_text: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql_text
        return fn

    return add


_ISLANDS = ctes("detections") + """,
g AS (SELECT *, CASE WHEN observed_us - lag(observed_us) OVER w <= 10800000000 THEN 0 ELSE 1 END AS s FROM detections WINDOW w AS (PARTITION BY user_id ORDER BY observed_us)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY observed_us) AS island FROM g)
SELECT user_id, min(observed_us) AS first_us, max(observed_us) AS last_us, count(*) AS detections, max(frp_mw) AS frp_mw FROM n GROUP BY user_id, island"""


def _sessions(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "detections", "frp_mw")


@register("activity_sessions", _ISLANDS)
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's detections with pauses of three hours at most."""
    return _sessions(activity_sessions(load(spark, sf, "detections"), ["user_id"]))


@register("streamed_sessions", _ISLANDS)
def streamed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream; a row far ahead closes the last sessions."""
    rows = load(spark, sf, "detections").select("event_id", "user_id", "observed_at", "frp_mw")
    days = days_spanned(rows)
    ahead = rows.agg((F.max("observed_at") + F.expr(f"INTERVAL {days + 3} DAYS")).alias("observed_at")).select(
        F.lit(None).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "observed_at", F.lit(None).cast("double").alias("frp_mw"))
    return _sessions(played([*halves(rows, "event_id"), ahead], lambda s: jobs.sessions(s, ["user_id"], late=f"{days} days")))


# Metadata with missing, null and mistyped values, nested objects, and texts that are no JSON.
_META = """CASE event_id % 8
  WHEN 0 THEN '{"osint": true, "area": 1.5, "n": ' || CAST(user_id AS STRING) || ', "risk": "wildfire"}' WHEN 1 THEN '{"osint": "yes", "area": "1.5", "n": 2.5, "risk": 7}'
  WHEN 2 THEN '{"osint": null, "area": null, "n": null, "risk": null}' WHEN 3 THEN '{}' WHEN 4 THEN 'no json' WHEN 5 THEN '{"osint": false, "area": ' || CAST(event_id AS STRING) || ', "risk": {"a":1}}'
  WHEN 6 THEN '{"n": ' || CAST(event_id AS STRING) || ', "deep": {"list": [1, ' || CAST(user_id AS STRING) || ']}, "risk": true}' END"""


@register("metadata_values", f"""WITH m AS (SELECT event_id, user_id, {_META} AS j FROM events), v AS (SELECT *, TRY_CAST(j AS JSON) AS v FROM m),
t AS (SELECT *, json_type(v, '$.osint') AS to_, json_type(v, '$.area') AS ta, json_type(v, '$.n') AS tn, json_type(v, '$.risk') AS tr FROM v)
SELECT event_id, coalesce(CASE WHEN to_ = 'BOOLEAN' THEN CAST(v->>'$.osint' AS BOOLEAN) END, false) AS osint,
  coalesce(CASE WHEN ta IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(v->>'$.area' AS DOUBLE) END, 0) AS area,
  coalesce(CASE WHEN tn IN ('UBIGINT', 'BIGINT') THEN CAST(v->>'$.n' AS BIGINT) END, -1) AS n,
  coalesce(CASE WHEN tr <> 'NULL' THEN v->>'$.risk' END, 'other') AS risk, coalesce(CAST(v->>'$.deep.list[1]' AS BIGINT), 0) AS deep FROM t""")
def metadata_values(spark: SparkSession, sf: str) -> DataFrame:
    """Typed values of JSON metadata with defaults."""
    rows = spark.sql(f"SELECT event_id, {_META} AS j FROM parquet.`{sf}/events.parquet`")
    fields = {
        "osint": ("$.osint", "boolean", False), "area": ("$.area", "double", 0.0), "n": ("$.n", "long", -1), "risk": ("$.risk", "string", "other"), "deep": ("$.deep.list[1]", "long", 0),
    }
    return metadata.promoted(rows, "j", fields).select("event_id", *fields)


@register("sql_functions", ctes("detections") + """
SELECT event_id AS id, round(2 * 6371000.0e0 * asin(sqrt(pow(sin(radians(40 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40)) * pow(sin(radians(-3 - longitude) / 2), 2))), 1) AS metres,
  CASE confidence_code WHEN 'l' THEN 0.4 WHEN 'n' THEN 0.6 WHEN 'h' THEN 0.85 ELSE CAST(confidence_code AS DOUBLE) / 100 END AS confidence,
  'N' || user_id AS road, CASE WHEN event_id % 2 = 0 THEN lpad(CAST(event_id % 1000000 AS STRING), 6, '0') ELSE '' END AS aircraft, CASE WHEN frp_mw > 0 THEN frp_mw END AS power FROM detections""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    sql.register(spark)
    load(spark, sf, "detections").createOrReplaceTempView("sql_function_rows")
    return spark.sql("""
        SELECT event_id AS id, round(haversine_m(latitude, longitude, 40D, -3D), 1) AS metres, detection_confidence(confidence_code) AS confidence,
          road_ref('n-' || user_id) AS road, icao24(CASE WHEN event_id % 2 = 0 THEN lpad(CAST(event_id % 1000000 AS STRING), 6, '0') ELSE 'zz' END) AS aircraft,
          positive_number(CAST(frp_mw AS STRING)) AS power
        FROM sql_function_rows""")


@register("sql_text_functions", ctes("publications") + f""", t AS (SELECT *, published_at AS m FROM publications)
SELECT id, sha256(rtrim(split_part(url, '#', 1), '/') || '|' || {sql_normal('title')}) AS digest, trim(regexp_replace(title || '  x', '\\s+', ' ', 'g')) AS title,
  CASE source_type WHEN 'official' THEN 1 WHEN 'reliable_media' THEN 2 WHEN 'multiple_witnesses' THEN 3 ELSE 4 END AS evidence,
  CASE doc_id % 3 WHEN 0 THEN 'official_closure' WHEN 1 THEN 'reduced_visibility' ELSE 'insufficient_data' END AS kind, doc_id / 2 AS number,
  strftime(m + CASE WHEN m >= s0 AND m < s1 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d') AS "day" FROM {_SUMMER}""")
def sql_text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Text, date and class functions in SQL."""
    from emberlake.functions import text as X

    sql.register(spark)
    load(spark, sf, "publications").withColumn("plain", X.normalize(F.col("title"))).createOrReplaceTempView("sql_function_texts")
    return spark.sql("""
        SELECT id, publication_hash(url, plain) AS digest, squeezed(title || '  x') AS title, evidence_rank(source_type) AS evidence,
          road_incident_kind(CASE doc_id % 3 WHEN 0 THEN 'Carreteras CORTADAS' WHEN 1 THEN 'Lento' ELSE 'x' END) AS kind, comma_number(replace(CAST(doc_id / 2 AS STRING), '.', ',')) AS number,
          CAST(madrid_day(published_at) AS STRING) AS day
        FROM sql_function_texts""")


@register("listed_notices", ctes("incidents") + f"""
SELECT id, CASE orderkey % 3 WHEN 0 THEN 'AEMET Meteoalerta' ELSE 'Proteccio Civil' END AS source_name, epoch_us(make_timestamp(updated_us)) AS updated_us FROM incidents
WHERE orderkey % 3 <> 2 AND (orderkey % 3 = 1 OR observed_us >= epoch_us(TIMESTAMP '{AS_OF}') - 4 * {DAY_US}) AND (expires_us IS NULL OR make_timestamp(expires_us) >= TIMESTAMP '{AS_OF}')""")
def listed_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Active notices of two sources as one list; those of the first are listed for four days."""
    k = F.col("orderkey") % 3
    rows = load(spark, sf, "incidents").select(
        "id", F.when(k == 0, "AEMET Meteoalerta").when(k == 1, "Proteccio Civil").otherwise("other").alias("source_name"), "observed_at", F.timestamp_micros("updated_us").alias("updated_at"),
        F.date_format(F.timestamp_micros("expires_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("expires"),
    )
    return civil.listed_notices(rows, AS_OF).select("id", "source_name", F.unix_micros("updated_at").alias("updated_us"))


@register("connector_status", """
WITH r AS (SELECT 'connector ' || o_custkey % 30 AS connector, o_orderkey AS id, o_orderstatus AS status, epoch_us(o_orderdate::TIMESTAMP) AS us, o_orderkey % 50 AS received, o_orderkey % 7 AS duplicates,
  row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
SELECT connector, string_agg(id || ':' || status || ':' || received || ':' || duplicates || ':' || (received - duplicates) || ':' || us, ' ' ORDER BY n) AS runs FROM r WHERE n <= 5 GROUP BY 1""")
def connector_status(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest runs of every connector in the shape of its status."""
    k = F.col("o_orderkey")
    runs = base(spark, sf, "orders").select(
        F.concat(F.lit("connector "), (F.col("o_custkey") % 30).cast("string")).alias("connector_name"), k.alias("id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), (k % 50).alias("received"), (k % 7).alias("duplicates"),
        (k % 50 - k % 7).alias("persisted"), F.lit("archive").alias("raw_object_uri"),
    )
    text = lambda r: F.concat_ws(":", *[r[c].cast("string") for c in ("id", "status", "received", "duplicates", "persisted")], F.unix_micros(r["started_at"]).cast("string"))
    return civil.connector_status(runs).select("connector", F.array_join(F.transform("runs", text), " ").alias("runs"))
