"""Registered feed, merge and aircraft queries: payloads written from the driver tables, then parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import AS_OF, base, ctes, load
from emberlake.functions import fixed
from emberlake.operators import merge
from emberlake.operators.stage import spread
from emberlake.plans import aircraft, osint
from emberlake.registry import civil
from emberlake.sources import feeds, notices, roads, traffic, weather

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def raw(df: DataFrame, payload: Column, url: Column | None = None) -> DataFrame:
    """Payload rows as a landing zone would hold them; parsing is heavy per byte, so few splits are spread over the cores."""
    df = spread(df)
    where = url if url is not None else F.lit("https://example.org/feed")
    return df.select(where.alias("url"), payload.alias("payload"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"))


def text(col: str) -> Column:
    return F.col(col).cast("string")


@register("feed_items", ctes("publications") + """
SELECT id AS external_id, title, trim(regexp_replace(body, '[ \t\n\r]+', ' ', 'g'), ' ') AS body, strftime(date_trunc('second', published_at), '%Y-%m-%d %H:%M:%S') AS published_at FROM publications""")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Publications written as RSS items and read back."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    doc = F.concat(
        F.lit("<rss><channel><item><guid>"), "id", F.lit("</guid><title>"), escape(F.col("title")), F.lit("</title><description>"), escape(F.col("body")),
        F.lit("</description><link>"), "url", F.lit("</link><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>"),
    )
    out = feeds.publications(raw(load(spark, sf, "publications"), doc))
    return out.select("external_id", "title", F.trim(F.regexp_replace("body", r"[ \t\n\r]+", " ")).alias("body"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@register("page_anchors", """
SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=[^>]*>')) AS BIGINT) AS anchors FROM pages WHERE regexp_matches(html, '(?i)<a ')""")
def page_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every page; several pages may have one address."""
    found = feeds.anchors(base(spark, sf, "pages"), min_length=0, keep=("page_id",))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"))


@register("page_publications")
def page_publications(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as publications: text, date and places of every page."""
    pages = base(spark, sf, "pages")
    wanted = pages.select("url", F.lit("page").alias("title"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"))
    out = osint.enrich_from_pages(wanted, pages)
    return out.select("url", F.length("text").alias("chars"), "published_at", F.size("place_hints").alias("hints"))


@register("social_posts", """
SELECT 'p' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS external_id, CASE WHEN role = 'system' THEN 'official' ELSE 'individual' END AS source_type,
  substr(text, 1, 500) AS title FROM conversations""")
def social_posts(spark: SparkSession, sf: str) -> DataFrame:
    turns = base(spark, sf, "conversations")
    posts = turns.select(
        F.concat(F.lit("p"), text("conv_id"), F.lit("-"), text("turn")).alias("post_id"), "text", F.col("role").alias("author_id"), F.lit(AS_OF).cast("timestamp").alias("created_at")
    )
    users = turns.select(F.col("role").alias("author_id"), F.col("role").alias("username"), F.upper("role").alias("name")).distinct()
    return osint.social_posts(posts, users, ["SYSTEM"]).select("external_id", "source_type", "title")


@register("weather_observations", ctes("detections") + """
SELECT 'st' || CAST(user_id AS STRING) AS station_id, CAST(count(*) AS BIGINT) AS n, round(avg(frp_mw), 3) AS mean_temperature FROM detections GROUP BY 1""")
def weather_observations(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "detections")
    row = F.to_json(F.array(F.struct(
        F.concat(F.lit("st"), text("user_id")).alias("idema"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fint"), F.lit("402443N").alias("lat"), F.lit("0034041W").alias("lon"),
        F.replace(text("frp_mw"), F.lit("."), F.lit(",")).alias("ta"), text("event_id").alias("hr"), F.lit("1").alias("vv"))))
    out = weather.observations(raw(d, row))
    return out.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("temperature_celsius"), 3).alias("mean_temperature"))


@register("weather_forecasts", """
SELECT 'm' || CAST(o_orderkey AS STRING) AS municipality_id, CAST(o_orderkey % 24 AS INT) AS horizon_hours, CAST(o_orderkey % 40 AS DOUBLE) AS temperature_celsius, CAST(45 AS DOUBLE) AS wind_direction_degrees FROM orders""")
def weather_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    o = base(spark, sf, "orders")
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    doc = F.format_string(
        '[{"elaborado":"2024-01-01T00:00:00","prediccion":{"dia":[{"fecha":"2024-01-01T00:00:00","temperatura":[{"periodo":"%s","value":"%s"}],'
        '"vientoAndRachaMax":[{"periodo":"%s","direccion":"NE","velocidad":"12","rachaMax":"30"}]}]}}]', hour, (F.col("o_orderkey") % 40).cast("string"), hour)
    name = F.concat(F.lit("m"), text("o_orderkey"))
    payloads = o.select(name.alias("municipality"), doc.alias("payload"))
    places = o.select(name.alias("municipality"), F.lit(40.0).alias("latitude"), F.lit(-3.0).alias("longitude"))
    return weather.forecasts(payloads, places).select("municipality_id", "horizon_hours", "temperature_celsius", "wind_direction_degrees")


@register("weather_alerts", """
SELECT 'a' || CAST(o_orderkey AS STRING) AS external_id, CASE o_orderkey % 3 WHEN 0 THEN 'orange' WHEN 1 THEN 'red' ELSE 'yellow' END AS severity,
  printf('%.6f,%.6f,%.6f,%.6f', o_custkey % 10 - 8.0, 36.0 + o_orderkey % 6, o_custkey % 10 - 6.5, 36.75 + o_orderkey % 6) AS area_bbox FROM orders""")
def weather_alerts(spark: SparkSession, sf: str) -> DataFrame:
    o = base(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    lat, lon = 36.0 + F.col("o_orderkey") % 6, F.col("o_custkey") % 10 - 8.0
    corner = lambda y, x: F.concat((lat + y).cast("string"), F.lit(","), (lon + x).cast("string"))
    ring = F.concat_ws(" ", corner(0.0, 0.0), corner(0.75, 0.5), corner(0.25, 1.5), corner(0.0, 0.0))
    extra = F.when(k == 0, "<cap:parameter><cap:valueName>AEMET-Meteoalerta nivel</cap:valueName><cap:value>naranja</cap:value></cap:parameter>").otherwise("")
    xml = F.concat(
        F.lit('<cap:alert xmlns:cap="urn:oasis:names:tc:emergency:cap:1.2"><cap:identifier>a'), text("o_orderkey"),
        F.lit("</cap:identifier><cap:sent>2024-01-01T10:00:00+00:00</cap:sent><cap:info><cap:language>en</cap:language><cap:event>x</cap:event></cap:info><cap:info><cap:language>es-ES</cap:language><cap:event>Viento</cap:event><cap:severity>"),
        F.when(k == 1, "Extreme").otherwise("Moderate"), F.lit("</cap:severity>"), extra,
        F.lit("<cap:area><cap:areaDesc>Zona</cap:areaDesc><cap:polygon>"), ring, F.lit("</cap:polygon></cap:area></cap:info></cap:alert>"),
    )
    doc = F.to_json(F.struct(F.lit("f").alias("feed_url"), F.array(F.struct(F.lit("u").alias("url"), xml.alias("xml"))).alias("messages")))
    return weather.alerts(raw(o, doc)).select("external_id", "severity", "area_bbox")


@register("traffic_situations", """
SELECT 'https://example.org/feed#r' || CAST(p_partkey AS STRING) AS external_id, CASE WHEN p_partkey % 2 = 0 THEN 'CARRETERAS CORTADAS' ELSE 'OTRAS AFECCIONES' END AS kind,
  'Obres: N-' || CAST(p_partkey % 500 AS STRING) || ' (PK ' || CAST(p_partkey % 7 AS STRING) || CASE WHEN p_partkey % 7 = 6 THEN '' ELSE ' - 6' END || ')' AS title FROM part""")
def traffic_situations(spark: SparkSession, sf: str) -> DataFrame:
    p = base(spark, sf, "part")
    k = text("p_partkey")
    doc = F.concat(
        F.lit('<d2:payload xmlns:d2="u"><sit:situation id="s'), k, F.lit('"><sit:situationRecord xsi:type="sit:MaintenanceWorks" id="r'), k,
        F.lit('"><c:roadMaintenanceType>roadworks</c:roadMaintenanceType><c:roadNumber>N-'), (F.col("p_partkey") % 500).cast("string"),
        F.lit("</c:roadNumber>"), F.when(F.col("p_partkey") % 2 == 0, "<c:mobilityType>roadClosed</c:mobilityType>").otherwise(""),
        F.lit("<c:kilometerPoint>"), (F.col("p_partkey") % 7).cast("string"), F.lit("</c:kilometerPoint><c:kilometerPoint>6</c:kilometerPoint>"
        "<c:pointCoordinates><c:latitude>40.5</c:latitude><c:longitude>-3.5</c:longitude></c:pointCoordinates></sit:situationRecord></sit:situation></d2:payload>"),
    )
    return traffic.restrictions(raw(p, doc)).select("external_id", "kind", "title")


@register("traffic_map", """
SELECT 'etraffic:' || CAST(p_partkey AS STRING) AS external_id, 'RETENCIÓN - N-' || CAST(p_partkey % 500 AS STRING) AS title, CAST(2 AS INT) AS lines FROM part WHERE p_partkey % 3 <> 0""")
def traffic_map(spark: SparkSession, sf: str) -> DataFrame:
    """Map feed written in its wire encoding, then decoded and parsed."""
    p = base(spark, sf, "part")
    shape = F.when(F.col("p_partkey") % 3 == 0, F.lit('{"type":"Point","coordinates":[1.0,2.0]}')).otherwise(
        F.lit('{"type":"MultiLineString","coordinates":[[[1.0,2.0],[1.1,2.1]],[[3.0,4.0],[3.1,4.1],[3.2,4.2]]]}'))
    row = F.struct(text("p_partkey").alias("id"), F.lit("RETENCIÓN").alias("tipoVialidad"), F.concat(F.lit("N-"), (F.col("p_partkey") % 500).cast("string")).alias("carretera"), shape.alias("geometria"))
    doc = F.to_json(F.struct(F.array(row).alias("situationsRecords")))
    key = fixed.TRAFFIC_MAP_XOR_KEY
    source = "".join(chr(i) for i in range(256) if i != key)
    wire = F.base64(F.encode(F.translate(F.decode(F.encode(doc, "UTF-8"), "ISO-8859-1"), source, "".join(chr(i ^ key) for i in range(256) if i != key)), "ISO-8859-1"))
    encoded = F.regexp_replace(wire, r"\s", "")
    return traffic.map_restrictions(raw(p, traffic.decode_map(encoded))).select("external_id", "title", F.size("paths").alias("lines"))


@register("road_features", """
SELECT CAST(p_partkey AS STRING) AS external_id, p_name AS name, 'N-' || CAST(p_partkey % 500 AS STRING) AS road_ref FROM part""")
def road_features(spark: SparkSession, sf: str) -> DataFrame:
    p = base(spark, sf, "part")
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(
        text("p_partkey").alias("id"), F.struct(F.col("p_name").alias("nombre"), F.concat(F.lit("N-"), (F.col("p_partkey") % 500).cast("string")).alias("nationalRoadCode")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.5), F.lit(2.5))).alias("coordinates")).alias("geometry"))).alias("features")))
    return roads.transport_features(raw(p, doc)).select("external_id", "name", "road_ref")


@register("road_ways", """
SELECT 'osm-way:' || CAST(p_partkey AS STRING) AS external_id, p_size / 10e0 AS max_weight_tons, lower(p_brand) AS surface FROM part""")
def road_ways(spark: SparkSession, sf: str) -> DataFrame:
    p = base(spark, sf, "part")
    doc = F.to_json(F.struct(F.array(F.struct(
        F.lit("way").alias("type"), F.col("p_partkey").alias("id"),
        F.create_map(F.lit("highway"), F.lit("track"), F.lit("surface"), F.lower("p_brand"), F.lit("maxweight"), F.concat((F.col("p_size") / 10.0).cast("string"), F.lit("t"))).alias("tags"),
        F.array(F.struct(F.lit(40.0).alias("lat"), F.lit(-3.0).alias("lon")), F.struct(F.lit(40.1).alias("lat"), F.lit(-3.1).alias("lon"))).alias("geometry"))).alias("elements")))
    return roads.ways(raw(p, doc)).select("external_id", "max_weight_tons", "surface")


@register("burnt_areas", ctes("perimeters") + """
SELECT external_id, area_hectares, strip_accents(lower(province)) AS province FROM perimeters WHERE xmax >= -8 AND xmin <= 2 AND ymax >= 37 AND ymin <= 43 AND orderkey % 9 <> 0""")
def burnt_areas(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "perimeters")
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))])
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(
        F.struct(text("orderkey").alias("ID"), text("area_hectares").alias("area_ha"), F.when(F.col("orderkey") % 9 == 0, "France").otherwise("España").alias("COUNTRY"),
                 F.col("province").alias("Province"), F.col("commune").alias("COMMUNE")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("features")))
    from emberlake.functions.text import normalize

    out = notices.burnt_areas(raw(p, doc), (-8.0, 37.0, 2.0, 43.0))
    return out.select("external_id", "area_hectares", normalize(F.col("province")).alias("province"))


@register("plan_notices", """
SELECT 'row-' || CAST(o_orderkey AS STRING) AS external_id, CASE o_orderkey % 3 WHEN 0 THEN 'orange' WHEN 1 THEN 'yellow' ELSE 'red' END AS severity,
  'INFOCAT ' || CASE o_orderkey % 3 WHEN 0 THEN 'ALERTA' WHEN 1 THEN 'PREALERTA' ELSE 'EMERGENCIA 1' END AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS observed_at FROM orders""")
def plan_notices(spark: SparkSession, sf: str) -> DataFrame:
    o = base(spark, sf, "orders")
    phase = F.when(F.col("o_orderkey") % 3 == 0, "ALERTA").when(F.col("o_orderkey") % 3 == 1, "PREALERTA").otherwise("EMERGENCIA 1")
    doc = F.concat(F.lit('[{":id":"row-'), text("o_orderkey"), F.lit('","plaacronim":"INFOCAT","plafase":"'), phase, F.lit('","fasedatahora":"'),
                   F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy HH:mm"), F.lit('","descripcio":"text"}]'))
    out = notices.plans(raw(o, doc))
    return out.select("external_id", "severity", "title", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"))


@register("live_aircraft", """
SELECT 'ES-EMG-' || CAST(c_custkey AS STRING) AS aircraft_id, count(*) > 0 AS seen, round(arg_max(value * 3.6e0, (ts, value)), 1) AS velocity_kmh
FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'error' GROUP BY 1""")
def live_aircraft(spark: SparkSession, sf: str) -> DataFrame:
    """Newest airborne position of every registered aircraft, from state payloads; of equal times the fastest."""
    hexed = lambda c: F.lower(F.lpad(F.hex(F.col(c)), 6, "0"))
    reg_doc = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("ES-EMG-"), text("c_custkey")).alias("id"), hexed("c_custkey").alias("icao24"), F.col("c_name").alias("registration"), F.lit("op").alias("operator"))).alias("aircraft")))
    registry = notices.aircraft_registry(raw(base(spark, sf, "customer"), reg_doc))
    e = base(spark, sf, "events")
    null = F.lit(None).cast("string")
    state = F.array(hexed("user_id"), F.lit("CALL"), F.lit("Spain"), null, (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000).cast("decimal(7,0)")).cast("string"), F.lit("-3.5"), F.lit("40.1"), null,
                    F.when(F.col("event_type") == "error", "true").otherwise("false"), text("value"))
    doc = F.concat(F.lit('{"states":['), F.to_json(state), F.lit("]}"))
    out = aircraft.live_aircraft([notices.state_vectors(raw(e, doc))], registry, AS_OF)
    return out.select(F.col("aircraft.id").alias("aircraft_id"), F.lit(True).alias("seen"), "velocity_kmh")


def stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A stored table (three of four incidents) and a newer batch (two of three, some changed)."""
    inc = load(spark, sf, "incidents").select("orderkey", "id", "source_id", "status", "title", "version")
    old = inc.filter("orderkey % 4 <> 3").withColumns({"deduplication_hash": F.concat("id", F.lit(":1")), "expires_at": F.lit(None).cast("timestamp")})
    new = inc.filter("orderkey % 3 <> 2").withColumn("deduplication_hash", F.concat("id", F.when(F.col("orderkey") % 5 == 0, ":2").otherwise(":1")))
    return old, new.withColumn("title", F.concat(F.lit("new "), "title")).drop("version")


_STORED = ctes("incidents") + """, o AS (SELECT * FROM incidents WHERE orderkey % 4 <> 3), n AS (SELECT * FROM incidents WHERE orderkey % 3 <> 2)"""


@register("upserted_incidents", _STORED + """
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' WHEN n.orderkey % 5 <> 0 THEN 'duplicate' ELSE 'updated' END AS action,
  CAST(CASE WHEN o.id IS NULL THEN 1 WHEN n.id IS NOT NULL AND n.orderkey % 5 = 0 THEN o.version + 1 ELSE o.version END AS INT) AS version,
  CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND n.orderkey % 5 = 0) THEN 'new ' || n.title ELSE o.title END AS title
FROM o FULL JOIN n ON o.id = n.id""")
def upserted_incidents(spark: SparkSession, sf: str) -> DataFrame:
    old, new = stored(spark, sf)
    return merge.upsert(old, new, ["id"], "deduplication_hash").select("id", F.col("_action").alias("action"), "version", "title")


@register("snapshot_expiry", _STORED + """
SELECT o.id, o.source_id = 3 AND n.id IS NULL AS expired FROM o LEFT JOIN n ON o.id = n.id""")
def snapshot_expiry(spark: SparkSession, sf: str) -> DataFrame:
    old, new = stored(spark, sf)
    out = merge.expire_missing(old, new, "id", F.col("source_id") == 3, F.lit(AS_OF).cast("timestamp"))
    return out.select("id", F.col("expires_at").isNotNull().alias("expired"))


@register("new_by_hash", _STORED + """
SELECT n.id FROM n LEFT JOIN o ON o.id = n.id WHERE o.id IS NULL OR n.orderkey % 5 = 0""")
def new_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    from emberlake.operators.dedupe import only_new

    old, new = stored(spark, sf)
    return only_new(new, old, "deduplication_hash").select("id")


@register("fallback_expiry", ctes("incidents", "sources") + """
SELECT id, coalesce(name = 'Supplier#000000004', false) AS expired FROM incidents LEFT JOIN sources USING (source_id)""")
def fallback_expiry(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "incidents").select("id", "source_id", F.lit(None).cast("timestamp").alias("expires_at"))
    out = merge.expire_source(rows, load(spark, sf, "sources"), "Supplier#000000004", F.lit(AS_OF).cast("timestamp"))
    return out.select("id", F.col("expires_at").isNotNull().alias("expired"))


@register("reactivated_zones", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'expired' ELSE 'active' END AS state,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS geometry FROM orders""")
def reactivated_zones(spark: SparkSession, sf: str) -> DataFrame:
    o = base(spark, sf, "orders")
    k = F.col("o_orderkey")
    old = o.select(k.alias("id"), F.lit("old").alias("geometry"), F.lit("cnig_local_road_network").alias("strategy"), F.lit("n").alias("name"), F.lit(AS_OF).cast("timestamp").alias("expires_at"))
    snap = o.filter(k % 3 != 0).select(k.alias("id"), F.lit("new").alias("geometry"), F.when(k % 2 == 0, "road_ref_network_match").otherwise(merge.RAW_STRATEGY).alias("strategy"), F.lit("m").alias("name"))
    out = merge.reactivate(old, snap, "id")
    return out.select("id", F.when(F.col("expires_at").isNull(), "active").otherwise("expired").alias("state"), "geometry")


@register("known_sources", ctes("sources") + """
SELECT name, CASE WHEN source_id % 2 = 0 THEN 'refreshed' ELSE 'kept' END AS action FROM sources UNION ALL SELECT 'brand new', 'inserted'""")
def known_sources(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "sources")
    seen = old.filter("source_id % 2 = 0").select("name", F.lit("fresh").alias("attribution"))
    extra = old.agg(F.lit("brand new").alias("name"), F.lit("fresh").alias("attribution"))
    return merge.get_or_create(old, seen.unionByName(extra), "name", ["attribution"]).select("name", F.col("_action").alias("action"))


@register("connector_runs", """
SELECT l_shipmode_key AS connector_name, id FROM (SELECT 'connector ' || CAST(l_suppkey AS STRING) AS l_shipmode_key, l_orderkey * 10 + l_linenumber AS id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber, l_partkey) AS rn FROM lineitem) t WHERE rn <= 5""")
def connector_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = base(spark, sf, "lineitem").select(
        F.concat(F.lit("connector "), text("l_suppkey")).alias("connector_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("started_at"))
    return civil.civil.connector_runs(runs).select("connector_name", "id")
