"""Civil-protection plans, alert snapshots, burnt areas, aircraft."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import dates, fixed, geo, units
from emberlake.functions import text as X
from emberlake.functions.text import clean
from emberlake.operators.stage import computed
from emberlake.sources.raw import require_rows
from emberlake.sources.roads import features


def plans(raw: DataFrame) -> DataFrame:
    """Active plan rows as notices."""
    rows = raw.select(F.explode(F.from_json("payload", "array<string>")).alias("row"))
    get = lambda n: clean(F.get_json_object("row", f"$.{n}"))
    own = F.nullif(F.regexp_extract("row", r'"\:id"\s*:\s*"([^"]*)"', 1), F.lit(""))
    plan = F.coalesce(get("plaacronim"), get("planom"), F.lit("Proteccio Civil"))
    phase, url = get("plafase"), get("comunicatpdf.url")
    body = F.concat_ws("\n", get("descripcio"), F.concat(F.lit("Pla activat: "), get("plaactivat")), F.concat(F.lit("Comunicat oficial: "), url))
    external = F.coalesce(own, F.sha2(F.concat(F.lit("proteccio-civil|"), "row"), 256))
    return rows.select(
        external.alias("external_id"), F.substring(F.concat_ws(" ", plan, phase), 1, 240).alias("title"), F.concat_ws(" ", plan, phase).alias("full_title"), body.alias("body"),
        F.coalesce(url, F.lit("https://analisi.transparenciacatalunya.cat/d/wj9c-j6vf")).alias("url"), units.plan_level(phase).alias("severity"),
        F.lit(fixed.PLAN_AREA_BBOX).alias("area_bbox"), dates.plan_phase(get("fasedatahora")).alias("observed_at"),
        F.sha2(F.concat(external, F.lit("|"), "row"), 256).alias("deduplication_hash"),
    )


SNAPSHOT = (
    "struct<source_generated_at:timestamp,complete_snapshot:boolean,allow_empty_snapshot:boolean,alerts:array<struct<external_id:string,title:string,instruction:string,"
    "restriction_type:string,authority:string,level:string,area:string,url:string,sent_at:timestamp,expires_at:timestamp,geometry:string,is_test:boolean>>>"
)


def alert_snapshot(raw: DataFrame) -> DataFrame:
    """Alerts of a snapshot: tests dropped, expired and shapeless ones discarded.

    A complete snapshot without real alerts needs ``allow_empty_snapshot``.
    """
    doc = raw.select(F.from_json("payload", SNAPSHOT).alias("s")).select("s.*")
    refused = doc.filter(
        F.coalesce("complete_snapshot", F.lit(False)) & ~F.coalesce("allow_empty_snapshot", F.lit(False))
        & (F.size(F.filter(F.coalesce("alerts", F.array()), lambda a: ~F.coalesce(a["is_test"], F.lit(False)))) == 0)
    )
    if not refused.isEmpty():
        require_rows(refused.limit(0), "alert snapshot")
    rows = doc.select("source_generated_at", "complete_snapshot", F.explode("alerts").alias("a")).select("source_generated_at", "complete_snapshot", "a.*")
    live = rows.filter(~F.coalesce("is_test", F.lit(False)) & (F.col("expires_at") > F.col("source_generated_at")))
    shaped = live.withColumn("geometry", geo.parse_area(F.col("geometry"))).filter("geometry IS NOT NULL")
    cols = ["area", "authority", "expires_at", "external_id", "instruction", "level", "restriction_type", "sent_at", "title", "url"]
    return shaped.select(
        "external_id", F.substring("title", 1, 180).alias("name"), F.col("title").alias("full_title"), F.substring("restriction_type", 1, 120).alias("restriction_type"), "instruction", "authority",
        F.col("level").alias("alert_level"), "area", "url", F.col("sent_at").alias("observed_at"), "expires_at", "source_generated_at", "geometry",
        F.sha2(F.to_json(F.struct(*cols, "geometry")), 256).alias("deduplication_hash"),
    )


COUNTRIES = ["spain", "espana", "españa", "es"]


def burnt_areas(raw: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Burnt-area features: upper-case keys, country and region admission, dates and area."""
    west, south, east, north = bbox
    # Each step is evaluated once and read by the filters and columns behind it.
    rows = computed(features(raw), shape=F.get_json_object("feature", "$.geometry"), attrs=F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>"))
    rows = computed(rows, f=F.map_from_entries(F.transform(F.map_entries("attrs"), lambda e: F.struct(F.upper(e["key"]).alias("k"), e["value"].alias("v")))))
    country = clean(F.col("f")["COUNTRY"])
    rows = rows.filter((country.isNull() | F.lower(country).isin(COUNTRIES)) & (F.coalesce(F.col("f")["ID"], F.lit("")) != ""))
    rows = computed(rows, **geo.area_steps(F.col("shape")))
    rows = computed(rows, geometry=geo.area_of(F.col("kind"), F.col("parts"))).filter("geometry IS NOT NULL")
    rows = computed(rows, b=geo.bbox(F.col("geometry")))
    near = (F.col("b.xmax") >= west) & (F.col("b.xmin") <= east) & (F.col("b.ymax") >= south) & (F.col("b.ymin") <= north)
    kept = rows.filter(near)
    external = F.concat(F.lit("effis:"), F.col("f")["ID"])
    update = dates.iso(F.col("f")["LASTUPDATE"])
    return kept.select(
        external.alias("external_id"), F.col("f")["AREA_HA"].try_cast("double").alias("area_hectares"), dates.iso(F.col("f")["FIREDATE"]).alias("fire_date"),
        dates.iso(F.col("f")["FINALDATE"]).alias("final_date"), update.alias("last_update"), country.alias("country"), clean(F.col("f")["PROVINCE"]).alias("province"),
        clean(F.col("f")["COMMUNE"]).alias("commune"), "geometry", F.col("b.xmin").alias("xmin"), F.col("b.ymin").alias("ymin"), F.col("b.xmax").alias("xmax"), F.col("b.ymax").alias("ymax"),
        units.overlay(
            F.map_from_entries(F.transform(F.map_entries("f"), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))),
            F.create_map(F.lit("operational_extinction_status_available"), F.lit("false"),
                         F.lit("operational_extinction_status_note"), F.lit("EFFIS no publica les tasques operatives d'extincio.")),
        ).alias("metadata"),
        F.sha2(F.concat_ws("|", external, F.coalesce(F.date_format(update, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("")), "shape"), 256).alias("deduplication_hash"),
    )


def aircraft_registry(raw: DataFrame) -> DataFrame:
    """Registered emergency aircraft with normalized match keys."""
    schema = "struct<aircraft:array<struct<id:string,icao24:string,registration:string,operator:string,model:string,service_type:string,confidence:string>>>"
    rows = raw.select(F.explode(F.from_json("payload", schema)["aircraft"]).alias("a")).select("a.*").filter(F.col("id").startswith("ES-EMG-"))
    return rows.withColumns({"icao_key": X.icao24(F.col("icao24")), "registration_key": X.alnum_token(F.col("registration"))})


def state_vectors(raw: DataFrame) -> DataFrame:
    """Airborne positions from positional state arrays."""
    rows = raw.select("fetched_at", F.explode(F.from_json("payload", "struct<states:array<array<string>>>")["states"]).alias("s"))
    at = lambda i: F.get("s", F.lit(i))
    num = lambda i: at(i).try_cast("double")
    typed = rows.select(
        X.icao24(at(0)).alias("icao_key"), F.lower(F.coalesce(at(0), F.lit(""))).alias("icao24"), F.trim(F.coalesce(at(1), F.lit(""))).alias("callsign"), X.alnum_token(at(1)).alias("call_key"),
        at(2).alias("origin_country"), F.coalesce(F.timestamp_seconds(at(4).try_cast("decimal(18,6)")), F.col("fetched_at")).alias("observed_at"), num(5).alias("longitude"), num(6).alias("latitude"),
        F.coalesce(at(8) == "true", F.lit(False)).alias("on_ground"), F.coalesce(num(13), num(7)).alias("altitude_m"), num(9).alias("velocity_mps"),
        F.round(num(9) * 3.6, 1).alias("velocity_kmh"), num(10).alias("heading_degrees"), num(11).alias("vertical_rate_mps"), at(14).alias("squawk"), at(16).alias("position_source"),
        F.lit("OpenSky Network").alias("source_name"),
    )
    return typed.filter("longitude IS NOT NULL AND latitude IS NOT NULL AND NOT on_ground").drop("on_ground")


_LIVE = "hex,r,flight,type,squawk,lat,lon,rr_lat,rr_lon,gs,geom_rate,baro_rate,track,seen,seen_pos,alt_geom,alt_baro".split(",")


def live_positions(raw: DataFrame) -> DataFrame:
    """Airborne positions from live objects, units converted to metric."""
    rows = raw.select("fetched_at", F.explode(F.from_json("payload", f"struct<ac:array<struct<{','.join(f'{c}:string' for c in _LIVE)}>>>")["ac"]).alias("a")).select("fetched_at", "a.*")
    num = lambda c: F.col(c).try_cast("double")
    exact = num("lat").isNotNull() & num("lon").isNotNull()
    altitude = F.coalesce("alt_geom", "alt_baro")
    typed = rows.select(
        X.icao24(F.col("hex")).alias("icao_key"), X.icao24(F.col("hex")).alias("icao24"), F.trim(F.coalesce("flight", F.lit(""))).alias("callsign"), X.alnum_token(F.col("r")).alias("call_key"),
        F.lit(None).cast("string").alias("origin_country"), F.timestamp_micros(F.unix_micros("fetched_at") - F.coalesce(F.round(F.coalesce(num("seen_pos"), num("seen")) * 1e6).cast("long"), F.lit(0))).alias("observed_at"),
        F.when(exact, num("lon")).otherwise(num("rr_lon")).alias("longitude"), F.when(exact, num("lat")).otherwise(num("rr_lat")).alias("latitude"),
        F.round(altitude.try_cast("double") * 0.3048, 1).alias("altitude_m"), F.round(num("gs") * 0.514444, 1).alias("velocity_mps"), F.round(num("gs") * 1.852, 1).alias("velocity_kmh"),
        num("track").alias("heading_degrees"), F.round(F.coalesce(num("geom_rate"), num("baro_rate")) * 0.00508, 1).alias("vertical_rate_mps"), "squawk",
        F.when(exact, F.col("type")).otherwise("range_ring").alias("position_source"), F.lit("Airplanes.live").alias("source_name"), (altitude == "ground").alias("grounded"),
    )
    return typed.filter("longitude IS NOT NULL AND latitude IS NOT NULL AND NOT coalesce(grounded, false)").drop("grounded")
