"""Weather observations, hourly forecasts, and alert messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import dates, geo, units
from emberlake.functions.text import clean

OBSERVATION = "array<struct<idema:string,ubi:string,fint:string,lat:string,lon:string,ta:string,hr:string,vv:string,dv:string,vmax:string,prec:string>>"


def observations(raw: DataFrame) -> DataFrame:
    """Station rows with position and time; wind speed is kept in the unit of the feed."""
    rows = raw.select(F.explode(F.from_json("payload", OBSERVATION)).alias("r")).select("r.*")
    typed = rows.withColumns({"latitude": units.dms(F.col("lat")), "longitude": units.dms(F.col("lon")), "observed_at": dates.iso(F.col("fint"))})
    stamp = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    external = F.concat(F.lit("obs:"), F.coalesce("idema", F.lit("")), F.lit(":"), stamp)
    kept = typed.filter("latitude IS NOT NULL AND longitude IS NOT NULL AND observed_at IS NOT NULL").withColumn("external_id", external)
    numbers = {"wind_speed_kph": "vv", "wind_direction_degrees": "dv", "wind_gust_kph": "vmax", "temperature_celsius": "ta", "humidity_percent": "hr", "precipitation_mm": "prec"}
    return kept.select(
        "external_id", clean(F.col("idema")).alias("station_id"), "observed_at", "latitude", "longitude",
        *[units.number(F.col(c)).alias(n) for n, c in numbers.items()],
        units.canonical_hash(F.col("external_id"), F.struct(*sorted(rows.columns))).alias("deduplication_hash"),
    )


_VALUES = "array<struct<periodo:string,value:string>>"
FORECAST = (
    f"array<struct<elaborado:string,nombre:string,prediccion:struct<dia:array<struct<fecha:string,temperatura:{_VALUES},precipitacion:{_VALUES},"
    f"humedadRelativa:{_VALUES},vientoAndRachaMax:array<struct<periodo:string,direccion:string,velocidad:string,rachaMax:string>>>>>>>"
)


def forecasts(raw: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per municipality and hour from four parallel period lists.

    ``raw`` carries ``municipality``; ``locations`` is (municipality, latitude, longitude).
    """
    root = raw.select("municipality", F.get(F.from_json("payload", FORECAST), F.lit(0)).alias("f"))
    day = root.select("municipality", dates.iso(F.col("f.elaborado")).alias("issued_at"), F.explode("f.prediccion.dia").alias("d"))
    slot = lambda c, name: F.transform(F.coalesce(F.col(f"d.{c}"), F.array()), lambda v: F.struct(
        F.coalesce(v["periodo"], F.lit("")).alias("periodo"), F.lit(name).alias("name"), v["value"].alias("value")))
    wind = F.flatten(F.transform(F.coalesce(F.col("d.vientoAndRachaMax"), F.array()), lambda v: F.array(*[
        F.struct(F.coalesce(v["periodo"], F.lit("")).alias("periodo"), F.lit(n).alias("name"), v[n].alias("value")) for n in ("direccion", "velocidad", "rachaMax")])))
    every = F.concat(slot("temperatura", "temperatura"), slot("precipitacion", "precipitacion"), slot("humedadRelativa", "humedadRelativa"), wind)
    rows = day.select("municipality", "issued_at", F.col("d.fecha").alias("fecha"), F.explode(every).alias("s")).select("municipality", "issued_at", "fecha", "s.*")
    names = ["temperatura", "precipitacion", "humedadRelativa", "direccion", "velocidad", "rachaMax"]
    wide = rows.groupBy("municipality", "issued_at", "fecha", "periodo").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    timed = wide.withColumn("forecast_for", dates.forecast_hour(dates.iso(F.col("fecha")), F.col("periodo"))).filter("forecast_for IS NOT NULL")
    external = F.concat(F.lit("forecast:"), "municipality", F.lit(":"), F.date_format("forecast_for", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return timed.join(locations, "municipality").select(
        external.alias("external_id"), F.col("municipality").alias("municipality_id"), "issued_at", "forecast_for", "latitude", "longitude",
        units.number(F.col("velocidad")).alias("wind_speed_kph"), units.compass(F.col("direccion")).alias("wind_direction_degrees"),
        units.number(F.col("rachaMax")).alias("wind_gust_kph"), units.number(F.col("temperatura")).alias("temperature_celsius"),
        units.number(F.col("humedadRelativa")).alias("humidity_percent"), units.number(F.col("precipitacion")).alias("precipitation_mm"),
        dates.horizon_hours(F.col("issued_at"), F.col("forecast_for")).alias("horizon_hours"),
        units.canonical_hash(external, F.struct("periodo", *sorted(names))).alias("deduplication_hash"),
    )


_INFO = (
    "info array<struct<language:string,event:string,severity:string,urgency:string,certainty:string,headline:string,description:string,instruction:string,"
    "web:string,onset:string,expires:string,parameter:array<struct<valueName:string,value:string>>,area:array<struct<areaDesc:string,polygon:string>>>>"
)


def alerts(raw: DataFrame) -> DataFrame:
    """Alert messages from an envelope ``{"feed_url", "messages": [{"url", "xml"}]}``.

    The Spanish block is preferred; the level comes from the "nivel" parameter, else
    from the severity.
    """
    envelope = F.from_json("payload", "struct<feed_url:string,messages:array<struct<url:string,xml:string>>>")
    rows = raw.select(envelope.alias("e")).select("e.feed_url", F.explode("e.messages").alias("m")).select("feed_url", "m.url", "m.xml")
    doc = F.from_xml("xml", f"struct<identifier:string,sent:string,{_INFO.replace('info array', 'info:array')}>", {"ignoreNamespace": "true"})
    parsed = rows.select("feed_url", "url", doc.alias("a")).filter("a.identifier IS NOT NULL AND size(a.info) > 0")
    spanish = F.filter("a.info", lambda i: F.lower(F.coalesce(i["language"], F.lit(""))).startswith("es"))
    one = parsed.withColumn("i", F.coalesce(F.get(spanish, F.lit(0)), F.get("a.info", F.lit(0))))
    named = F.filter("i.parameter", lambda p: F.contains(F.lower(F.coalesce(p["valueName"], F.lit(""))), F.lit("nivel")))
    level = F.when(F.size(F.coalesce(named, F.array())) > 0, units.alert_level(F.get(named, F.lit(0))["value"])).otherwise(units.severity_level(clean(F.col("i.severity"))))
    area = F.get("i.area", F.lit(0))
    out = one.select(
        clean(F.col("a.identifier")).alias("external_id"),
        F.substring(F.coalesce(clean(F.col("i.headline")), clean(F.col("i.event")), F.lit("Avís AEMET")), 1, 240).alias("title"),
        F.coalesce(clean(F.col("i.headline")), clean(F.col("i.event")), F.lit("Avís AEMET")).alias("full_title"),
        F.concat_ws("\n", clean(F.col("i.description")), clean(F.col("i.instruction"))).alias("body"),
        F.coalesce(clean(F.col("i.web")), F.col("url")).alias("url"), level.alias("severity"), dates.iso(F.col("a.sent")).alias("observed_at"),
        area["areaDesc"].alias("area"), geo.polygon_text_bbox(area["polygon"]).alias("area_bbox"), clean(F.col("i.onset")).alias("onset"),
        clean(F.col("i.expires")).alias("expires"), clean(F.col("i.event")).alias("event"), F.col("url").alias("cap_url"),
    )
    payload = F.struct("area", "area_bbox", "cap_url", "event", "expires", "onset", "severity")
    return out.withColumn("deduplication_hash", units.canonical_hash(F.col("external_id"), payload))


def alert_links(raw: DataFrame) -> DataFrame:
    """Distinct .xml links of a feed index."""
    from emberlake.sources.feeds import items

    return items(raw).filter(F.lower("link").endswith(".xml")).select("link").distinct()
