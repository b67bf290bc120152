"""Road networks: GeoJSON features, way documents, and the reference network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import fixed, geo, units
from emberlake.functions.text import clean
from emberlake.operators.stage import computed


def features(raw: DataFrame) -> DataFrame:
    """One row per feature of a GeoJSON FeatureCollection payload (feature as JSON text)."""
    doc = F.from_json("payload", "struct<type:string,features:array<string>>")
    return computed(raw.select("payload"), doc=doc).filter("doc.type = 'FeatureCollection'").select(F.explode("doc.features").alias("feature"))


def transport_features(raw: DataFrame) -> DataFrame:
    """Road lines with id fallbacks and mapped properties."""
    get = lambda path: F.get_json_object("feature", path)
    prop = lambda *names: clean(F.coalesce(*[F.nullif(get(f"$.properties.{n}"), F.lit("")) for n in names]))
    rows = features(raw).withColumns({"geom": get("$.geometry"), "props": get("$.properties")}).filter("geom IS NOT NULL AND props IS NOT NULL")
    shaped = rows.withColumn("geometry", geo.parse_line(F.col("geom"))).filter("geometry IS NOT NULL")
    external = F.coalesce(F.nullif(get("$.id"), F.lit("")), F.nullif(get("$.properties.localId"), F.lit("")), F.sha2(F.concat("geom", F.lit("|"), "props"), 256))
    return shaped.select(
        external.alias("external_id"), prop("name", "nombre").alias("name"), prop("nationalRoadCode", "localId").alias("road_ref"),
        prop("formOfWay", "roadClass").alias("road_class"), "geometry", F.lit("official").alias("provenance"),
        F.sha2(F.concat(external, F.lit("|"), "props"), 256).alias("deduplication_hash"),
    )


WAYS = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"


def ways(raw: DataFrame) -> DataFrame:
    """Road lines from way elements. Only the retained tags feed the columns, so name and ref stay empty."""
    e = raw.select(F.explode(F.from_json("payload", WAYS)["elements"]).alias("e")).select("e.*").filter("type = 'way' AND geometry IS NOT NULL")
    tags = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(fixed.WAY_TAGS))
    path = F.transform(F.filter("geometry", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()), lambda p: geo.xy(p["lon"], p["lat"]))
    external = F.concat(F.lit("osm-way:"), F.col("id").cast("string"))
    sorted_tags = F.map_from_entries(F.array_sort(F.map_entries("kept")))
    return (
        e.withColumns({"kept": tags, "geom": geo.line(path), "external_id": external}).filter("geom IS NOT NULL")
        .select(
            "external_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("road_ref"), clean(F.col("kept")["highway"]).alias("road_class"),
            clean(F.col("kept")["surface"]).alias("surface"), units.tagged_number(F.col("kept")["width"]).alias("width_meters"),
            clean(F.col("kept")["access"]).alias("access"), units.tagged_number(F.col("kept")["maxweight"]).alias("max_weight_tons"),
            clean(F.col("kept")["incline"]).alias("incline"), F.col("tags").alias("all_tags"), F.col("geom").alias("geometry"),
            F.lit("observed").alias("provenance"), F.sha2(F.concat("external_id", F.lit("|"), F.to_json(sorted_tags)), 256).alias("deduplication_hash"),
        )
    )


def network_segments(raw: DataFrame) -> DataFrame:
    """Reference network lines (segment_id, name, code, path) from GeoJSON features."""
    get = lambda path: F.get_json_object("feature", path)
    rows = features(raw).select(get("$.properties.nombre").alias("name"), get("$.properties.codigo").alias("code"), geo.parse_line(get("$.geometry")).alias("g"), "feature")
    return rows.filter("g IS NOT NULL").select(F.sha2("feature", 256).alias("segment_id"), "name", "code", F.col("g.parts")[0][0].alias("path"))


def network_posts(raw: DataFrame) -> DataFrame:
    """Kilometre posts (name, number, point) from GeoJSON point features."""
    get = lambda path: F.get_json_object("feature", path)
    return features(raw).select(
        get("$.properties.nombre").alias("name"), get("$.properties.numero").alias("number"),
        geo.xy(get("$.geometry.coordinates[0]").try_cast("double"), get("$.geometry.coordinates[1]").try_cast("double")).alias("point"),
    )


def projected_points(raw: DataFrame) -> DataFrame:
    """Kilometre service answers: (url, position, x, y) with single-quoted tokens repaired, plus lon/lat."""
    fixed_text = F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise(F.regexp_replace("payload", r"'([^'\\]*)'", '"$1"'))
    schema = "struct<results:array<struct<paramName:string,value:array<array<string>>>>>"
    results = F.filter(F.from_json(fixed_text, schema)["results"], lambda r: r["paramName"] == "localizacion")
    rows = raw.select("url", F.posexplode(F.flatten(F.transform(results, lambda r: r["value"]))).alias("position", "v"))
    xy = rows.select("url", "position", F.get("v", F.lit(0)).try_cast("double").alias("x"), F.get("v", F.lit(1)).try_cast("double").alias("y"))
    return xy.filter("x IS NOT NULL AND y IS NOT NULL").withColumn("point", geo.utm30_to_lonlat(F.col("x"), F.col("y")))
