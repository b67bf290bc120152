"""Traffic restrictions: situation XML and the encoded map feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import dates, fixed, geo, units
from emberlake.functions.text import clean
from emberlake.operators.stage import computed


def _texts(name: str, xml: str = "xml") -> Column:
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?:\s[^>]*)?>([^<]*)</{name}>"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")


def _text(*names: str) -> Column:
    return F.coalesce(*[F.get(_texts(n), F.lit(0)) for n in names])


def _distinct_text(name: str) -> Column:
    return F.nullif(F.array_join(F.array_distinct(_texts(name)), " - "), F.lit(""))


def situations(raw: DataFrame) -> DataFrame:
    """(feed_url, situation_id, record_id, record_type, xml): situation records without namespace prefixes."""
    bare = raw.select("url", F.regexp_replace(F.regexp_replace("payload", r"(</?)\w+:", "$1"), r"\s(?:xmlns(?::\w+)?|\w+:schemaLocation)=\"[^\"]*\"", "").alias("doc"))
    one = bare.select("url", F.explode(F.regexp_extract_all("doc", F.lit(r"(?s)(<situation\b.*?</situation>)"), F.lit(1))).alias("s"))
    sid = F.coalesce(F.nullif(F.regexp_extract("s", r"^<situation\b[^>]*\bid=\"([^\"]*)\"", 1), F.lit("")), F.sha2(F.concat("url", F.lit("|"), "s"), 256))
    rec = one.select("url", sid.alias("situation_id"), F.explode(F.regexp_extract_all("s", F.lit(r"(?s)(<situationRecord\b.*?</situationRecord>)"), F.lit(1))).alias("xml"))
    rid = F.coalesce(F.nullif(F.regexp_extract("xml", r"^<situationRecord\b[^>]*\bid=\"([^\"]*)\"", 1), F.lit("")), _text("situationRecordCreationReference"), F.col("situation_id"))
    typed = F.nullif(F.regexp_extract("xml", r"^<situationRecord\b[^>]*\b(?:\w+:)?type=\"(?:\w+:)?([^\"]*)\"", 1), F.lit(""))
    kind = F.coalesce(typed, _text("roadMaintenanceType", "trafficConstrictionType", "accidentType", "mobilityType"), F.lit("situationRecord"))
    return rec.select(F.col("url").alias("feed_url"), "situation_id", rid.alias("record_id"), kind.alias("record_type"), "xml")


def restrictions(raw: DataFrame) -> DataFrame:
    """Normalized restrictions with labels, title, kilometre range and a two-point (or longer) path."""
    points = F.regexp_extract_all("xml", F.lit(r"(?s)<pointCoordinates(?:\s[^>]*)?>(.*?)</pointCoordinates>"), F.lit(1))
    pair = lambda p: geo.xy(
        F.regexp_extract(p, r"<longitude>\s*([^<\s]*)\s*</longitude>", 1).try_cast("double"), F.regexp_extract(p, r"<latitude>\s*([^<\s]*)\s*</latitude>", 1).try_cast("double")
    )
    coords = F.filter(F.transform(points, pair), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rows = computed(
        situations(raw), coords=coords, cause_type=_text("causeType"), detail=_text("detailedCauseType"), maintenance=_text("roadMaintenanceType"),
        management=_text("roadOrCarriagewayOrLaneManagementType"), constriction=_text("trafficConstrictionType"), mobility=_text("mobilityType"), accident=_text("accidentType"),
        lane=_text("laneUsage"), way=_text("tpegDirectionRoad", "tpegDirection"), severity=_text("severity"), road_ref=_text("roadNumber", "roadName"),
        kilometer_points=F.array_distinct(_texts("kilometerPoint")), comments=_texts("value"), validity_status=_text("validityStatus"),
        province=_distinct_text("province"), municipalities=_distinct_text("municipality"), community=_distinct_text("autonomousCommunity"),
        started=_text("overallStartTime", "situationRecordCreationTime"), ended=_text("overallEndTime"),
    )
    p0, d = F.col("coords")[0], 0.0002
    short = F.array(geo.xy(p0["x"] - d, p0["y"] - d), geo.xy(p0["x"] + d, p0["y"] + d))
    cause = F.coalesce(
        units.label(F.col("detail"), fixed.DETAIL_LABELS), units.label(F.col("maintenance"), fixed.DETAIL_LABELS),
        units.label(F.col("cause_type"), fixed.CAUSE_LABELS), units.label(F.col("management"), fixed.DETAIL_LABELS),
    )
    words = F.concat_ws(" ", "record_type", "cause_type", "detail", "maintenance", "management", "constriction", "mobility", "accident")
    shaped = rows.filter(F.size("coords") >= 1).withColumns(
        {
            "path": F.when(F.size("coords") == 1, short).otherwise(F.col("coords")), "cause": cause, "kind": units.traffic_category(words),
            "kilometer_range": units.kilometer_range(F.col("kilometer_points")), "external_id": F.concat("feed_url", F.lit("#"), "record_id"),
        }
    )
    head = F.coalesce("cause", units.label(F.col("record_type"), fixed.DETAIL_LABELS))
    title = F.coalesce(
        F.substring(F.get("comments", F.lit(0)), 1, 240),
        F.concat(head, F.lit(": "), "road_ref", F.lit(" ("), "kilometer_range", F.lit(")")),
        F.concat(head, F.lit(": "), "road_ref"), F.concat(head, F.lit(": "), "municipalities"), F.col("record_type"),
    )
    out = shaped.select(
        "external_id", "feed_url", "situation_id", "record_id", "record_type", "kind", title.alias("title"), "road_ref", "path", F.array("path").alias("paths"),
        "cause_type", "cause", units.label(F.col("lane"), fixed.LANE_LABELS).alias("affected_lane"), units.label(F.col("way"), fixed.DIRECTION_LABELS).alias("direction"),
        units.label(F.col("severity"), fixed.SERVICE_LABELS).alias("service_level"), "kilometer_points", "kilometer_range", "province", "municipalities",
        F.col("community").alias("autonomous_community"), "comments", "validity_status", dates.iso(F.col("started")).alias("observed_at"),
        dates.iso(F.col("ended")).alias("expires_at"), F.lit("nap_datex_coordinates").alias("strategy"),
    )
    payload = F.struct(*sorted(c for c in out.columns if c not in ("observed_at", "expires_at", "paths")))
    return out.withColumn("deduplication_hash", units.canonical_hash(F.col("external_id"), payload))


def decode_map(payload: Column) -> Column:
    """Base64, then one fixed byte flipped into every byte: a character translation over Latin-1."""
    key = fixed.TRAFFIC_MAP_XOR_KEY
    source = "".join(chr(i) for i in range(256) if i != key)
    target = "".join(chr(i ^ key) for i in range(256) if i != key)
    flipped = F.translate(F.decode(F.unbase64(payload), "ISO-8859-1"), source, target)
    return F.decode(F.encode(flipped, "ISO-8859-1"), "UTF-8")


MAP_FIELDS = ["id", "situationId", "tipoVialidad", "subtipoVialidad", "fechaInicio", "estado", "fuente", "causa", "subcausa", "carretera", "sentido", "provinciaIni", "municipioIni", "geometria"]


def map_restrictions(raw: DataFrame) -> DataFrame:
    """Line restrictions of the map feed (payload already decoded); points are not restrictions."""
    schema = f"struct<situationsRecords:array<struct<{','.join(f'{f}:string' for f in MAP_FIELDS)}>>>"
    rows = raw.select(F.explode(F.from_json("payload", schema)["situationsRecords"]).alias("r")).select("r.*")
    lines = rows.withColumn("paths", geo.parse_lines(F.col("geometria"))).filter(F.size("paths") > 0)
    kind = F.coalesce(clean(F.col("tipoVialidad")), clean(F.col("causa")), F.lit("etraffic"))
    title = F.nullif(F.concat_ws(" - ", kind, clean(F.col("subtipoVialidad")), clean(F.col("carretera")), clean(F.col("provinciaIni"))), F.lit(""))
    everything = F.to_json(F.struct(*sorted(MAP_FIELDS)))
    external = F.concat(F.lit("etraffic:"), F.coalesce(clean(F.col("id")), F.sha2(everything, 256)))
    return lines.select(
        external.alias("external_id"), F.substring(F.coalesce(title, clean(F.col("causa")), F.lit("DGT eTraffic")), 1, 240).alias("title"),
        F.coalesce(title, clean(F.col("causa")), F.lit("DGT eTraffic")).alias("full_title"), clean(F.col("carretera")).alias("road_ref"),
        kind.alias("kind"), "paths", F.get_json_object("geometria", "$.type").alias("geometry_type"), clean(F.col("causa")).alias("cause"), clean(F.col("subcausa")).alias("subcause"),
        clean(F.col("fuente")).alias("source_authority"), F.col("fechaInicio").try_cast("timestamp").alias("observed_at"),
        F.sha2(F.concat(external, F.lit("|"), everything), 256).alias("deduplication_hash"),
    )
