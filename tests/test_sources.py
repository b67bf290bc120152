import json

import pytest
from pyspark.sql import functions as F

from emberlake.functions import fixed
from emberlake.operators import dedupe
from emberlake.plans import osint
from emberlake.sources import detections, feeds, notices, roads, traffic, weather
from emberlake.sources.raw import FeedError, region_tiles, split_json

HEADER = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\n"


def test_detection_csv_union_normalize_and_dedupe(spark, tmp_path):
    row = "40.1,-3.2,330,0.4,0.5,2025-05-12,{t},N,VIIRS,{c},2.0,290,{f},D\n"
    (tmp_path / "a.csv").write_text(HEADER + row.format(t="905", c="n", f="12.5") + row.format(t="905", c="n", f="12.5") + row.format(t="0905", c="h", f="") + "60.0" + row.format(t="1", c="l", f="1")[4:])
    (tmp_path / "b.csv").write_text(HEADER.replace(",daynight", ",extra") + "x,-3.2,1,1,1,2025-05-12,1,N,V,l,2,2,1,e\n")
    rows = detections.read_csv(spark, {"VIIRS_A": str(tmp_path / "a.csv"), "VIIRS_B": str(tmp_path / "b.csv")})
    assert rows.columns[0] == "firms_source" and {"daynight", "extra"} <= set(rows.columns)
    out = detections.normalize(rows)
    assert out.count() == 3
    assert tuple(dedupe.duplicate_counts(out, ["deduplication_hash"]).first()) == (3, 2, 1)
    first = out.filter("confidence = 0.6").first()
    assert str(first.observed_at) == "2025-05-12 09:05:00" and first.frp_mw == 12.5


def test_detection_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("latitude,longitude\n1,2\n")
    with pytest.raises(FeedError, match="acq_date"):
        detections.read_csv(spark, {"X": str(tmp_path / "c.csv")})


def test_weather(spark, raw):
    row = {"idema": "3195", "ubi": "M", "fint": "2025-05-12T10:00:00+0000", "lat": "402443N", "lon": "0034041W", "ta": "31,5", "hr": "20", "vv": "4.2", "dv": "180", "vmax": "9", "prec": "0"}
    out = weather.observations(raw(json.dumps([row, row, {"idema": "x", "lat": "1"}])))
    assert out.count() == 2 and dedupe.keep_first(out, ["deduplication_hash"], ["station_id"]).count() == 1
    first = out.first()
    assert (first.temperature_celsius, first.wind_speed_kph) == (31.5, 4.2) and first.latitude == pytest.approx(40.4119, abs=1e-3)


def test_hourly_forecast_pivots_by_period(spark, raw):
    day = {
        "fecha": "2025-05-12T00:00:00", "temperatura": [{"periodo": "14", "value": "33"}], "precipitacion": [{"periodo": "14", "value": "0,2"}],
        "humedadRelativa": [{"periodo": "14", "value": "18"}], "vientoAndRachaMax": [{"periodo": "14", "direccion": "NE", "velocidad": "12", "rachaMax": "30"}],
    }
    doc = json.dumps([{"elaborado": "2025-05-12T10:00:00", "nombre": "M", "prediccion": {"dia": [day]}}])
    places = spark.createDataFrame([("28079", 40.4, -3.7)], "municipality string, latitude double, longitude double")
    out = weather.forecasts(raw(doc).withColumn("municipality", F.lit("28079")), places).collect()
    assert len(out) == 1 and out[0].horizon_hours == 4 and out[0].wind_direction_degrees == 45.0 and out[0].precipitation_mm == 0.2


CAP = """<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>id-1</identifier><sent>2025-05-12T08:00:00+02:00</sent>
<info><language>en-GB</language><event>wind</event><severity>Extreme</severity></info>
<info><language>es-ES</language><event>Viento</event><severity>Moderate</severity><headline>Aviso de viento</headline><description>Rachas</description><instruction>Precaución</instruction>
<parameter><valueName>AEMET-Meteoalerta nivel</valueName><value>naranja</value></parameter><area><areaDesc>Priorat</areaDesc><polygon>41.25,0.5 41.75,0.5 41.5,1.25 41.25,0.5</polygon></area></info></alert>"""


def test_alert_messages(spark, raw):
    out = weather.alerts(raw(json.dumps({"feed_url": "f", "messages": [{"url": "u", "xml": CAP}]}))).first()
    assert (out.severity, out.area_bbox, out.title) == ("orange", "0.500000,41.250000,1.250000,41.750000", "Aviso de viento")
    assert out.body == "Rachas\nPrecaución" and str(out.observed_at) == "2025-05-12 06:00:00"


RSS = """<rss><channel><item><guid>g1</guid><title>Incendi a Benassal</title><description><![CDATA[<p>Text &amp; més</p>]]></description><link>https://e.org/a#f</link><pubDate>Mon, 03 Mar 2025 09:10:00 GMT</pubDate></item>
<item><title>RT by @x: res</title><link>https://nitter.net/Acc/status/9#m</link></item>
<item><title>Foc al municipi d'Benassal</title><guid>g3</guid><link>https://nitter.net/Acc/status/10#m</link><pubDate>Mon, 03 Mar 2025 11:10:00 +0200</pubDate></item></channel></rss>"""


def test_rss_and_gateway(spark, raw):
    out = feeds.publications(raw(RSS)).collect()
    assert len(out) == 3 and out[0].body == "Text & més" and str(out[0].published_at) == "2025-03-03 09:10:00"
    assert str(out[1].published_at) == "2026-07-28 00:00:00"
    posts = feeds.gateway_posts(raw(RSS), {"handle": "Acc", "authority": "A"}, "https://nitter.net/").filter("external_id = 'nitter:Acc:g3'").collect()
    assert posts[0].canonical_url == "https://x.com/Acc/status/10" and posts[0].place_hints == ["Benassal"] and str(posts[0].published_at) == "2025-03-03 09:10:00"
    assert feeds.gateway_posts(raw(RSS), {"handle": "Acc", "authority": "A"}, "https://nitter.net/").count() == 2


def test_atom_and_links(spark, raw):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>Hola</title><summary>s</summary><link href="https://e.org/x.xml"/><updated>2025-05-12T10:00:00Z</updated></entry></feed>'
    out = feeds.publications(raw(atom)).first()
    assert (out.external_id, out.url, str(out.published_at)) == ("e1", "https://e.org/x.xml", "2025-05-12 10:00:00")
    assert [r.link for r in weather.alert_links(raw(atom, atom)).collect()] == ["https://e.org/x.xml"]


def test_html(spark):
    html = "<html><script>no()</script><body><a href='/n/1'>Incendi forestal a la <b>vall</b></a><a href='x'>curt</a><p>Hola&nbsp;món 12/05/25</p><style>p{}</style></body></html>"
    pages = spark.createDataFrame([("https://e.org/d/p.html?q=1", html)], "url string, html string")
    a = feeds.anchors(pages).collect()
    assert [(r.url, r.title) for r in a] == [("https://e.org/n/1", "Incendi forestal a la vall")]
    found = osint.page_candidates(feeds.anchors(pages).withColumn("source", F.lit("s"))).withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp"))
    page = osint.enrich_from_pages(found, pages.withColumn("url", F.lit("https://e.org/n/1"))).first()
    assert page.text == "Incendi forestal a la vall curt Hola món 12/05/25" and str(page.published_at)[:10] == "2025-05-12"
    urls = [("https://e.org/a/b", "c"), ("https://e.org/a/b", "?z"), ("https://e.org", "c"), ("http://e.org/a", "//f.org/g"), ("https://e.org/a", "mailto:x")]
    got = [r[0] for r in spark.createDataFrame(urls, "b string, h string").select(feeds.absolute_url(F.col("b"), F.col("h"))).collect()]
    assert got == ["https://e.org/a/c", "https://e.org/a/b?z", "https://e.org/c", "http://f.org/g", "mailto:x"]


SITUATION = """<d2:d2LogicalModel xmlns:d2="x"><d2:situation id="s1"><d2:situationRecord xsi:type="d2:MaintenanceWorks" id="r1">
<d2:validityStatus>active</d2:validityStatus><d2:overallStartTime>2025-05-12T08:00:00Z</d2:overallStartTime><d2:roadNumber>N-150</d2:roadNumber><d2:roadMaintenanceType>roadworks</d2:roadMaintenanceType>
<d2:kilometerPoint>12</d2:kilometerPoint><d2:kilometerPoint>3.5</d2:kilometerPoint><d2:tpegDirection>both</d2:tpegDirection><d2:severity>high</d2:severity>
<d2:pointCoordinates><d2:latitude>41.5</d2:latitude><d2:longitude>2.1</d2:longitude></d2:pointCoordinates></d2:situationRecord></d2:situation></d2:d2LogicalModel>"""


def test_traffic_situations(spark, raw):
    out = traffic.restrictions(raw(SITUATION)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.road_ref, r.kind, r.cause, r.direction, r.service_level) == ("N-150", "OTRAS AFECCIONES", "Obres", "Ambdós sentits", "Vermell")
    assert r.title == "Obres: N-150 (PK 3.5 - 12)" and [(p.x, p.y) for p in r.path] == [(2.0998, 41.4998), (2.1002, 41.5002)]


def test_traffic_map_encoding(spark, raw):
    import base64

    line = {"type": "MultiLineString", "coordinates": [[[1, 2], [1.1, 2]], [[3, 4], [3.1, 4]]]}
    records = [{"id": 7, "tipoVialidad": "CORTADA", "carretera": "N-340", "provinciaIni": "Castelló", "geometria": json.dumps(line)}, {"id": 8, "geometria": '{"type":"Point","coordinates":[1,2]}'}]
    wire = base64.b64encode(bytes(b ^ fixed.TRAFFIC_MAP_XOR_KEY for b in json.dumps({"situationsRecords": records}, ensure_ascii=False).encode())).decode()
    decoded = raw(wire).withColumn("payload", traffic.decode_map(F.col("payload")))
    out = traffic.map_restrictions(decoded).collect()
    assert len(out) == 1 and out[0].title == "CORTADA - N-340 - Castelló" and len(out[0].paths) == 2


def test_roads(spark, raw):
    feature = {"type": "Feature", "id": "f1", "properties": {"nombre": "Carretera", "localId": "L1", "roadClass": "main"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    doc = json.dumps({"type": "FeatureCollection", "features": [feature, feature, {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]})
    out = dedupe.keep_first(roads.transport_features(raw(doc)), ["deduplication_hash"], ["external_id"]).collect()
    assert [(r.external_id, r.name, r.road_ref, r.road_class) for r in out] == [("f1", "Carretera", "L1", "main")]
    way = {"type": "way", "id": 5, "tags": {"highway": "track", "maxweight": "3.5t", "width": "2,5", "name": "X"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 1.1, "lon": 2.1}]}
    w = roads.ways(raw(json.dumps({"elements": [way, {"type": "node", "id": 1}]}))).collect()
    assert len(w) == 1 and (w[0].max_weight_tons, w[0].width_meters, w[0].name) == (3.5, 2.5, None)
    answer = '{"results":[{"paramName":"localizacion","value":[[\'380414.6\',4493761.41]]},{"paramName":"x","value":[]}],"z":\'05\'}'
    p = roads.projected_points(raw(answer)).collect()
    assert [(r.x, r.y) for r in p] == [(380414.6, 4493761.41)]


def test_tiles_cover_a_region(spark):
    tiles = region_tiles(spark, "0,0,1,0.5", 0.4).collect()
    assert len(tiles) == 6 and max(t.east for t in tiles) == 1.0 and max(t.north for t in tiles) == 0.5


def test_plans(spark, raw):
    row = {":id": "row-1", "plaacronim": "INFOCAT", "plafase": "ALERTA", "plaactivat": "Sí", "fasedatahora": "12/05/2025 10:15", "descripcio": "Foc", "comunicatpdf": {"url": "https://e.org/c.pdf"}}
    out = notices.plans(raw(json.dumps([row]))).first()
    assert (out.external_id, out.title, out.severity) == ("row-1", "INFOCAT ALERTA", "orange")
    assert out.body == "Foc\nPla activat: Sí\nComunicat oficial: https://e.org/c.pdf" and str(out.observed_at) == "2025-05-12 10:15:00"


def snapshot(**kw):
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    alert = {"external_id": "a", "title": "t", "restriction_type": "r", "sent_at": "2025-05-12T10:00:00Z", "expires_at": "2025-05-12T20:00:00Z", "geometry": shape, "is_test": False}
    alert.update(kw)
    return alert


def test_alert_snapshot_admission(spark, raw):
    doc = {"source_generated_at": "2025-05-12T12:00:00Z", "complete_snapshot": True, "alerts": [snapshot(), snapshot(external_id="t", is_test=True), snapshot(external_id="o", expires_at="2025-05-12T11:00:00Z"), snapshot(external_id="g", geometry={"type": "Point", "coordinates": [0, 0]})]}
    assert [r.external_id for r in notices.alert_snapshot(raw(json.dumps(doc))).collect()] == ["a"]
    empty = {"source_generated_at": "2025-05-12T12:00:00Z", "complete_snapshot": True, "alerts": [snapshot(is_test=True)]}
    with pytest.raises(FeedError):
        notices.alert_snapshot(raw(json.dumps(empty)))
    assert notices.alert_snapshot(raw(json.dumps({**empty, "allow_empty_snapshot": True}))).count() == 0


def test_burnt_areas(spark, raw):
    shape = {"type": "Polygon", "coordinates": [[[-3, 40], [-2.9, 40], [-2.9, 40.1], [-3, 40]]]}
    props = {"id": 1, "FIREDATE": "2024-05-01", "LASTUPDATE": "2025-05-12 10:00:00", "COUNTRY": "Spain", "PROVINCE": "Madrid", "COMMUNE": " X ", "AREA_HA": 12.5, "CONIFER": 3.0}
    far = {"type": "Polygon", "coordinates": [[[30, 40], [31, 40], [31, 41], [30, 40]]]}
    features = [{"properties": props, "geometry": shape}, {"properties": {**props, "COUNTRY": "France"}, "geometry": shape}, {"properties": props, "geometry": far}, {"properties": {"COUNTRY": "Spain"}, "geometry": shape}]
    out = notices.burnt_areas(raw(json.dumps({"type": "FeatureCollection", "features": features})), fixed.SPAIN_BBOX).collect()
    assert len(out) == 1 and out[0].area_hectares == 12.5 and out[0].commune == "X" and out[0].metadata["conifer"] == "3.0"


def test_aircraft(spark, raw):
    from emberlake.plans.aircraft import live_aircraft

    registry = notices.aircraft_registry(raw(json.dumps({"aircraft": [{"id": "ES-EMG-1", "icao24": "34A1B2", "registration": "EC-ABC", "operator": "OP"}, {"id": "ES-EMG-2", "registration": "EC-XYZ"}, {"id": "XX", "icao24": "000001"}]})))
    state = ["34a1b2", "CALL ", "Spain", None, 1785196800, -3.5, 40.1, 900, False, 50.0, 90.0, 1.5, None, 950.5, "7000", False, 0]
    grounded = ["34a1b2", "C", "Spain", None, 1785196800, -3.5, 40.1, 0, True]
    a = notices.state_vectors(raw(json.dumps({"states": [state, grounded]})))
    live = [{"hex": "bad", "r": "EC-XYZ", "flight": "F1", "rr_lat": 41.0, "rr_lon": 1.0, "gs": 100, "alt_baro": 1000, "seen_pos": 5, "baro_rate": 200}, {"hex": "34a1b2", "r": "EC-ABC", "lat": 1, "lon": 1, "alt_baro": "ground"}]
    b = notices.live_positions(raw(json.dumps({"ac": live})))
    out = {r.aircraft.id: r for r in live_aircraft([a, b], registry, "2026-07-28 01:00:00").collect()}
    assert out["ES-EMG-1"].velocity_kmh == 180.0 and out["ES-EMG-1"].confidence == 0.82 and out["ES-EMG-1"].altitude_m == 950.5
    two = out["ES-EMG-2"]
    assert (two.velocity_mps, two.velocity_kmh, two.altitude_m, two.vertical_rate_mps, two.position_source) == (51.4, 185.2, 304.8, 1.0, "range_ring")


def test_posts_catalogue_intake_and_dead_letters(spark, raw):
    doc = {"data": [{"id": "1", "text": "t", "author_id": "u", "created_at": "2025-05-12T10:00:00Z"}], "includes": {"users": [{"id": "u", "name": "N", "username": "Emer"}]}}
    posts, users = feeds.post_tables(raw(json.dumps(doc)))
    out = osint.social_posts(posts, users, ["emer"]).first()
    assert (out.url, out.source_type, out.reliability, out.authority) == ("https://x.com/Emer/status/1", "official", 0.95, "N")
    sources = [{"name": "a", "url": "u", "enabled": False}, {"name": "b", "url": "v"}]
    assert [r.name for r in feeds.catalogue(raw(json.dumps(sources))).collect()] == ["b"]
    good, bad = feeds.intake(raw(json.dumps([{"external_id": "1", "title": "t", "locations": ["X"]}])), max_batch=1)
    assert good.first().locations == ["X"] and bad.count() == 0
    assert feeds.intake(raw(json.dumps([{"external_id": "1"}, {"external_id": "2"}])), max_batch=1)[1].count() == 1
    ok, dead = split_json(raw("{not json", '{"a":1}'), "struct<a:int>")
    assert ok.count() == 1 and dead.first().rule == "payload_is_json"


def test_anchors_of_pages_with_one_address(spark):
    pages = spark.createDataFrame([(1, "https://e.org/p", "<a href='x'>un</a>"), (2, "https://e.org/p", "<a href='y'>dos</a><a href='z'>tres</a>")], "page_id long, url string, html string")
    found = feeds.anchors(pages, min_length=0, keep=("page_id",))
    assert {r.page_id: r["count"] for r in found.groupBy("page_id").count().collect()} == {1: 1, 2: 2}


def test_positions_within_one_second_have_an_order(spark, raw):
    from emberlake.plans.aircraft import live_aircraft

    registry = notices.aircraft_registry(raw(json.dumps({"aircraft": [{"id": "ES-EMG-1", "icao24": "34A1B2", "registration": "EC-ABC", "operator": "OP"}]})))
    state = lambda at, speed: ["34a1b2", "CALL", "Spain", None, at, -3.5, 40.1, 900, False, speed, 90.0]
    for speeds in ([30.0, 50.0, 40.0, 90.0], [90.0, 40.0, 50.0, 30.0]):
        at = {30.0: "1785196800.25", 50.0: "1785196800.75", 40.0: "1785196800.75", 90.0: "1785196800.5"}
        a = notices.state_vectors(raw(json.dumps({"states": [state(at[s], s) for s in speeds]})))
        assert [r.velocity_mps for r in live_aircraft([a], registry, "2026-07-28 01:00:00").collect()] == [50.0]
