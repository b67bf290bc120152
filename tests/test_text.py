import unicodedata

import pytest
from pyspark.sql import functions as F

from emberlake.functions import text as X
from emberlake.operators import mentions
from emberlake.plans import osint


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def reference_normal(value):
    folded = unicodedata.normalize("NFKD", value.lower())
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).split())


def test_normalize_follows_compatibility_decomposition(spark):
    texts = ["  Evacuació   d'Artana\t", "Ñandú çÀÈÌÒÙ ïü", "l·l COL·LAPSE…", "ﬁ ﬂ ½ ™ №", "ÅŁß ŀ", "a b c", "Ωμέγα Привет й", "Ｆｕｌｌ", "é"]
    assert values(spark, texts, X.normalize) == [reference_normal(t) for t in texts]


@pytest.mark.parametrize(
    "text, event, risk",
    [
        ("Ordre de confinament per incendi forestal", "confinement_order", "wildfire"),
        ("Levantado el confinamiento en la zona", "confinement_lift", "other"),
        ("Baso-sutea: ebakuatzeko agindua", "evacuation_order", "wildfire"),
        ("S'ha enviat ES-Alert per inundació", "es_alert_sent", "flood"),
        ("ES-Alert i evacueu la zona", "other_emergency_update", "other"),
        ("Seguim treballant #IFArtana", "firefighting_update", "wildfire"),
        ("Varios #IIFF en la provincia", "firefighting_update", "wildfire"),
        ("Bon dia", "other_emergency_update", "other"),
    ],
)
def test_event_and_risk(spark, text, event, risk):
    df = spark.createDataFrame([(text, "", "official")], "title string, body string, source_type string")
    row = osint.classify_publications(df).first()
    assert (row.event_type, row.risk_type) == (event, risk)


def test_body_only_fills_an_empty_title_with_more_than_a_risk_notice(spark):
    rows = [("Nota", "Alerta por riesgo de tormenta", "official"), ("Nota", "Incendio controlado", "official")]
    out = osint.classify_publications(spark.createDataFrame(rows, "title string, body string, source_type string")).collect()
    assert [r.event_type for r in out] == ["other_emergency_update", "firefighting_update"]


def test_action_and_alert_states(spark):
    events = ["evacuation_lift", "plan_update", "evacuation_order", "es_alert_cancelled", "fire_extinguished"]
    assert values(spark, events, X.action_state) == ["ended", "updated", "started", "ended", "ended"]
    states = [("es_alert_sent", "official"), ("es_alert_sent", "individual"), ("es_alert_received", "official"), ("es_alert_announcement", "x"), ("es_alert_test", "x"), ("plan_update", "x")]
    df = spark.createDataFrame(states, "e string, s string")
    got = [r[0] for r in df.select(X.es_alert_evidence(F.col("e"), F.col("s"))).collect()]
    assert got == ["confirmed_sent", "presumed_received", "presumed_received", "announced", "test", "not_applicable"]


def test_language(spark):
    texts = ["els veins amb les claus", "los vecinos del pueblo", "sute bat eta udalerri hau", "unha evacuacion no concello", "plain words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.v for r in df.select("i", X.language("t").alias("v")).orderBy("i").collect()] == ["ca", "es", "eu", "gl", "und"]


def test_instructions_keep_marked_sentences(spark):
    text = "Hi ha un incendi. Confineu-vos a casa! Tanqueu portes.\nSeguiu les indicacions."
    assert values(spark, [text, "res"], X.instructions) == ["Confineu-vos a casa! Seguiu les indicacions.", None]


def test_literal_alert_message(spark):
    text = 'Text literal: "Incendi forestal a prop. Tanqueu portes i finestres."'
    assert values(spark, [text, "sense"], X.es_alert_message) == ["Incendi forestal a prop. Tanqueu portes i finestres.", None]


def test_places_and_tags(spark):
    text = "Evacuació al municipi d'Artana, i a la zona de La Vall d'Uixó. #IFArtana #ifartana #InfoCat #IF1 x#IFno"
    assert values(spark, [text], X.places) == [["Artana", "Vall d'Uixó"]]
    assert values(spark, [text], X.incident_hashtags) == [["#IFArtana", "#ifartana"]]


def test_arrows(spark):
    text = "✅ Ourense ➡️ Larouco\n✅ Zamora → Castromil. Final"
    assert values(spark, [text], lambda c: X.arrow_side(c, 1)) == [["Ourense", "Zamora"]]
    assert values(spark, [text], lambda c: X.arrow_side(c, 2)) == [["Larouco", "Castromil"]]


def test_publication_hash_ignores_fragment_and_slash(spark):
    df = spark.createDataFrame([("https://e.org/a/#x", "Tèxt  u"), ("https://e.org/a", "text U")], "u string, t string")
    assert df.select(X.publication_hash(F.col("u"), X.normalize(F.col("t"))).alias("h")).distinct().count() == 1


def test_tokens(spark):
    assert values(spark, ["ec-123 ", None], X.alnum_token) == ["EC123", ""]
    assert values(spark, ["3A-bC 12", "xyz"], X.icao24) == ["3abc12", ""]
    assert values(spark, ["N-340, e 15/AP-7"], X.road_ref_tokens) == [["N340", "E", "15", "AP7"]]
    df = spark.createDataFrame([("A-3; N-340", "n-340"), ("N-3401", "N-340")], "v string, r string")
    assert [r[0] for r in df.select(X.matches_road_ref(F.col("v"), F.col("r"))).collect()] == [True, False]


def brute_mentions(names, text):
    """Longest-first, non-overlapping mentions by direct search."""
    import re

    words = X.plain(text)
    words = " ".join(re.sub(r"[^a-z0-9]+", " ", words).split())
    hits = []
    for name in names:
        forms = [name]
        if ", " in name and X.plain(name.rsplit(", ", 1)[1]) in {"la", "el", "les", "els", "los", "las", "o", "a"}:
            base, article = name.rsplit(", ", 1)
            forms.append(f"{article} {base}")
        for form in forms:
            norm = " ".join(re.sub(r"[^a-z0-9]+", " ", X.plain(form)).split())
            if len(norm.replace(" ", "")) < 4 or norm == "agost":
                continue
            if " " not in norm and not re.search(rf"(?<!\w){re.escape(form)}(?!\w)", text):
                continue
            for m in re.finditer(rf"(?<!\w){re.escape(norm)}(?!\w)", words):
                hits.append((m.start(), m.end(), name))
    found, end = [], -1
    for start, stop, name in sorted(hits, key=lambda h: (h[0], -(h[1] - h[0]), h[2])):
        if start >= end:
            end = stop
            if name not in found:
                found.append(name)
    return found[:20]


def test_mention_join_matches_direct_search(spark):
    names = ["Artana", "Vall d'Uixó, la", "Vall", "San Roque del Acebal", "San Roque", "Agost", "Ib", "Llanes", "Sant Mateu"]
    texts = [
        "Incendi a la Vall d'Uixó i a Artana.", "el foc de artana no compta", "San Roque del Acebal y San Roque, cerca de Llanes", "Agost i Ib", "SANT MATEU, Sant Mateu!", "res de res",
    ]
    t = spark.createDataFrame([(str(i), v) for i, v in enumerate(texts)], "doc_id string, text string")
    g = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.doc_id: r.names for r in mentions.mention_join(t, g).collect()}
    assert got == {str(i): brute_mentions(names, v) for i, v in enumerate(texts)}


def test_mention_hints_regions_and_hashtags(spark):
    g = spark.createDataFrame([("Ourense",), ("Larouco",), ("La Pobla",), ("Artana",)], "name string")
    rows = [("a", "Ourense ➡️ Larouco", []), ("b", "sense lloc #IFArtana", ["Benicàssim "]), ("c", "res", ["Agost", "X"])]
    t = spark.createDataFrame(rows, "doc_id string, text string, hints array<string>")
    got = {r.doc_id: r.names for r in mentions.mention_join(t, g).collect()}
    assert got == {"a": ["Larouco"], "b": ["Benicàssim", "Artana"], "c": ["X"]}


def test_places_must_match_one_boundary(spark):
    n = spark.createDataFrame([("d", ["Artana", "Vila", "Cap"])], "doc_id string, names array<string>")
    b = spark.createDataFrame([("ARTANA", "1", "11"), ("Vila", "2", "22"), ("Vila", "3", "33")], "name string, ine_code string, national_code string")
    from emberlake.functions.geo import GEOMETRY

    b = b.withColumn("geometry", F.lit(None).cast(GEOMETRY))
    locations = mentions.resolve_places(n, b).first().locations
    assert [(p.name, p.matched) for p in locations] == [("ARTANA", True), ("Vila", False), ("Cap", False)]


def test_gazetteer_sql_states_the_rule_of_the_query(spark, monkeypatch):
    """Names that end in a letter without an ASCII form, and names of three parts."""
    import duckdb

    from emberlake.registry import osint
    from tools.check import rows_of

    rows = [(1, "Acherß baut. Acherß und Acherß"), (2, "Graßauß"), (3, "Oberßdorfßbach liegt am Acherß hier"), (4, "der Acherß")]
    data = [(i, f"pub-{i}", "Commune 1", f"T. {t}", t) for i, t in rows]
    pubs = spark.createDataFrame(data, "doc_id long, id string, place string, original_text string, body string")
    monkeypatch.setattr(osint, "load", lambda *_: pubs)
    con = duckdb.connect()
    con.execute("CREATE TABLE publications (doc_id BIGINT, id VARCHAR, place VARCHAR, original_text VARCHAR, body VARCHAR)")
    con.executemany("INSERT INTO publications VALUES (?, ?, ?, ?, ?)", data)
    sql = osint.ORACLE["gazetteer_occurrences"]
    cur = con.execute("WITH " + sql[sql.index(", g AS (") + 2:])
    df = osint.gazetteer_occurrences(spark, "")
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
