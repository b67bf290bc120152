"""Texts are normalized, classified and searched in tasks like the Column functions do it, and once each."""

from pyspark.sql import functions as F

from emberlake.functions import text as X
from emberlake.operators import mentions
from emberlake.plans import osint

TEXTS = [
    None, "", "  Incendi   forestal a  Lleida …", "L'EVACUACIÓ: s'ha enviat es-alert ½ ﬁ", "#IFLlucena activo", "Σίσυφος ΟΔΟΣ ñandú İstanbul", "los las del incendio",
    "Alerta por riesgo de inundación\nConfineu-vos a casa. Res més.", "éxit x　 y\x1cz", "cancel·lat es-alert", "汉字 Ж ŀĳ™", "#iiff eta sute",
]


def test_task_functions_equal_column_functions(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("n", X.normalize(F.col("t")))
    tag = F.coalesce(F.size(X.incident_hashtags(F.col("t"))) > 0, F.lit(False))
    rows = rows.withColumn("tag", tag).withColumn("c", X.text_classes(F.col("t"), F.col("tag")))
    out = rows.select(
        "n", X.fire_filled(X.event_class("n"), F.col("n"), F.col("tag")).alias("e"), X.risk_type("n", F.col("tag")).alias("r"), X.language("n").alias("l"),
        F.coalesce(X.contains_any(F.col("n"), X.fixed.INSTRUCTION_TERMS), F.lit(False)).alias("told"), "c.*",
    ).collect()
    for r in out:
        assert (r.n, r.e, r.r, r.l, r.told) == (r.normalized, r.event, r.risk, r.language, r[9]), r


def test_words_that_begin_no_place_become_no_rows(spark, monkeypatch):
    texts = spark.createDataFrame([("a", "Foc a Vall de Dalt i a Lleida, prop de Vall"), ("b", None), ("c", "res")], "doc_id string, text string")
    known = spark.createDataFrame([("Vall de Dalt",), ("Lleida",)], "name string")
    alias_rows = mentions.aliases(known)
    count = texts.select(F.explode(X.token_windows(F.col("text"), ["vall", "lleida"], 3))).count()
    assert count == 3
    few = {tuple(r) for r in mentions.raw_mentions(texts, alias_rows, 3).collect()}
    monkeypatch.setattr(mentions, "MAX_HEADS", 1)
    assert few == {tuple(r) for r in mentions.raw_mentions(texts, alias_rows, 3).collect()} == {("a", 2, 3, "Vall de Dalt"), ("a", 7, 1, "Lleida")}


def test_a_task_hands_on_few_rows_at_once_and_no_foreign_spellings():
    import pandas as pd

    known = [("Lleida", "Lleida", "lleida", "lleida", 1), ("LLEIDA", "LLEIDA", "lleida", "lleida", 1), ("Vall de Dalt", "Vall de Dalt", "vall de dalt", "vall", 3)]
    frame = pd.DataFrame({"doc_id": ["a", "b"], "text": ["Lleida " * 50_000 + "Vall de Dalt", None]})
    pieces = list(mentions._in_pieces(mentions._occurrences(known), ["doc_id", "at", "words", "name", "alias"])(iter([frame])))
    assert [len(p) for p in pieces] == [20_000, 20_000, 10_001]
    assert {tuple(r) for p in pieces for r in p[["name", "words"]].values} == {("Lleida", 1), ("Vall de Dalt", 3)}


def test_places_are_told_apart_by_their_normal_form(spark):
    texts = spark.createDataFrame([("a", "Foc a Lleida i a LLEIDA, a Vall de Dalt → Tremp i Lleida")], "doc_id string, text string")
    known = spark.createDataFrame([("Vall de Dalt",), ("Lleida",), ("LLEIDA",), ("Tremp",)], "name string")
    names = [r.names for r in mentions.mention_join(texts, known).collect()]
    rows = spark.createDataFrame([(["b", "B ", "a", "b", "á"],)], "n array<string>")
    assert [r.f for r in mentions.first_spellings(rows, "f", F.col("n")).collect()] == [["b", "a"]]
    assert len(names) == 1 and len({n.lower() for n in names[0]}) == len(names[0])


def test_versions_classify_texts_once(spark):
    rows = spark.createDataFrame(
        [("p1", "Incendi forestal", "x", "official", "i", "2024-01-01 00:00:00", "u")], "id string, title string, body string, source_type string, incident_id string, published_at string, url string"
    ).withColumn("published_at", F.to_timestamp("published_at"))
    found = osint.incident_versions(osint.classify_publications(rows), spark.createDataFrame([("i", 3)], "id string, version int"))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.incident_id, r.version, r.publication_id) for r in found.collect()] == [("i", 4, "p1")]
