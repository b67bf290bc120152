"""Registered text and publication queries with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import AS_OF, base, ctes, load
from emberlake.functions import fixed
from emberlake.functions import text as X
from emberlake.operators import mentions
from emberlake.plans import osint
from emberlake.registry import civil
from emberlake.session import cut_lineage

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def sql_text(value: str) -> str:
    return value.replace("'", "''")


def sql_normal(col: str) -> str:
    """Normalized text in the check dialect."""
    return f"trim(regexp_replace(strip_accents(lower({col})), '\\s+', ' ', 'g'))"


def sql_any(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{sql_text(X.plain(t))}')" for t in terms) + ")"


def sql_rules(col: str, rules: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(col, t)} THEN '{n}'" for n, t in rules.items()) + f" ELSE '{default}' END"


def sql_event(norm: str, tag: str) -> str:
    alerts = {k: v for k, v in fixed.EVENT_TERMS.items() if k.startswith("es_alert_")}
    base_rule = (
        f"CASE WHEN contains({norm}, 'es-alert') THEN {sql_rules(norm, alerts, osint.OTHER)} "
        f"ELSE {sql_rules(norm, fixed.EVENT_TERMS, osint.OTHER)} END"
    )
    return f"CASE WHEN ({tag} OR contains({norm}, '#iiff')) AND ({base_rule}) = '{osint.OTHER}' THEN 'firefighting_update' ELSE ({base_rule}) END"


def sql_risk(norm: str, tag: str) -> str:
    return f"CASE WHEN {tag} OR contains({norm}, '#iiff') THEN 'wildfire' ELSE {sql_rules(norm, fixed.RISK_TERMS, 'other')} END"


def sql_has_tag(col: str) -> str:
    return f"regexp_matches(lower({col}), '(^|[^a-z0-9_])#if[a-zà-ÿ0-9_-]{{3,}}') AND NOT regexp_matches(lower({col}), '#info')"


CLASSIFIED = f""", n AS (SELECT *, {sql_normal('title')} AS tn, {sql_normal('body')} AS bn, {sql_has_tag('title')} AS tt, {sql_has_tag('body')} AS bt FROM publications),
e AS (SELECT *, {sql_event('tn', 'tt')} AS te, {sql_event('bn', 'bt')} AS be, {sql_risk('tn', 'tt')} AS tr, {sql_risk('bn', 'bt')} AS br FROM n),
c0 AS (SELECT *, CASE WHEN te <> '{osint.OTHER}' THEN te WHEN be NOT IN ('{osint.OTHER}', 'risk_alert_update') THEN be ELSE '{osint.OTHER}' END AS event_type FROM e),
c AS (SELECT *, CASE WHEN tr <> 'other' THEN tr WHEN event_type <> '{osint.OTHER}' THEN br ELSE 'other' END AS risk_type,
  CASE WHEN event_type LIKE '%\\_lift' ESCAPE '\\' OR event_type IN ('plan_deactivation', 'es_alert_cancelled', 'fire_extinguished') THEN 'ended'
       WHEN event_type IN ('evacuation_expansion', 'plan_update') THEN 'updated' ELSE 'started' END AS action_state FROM c0)"""


def publications(spark: SparkSession, sf: str) -> DataFrame:
    """Classified publications with the columns of the intake."""
    rows = load(spark, sf, "publications").withColumns({"reliability": F.lit(1.0), "external_id": F.col("id")})
    return osint.classify_publications(rows).withColumns(
        {
            "place_names": F.array("place"), "multi_incident_summary": F.lit(False), "ends_at": F.lit(None).cast("timestamp"),
            "starts_at": F.lit(None).cast("timestamp"), "evidence_rank": F.lit(4),
            "confidence": F.round((F.col("doc_id") % 100) / 100.0, 2),
        }
    )


_LANG = "CASE WHEN greatest({0}) = 0 THEN 'und' " + " ".join(
    f"WHEN {{{i + 1}}} = greatest({{0}}) THEN '{lang}'" for i, lang in enumerate(fixed.LANGUAGE_MARKERS)
) + " END"
_SCORES = ["(" + " + ".join(f"CAST(contains(' ' || bn || ' ', ' {w} ') AS INT)" for w in words) + ")" for words in fixed.LANGUAGE_MARKERS.values()]


@register("publication_classes", ctes("publications") + CLASSIFIED + f"""
SELECT id, event_type, risk_type, action_state, {_LANG.format(', '.join(_SCORES), *_SCORES)} AS language FROM c""")
def publication_classes(spark: SparkSession, sf: str) -> DataFrame:
    return publications(spark, sf).select("id", "event_type", "risk_type", "action_state", "language")


@register("publication_hashes", ctes("publications") + f"""
SELECT id, sha256(rtrim(split_part(url, '#', 1), '/') || '|' || {sql_normal('body')}) AS digest FROM publications""")
def publication_hashes(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "publications")
    return df.select("id", X.publication_hash(F.col("url"), X.normalize(F.col("body"))).alias("digest"))


@register("publication_instructions", ctes("publications") + """
SELECT id, CASE WHEN doc_id % 8 = 1 THEN 'Confineu-vos a casa.' WHEN doc_id % 8 = 4 THEN 'ES-Alert: "Incendio cerca de ' || place || ', permanezca en su casa".' ELSE '' END AS instructions,
  CASE WHEN doc_id % 8 = 4 THEN 'Incendio cerca de ' || place || ', permanezca en su casa' ELSE '' END AS message FROM publications""")
def publication_instructions(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "publications")
    return df.select(
        "id", F.coalesce(X.instructions(F.concat("title", F.lit(". "), "body")), F.lit("")).alias("instructions"),
        F.coalesce(X.es_alert_message(F.col("original_text")), F.lit("")).alias("message"),
    )


@register("place_hints", ctes("publications") + """
SELECT id, CASE doc_id % 8 WHEN 0 THEN place || ' #IF' || replace(place, ' ', '') WHEN 1 THEN place ELSE '' END AS hints FROM publications""")
def place_hints(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "publications").select("id", F.array_join(X.places(F.col("title")), "|").alias("hints"))


@register("hashtag_usage", ctes("publications") + """
SELECT lower('#IF' || replace(place, ' ', '')) AS tag, count(*) AS uses, min(id) AS first_id FROM publications WHERE doc_id % 8 = 0 GROUP BY 1""")
def hashtag_usage(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "publications").select("id", F.explode(X.incident_hashtags(F.col("original_text"))).alias("tag"))
    return df.groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("uses"), F.min("id").alias("first_id"))


@register("witness_promotion", ctes("publications") + """,
p AS (SELECT id, source_type, authority, published_us, 'inc-' || CAST(doc_id % 60 AS STRING) AS inc FROM publications),
seen AS (  -- distinct authorities among the eye witnesses up to and with each report
  SELECT a.id, count(DISTINCT b.authority) AS n FROM p a JOIN p b ON a.inc = b.inc AND (b.published_us, b.id) <= (a.published_us, a.id)
  WHERE b.source_type IN ('individual', 'multiple_witnesses') GROUP BY 1)
SELECT p.id, CASE WHEN source_type = 'individual' AND n >= 3 THEN 'multiple_witnesses' ELSE source_type END AS source_type,
  CASE WHEN source_type = 'individual' AND n >= 3 THEN 3 ELSE 4 END AS evidence_rank
FROM p LEFT JOIN seen USING (id)""")
def witness_promotion(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "publications").withColumns(
        {"incident_id": F.concat(F.lit("inc-"), (F.col("doc_id") % 60).cast("string")), "evidence_rank": F.lit(4), "confidence": F.lit(0.3)}
    )
    return osint.promote_witnesses(df).select("id", "source_type", "evidence_rank")


@register("incident_transitions", ctes("publications") + CLASSIFIED + f"""
SELECT incident_id, CASE WHEN arg_max(action_state, (published_us, id)) = 'ended' THEN 'controlled' ELSE 'active' END AS status,
  arg_max(event_type, (published_us, id)) AS event_type, max(published_us) AS observed_us, count(*) AS transitions,
  coalesce(max(published_us) FILTER (action_state = 'ended'), 0) AS ended_us,
  coalesce(min(published_us) FILTER (event_type IN ('confinement_order', 'evacuation_order')), 0) AS started_us
FROM c WHERE event_type <> '{osint.OTHER}' GROUP BY 1""")
def incident_transitions(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = osint.discard_non_events(publications(spark, sf))
    out = osint.incident_transitions(kept)
    us = lambda c: F.coalesce(F.unix_micros(c), F.lit(0))
    return out.select("incident_id", "status", "event_type", us("observed_at").alias("observed_us"), "transitions",
                      us("ended_at").alias("ended_us"), us("restriction_started_at").alias("started_us"))


@register("incident_versions", ctes("publications", "incidents") + """
SELECT incident_id, coalesce(i.version, 1) + row_number() OVER (PARTITION BY incident_id ORDER BY p.published_us, p.id) AS version, p.id AS publication_id
FROM publications p LEFT JOIN incidents i ON i.id = p.incident_id""")
def incident_versions(spark: SparkSession, sf: str) -> DataFrame:
    out = osint.incident_versions(publications(spark, sf), load(spark, sf, "incidents"))
    return out.select("incident_id", "version", "publication_id")


@register("active_or_recent_incidents", ctes("incidents") + f"""
SELECT id, status FROM incidents WHERE osint AND merged_into IS NULL AND NOT hidden
  AND (status = 'active' OR observed_us >= {civil.NOW_US} - 72 * 3600000000)""")
def active_or_recent_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return osint.active_or_recent(civil.incidents(spark, sf), AS_OF, 72).select("id", "status")


@register("incident_evidence", ctes("publications", "incidents", "sources") + f"""
SELECT p.incident_id, p.id, s.name AS source_name, p.published_us FROM publications p LEFT JOIN sources s ON p.source_id = s.source_id
WHERE review_status <> 'rejected' AND incident_id IN (SELECT id FROM incidents WHERE osint AND merged_into IS NULL AND NOT hidden
  AND (status = 'active' OR observed_us >= {civil.NOW_US} - 72 * 3600000000))""")
def incident_evidence(spark: SparkSession, sf: str) -> DataFrame:
    page = osint.active_or_recent(civil.incidents(spark, sf), AS_OF, 72)
    out = osint.incident_evidence(page, publications(spark, sf), load(spark, sf, "sources"))
    return out.select("incident_id", "id", "source_name", F.unix_micros("published_at").alias("published_us"))


@register("review_pending", ctes("publications") + """
SELECT count(*) FILTER (review_status = 'pending') AS pending FROM publications""")
def review_pending(spark: SparkSession, sf: str) -> DataFrame:
    return osint.pending_count(load(spark, sf, "publications"))


@register("review_queue", ctes("publications") + """
SELECT id, authority FROM publications WHERE review_status = 'pending' ORDER BY published_us DESC, id LIMIT 100""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return osint.review_queue(load(spark, sf, "publications"), 100).select("id", "authority")


@register("review_decisions", ctes("publications") + """
SELECT p.id AS publication_id, coalesce(x.status, review_status) AS review_status FROM publications p LEFT JOIN (
  SELECT l_orderkey AS d, arg_max(CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'accepted' END,
    (epoch_us(l_shipdate), l_partkey, l_suppkey, l_extendedprice)) AS status FROM lineitem GROUP BY 1) x ON x.d = p.doc_id""")
def review_decisions(spark: SparkSession, sf: str) -> DataFrame:
    from emberlake.operators.merge import review

    lines = base(spark, sf, "lineitem")
    rank = F.struct(F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), "l_partkey", "l_suppkey", "l_extendedprice")
    decisions = lines.select(
        F.concat(F.lit("pub-"), F.col("l_orderkey").cast("string")).alias("publication_id"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("status"),
        F.lit(None).cast("string").alias("notes"), F.lit("duty").alias("reviewer"), rank.alias("reviewed_at"),
    )
    pubs = load(spark, sf, "publications").withColumnRenamed("id", "publication_id")
    return review(pubs, decisions).select("publication_id", "review_status")


@register("page_texts", """
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', ' ', 'g'),
  '(?s)<[a-zA-Z/][^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS "text"
FROM pages""")
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Place list: first word of every text, every commune, and turned article names."""
    pubs = load(spark, sf, "publications")
    words = pubs.select(F.regexp_extract("body", "^([A-Za-zÀ-ÿ]+)", 1).alias("name"))
    return words.unionByName(pubs.select(F.col("place").alias("name"))).filter("name <> ''").distinct()


def mention_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "publications").select(F.col("id").alias("doc_id"), F.col("original_text").alias("text"))


_OCCURRENCES = ctes("publications") + f""", g AS (
  SELECT name, lower(strip_accents(name)) AS form FROM (
    SELECT DISTINCT regexp_extract(body, '^([A-Za-zÀ-ÿ]+)', 1) AS name FROM publications UNION SELECT place FROM publications)
  WHERE name <> ''),
h AS (SELECT name, trim(regexp_replace(form, '[^a-z0-9]+', ' ', 'g')) AS form FROM g WHERE length(regexp_replace(form, '[^a-z0-9]+', '', 'g')) >= 4 AND trim(regexp_replace(form, '[^a-z0-9]+', ' ', 'g')) <> 'agost'),
words AS (SELECT id, unnest(list_distinct(regexp_extract_all(original_text, '([\\p{{L}}\\p{{M}}0-9_]+)', 1))) AS word FROM publications),
t AS (SELECT id, string_split(trim(regexp_replace({sql_normal('original_text')}, '[^a-z0-9]+', ' ', 'g')), ' ') AS toks FROM publications),
tok AS (SELECT id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos, unnest(list_concat(toks[2:], [''])) AS nxt FROM t),
one AS (SELECT tok.id, pos, name FROM tok JOIN h ON tok = form WHERE NOT contains(form, ' ') AND EXISTS (SELECT 1 FROM words w WHERE w.id = tok.id AND w.word = name)),
two AS (SELECT tok.id, pos, 2 AS w, name FROM tok JOIN h ON tok || ' ' || nxt = form UNION ALL
  SELECT tok.id, pos, w, name FROM (SELECT *, len(string_split(form, ' ')) AS w FROM h) h JOIN tok ON tok = split_part(form, ' ', 1) JOIN t ON t.id = tok.id
  WHERE w > 2 AND array_to_string(toks[pos + 1:pos + w], ' ') = form)"""


@register("gazetteer_occurrences", _OCCURRENCES + """
SELECT name, count(*) AS hits, count(DISTINCT id) AS docs, CAST(sum(pos) AS BIGINT) AS position_sum FROM (SELECT * FROM one UNION ALL SELECT id, pos, name FROM two) GROUP BY 1""")
def gazetteer_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Every alias occurrence before overlaps are resolved."""
    alias_rows = cut_lineage(mentions.aliases(gazetteer(spark, sf)), "aliases")
    longest = alias_rows.agg(F.max("words")).first()[0] or 1
    raw = mentions.raw_mentions(mention_texts(spark, sf), alias_rows, longest)
    return raw.groupBy("name").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"), F.sum("at").cast("long").alias("position_sum")
    )


_NAME = sql_normal("n")


@register("gazetteer_mentions", _OCCURRENCES + f""",
m AS (SELECT id, list({{'at': pos, 'words': w, 'names': [name]}} ORDER BY pos, w DESC, name) AS l FROM (
  SELECT DISTINCT id, pos, 1 AS w, name FROM one UNION ALL SELECT DISTINCT id, pos, w, name FROM two) GROUP BY id),
f AS (SELECT id, list_reduce(list_prepend({{'at': -1::BIGINT, 'words': 0, 'names': []::VARCHAR[]}}, l),
  lambda a, x: CASE WHEN x.at >= a.at THEN {{'at': x.at + x.words, 'words': 0, 'names': list_concat(a.names, x.names)}} ELSE a END).names AS picks FROM m),
r AS (SELECT p.id, list_concat(coalesce(picks, []), CASE WHEN doc_id % 8 = 0 THEN [place] ELSE [] END) AS names FROM publications p LEFT JOIN f USING (id)),
k AS (SELECT id, names, list_transform(names, lambda n: {_NAME}) AS plain FROM r)
SELECT id AS doc_id, array_to_string(list_filter(names, lambda n, i: list_position(plain, {_NAME}) = i), '|') AS names FROM k""")
def gazetteer_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved place mentions per document (longest match first)."""
    return mentions.mention_join(mention_texts(spark, sf), gazetteer(spark, sf)).select("doc_id", F.array_join("names", "|").alias("names"))


@register("publications_to_incidents", ctes("publications", "incidents") + CLASSIFIED + """
SELECT c.id AS pub_id, arg_max(i.id, (i.observed_us, i.id)) AS incident_id
FROM c JOIN incidents i ON lower(i.commune) = lower(c.place) AND c.risk_type = 'wildfire' AND i.observed_us >= c.published_us - 7 * 86400000000
GROUP BY 1""")
def publications_to_incidents(spark: SparkSession, sf: str) -> DataFrame:
    inc = civil.incidents(spark, sf).withColumns(
        {"risk_type": F.lit("wildfire"), "affected_locations": F.array("commune"), "multi_incident_summary": F.lit(False)}
    )
    return osint.assign_to_incidents(publications(spark, sf), inc)


@register("ingested_publications", ctes("publications", "incidents") + CLASSIFIED + f""",
k AS (SELECT *, coalesce(nullif(regexp_extract(title, 'Commune [0-9]+'), ''), '') AS named FROM c WHERE event_type <> '{osint.OTHER}'),
m AS (  -- newest stored incident of the risk and place, one at a time
  SELECT k.id AS pub_id, (SELECT i.id FROM incidents i WHERE i.commune = k.named AND k.risk_type = 'flood' AND i.observed_us >= k.published_us - 7 * 86400000000
    ORDER BY i.observed_us DESC, i.id DESC LIMIT 1) AS incident_id FROM k),
r AS (SELECT k.id, k.risk_type, k.named, k.published_us AS us FROM k JOIN m ON m.pub_id = k.id WHERE m.incident_id IS NULL),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY risk_type, named ORDER BY us, id) <= 7 * 86400000000 THEN 0 ELSE 1 END AS s FROM r),
g AS (SELECT *, sum(s) OVER (PARTITION BY risk_type, named ORDER BY us, id) AS run FROM b),
l AS (SELECT id, first_value(id) OVER (PARTITION BY risk_type, named, run ORDER BY us, id) AS lead_id FROM g)
SELECT k.id, event_type, risk_type, coalesce(m.incident_id, sha256('osint:' || lead_id)) AS incident_id
FROM k LEFT JOIN m ON m.pub_id = k.id LEFT JOIN l ON l.id = k.id""")
def ingested_publications(spark: SparkSession, sf: str) -> DataFrame:
    """The whole intake of publications against stored flood incidents."""
    batch = load(spark, sf, "publications").withColumns({"reliability": F.lit(1.0), "external_id": F.col("id")}).drop("incident_id", "review_status")
    stored = spark.createDataFrame([], "deduplication_hash string")
    inc = civil.incidents(spark, sf).withColumns({"risk_type": F.lit("flood"), "affected_locations": F.array("commune"), "multi_incident_summary": F.lit(False)})
    places = load(spark, sf, "publications").select(F.col("place").alias("name")).distinct()
    out, _ = osint.ingest_publications(batch, stored, inc, places)
    return out.select("id", "event_type", "risk_type", "incident_id")


@register("empty_incidents_hidden", ctes("incidents", "publications") + """
SELECT id, hidden OR (osint AND id NOT IN (SELECT incident_id FROM publications)) AS hidden FROM incidents""")
def empty_incidents_hidden(spark: SparkSession, sf: str) -> DataFrame:
    from emberlake.plans.reconcile import hide_empty

    inc = civil.incidents(spark, sf).withColumn("canonical_source", F.lit(""))
    return hide_empty(inc, load(spark, sf, "publications")).select("id", "hidden")
