"""Publications: classification, enrichment, incident assignment, transitions, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import dates, fixed, scoring
from emberlake.functions import text as X
from emberlake.operators.components import connected_components
from emberlake.operators.dedupe import keep_first, top_rows
from emberlake.operators.mentions import mention_join, resolve_places
from emberlake.operators.skew import salted_join
from emberlake.operators.stage import computed
from emberlake.session import cut_lineage

OTHER = "other_emergency_update"


def classify_publications(df: DataFrame, title: str = "title", text: str = "body") -> DataFrame:
    """Add event_type, risk_type, action_state, es_alert_status, language, normalized_body and instructed (an instruction term occurs).

    The title decides; a body only fills an empty title class when it is more
    than a general risk notice. Texts are normalized once per row.
    """
    tagged = lambda c: F.coalesce(F.size(X.incident_hashtags(F.col(c))) > 0, F.lit(False))
    read = df.withColumns({"_t": X.text_classes(F.col(title), tagged(title)), "_b": X.text_classes(F.col(text), tagged(text))})
    event = F.when(F.col("_t.event") != OTHER, F.col("_t.event")).when(~F.col("_b.event").isin(OTHER, "risk_alert_update"), F.col("_b.event")).otherwise(OTHER)
    decided = computed(read, event_type=event)
    risk = F.when(F.col("_t.risk") != "other", F.col("_t.risk")).when(F.col("event_type") != OTHER, F.col("_b.risk")).otherwise("other")
    return decided.withColumns(
        {
            "normalized_body": F.col("_b.normalized"), "language": F.col("_b.language"), "instructed": F.col("_b.told"), "risk_type": risk,
            "action_state": X.action_state(F.col("event_type")), "es_alert_status": X.es_alert_evidence(F.col("event_type"), F.col("source_type")),
        }
    ).drop("_t", "_b")


def discard_non_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(publications about an event, the discarded rest)."""
    return df.filter(F.col("event_type") != OTHER), df.filter(F.col("event_type") == OTHER)


def enrich_publications(df: DataFrame, gazetteer: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Stateless part of the intake: hash, arrows, places, instructions, evidence, review status.

    Needs id, title, body, url, source_type, reliability, published_at. Multi-region
    arrow summaries are marked and become firefighting updates when they are about
    wildfires.
    """
    classified, _ = discard_non_events(classify_publications(df))
    full = F.concat("title", F.lit(". "), "body")
    # A copy read through a gateway names its original; both hash alike.
    canonical = F.coalesce(F.col("canonical_url"), F.col("url")) if "canonical_url" in df.columns else F.col("url")
    hashed = F.when(F.col("body") == "", X.normalize(F.col("title"))).otherwise(F.col("normalized_body"))
    rows = computed(
        classified, deduplication_hash=X.publication_hash(canonical, hashed),
        administrative_context=X.arrow_side(full, 1), multi_incident_summary=F.size(X.arrow_side(full, 2)) > 1,
        instructions=F.when(F.col("instructed"), X.instructions(F.col("body"))), es_alert_message=X.es_alert_message(F.col("body")),
    )
    rows = rows.withColumn(
        "event_type", F.when(F.col("multi_incident_summary") & (F.col("risk_type") == "wildfire"), "firefighting_update").otherwise(F.col("event_type"))
    )
    rank = scoring.evidence_rank(F.col("source_type"))
    rows = rows.withColumns(
        {
            "action_state": X.action_state(F.col("event_type")), "es_alert_status": X.es_alert_evidence(F.col("event_type"), F.col("source_type")),
            "evidence_rank": rank, "confidence": scoring.evidence_confidence(rank, F.col("reliability")),
            "review_status": scoring.review_status(rank, F.col("event_type")),
        }
    )
    # Classes and patterns are found once per text; the search for places reads its texts three times.
    rows = cut_lineage(rows.withColumn("_hints", X.places(full)), "classified")
    texts = rows.select(F.col("id").alias("doc_id"), full.alias("text"), F.col("_hints").alias("hints"))
    named = mention_join(texts, gazetteer)
    out = rows.drop("_hints").join(named.select(F.col("doc_id").alias("id"), F.col("names").alias("place_names")), "id", "left")
    if boundaries is not None:
        located = resolve_places(named, boundaries).withColumnRenamed("doc_id", "id")
        out = out.join(located, "id", "left").withColumn(
            "geometry_inference_method", F.when(F.col("geometry").isNotNull(), "ign_official_boundaries_text_mentions").otherwise("none")
        )
    return out


def split_known(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first copy of every unseen hash, rows repeating a stored or earlier hash)."""
    first = keep_first(batch, ["deduplication_hash"], ["published_at", "id"])
    known = stored.select("deduplication_hash").distinct()
    fresh = first.join(known, "deduplication_hash", "left_anti")
    return fresh, batch.join(fresh.select("id"), "id", "left_anti")


def assign_to_incidents(publications: DataFrame, incidents: DataFrame, days: int = 7) -> DataFrame:
    """(pub_id, incident_id): newest incident of the same risk that shares a place, or two title words when no place is known.

    Incidents older than ``days`` before the publication do not count. The newest incident under a
    place or a pair of title words is the same for every publication, so incidents fold to
    one row per key before they meet publications, and no pairs of the two are formed.
    """
    p = publications.select(
        F.col("id").alias("pub_id"), "risk_type", (F.unix_micros("published_at") / 1e6).alias("p_at"),
        F.array_distinct(F.transform("place_names", X.normalize)).alias("p_places"), X.title_tokens(X.normalize(F.col("title"))).alias("p_words"),
    )
    i = incidents.filter(~F.coalesce(F.col("multi_incident_summary"), F.lit(False))).select(
        F.col("id").alias("incident_id"), F.coalesce("risk_type", F.lit("other")).alias("risk_type"), (F.unix_micros("observed_at") / 1e6).alias("i_at"),
        F.array_distinct(F.transform("affected_locations", X.normalize)).alias("i_places"),
        X.title_tokens(X.normalize(F.coalesce("summary", "title"))).alias("i_words"),
    )
    keys = F.when(F.size("p_places") == 0, X.word_pairs(F.col("p_words"))).otherwise(F.col("p_places"))
    asked = cut_lineage(p.select("pub_id", "p_at", "risk_type", F.explode(keys).alias("k")), "asked")
    wanted = asked.select("risk_type", "k").distinct()
    shown = i.select("incident_id", "i_at", "risk_type", F.explode(F.concat("i_places", X.word_pairs(F.col("i_words")))).alias("k"))
    at = F.struct("i_at", "incident_id")
    # Folded on the map side first: the few keys of very many incidents never travel.
    newest = shown.filter(F.col("i_at").isNotNull()).groupBy("risk_type", "k").agg(F.max(at).alias("newest")).join(wanted, ["risk_type", "k"], "left_semi")
    hits = salted_join(asked, newest, ["risk_type", "k"], F.col("pub_id")).filter(F.col("newest.i_at") >= F.col("p_at") - days * 86_400)
    return hits.groupBy("pub_id").agg(F.max("newest").alias("newest")).select("pub_id", F.col("newest.incident_id").alias("incident_id"))


def group_new_reports(publications: DataFrame, days: int = 7) -> DataFrame:
    """(pub_id, lead_id): reports of one new fire under the earliest of them.

    Reports of one risk that name a place (or, without a place, share a title word pair)
    belong together while no more than ``days`` lie between one and the next; groups that
    share a report are one. Summaries of several fires stand alone. Gaps are looked for
    between hour blocks, so a busy place is one row per hour in the window.
    """
    multi = F.coalesce(F.col("multi_incident_summary"), F.lit(False))
    rows = publications.select(
        "id", "risk_type", F.unix_micros("published_at").alias("us"), multi.alias("multi"),
        F.array_distinct(F.transform(F.coalesce("place_names", F.array().cast("array<string>")), X.normalize)).alias("places"),
        F.array_sort(X.title_tokens(X.normalize(F.col("title")))).alias("words"),
    )
    pairs = F.flatten(F.transform("words", lambda a, i: F.transform(F.filter("words", lambda b: b > a), lambda b: F.concat(F.lit("words:"), a, F.lit(" "), b))))
    keyed = rows.filter(~F.col("multi")).withColumn("k", F.explode(F.when(F.size("places") > 0, F.col("places")).otherwise(pairs)))
    keyed = keyed.select("id", "risk_type", "k", "us", F.expr("us div 3600000000").alias("hour"))
    at = F.struct("us", "id")
    blocks = keyed.groupBy("risk_type", "k", "hour").agg(F.min("us").alias("low"), F.max("us").alias("high"), F.min(at).alias("first"))
    w = Window.partitionBy("risk_type", "k").orderBy("hour")
    starts = (F.col("low") - F.lag("high").over(w) > days * 86_400_000_000) | F.lag("high").over(w).isNull()
    runs = blocks.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = runs.groupBy("risk_type", "k", "run").agg(F.min("first").alias("head"))
    in_run = keyed.join(runs.select("risk_type", "k", "hour", "run"), ["risk_type", "k", "hour"]).join(heads, ["risk_type", "k", "run"])
    edges = in_run.select(F.col("id").alias("src"), F.col("head.id").alias("dst")).distinct()
    found = connected_components(edges).select(F.col("node").alias("id"), "component")
    member = rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    leads = member.groupBy("component").agg(F.min(at).alias("lead"))
    return member.join(leads, "component").select(F.col("id").alias("pub_id"), F.col("lead.id").alias("lead_id"))


def new_incidents(publications: DataFrame, leads: DataFrame | None = None) -> DataFrame:
    """Incidents opened by the reports that lead a group of ``group_new_reports``; by every report without ``leads``.

    Ids are digests of the leading report's external id. Summaries of several fires open their own.
    """
    place = F.coalesce(F.initcap(X.normalize(F.get("place_names", F.lit(0)))), F.lit("Espanya"))
    names = F.coalesce(F.nullif(F.array_join("place_names", " / "), F.lit("")), F.lit("Espanya"))
    multi = F.coalesce(F.col("multi_incident_summary"), F.lit(False))
    official = F.col("source_type") == "official"
    rows = publications if leads is None else publications.join(leads.select(F.col("lead_id").alias("id")).distinct(), "id", "left_semi")
    external = F.when(multi, F.concat(F.lit("osint-summary:"), "external_id")).otherwise(F.concat(F.lit("osint:"), "external_id"))
    return rows.select(
        F.sha2(external, 256).alias("id"), external.alias("external_id"), F.col("id").alias("opened_by"),
        F.when(multi, F.concat(F.lit("Resum d'incendis - "), names)).otherwise(F.concat(X.risk_label(F.col("risk_type")), F.lit(" - "), place)).alias("title"),
        F.lit("active").alias("status"), F.col("title").alias("summary"), "risk_type", F.col("place_names").alias("affected_locations"),
        F.when(official, "official").otherwise("observed").alias("provenance"),
        F.when(official, "verified").otherwise("pending").alias("verification_status"),
        F.col("published_at").alias("observed_at"), "confidence", multi.alias("multi_incident_summary"), F.lit(1).alias("version"),
    )


def ingest_publications(batch: DataFrame, stored: DataFrame, incidents: DataFrame, gazetteer: DataFrame, boundaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(publications with their incident, incidents they opened) of a batch.

    Classified and enriched publications are split by their hash: unseen ones are assigned,
    repeated ones left to the caller. Given ``locations`` win over names found in the text. Unseen
    publications go to the newest matching stored incident, the rest open one incident per
    group of reports, and individual reports are promoted once enough witnesses have spoken.
    """
    rows = enrich_publications(batch, gazetteer, boundaries)
    names = F.coalesce("place_names", F.array().cast("array<string>"))
    given = F.coalesce("locations", F.array().cast("array<string>")) if "locations" in batch.columns else F.array().cast("array<string>")
    rows = cut_lineage(rows.withColumn("place_names", F.when(F.size(given) > 0, given).otherwise(names)), "enriched")
    fresh, _ = split_known(rows, stored)
    fresh = cut_lineage(fresh, "fresh")
    single = fresh.filter(~F.coalesce("multi_incident_summary", F.lit(False)))
    assigned = cut_lineage(assign_to_incidents(single, incidents), "assigned")
    rest = fresh.join(assigned.select(F.col("pub_id").alias("id")), "id", "left_anti")
    groups = cut_lineage(group_new_reports(rest), "new-reports")
    opened = cut_lineage(new_incidents(rest, groups), "opened")
    own = groups.join(opened.select(F.col("opened_by").alias("lead_id"), F.col("id").alias("incident_id")), "lead_id").select("pub_id", "incident_id")
    out = fresh.drop("incident_id").join(assigned.unionByName(own).withColumnRenamed("pub_id", "id"), "id", "left")
    return promote_witnesses(out), opened


def promote_witnesses(publications: DataFrame) -> DataFrame:
    """Individual reports become multiple witnesses from the report on with which their incident has three or more distinct authorities.

    Reports count in the order of (published_at, id); earlier ones stay individual. The
    moment at which an incident reaches the quorum is the time of the third authority's
    first report, so one aggregation per (incident, authority) and a rank of these decide.
    """
    eye = F.col("source_type").isin("individual", "multiple_witnesses") & F.col("incident_id").isNotNull()
    at = F.struct("published_at", "id")
    first = publications.filter(eye & F.col("authority").isNotNull()).groupBy("incident_id", "authority").agg(F.min(at).alias("_from"))
    quorum = top_rows(first, ["incident_id"], [F.col("_from").asc()], fixed.WITNESS_QUORUM).groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_from").alias("_from")
    ).filter(F.col("_n") >= fixed.WITNESS_QUORUM).drop("_n")
    joined = publications.join(quorum, "incident_id", "left")
    hit = F.coalesce((F.col("source_type") == "individual") & (at >= F.col("_from")), F.lit(False))
    return joined.withColumns(
        {
            "evidence_rank": F.when(hit, 3).otherwise(F.col("evidence_rank")),
            "confidence": F.when(hit, 0.62).otherwise(F.col("confidence")),
            "source_type": F.when(hit, "multiple_witnesses").otherwise(F.col("source_type")),
        }
    ).select(*publications.columns)


def incident_transitions(publications: DataFrame) -> DataFrame:
    """State of every incident after all of its publications in time order.

    Each field of the ordered fold is a decomposable aggregate (last, max, first,
    count), so no incident's history is gathered in one place.
    """
    order = F.struct("published_at", "id")
    ended = F.col("action_state") == "ended"
    starts = ~ended & F.col("event_type").isin("confinement_order", "evacuation_order")
    last = F.max_by(F.struct("title", "event_type", "risk_type", "es_alert_status", "action_state", "place_names"), order)
    return publications.filter(F.col("incident_id").isNotNull()).groupBy("incident_id").agg(
        last.alias("l"), F.max("published_at").alias("observed_at"), F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("transitions"),
        F.min_by(F.when(starts, F.coalesce("starts_at", "published_at")), F.when(starts, order)).alias("restriction_started_at"),
        F.max_by(F.when(ended, F.coalesce("ends_at", "published_at")), F.when(ended, order)).alias("ended_at"),
    ).select(
        "incident_id", F.when(F.col("l.action_state") == "ended", "controlled").otherwise("active").alias("status"),
        F.col("l.title").alias("summary"), F.col("l.event_type").alias("event_type"), F.col("l.risk_type").alias("risk_type"),
        F.col("l.es_alert_status").alias("es_alert_status"), F.col("l.place_names").alias("affected_locations"),
        "observed_at", "confidence", "transitions", "restriction_started_at", "ended_at",
    )


def incident_versions(publications: DataFrame, incidents: DataFrame) -> DataFrame:
    """One version row per transition, numbered after the incident's stored version.

    Numbers come from a running count inside hour blocks plus the blocks before, so a
    busy incident is spread over its hours.
    """
    rows = publications.filter(F.col("incident_id").isNotNull()).select("incident_id", "id", "published_at", "action_state", "title", "event_type")
    # Read twice below; the classes of a text are found once.
    rows = cut_lineage(rows, "versioned").withColumn("_hour", F.date_trunc("hour", "published_at"))
    per_hour = rows.groupBy("incident_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("incident_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_hour.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    in_hour = Window.partitionBy("incident_id", "_hour").orderBy("published_at", "id")
    numbered = rows.withColumn("_rn", F.row_number().over(in_hour)).join(offsets, ["incident_id", "_hour"])
    stored = incidents.select(F.col("id").alias("incident_id"), F.col("version").alias("_stored"))
    return numbered.join(stored, "incident_id", "left").select(
        "incident_id", (F.coalesce("_stored", F.lit(1)) + F.col("_before") + F.col("_rn")).alias("version"),
        F.when(F.col("action_state") == "ended", "controlled").otherwise("active").alias("status"),
        "title", F.col("event_type").alias("change_reason"), F.col("id").alias("publication_id"), F.col("published_at").alias("created_at"),
    )


def active_or_recent(incidents: DataFrame, as_of: str, window_hours: int = 24, limit: int | None = None) -> DataFrame:
    """Visible publication-based incidents that are active or were observed in the window, newest first."""
    if not 1 <= window_hours <= 720:
        raise ValueError("window_hours must be within 1 and 720")
    cutoff = dates.ts(as_of) - dates.span(hours=window_hours)
    out = incidents.filter(
        F.coalesce("osint", F.lit(False)) & F.col("merged_into").isNull() & ~F.coalesce(F.col("hidden"), F.lit(False))
        & ((F.col("status") == "active") | (F.col("observed_at") >= cutoff))
    ).orderBy(F.col("observed_at").desc_nulls_last(), F.col("id").desc())
    return out if limit is None else out.limit(limit)


EVIDENCE_FIELDS = [
    "id", "event_type", "risk_type", "action_state", "title", "authority", "published_at", "url", "source_type", "source_name",
    "confidence", "evidence_rank", "review_status",
]


def publication_payload(publications: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.select("source_id", F.col("name").alias("source_name"))
    return publications.join(named, "source_id", "left").select("incident_id", *EVIDENCE_FIELDS)


def incident_evidence(incidents: DataFrame, publications: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence rows (incident_id, position, ...) of the given incidents in time order, rejected ones left out.

    Rows, not nested lists: an incident may have any number of publications.
    ``evidence_document`` nests them for the incidents of one page.
    """
    shown = publications.filter(F.col("review_status") != "rejected").join(
        incidents.select(F.col("id").alias("incident_id")), "incident_id", "left_semi"
    )
    return publication_payload(shown, sources)


def evidence_document(page: DataFrame, publications: DataFrame, sources: DataFrame) -> DataFrame:
    """The incidents of one page with their publications nested in time order."""
    rows = incident_evidence(page, publications, sources)
    nested = rows.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("published_at", *[f for f in EVIDENCE_FIELDS if f != "published_at"]))).alias("timeline"))
    return page.join(nested.withColumnRenamed("incident_id", "id"), "id", "left")


def pending_count(publications: DataFrame) -> DataFrame:
    return publications.agg(F.count_if(F.col("review_status") == "pending").alias("pending"))


def review_queue(publications: DataFrame, limit: int | None = None) -> DataFrame:
    queue = publications.filter(F.col("review_status") == "pending").orderBy(F.col("published_at").desc(), F.col("id").asc())
    return queue if limit is None else queue.limit(limit)


def page_candidates(anchors: DataFrame, per_source: int = 5) -> DataFrame:
    """Anchors whose title has an emergency keyword, the first few per source."""
    hit = X.contains_any(X.normalize(F.col("title")), fixed.PAGE_TITLE_KEYWORDS)
    return top_rows(anchors.filter(hit), ["source"], [F.col("position").asc()], per_source)


def enrich_from_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Page text, date and places for candidates by url; missing pages keep the title as text."""
    text = X.html_text(F.col("html"))
    body = pages.select("url", text.alias("page_text"))
    joined = candidates.join(body, "url", "left")
    return joined.select(
        *candidates.columns, F.coalesce(F.nullif("page_text", F.lit("")), F.col("title")).alias("text"),
        dates.published_in_text(F.coalesce("page_text", F.lit("")), F.col("fetched_at")).alias("published_at"),
        X.places(F.coalesce("page_text", F.lit(""))).alias("place_hints"),
    )


def social_posts(posts: DataFrame, users: DataFrame, official: list[str]) -> DataFrame:
    """Posts joined to their authors; official accounts get the official source type."""
    accounts = [a.strip().lower() for a in official if a.strip()]
    joined = posts.join(users, "author_id", "left")
    username = F.coalesce("username", F.lit("unknown"))
    trusted = F.lower(username).isin(accounts) if accounts else F.lit(False)
    return joined.select(
        F.col("post_id").alias("external_id"), F.substring("text", 1, 500).alias("title"), F.col("text").alias("body"),
        F.concat(F.lit("https://x.com/"), username, F.lit("/status/"), F.col("post_id")).alias("url"),
        F.concat(F.lit("X @"), username).alias("source_name"), F.coalesce("name", username).alias("authority"),
        F.when(trusted, "official").otherwise("individual").alias("source_type"),
        F.when(trusted, 0.95).otherwise(1.0).alias("reliability"), "created_at",
    )
