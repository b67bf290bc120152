"""Multilingual text functions as Column expressions."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.functions import fixed

COMBINING = r"[̀-ͯ҃-҇᷀-᷿⃐-⃜︠-︯]"
# Compatibility characters that expand to more than one letter and do occur in prose.
EXPANSIONS = "…ŀĳﬁﬂﬀ™№½¼¾"


def plain(value: str) -> str:
    """Driver-side twin of ``normalize`` for literals and small vocabularies."""
    folded = unicodedata.normalize("NFKD", value.lower())
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).split())


@functools.lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """One-to-one folding of every letter of the Latin, Greek and Cyrillic blocks."""
    source, target = [], []
    for code in [*range(0xA0, 0x530), *range(0x1E00, 0x2070), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(folded) == 1 and folded != char:
            source.append(char)
            target.append(folded)
    return "".join(source), "".join(target)


def strip_accents(col: Column) -> Column:
    """NFKD without combining marks; plain ASCII text is returned as it is."""
    source, target = accent_table()
    expanded = col
    for char in EXPANSIONS:
        expanded = F.replace(expanded, F.lit(char), F.lit(unicodedata.normalize("NFKD", char)))
    wide = F.when(col.rlike(f"[{EXPANSIONS}]"), expanded).otherwise(col)
    return F.when(
        col.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(wide, source, target), COMBINING, "")
    ).otherwise(col)


# Every whitespace character, spelled out: the Unicode class flag is several times slower.
SPACES = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def collapse(col: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def normalize(col: Column) -> Column:
    """Lower case, accents removed, whitespace collapsed."""
    return collapse(strip_accents(F.lower(col)))


def normalize_match(col: Column) -> Column:
    """``normalize`` with case folding (sharp s becomes ss)."""
    return collapse(strip_accents(F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))))


@functools.lru_cache(maxsize=1)
def _folding() -> dict[str, str]:
    source, target = accent_table()
    return dict(zip(source, target)) | {c: unicodedata.normalize("NFKD", c) for c in EXPANSIONS}


def normalized_text(value: str) -> str:
    """``normalize`` of one text in a task: searching and folding a long text costs a small part of what it costs in Column functions."""
    folded = value.lower()
    if not folded.isascii():
        table = _folding()
        # A text has few different letters outside ASCII.
        for char in set(folded):
            if not char.isascii():
                folded = folded.replace(char, "" if re.match(COMBINING, char) else table.get(char, char))
        if not folded.isascii():
            folded = re.sub(COMBINING, "", folded)
    return " ".join(folded.split())


def geographic_words(value: str) -> list[str]:
    """Words of ``geographic`` of a normalized text, in a task."""
    return re.sub("[^a-z0-9]+", " ", normalized_text(value)).strip(" ").split(" ")


def text_windows(value: str | None, wanted: frozenset[str] | None, most: int) -> list[tuple[int, str, str]]:
    """What ``token_windows`` gives for one text."""
    words = [] if value is None else geographic_words(value)
    return [(i, w, " ".join(words[i:i + most])) for i, w in enumerate(words) if wanted is None or w in wanted]


def token_windows(text: Column, heads: list[str] | None, most: int) -> Column:
    """(at, head, window) of the words of ``geographic`` of a normalized text that are among ``heads`` (None: all), each with what follows, ``most`` words in all."""
    wanted = None if heads is None else frozenset(heads)

    def every(texts: pd.Series) -> pd.Series:
        shown = lambda t: None if t is None else [dict(zip(("at", "head", "window"), w)) for w in text_windows(t, wanted, most)]
        return pd.Series([shown(t) for t in texts], dtype=object)

    return F.pandas_udf(every, "array<struct<at: int, head: string, window: string>>")(text)


def geographic(normalized: Column) -> Column:
    """Normalized text reduced to space-separated ASCII words and numbers."""
    return F.trim(F.regexp_replace(normalized, "[^a-z0-9]+", " "))


def contains_any(col: Column, terms: Iterable[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(col, F.lit(t)) for t in terms])


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_sql(column: str, terms: Iterable[str]) -> str:
    return " OR ".join(f"contains(`{column}`, {_quoted(plain(t))})" for t in terms)


def _rules_sql(column: str, rules: dict[str, list[str]], default: str) -> str:
    cases = " ".join(f"WHEN {_any_sql(column, terms)} THEN '{name}'" for name, terms in rules.items())
    return f"CASE {cases} ELSE '{default}' END"


def first_rule(column: str, rules: dict[str, list[str]], default: str) -> Column:
    """Name of the first rule with a term inside the named text column."""
    return F.expr(_rules_sql(column, rules, default))


def incident_hashtags(text: Column) -> Column:
    """Distinct ``#if...`` tags longer than five characters that are not ``#info...``."""
    every = F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)(#[\wÀ-ÿ-]{3,80})"), F.lit(1))
    tags = F.when(text.isNull() | text.rlike("#[iI][fF]"), every).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.filter(
            tags,
            lambda t: F.lower(t).startswith("#if") & ~F.lower(t).startswith("#info") & (F.length(t) > 5),
        )
    )


def event_class(column: str) -> Column:
    """Event class of a normalized text column; texts about the alert channel only match alert classes."""
    alerts = {k: v for k, v in fixed.EVENT_TERMS.items() if k.startswith("es_alert_")}
    other = "other_emergency_update"
    return F.when(F.contains(F.col(column), F.lit("es-alert")), first_rule(column, alerts, other)).otherwise(
        first_rule(column, fixed.EVENT_TERMS, other)
    )


def fire_filled(event: Column, normalized: Column, has_fire_tag: Column) -> Column:
    """Fire hashtags fill an otherwise empty event class."""
    fire = has_fire_tag | F.contains(normalized, F.lit("#iiff"))
    return F.when(fire & (event == "other_emergency_update"), "firefighting_update").otherwise(event)


def risk_type(column: str, has_fire_tag: Column) -> Column:
    fire = has_fire_tag | F.contains(F.col(column), F.lit("#iiff"))
    return F.when(fire, "wildfire").otherwise(first_rule(column, fixed.RISK_TERMS, "other"))


def _rule_of(text: str, rules: dict[str, list[str]], default: str) -> str:
    return next((name for name, terms in rules.items() if any(t in text for t in terms)), default)


@functools.lru_cache(maxsize=1)
def _vocabulary() -> tuple[dict, dict, dict, dict, list[str]]:
    plained = lambda rules: {name: [plain(t) for t in terms] for name, terms in rules.items()}
    events = plained(fixed.EVENT_TERMS)
    alerts = {k: v for k, v in events.items() if k.startswith("es_alert_")}
    markers = {lang: [f" {w} " for w in words] for lang, words in fixed.LANGUAGE_MARKERS.items()}
    return events, alerts, plained(fixed.RISK_TERMS), markers, fixed.INSTRUCTION_TERMS


def _classes(text: str | None, tagged: bool | None) -> tuple:
    other = "other_emergency_update"
    if text is None:
        return None, other, "wildfire" if tagged else "other", None, False
    events, alerts, risks, markers, told = _vocabulary()
    plain_text = normalized_text(text)
    fire = bool(tagged) or "#iiff" in plain_text
    event = _rule_of(plain_text, alerts if "es-alert" in plain_text else events, other)
    risk = "wildfire" if fire else _rule_of(plain_text, risks, "other")
    padded = f" {plain_text} "
    scores = {lang: sum(w in padded for w in words) for lang, words in markers.items()}
    best = max(scores, key=scores.get)
    return (
        plain_text, "firefighting_update" if fire and event == other else event, risk, best if scores[best] else "und",
        any(t in plain_text for t in told),
    )


def text_classes(text: Column, tagged: Column) -> Column:
    """``normalize``, ``event_class`` with ``fire_filled``, ``risk_type`` and ``language`` of a text, and whether it holds an instruction term.

    ``tagged`` says whether the text has a fire hashtag. Row by row; nothing is kept.
    """
    return F.pandas_udf(_all_classes, "normalized string, event string, risk string, language string, told boolean")(text, tagged)


def _all_classes(texts: pd.Series, tagged: pd.Series) -> pd.DataFrame:
    rows = [_classes(t, None if pd.isna(g) else g) for t, g in zip(texts, tagged)]
    return pd.DataFrame(rows, columns=["normalized", "event", "risk", "language", "told"])


def action_state(event: Column) -> Column:
    ended = event.endswith("_lift") | event.isin("plan_deactivation", "es_alert_cancelled", "fire_extinguished")
    return (
        F.when(ended, "ended")
        .when(event.isin("evacuation_expansion", "plan_update"), "updated")
        .otherwise("started")
    )


def es_alert_evidence(event: Column, source_type: Column) -> Column:
    return (
        F.when(event == "es_alert_announcement", "announced")
        .when((event == "es_alert_sent") & (source_type == "official"), "confirmed_sent")
        .when(event.isin("es_alert_sent", "es_alert_received"), "presumed_received")
        .when(event == "es_alert_cancelled", "cancelled")
        .when(event == "es_alert_test", "test")
        .otherwise("not_applicable")
    )


def language(column: str) -> Column:
    """Language of a normalized text column with most marker words; ties go to the earlier one, none is ``und``."""
    scores = {
        lang: "(" + " + ".join(f"CAST(contains(concat(' ', `{column}`, ' '), ' {w} ') AS INT)" for w in words) + ")"
        for lang, words in fixed.LANGUAGE_MARKERS.items()
    }
    best = f"greatest({', '.join(scores.values())})"
    cases = " ".join(f"WHEN {score} = {best} THEN '{lang}'" for lang, score in scores.items())
    return F.expr(f"CASE WHEN {best} = 0 THEN 'und' {cases} END")


def instructions(text: Column, most: int | None = None) -> Column:
    """Sentences that tell people what to do, joined; ``most`` characters of them where a view wants a cut."""
    sentences = F.transform(
        F.split(text, r"(?<=[.!?])\s+|[\r\n]+"), lambda s: F.struct(F.trim(s).alias("raw"), normalize(s).alias("plain"))
    )
    kept = F.filter(sentences, lambda s: contains_any(s["plain"], fixed.INSTRUCTION_TERMS))
    joined = F.array_join(F.transform(kept, lambda s: s["raw"]), " ")
    return F.nullif(joined if most is None else F.substring(joined, 1, most), F.lit(""))


# Patterns of a quoted literal alert message.
QUOTED_ALERT = [
    r"(?is)(?:text(?: literal)?|missatge|mensaje)\s*(?:de l['’]es-alert|del es-alert|es-alert)?"
    r"\s*[:\-]\s*[\"“](.{20,1500}?)[\"”]",
    r"(?is)ES-Alert\s*[:\-]\s*[\"“](.{20,1500}?)[\"”]",
]


def es_alert_message(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in QUOTED_ALERT]
    return F.when(text.rlike(r"[:\-]\s*[\"“]"), collapse(F.coalesce(*found)))


# Pattern of a place introduced by an administrative noun.
PLACE_AFTER_NOUN = (
    r"(?=[mtcupz])(?:municipi(?:o)?|terme municipal|termino municipal|concello|udalerri|urbanitzaci[oó]|urbanizaci[oó]n"
    r"|poblaci[oó]n?|zona)\s+(?:de\s+|d['’])?([A-ZÁÉÍÓÚÜÑÀÈÌÒÙÇ][^,.;:\n()]{1,100})"
)


def places(text: Column, most: int | None = None) -> Column:
    """Places named after an administrative noun, distinct in order, all or the first ``most``."""
    raw = F.regexp_extract_all(text, F.lit(PLACE_AFTER_NOUN), F.lit(1))
    names = F.transform(
        raw,
        lambda n: F.regexp_replace(F.btrim(n, F.lit(" ,.;:()")), r"^(?:La|El|Les|Los|Las)\s+", ""),
    )
    found = F.array_distinct(F.filter(names, lambda n: n != ""))
    return found if most is None else F.slice(found, 1, most)


# Pattern of "region -> target" summaries.
ARROW_PAIR = r"(?:✅\s*)?([^✅➡→\n:]{2,50}?)\s*(?:➡️?|→|->)\s*([^✅.\n]{2,100})"


def arrow_side(text: Column, group: int) -> Column:
    """Distinct left (1) or right (2) sides of arrow pairs, in order."""
    raw = F.when(
        text.rlike("➡|→|->"), F.regexp_extract_all(text, F.lit(ARROW_PAIR), F.lit(group))
    ).otherwise(F.array().cast("array<string>"))
    trimmed = F.transform(raw, lambda v: F.btrim(v, F.lit(" ,;:-")))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def publication_hash(url: Column, normalized_text: Column) -> Column:
    base = F.rtrim(F.substring_index(url, "#", 1), F.lit("/"))
    return F.sha2(F.concat(base, F.lit("|"), normalized_text), 256)


def alnum_token(col: Column) -> Column:
    """Upper-case letters and digits only; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(col.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]", "")


def icao24(col: Column) -> Column:
    token = F.lower(alnum_token(col))
    return F.when(token.rlike("^[0-9a-f]{6}$"), token).otherwise(F.lit(""))


def road_ref(col: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), "[^A-Z0-9]", "")


def road_ref_tokens(col: Column) -> Column:
    parts = F.split(F.coalesce(col, F.lit("")), "[,;/| ]+")
    return F.array_distinct(F.filter(F.transform(parts, road_ref), lambda t: t != ""))


def matches_road_ref(value: Column, ref: Column) -> Column:
    """True when ``ref`` stands alone in a delimited list of references."""
    quoted = F.concat(F.lit(r"(?i)(^|;|,| )(\Q"), ref, F.lit(r"\E)($|;|,| )"))
    return value.rlike(quoted) if isinstance(quoted, str) else F.rlike(value, quoted)


def clean(col: Column, length: int | None = None) -> Column:
    """Trimmed text, empty as null, optionally truncated."""
    out = F.nullif(F.trim(col.cast("string")), F.lit(""))
    return F.substring(out, 1, length) if length else out


def title_tokens(normalized: Column) -> Column:
    stop = F.array(*[F.lit(t) for t in fixed.TITLE_STOP_TOKENS])
    return F.array_distinct(
        F.filter(F.split(normalized, " "), lambda t: (F.length(t) > 4) & ~F.array_contains(stop, t))
    )


def word_pairs(words: Column) -> Column:
    """Every two different words, as keys that no place can have."""
    ordered = F.array_sort(F.array_distinct(words))
    return F.flatten(F.transform(ordered, lambda a: F.transform(F.filter(ordered, lambda b: b > a), lambda b: F.concat(F.lit("\x01"), a, F.lit("\x01"), b))))


def risk_label(risk: Column) -> Column:
    return F.initcap(F.replace(risk, F.lit("_"), F.lit(" ")))


def merge_spellings(arrays: Column) -> Column:
    """Union of tag arrays ignoring case: first spelling kept, sorted ignoring case."""
    flat = F.filter(F.flatten(arrays), lambda v: v.isNotNull() & (v != ""))
    lowered = F.transform(flat, F.lower)
    firsts = F.filter(flat, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)
    return F.transform(
        F.array_sort(F.transform(firsts, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))),
        lambda s: s["v"],
    )


def html_text(html: Column) -> Column:
    """Visible text: hidden elements and comments dropped, tags removed, entities decoded.

    Inline tags split words the way the text nodes of the page do, so every
    tag becomes a space before whitespace is collapsed.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", " ")
    return collapse(decode_entities(F.regexp_replace(body, r"(?s)<[a-zA-Z/][^>]*>", " ")))


# Named entities met in pages.
ENTITIES: Sequence[tuple[str, str]] = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"),
)


def decode_entities(col: Column) -> Column:
    out = col
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_tags(col: Column) -> Column:
    return collapse(F.regexp_replace(col, "<[^>]+>", " "))
