"""RSS / Atom feeds, social gateways, pages, posts, catalogues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import dates
from emberlake.functions import text as X


def _tag(block: Column, *names: str) -> Column:
    """Text of the first non-empty child with one of the names; CDATA unwrapped, entities decoded."""
    found = []
    for name in names:
        inner = F.regexp_extract(block, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1)
        plain = F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        found.append(F.nullif(F.trim(X.decode_entities(plain)), F.lit("")))
    return F.coalesce(*found, F.lit(""))


def items(raw: DataFrame) -> DataFrame:
    """One row per RSS item or Atom entry with its plain fields."""
    blocks = raw.select(
        "url", "fetched_at", F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<((?:\w+:)?(item|entry)\b.*?</(?:\w+:)?(?:item|entry))>"), F.lit(1))).alias("b")
    )
    href = F.regexp_extract("b", r"<(?:\w+:)?link\b[^>]*href=[\"']([^\"']+)", 1)
    return blocks.select(
        F.col("url").alias("feed_url"), "fetched_at", _tag(F.col("b"), "title").alias("title"), _tag(F.col("b"), "description", "summary", "content").alias("description"),
        F.coalesce(F.nullif(_tag(F.col("b"), "link"), F.lit("")), href).alias("link"), _tag(F.col("b"), "guid", "id").alias("guid"),
        _tag(F.col("b"), "pubDate", "published", "updated").alias("published"),
    )


def publications(raw: DataFrame) -> DataFrame:
    """Feed items as publications (external_id, title, body, url, published_at)."""
    rows = items(raw).withColumn("external_id", F.coalesce(F.nullif("guid", F.lit("")), F.nullif("link", F.lit(""))))
    fallback = X.publication_hash(F.col("link"), X.normalize(F.col("title")))
    return rows.select(
        F.coalesce("external_id", fallback).alias("external_id"), "title", X.strip_tags(F.col("description")).alias("body"),
        F.coalesce(F.nullif("link", F.lit("")), F.col("feed_url")).alias("url"), dates.feed_date(F.col("published"), F.col("fetched_at")).alias("published_at"),
    )


def gateway_posts(raw: DataFrame, account: dict[str, str], base_url: str) -> DataFrame:
    """Posts of one account read through a gateway: reposts dropped, addresses made canonical."""
    handle, root = account["handle"], base_url.rstrip("/")
    rows = publications(raw).filter(~X.normalize(F.col("title")).startswith("rt by @"))
    pattern = rf"(?i)^{re.escape(root)}/{re.escape(handle)}/status/"
    canonical = F.substring_index(F.regexp_replace("url", pattern, f"https://x.com/{handle}/status/"), "#", 1)
    return rows.select(
        F.concat(F.lit(f"nitter:{handle}:"), "external_id").alias("external_id"), "title", F.col("title").alias("body"),
        F.substring_index("url", "#", 1).alias("url"), "published_at", X.places(F.col("title")).alias("place_hints"),
        canonical.alias("canonical_url"), F.lit(account["authority"]).alias("authority"),
        F.lit(account.get("source_type", "official")).alias("source_type"), F.lit(float(account.get("reliability", "0.95"))).alias("reliability"),
        F.lit(f"X @{handle} via Nitter").alias("source_name"),
    )


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against its page: absolute, protocol-relative, root-relative, query, or relative."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*):", 1)
    host = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page.rlike(r"^[a-zA-Z][\w+.-]*://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(host, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )


def anchors(pages: DataFrame, min_length: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_url, position, url, title) of links whose text is long enough, after the ``keep`` columns of their page."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(a\b[^>]*\bhref\s*=[^>]*>.*?</a)\s*>"), F.lit(1))
    rows = pages.select(*keep, F.col("url").alias("page_url"), F.posexplode(found).alias("position", "a"))
    href = F.regexp_extract("a", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    title = X.collapse(X.decode_entities(F.regexp_replace(F.regexp_replace("a", r"(?is)^a\b[^>]*>|</a$", ""), r"(?s)<[^>]*>", " ")))
    out = rows.select(*keep, "page_url", "position", X.decode_entities(href).alias("href"), title.alias("title")).filter(F.length("title") >= min_length)
    return out.select(*keep, "page_url", "position", absolute_url(F.col("page_url"), F.col("href")).alias("url"), "title")


POSTS = (
    "struct<data:array<struct<id:string,text:string,author_id:string,created_at:string>>,"
    "includes:struct<users:array<struct<id:string,name:string,username:string,verified:boolean>>>>"
)


def post_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts, users) of post-search payloads."""
    doc = raw.select(F.from_json("payload", POSTS).alias("d"))
    posts = doc.select(F.explode("d.data").alias("p")).select(
        F.col("p.id").alias("post_id"), "p.text", "p.author_id", dates.iso(F.col("p.created_at")).alias("created_at")
    )
    users = doc.select(F.explode("d.includes.users").alias("u")).select(F.col("u.id").alias("author_id"), "u.name", "u.username", "u.verified").distinct()
    return posts, users


def catalogue(raw: DataFrame) -> DataFrame:
    """Enabled sources of a catalogue document."""
    schema = "array<struct<name:string,authority:string,url:string,source_type:string,format:string,enabled:boolean,reliability:double>>"
    rows = raw.select(F.explode(F.from_json("payload", schema)).alias("s")).select("s.*")
    return rows.filter(F.coalesce("enabled", F.lit(True))).withColumn("reliability", F.coalesce("reliability", F.lit(1.0)))


def accounts(raw: DataFrame, gateway: str = "https://nitter.net") -> DataFrame:
    """Institutional accounts with their public addresses."""
    rows = raw.select(F.explode(F.from_json("payload", "array<struct<handle:string,authority:string,source_type:string,reliability:string>>")).alias("a")).select("a.*")
    return rows.withColumns({"x_url": F.concat(F.lit("https://x.com/"), "handle"), "gateway_url": F.concat(F.lit(f"{gateway.rstrip('/')}/"), "handle")})


def gazetteer(pages: list[DataFrame]) -> DataFrame:
    """Distinct municipality names over all pages of a boundary service."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out.filter(F.col("name").isNotNull() & (F.col("name") != "")).dropDuplicates(["name"])


INTAKE = (
    "array<struct<external_id:string,title:string,text:string,url:string,source_name:string,authority:string,source_type:string,published_at:timestamp,"
    "starts_at:timestamp,ends_at:timestamp,locations:array<string>,geometry:string,metadata:map<string,string>>>"
)


def intake(raw: DataFrame, max_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalized publications, payloads that are no list of records or, with ``max_batch``, too long, as dead letters)."""
    rows = raw.withColumn("records", F.from_json("payload", INTAKE))
    fits = F.col("records").isNotNull() if max_batch is None else F.coalesce(F.size("records") <= max_batch, F.lit(False))
    good = rows.filter(fits).select(F.explode("records").alias("r")).select("r.*")
    rule = F.when(F.col("records").isNull(), "payload_is_json").otherwise("batch_size")
    bad = rows.filter(~fits).select("url", "payload", rule.alias("rule"))
    return good.withColumn("reliability", F.lit(1.0)), bad
