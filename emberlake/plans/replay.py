"""Replay of archived detection payloads through validation, deduplication and insertion.

A ledger keeps the outcome of every payload by its digest. Payloads with a completed
outcome are left out of later runs, failed ones are tried again, so replaying an archive
twice changes nothing the second time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import fixed
from emberlake.operators.dedupe import keep_first
from emberlake.operators.stage import computed
from emberlake.session import cut_lineage
from emberlake.sources import detections

LEDGER = "payload_digest string, url string, status string, received long, discarded long, duplicated long, persisted long, error string"
#: Columns a payload may have beyond those it must have.
OPTIONAL = ["firms_source", "instrument", "scan", "track", "version", "bright_ti4", "bright_ti5", "brightness", "bright_t31", "frp", "daynight", "satellite", "confidence"]
#: Fields of a line that are read; a payload with a wider header fails.
WIDEST = 64


class Replay(NamedTuple):
    """detections: new rows of the target; ledger: new outcomes; dead: payloads that failed."""

    detections: DataFrame
    ledger: DataFrame
    dead: DataFrame


def _lines() -> Column:
    return F.split(F.regexp_replace("payload", "\r\n?", "\n"), "\n")


def _header() -> Column:
    """Column names of a payload; names hold no commas."""
    return F.transform(F.split(F.replace(F.get(_lines(), F.lit(0)), F.lit('"'), F.lit("")), ","), F.trim)


def payload_rows(payloads: DataFrame) -> DataFrame:
    """Lines of CSV payloads as maps from column to text: payload_digest, number, fields. Quoted fields may hold commas."""
    schema = ", ".join(f"c{i} string" for i in range(WIDEST))
    body = payloads.select("payload_digest", _header().alias("header"), F.posexplode(_lines()).alias("number", "line")).filter("number > 0 AND trim(line) <> ''")
    # One parse per line; the fields of the result are then read as an array.
    parsed = computed(body, row=F.from_csv("line", schema))
    values = F.slice(F.array(*[F.col("row")[f"c{i}"] for i in range(WIDEST)]), F.lit(1), F.size("header"))
    return parsed.select("payload_digest", "number", F.map_from_arrays("header", values).alias("fields"))


def replay_detections(payloads: DataFrame, ledger: DataFrame, target: DataFrame, bbox=fixed.SPAIN_BBOX) -> Replay:
    """Run archived payloads (url, payload, fetched_at) that have no completed outcome yet.

    A payload fails when a required column is missing, a column repeats, or it has no rows.
    Rows outside the region or without coordinates are discarded; of equal rows the first of
    a payload counts; rows whose hash another payload of the run or ``target`` holds are
    duplicates. Equal payloads are one, under the earliest url.
    """
    done = ledger.filter("status = 'completed'").select("payload_digest").distinct()
    fresh = payloads.filter(F.col("payload").isNotNull()).withColumn("payload_digest", F.sha2("payload", 256)).join(done, "payload_digest", "left_anti")
    fresh = cut_lineage(keep_first(fresh, ["payload_digest"], ["fetched_at", "url"]), "payloads")
    header = _header()
    missing = F.array_except(F.array(*[F.lit(c) for c in fixed.DETECTION_REQUIRED]), header)
    lines = F.size(F.filter(_lines(), lambda v: F.trim(v) != "")) - 1
    error = (
        F.when(F.size(missing) > 0, F.concat(F.lit("payload is missing required columns: "), F.array_join(F.array_sort(missing), ", ")))
        .when(F.size(header) != F.size(F.array_distinct(header)), F.lit("payload repeats a column")).when(F.size(header) > WIDEST, F.lit("payload has too many columns"))
        .when(lines < 1, F.lit("payload has no rows"))
    )
    judged = cut_lineage(fresh.withColumn("error", error), "judged-payloads")
    valid, dead = judged.filter("error IS NULL"), judged.filter("error IS NOT NULL")
    names = list(dict.fromkeys(["firms_source", *fixed.DETECTION_REQUIRED, *OPTIONAL]))
    rows = payload_rows(valid).select("payload_digest", "number", *[F.col("fields")[c].alias(c) for c in names])
    received = rows.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("received"))
    parsed = detections.normalize(rows, bbox, keep=["payload_digest", "number"], raw=names)
    parsed = cut_lineage(parsed, "replayed-rows")
    unique = keep_first(parsed, ["payload_digest", "deduplication_hash"], ["number"])
    first = keep_first(unique.join(valid.select("payload_digest", "fetched_at"), "payload_digest"), ["deduplication_hash"], ["fetched_at", "payload_digest"])
    new = cut_lineage(first.drop("fetched_at").join(target.select("deduplication_hash").distinct(), "deduplication_hash", "left_anti"), "new-detections")
    inside = parsed.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_inside"))
    stored = new.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("persisted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    outcome = judged.join(received, "payload_digest", "left").join(inside, "payload_digest", "left").join(stored, "payload_digest", "left").select(
        "payload_digest", "url", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), zero("received").alias("received"),
        (zero("received") - zero("_inside")).alias("discarded"), (zero("_inside") - zero("persisted")).alias("duplicated"), zero("persisted").alias("persisted"), "error",
    )
    return Replay(new.drop("number"), outcome, dead.select("payload_digest", "url", "payload", F.col("error").alias("rule")))
