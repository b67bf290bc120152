"""Registered streaming queries: each runs once over what is there and must equal its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import DAY_US, ctes, load
from emberlake.registry import civil, osint
from emberlake.session import checkpoint_root
from emberlake.streaming import jobs

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


def played(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a streaming query writes while ``parts`` arrive one after the other and the query stops and goes on in between."""
    spark = parts[0].sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/emberlake/stream-{uuid.uuid4().hex}"
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        out = build(jobs.read_raw(spark, f"{root}/in", parts[0].schema))
        jobs.start(out, f"{root}/checkpoint", jobs.append_to(f"{root}/out"), mode=mode).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(out.schema).parquet(f"{root}/out")


def halves(df: DataFrame, column: str) -> list[DataFrame]:
    return [df.filter(F.col(column) % 2 == 0), df.filter(F.col(column) % 2 == 1)]


def days_spanned(rows: DataFrame, stamp: str = "observed_at") -> int:
    """Whole days that a watermark must wait so that no row of ``rows`` is late, whatever order they arrive in."""
    us = F.unix_micros(stamp)
    # A day more for local time, which moves against UTC within a year.
    return int(rows.agg(F.ceil((F.max(us) - F.min(us)) / DAY_US)).first()[0] or 0) + 1


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "detections").select("event_id", "user_id", "observed_at")


@register("streamed_local_days", civil.ORACLE["detection_local_days"])
def streamed_local_days(spark: SparkSession, sf: str) -> DataFrame:
    """Local days of a stream; a row far ahead closes the last day and is not part of a closed one."""
    rows = detections(spark, sf)
    # Both halves hold rows of all days: the second is as late as the watermark allows.
    days = days_spanned(rows)
    ahead = rows.agg((F.max("observed_at") + F.expr(f"INTERVAL {days + 3} DAYS")).alias("observed_at")).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), "observed_at")
    found = played([*halves(rows, "event_id"), ahead], lambda s: jobs.daily_counts(s, late=f"{days} days"))
    return found.select(F.col("day").cast("string").alias("day"), "moments", "detections", civil.stamp("observed_from"), civil.stamp("observed_to"))


@register("streamed_minutes", ctes("detections") + """
SELECT epoch_us(date_trunc('minute', observed_at)) AS minute_us, count(*) AS "count" FROM detections GROUP BY 1""")
def streamed_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Detections per minute; the newest state of a minute counts."""
    rows = detections(spark, sf)
    days = days_spanned(rows)
    out = played(halves(rows, "event_id"), lambda s: jobs.minute_counts(s, late=f"{days} days"), "update")
    return out.groupBy(F.unix_micros("observed_at").alias("minute_us")).agg(F.max("count").alias("count"))


@register("streamed_unique", ctes("detections") + """
SELECT user_id, event_id % 3 AS part FROM detections GROUP BY ALL""")
def streamed_unique(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and sensor of two overlapping arrivals."""
    rows = detections(spark, sf).select("user_id", (F.col("event_id") % 3).alias("part"), F.concat_ws("|", "user_id", F.col("event_id") % 3).alias("deduplication_hash"), F.col("observed_at").alias("received_at"))
    days = days_spanned(rows, "received_at")
    return played([rows, rows], lambda s: jobs.deduplicated(s, days=days)).select("user_id", "part")


@register("streamed_positions", ctes("detections") + """
SELECT CAST(user_id AS STRING) AS icao24, max(observed_us) AS newest_us FROM detections GROUP BY 1""")
def streamed_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Newest position of every aircraft."""
    rows = detections(spark, sf).select("event_id", F.col("user_id").cast("string").alias("icao24"), "observed_at")
    out = played(halves(rows, "event_id"), jobs.latest_positions, "update")
    return out.groupBy("icao24").agg(F.max(F.unix_micros("observed_at")).alias("newest_us"))


@register("streamed_transitions", osint.ORACLE["incident_transitions"])
def streamed_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """State of every incident after its publications came in two parts."""
    kept, _ = osint.osint.discard_non_events(osint.publications(spark, sf))
    rows = kept.select("doc_id", "id", "incident_id", "published_at", "title", "event_type", "risk_type", "action_state", "confidence")
    out = played(halves(rows, "doc_id"), jobs.incident_state, "update")
    last = out.groupBy("incident_id").agg(F.max_by(F.struct("status", "event_type", "observed_us", "transitions", "ended_us", "restriction_started_us"), "transitions").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return last.select("incident_id", "s.status", "s.event_type", "s.observed_us", "s.transitions", zero("s.ended_us").alias("ended_us"), zero("s.restriction_started_us").alias("started_us"))


@register("streamed_witnesses", ctes("publications") + """
SELECT 'inc-' || doc_id % 60 AS incident_id, CAST(count(DISTINCT authority) AS INT) AS witnesses, count(DISTINCT authority) >= 3 AS promoted
FROM publications WHERE source_type IN ('individual', 'multiple_witnesses') GROUP BY 1""")
def streamed_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    """Witnesses of every incident after all reports."""
    rows = load(spark, sf, "publications").select("doc_id", F.concat(F.lit("inc-"), (F.col("doc_id") % 60).cast("string")).alias("incident_id"), "authority", "source_type")
    out = played(halves(rows, "doc_id"), jobs.witnesses, "update")
    return out.groupBy("incident_id").agg(F.max("witnesses").alias("witnesses"), F.max("promoted").alias("promoted"))


@register("late_rows", ctes("detections") + f""", b AS (SELECT max(observed_us) - 5 * {DAY_US} AS bound FROM detections WHERE event_id % 2 = 0)
SELECT CASE WHEN event_id % 2 = 1 AND observed_us < bound THEN 'late' ELSE 'kept' END AS fate, event_id FROM detections, b""")
def late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every received row is kept or a dead letter: the second half meets a watermark of five days behind the first."""
    root = f"{checkpoint_root(spark).rstrip('/')}/emberlake/late-{uuid.uuid4().hex}"
    for part in halves(detections(spark, sf), "event_id"):
        part.write.mode("append").parquet(f"{root}/in")
        jobs.start(jobs.read_raw(spark, f"{root}/in", part.schema), f"{root}/checkpoint", jobs.split_late(spark, root, delay_us=5 * DAY_US)).awaitTermination()
    read = lambda kind: spark.read.parquet(f"{root}/{kind}").select(F.lit(kind).alias("fate"), "event_id")
    return read("kept").unionByName(read("late"))
