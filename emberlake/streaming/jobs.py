"""Streaming twins of the batch operators. Every job names the batch function it must agree with."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberlake.functions import fixed, geo
from emberlake.operators.merge import expire_missing, reactivate
from emberlake.plans.sessions import activity_sessions
from emberlake.sinks.zones import SnapshotTable

# Polling periods of the feeds in seconds.
SCHEDULES = {
    "detections": 900, "publications": 300, "traffic": 300, "traffic_map": 300, "road_enrichment": 60, "weather": 3600,
    "alerts": 300, "plans": 300, "perimeters": 86_400, "roads": 86_400,
}


def read_raw(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of new files in a landing folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], feed: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run a sink per micro-batch: on the feed's schedule, or once over what is there.

    The checkpoint makes the query the single writer of its sink and restarts it
    after a loss without repeating or skipping a batch.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=f"{SCHEDULES[feed]} seconds") if feed else writer.trigger(availableNow=True)
    return writer.start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes every batch to its own folder, so a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def deduplicated(stream: DataFrame, key: str = "deduplication_hash", stamp: str = "received_at", days: int = 14) -> DataFrame:
    """First copy of every hash (twin of ``dedupe.keep_first``)."""
    return stream.withWatermark(stamp, f"{days} days").dropDuplicatesWithinWatermark([key])


def minute_counts(stream: DataFrame, stamp: str = "observed_at", late: str = "14 days") -> DataFrame:
    """Detections per minute (twin of ``civil.detection_timeline``)."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, "1 minute")).agg(F.count(F.lit(1)).alias("count")).select(
        F.col("window.start").alias("observed_at"), "count"
    )


def daily_counts(stream: DataFrame, stamp: str = "observed_at", late: str = "14 days") -> DataFrame:
    """Per Madrid day: moments, detections, first and last minute (twin of ``civil.local_days`` over its timeline).

    Two chained aggregations in append mode: minutes, then days of the minutes that are
    complete. Event time is local, so a day of 23 or 25 hours is one window; minutes of the
    repeated hour stay apart by their distance from UTC. A day appears once the watermark,
    which is local time too, has passed it.
    """
    local = stream.withColumn("_local", F.from_utc_timestamp(F.col(stamp), "Europe/Madrid"))
    shift = F.unix_micros("_local") - F.unix_micros(stamp)
    minutes = local.withColumn("_shift", shift).withWatermark("_local", late).groupBy(F.window("_local", "1 minute"), "_shift").agg(F.count(F.lit(1)).alias("_n"))
    minutes = minutes.select(F.window_time("window").alias("_at"), F.timestamp_micros(F.unix_micros("window.start") - F.col("_shift")).alias("_minute"), "_n")
    return minutes.groupBy(F.window("_at", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("moments"), F.sum("_n").alias("detections"), F.min("_minute").alias("observed_from"), F.max("_minute").alias("_last")
    ).select(
        F.to_date("day.start").alias("day"), "moments", "detections", "observed_from", (F.col("_last") + F.expr("INTERVAL '59.999' SECOND")).alias("observed_to")
    )


def sessions(stream: DataFrame, keys: list[str], stamp: str = "observed_at", late: str = "14 days") -> DataFrame:
    """Activity sessions that the watermark has closed (twin of ``sessions.activity_sessions``)."""
    return activity_sessions(stream.withWatermark(stamp, late), keys, stamp)


def split_late(spark: SparkSession, root: str, stamp: str = "observed_at", delay_us: int = 14 * 86_400_000_000) -> Callable[[DataFrame, int], None]:
    """Sink that keeps rows behind the watermark as dead letters instead of losing them.

    A row is late if it is older than the newest row of all earlier batches by more than the
    delay, which is the bound a watermark of that delay has. Kept rows go to ``root``/kept,
    late ones to ``root``/late, the newest stamp of a batch to ``root``/newest; every batch
    has its own folders, so a repeated batch replaces itself. Rows without a stamp are kept.
    """
    schema = "batch long, newest long"

    def apply(batch: DataFrame, number: int) -> None:
        path = root.rstrip("/")
        rows = batch.persist()
        known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/newest") if number else spark.createDataFrame([], schema)
        newest = known.filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        late = F.coalesce(F.unix_micros(stamp) < F.lit(None if newest is None else newest - delay_us).cast("long"), F.lit(False))
        rows.filter(~late).write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        rows.filter(late).withColumn("rule", F.lit("behind_watermark")).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rows.agg(F.max(F.unix_micros(stamp)).alias("newest")).select(F.lit(number).cast("long").alias("batch"), "newest").write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        rows.unpersist()

    return apply


class RowLosses(StreamingQueryListener):
    """Rows that queries received and that their stateful operators dropped behind the watermark, by query name or id."""

    def __init__(self) -> None:
        self.received: Counter[str] = Counter()
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        self.received[name] += progress.numInputRows
        self.dropped[name] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


def witnesses(stream: DataFrame) -> DataFrame:
    """Number of authorities per incident, updated as reports arrive (twin of ``osint.promote_witnesses``).

    The state of an incident is the set of its authorities: the rule is exact.
    """
    eye = stream.filter(F.col("source_type").isin("individual", "multiple_witnesses"))
    return eye.groupBy("incident_id").agg(F.size(F.collect_set("authority")).alias("witnesses")).withColumn(
        "promoted", F.col("witnesses") >= fixed.WITNESS_QUORUM
    )


def enriched(stream: DataFrame, sources: DataFrame) -> DataFrame:
    """Stream-static lookup of the source of every record."""
    return stream.join(sources.select("source_id", F.col("name").alias("source_name"), "reliability_score"), "source_id", "left")


def latest_positions(stream: DataFrame, key: str = "icao24") -> DataFrame:
    """Newest position per aircraft, in update mode (twin of ``aircraft.live_aircraft``)."""
    fields = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*fields), "observed_at").alias("p")).select(key, "p.*")


def detections_near_perimeters(detections: DataFrame, perimeters: DataFrame, late: str = "14 days") -> DataFrame:
    """Detection-perimeter matches as both arrive (twin of the candidate step of ``reconcile.link_detections_to_fires``).

    Both sides meet on grid cells inside the interval [-2, +14] days; the watermarks
    bound the state.
    """
    cell = 4 * fixed.FIRE_LINK_DISTANCE_M / fixed.METERS_PER_DEGREE
    d = detections.select(
        F.col("id").alias("detection_id"), "longitude", "latitude", F.col("observed_at").alias("d_at"),
        F.floor(F.col("longitude") / cell).cast("long").alias("cx"), F.floor(F.col("latitude") / cell).cast("long").alias("cy"),
    ).withWatermark("d_at", late)
    dy = fixed.FIRE_LINK_DISTANCE_M * 1.01 / fixed.METERS_PER_DEGREE
    dx = dy / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("ymin"), F.abs("ymax")) + dy)))
    span = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))
    p = perimeters.select(
        F.col("id").alias("perimeter_id"), F.col("incident_id").alias("fire_id"), "geometry", F.col("observed_at").alias("p_at"),
        span(F.col("xmin") - dx, F.col("xmax") + dx).alias("xs"), span(F.col("ymin") - dy, F.col("ymax") + dy).alias("ys"),
    ).withWatermark("p_at", late)
    p = p.withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys")).drop("xs", "ys")
    window = F.expr(f"d_at >= p_at - INTERVAL {fixed.FIRE_LINK_DAYS_BEFORE} DAYS AND d_at <= p_at + INTERVAL {fixed.MATCH_WINDOW_DAYS} DAYS")
    joined = d.join(p, (d.cx == p.cx) & (d.cy == p.cy) & window)
    near = geo.point_to_geometry_m(F.col("longitude"), F.col("latitude"), F.col("geometry")) <= fixed.FIRE_LINK_DISTANCE_M
    return joined.filter(near).select("detection_id", "perimeter_id", "fire_id", "d_at", "p_at")


def sync_snapshot(spark: SparkSession, table: str, key: str, source_id: Any) -> Callable[[DataFrame, int], None]:
    """Sink for complete snapshots: returning rows reactivate, missing ones expire, empty batches change nothing.

    Twin of ``merge.reactivate`` followed by ``merge.expire_missing``.
    """
    target = SnapshotTable(spark, table)

    def apply(batch: DataFrame, _number: int) -> None:
        if batch.isEmpty():
            return
        if "source_generated_at" in batch.columns:  # of several snapshots in a batch only the newest counts
            newest = batch.agg(F.max("source_generated_at")).first()[0]
            batch = batch.filter(F.col("source_generated_at").eqNullSafe(F.lit(newest)))
        snapshot = batch.dropDuplicates([key])

        def change(current: DataFrame | None) -> DataFrame:
            if current is None:
                return snapshot.withColumn("expires_at", F.lit(None).cast("timestamp"))
            kept = reactivate(current, snapshot, key)
            return expire_missing(kept, snapshot, key, F.col("source_id") == source_id, F.current_timestamp())

        target.mutate(change)

    return apply


# --- incident state -----------------------------------------------------------------

def incident_state(stream: DataFrame) -> DataFrame:
    """Incident state after every batch, in update mode (twin of ``osint.incident_transitions``).

    Every field is a decomposable aggregate (last, maximum, first, count), so a late
    publication lands where time order puts it and the state of an incident has constant size.
    """
    order = F.struct("published_at", "id")
    us = F.unix_micros("published_at")
    ended = F.col("action_state") == "ended"
    starts = ~ended & F.col("event_type").isin("confinement_order", "evacuation_order")
    last = F.max_by(F.struct("title", "event_type", "risk_type", "action_state"), order)
    return stream.groupBy("incident_id").agg(
        last.alias("l"), F.max(us).alias("observed_us"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("transitions"),
        F.min_by(F.when(starts, us), F.when(starts, order)).alias("restriction_started_us"), F.max_by(F.when(ended, us), F.when(ended, order)).alias("ended_us"),
    ).select(
        "incident_id", F.col("l.title").alias("summary"), F.col("l.event_type").alias("event_type"), F.col("l.risk_type").alias("risk_type"),
        F.when(F.col("l.action_state") == "ended", "controlled").otherwise("active").alias("status"), "observed_us", "confidence", "transitions",
        "restriction_started_us", "ended_us",
    )


class ExpiryTimer(StatefulProcessor):
    """Emits a restriction once when it starts and once when its expiry passes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "expires_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(int(v) for batch in rows for v in batch["expires_ms"])
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        self.expiry.update((newest,))
        self.handle.registerTimer(newest)
        yield pd.DataFrame({"id": [key[0]], "state": ["active"], "at_ms": [newest]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.expiry.clear()
        yield pd.DataFrame({"id": [key[0]], "state": ["expired"], "at_ms": [at]})

    def close(self) -> None:
        pass


def expiring(stream: DataFrame, stamp: str = "observed_at", late: str = "1 minute") -> DataFrame:
    """(id, state, at_ms): restrictions as they start and expire in event time."""
    rows = stream.withWatermark(stamp, late).select("id", stamp, F.unix_millis("expires_at").alias("expires_ms"))
    return rows.groupBy("id").transformWithStateInPandas(
        ExpiryTimer(), outputStructType="id string, state string, at_ms long", outputMode="Append", timeMode="EventTime"
    )
