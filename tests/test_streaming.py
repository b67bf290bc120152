import time

from pyspark.sql import functions as F

from emberlake.functions import geo
from emberlake.plans import civil, osint, reconcile
from emberlake.sinks import zones
from emberlake.streaming import jobs


def run(df, tmp_path, name, mode="append"):
    """Process everything that is there and return the rows written."""
    out = str(tmp_path / f"{name}-out")
    q = jobs.start(df, str(tmp_path / f"{name}-ckpt"), jobs.append_to(out), mode=mode)
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.read.option("recursiveFileLookup", "true").schema(df.schema).parquet(out)


def detections(spark):
    rows = [(f"d{i % 40}", f"h{i % 40}", i * 20, -3.0 + i * 1e-4, 40.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, deduplication_hash string, s long, longitude double, latitude double")
    at = F.timestamp_seconds(F.col("s") + 1_767_225_600)
    return df.withColumns({"observed_at": at, "received_at": at}).drop("s")


def test_dedupe_and_minute_counts_agree_with_batch(spark, tmp_path):
    batch = detections(spark)
    batch.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_raw(spark, str(tmp_path / "in"), batch.schema)
    unique = run(jobs.deduplicated(stream), tmp_path, "dedupe")
    assert unique.count() == unique.select("deduplication_hash").distinct().count() == 40
    minutes = run(jobs.minute_counts(stream, late="0 seconds"), tmp_path, "minutes", "update")
    final = minutes.groupBy("observed_at").agg(F.max("count").alias("count"))
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, civil.detection_timeline(batch).collect()))


def at(spark, stamps):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "id long, t string")
    return df.withColumn("observed_at", F.col("t").cast("timestamp")).drop("t")


def test_days_of_hours_agree_with_batch_over_both_time_changes(spark, tmp_path):
    stamps = ["2026-03-28 22:59:59", "2026-03-28 23:00:00", "2026-03-29 00:59:00", "2026-03-29 21:59:30", "2026-03-29 22:00:00", "2026-10-24 22:00:00",
              "2026-10-25 00:30:10", "2026-10-25 01:30:10", "2026-10-25 01:30:50", "2026-10-25 22:59:59", "2026-10-25 23:00:00"]
    batch = at(spark, stamps)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_raw(spark, str(tmp_path / "in"), batch.schema)
    days = jobs.daily_counts(stream, late="2 hours")
    assert run(days, tmp_path, "days").filter("day = date'2026-10-26'").count() == 0
    # A row of a later day closes the days before it; the query goes on where it stopped.
    at(spark, ["2026-12-01 12:00:00"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, run(days, tmp_path, "days").collect()))
    want = sorted(map(tuple, civil.local_days(civil.detection_timeline(batch)).collect()))
    assert got == want and [r[1] for r in got if str(r[0]) == "2026-10-25"] == [4]


def test_late_rows_are_kept_as_dead_letters(spark, tmp_path):
    root = str(tmp_path / "split")
    first, second = at(spark, ["2026-01-10 00:00:00", "2026-01-01 00:00:00"]), at(spark, ["2026-01-08 23:59:59", "2026-01-09 00:00:00", "2026-01-12 00:00:00", "2025-01-01 00:00:00", None])
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_raw(spark, str(tmp_path / "in"), first.schema, files_per_trigger=1)
    q = jobs.start(stream, str(tmp_path / "ck"), jobs.split_late(spark, root, delay_us=86_400_000_000))
    q.awaitTermination(120)
    kept, late = (spark.read.parquet(f"{root}/{p}") for p in ("kept", "late"))
    assert kept.count() == 5 and sorted(str(r.observed_at) for r in late.collect()) == ["2025-01-01 00:00:00", "2026-01-08 23:59:59"]
    apply = jobs.split_late(spark, root, delay_us=86_400_000_000)
    apply(second, 1)
    assert spark.read.parquet(f"{root}/late").count() == 2


def test_listener_counts_what_the_watermark_dropped(spark, tmp_path):
    losses = jobs.RowLosses()
    spark.streams.addListener(losses)
    try:
        for part in (["2026-01-10 00:00:00", "2026-01-09 23:59:00"], ["2026-01-20 00:00:00"], ["2026-01-01 00:00:00", "2026-01-02 00:00:00", "2026-01-20 00:00:30"]):
            at(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_raw(spark, str(tmp_path / "in"), at(spark, []).schema, files_per_trigger=1)
        counts = run(jobs.minute_counts(stream, late="0 seconds"), tmp_path, "m", "update")
        last = counts.groupBy("observed_at").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
        for _ in range(50):
            if sum(losses.received.values()) == 6:
                break
            time.sleep(0.2)
        assert sum(losses.received.values()) == 6 and sum(losses.dropped.values()) == 2 == 6 - last
    finally:
        spark.streams.removeListener(losses)


def publications(spark):
    rows = [
        ("i1", "p1", 10, "evacuation_order", "started", 0.5, "a"), ("i1", "p2", 30, "evacuation_lift", "ended", 0.9, "b"), ("i1", "p3", 20, "firefighting_update", "started", 0.3, "c"),
        ("i2", "p4", 5, "plan_activation", "started", 0.4, "a"), ("i2", "p5", 7, "confinement_order", "started", 0.2, "a"),
    ]
    df = spark.createDataFrame(rows, "incident_id string, id string, s long, event_type string, action_state string, confidence double, authority string")
    return df.withColumns({
        "published_at": F.timestamp_seconds("s"), "title": F.col("id"), "risk_type": F.lit("wildfire"), "es_alert_status": F.lit("x"), "place_names": F.array(F.lit("p")),
        "starts_at": F.lit(None).cast("timestamp"), "ends_at": F.lit(None).cast("timestamp"), "source_type": F.lit("individual"),
    })


def test_incident_state_agrees_with_batch_even_when_late(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    pubs = publications(spark)
    for i, ids in enumerate((["p2", "p4"], ["p1", "p3", "p5"])):
        pubs.filter(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_raw(spark, str(tmp_path / "in"), pubs.schema, files_per_trigger=1)
    out = run(jobs.incident_state(stream), tmp_path, "state", "update")
    last = out.groupBy("incident_id").agg(F.max_by(F.struct("summary", "status", "observed_us", "confidence", "transitions", "restriction_started_us", "ended_us"), "transitions").alias("s")).select("incident_id", "s.*")
    twin = osint.incident_transitions(pubs).select(
        "incident_id", "summary", "status", F.unix_micros("observed_at"), "confidence", "transitions", F.unix_micros("restriction_started_at"), F.unix_micros("ended_at"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, twin.collect()))


def test_witnesses_and_latest_positions(spark, tmp_path):
    pubs = publications(spark)
    pubs.write.parquet(str(tmp_path / "w"))
    w = run(jobs.witnesses(jobs.read_raw(spark, str(tmp_path / "w"), pubs.schema)), tmp_path, "w1", "update")
    assert {(r.incident_id, r.promoted) for r in w.collect()} == {("i1", True), ("i2", False)}
    pos = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, 2.0)], "icao24 string, s long, longitude double").withColumn("observed_at", F.timestamp_seconds("s"))
    pos.write.parquet(str(tmp_path / "p"))
    p = run(jobs.latest_positions(jobs.read_raw(spark, str(tmp_path / "p"), pos.schema)), tmp_path, "p1", "update")
    assert {(r.icao24, r.longitude) for r in p.collect()} == {("a", 3.0), ("b", 2.0)}


def test_interval_join_agrees_with_batch(spark, tmp_path):
    d = detections(spark).dropDuplicates(["id"]).withColumn("incident_id", F.lit(None).cast("string"))
    p = spark.createDataFrame([("x", -3.0, 40.0, 0), ("y", -3.0, 40.0, 40), ("z", 2.0, 40.0, 0)], "id string, lon double, lat double, days int")
    p = p.withColumns({"xmin": F.col("lon") - 0.01, "ymin": F.col("lat") - 0.01, "xmax": F.col("lon") + 0.01, "ymax": F.col("lat") + 0.01,
                       "observed_at": F.timestamp_seconds(F.lit(1_767_225_600) + F.col("days") * 86_400), "incident_id": F.concat(F.lit("f-"), "id")})
    p = p.withColumn("geometry", geo.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
    d.write.parquet(str(tmp_path / "d"))
    p.write.parquet(str(tmp_path / "pp"))
    joined = jobs.detections_near_perimeters(jobs.read_raw(spark, str(tmp_path / "d"), d.schema), jobs.read_raw(spark, str(tmp_path / "pp"), p.schema))
    got = {(r.detection_id, r.perimeter_id) for r in run(joined, tmp_path, "j").collect()}
    assert got == {(r.detection_id, r.perimeter_id) for r in reconcile.link_detections_to_fires(d, p).collect()} and len(got) == 40


def test_snapshot_sync_expires_and_reactivates(spark, tmp_path):
    schema = "id string, source_id int, geometry string, strategy string, name string"
    table = str(tmp_path / "table")
    apply = jobs.sync_snapshot(spark, table, "id", 1)
    first = spark.createDataFrame([("a", 1, "ga", "cnig", "n"), ("b", 1, "gb", "cnig", "n")], schema)
    apply(first, 0)
    apply(spark.createDataFrame([("a", 1, "raw", "nap_datex_coordinates", "m")], schema), 1)
    apply(first.limit(0), 2)
    rows = {r.id: r for r in zones.SnapshotTable(spark, table).read().collect()}
    assert rows["a"].geometry == "ga" and rows["a"].name == "m" and rows["a"].expires_at is None and rows["b"].expires_at is not None
    apply(first, 3)
    assert zones.SnapshotTable(spark, table).read().filter("expires_at IS NOT NULL").count() == 0


def test_expiry_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.createDataFrame([("a", 5, 100), ("b", 10, 5_000)], "id string, s long, e long")
    df = df.withColumns({"observed_at": F.timestamp_seconds("s"), "expires_at": F.timestamp_seconds("e")}).drop("s", "e")
    later = spark.createDataFrame([("c", 1_000, 9_000)], "id string, s long, e long").withColumns({"observed_at": F.timestamp_seconds("s"), "expires_at": F.timestamp_seconds("e")}).drop("s", "e")
    for part in (df, later):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = jobs.read_raw(spark, str(tmp_path / "e"), df.schema, files_per_trigger=1)
    got = {(r.id, r.state) for r in run(jobs.expiring(stream, late="0 seconds"), tmp_path, "exp").collect()}
    assert {("a", "active"), ("b", "active"), ("c", "active"), ("a", "expired")} <= got and ("b", "expired") not in got


def test_archive_replay_ledger_and_dead_letters(spark, raw, tmp_path):
    root = str(tmp_path / "lake")
    rows = raw("one", "two")
    zones.archive(rows, root, "detections")
    assert zones.replay(spark, root, "detections", "2026-07-01", "2026-07-31").count() == 2
    assert zones.replay(spark, root, "detections", "2026-08-01", "2026-08-31").count() == 0
    watched, seen = zones.observed(rows, received=F.count(F.lit(1)))
    watched.write.format("noop").mode("overwrite").save()
    zones.append_run(spark, root, "detections", "2026-07-28 00:00:00", {**seen.get, "persisted": 2})
    zones.append_run(spark, root, "detections", "2026-07-29 00:00:00", {"received": 1}, errors=1)
    runs = {(r.status, r.received) for r in spark.read.parquet(f"{root}/ingestion_runs").collect()}
    assert runs == {("completed", 2), ("failed", 1)}
    zones.dead_letter(rows, root, "detections", "payload_is_json")
    assert spark.read.parquet(f"{root}/dead_letter").filter("rule = 'payload_is_json'").count() == 2
    assert zones.run_status(5, 3, 0, 1) == "partial"


def test_snapshot_table_keeps_the_last_good_state(spark, tmp_path):
    table = zones.SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.write(spark.range(3).withColumnRenamed("id", "x"), cluster_by=["x"])
    assert table.mutate(lambda current: current.limit(0)) is None and table.read().count() == 3
    table.mutate(lambda current: current.filter("x > 0"))
    assert table.version() == 2 and table.read().count() == 2


def test_registered_streams_keep_rows_of_half_a_century(spark, monkeypatch):
    """Archives longer than ten years: no row of the second part is late, and the last days and sessions are closed."""
    from emberlake.registry import streams, surface

    rows = [(i, i % 3, f"{1980 + i * 7 % 48}-05-0{1 + i % 9} 10:00:00", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string, frp_mw double").withColumn("observed_at", F.col("t").cast("timestamp")).drop("t")
    monkeypatch.setattr(streams, "load", lambda *_: df)
    monkeypatch.setattr(surface, "load", lambda *_: df)
    assert streams.streamed_local_days(spark, "").agg(F.sum("detections")).first()[0] == 40
    assert streams.streamed_minutes(spark, "").agg(F.sum("count")).first()[0] == 40
    assert streams.streamed_unique(spark, "").count() == len({(u, e % 3) for e, u, *_ in rows})
    assert surface.streamed_sessions(spark, "").agg(F.sum("detections")).first()[0] == 40
