"""Registered snapshot synchronization and replay with their SQL checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.adapters import base
from emberlake.functions import geo
from emberlake.operators import snapshot_sync as S
from emberlake.plans import replay
from emberlake.session import cut_lineage

QUERIES, ORACLE = {}, {}
AS_OF = "2030-01-01 00:00:00"


def register(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


def _path(points: int, at: Column) -> Column:
    return F.array(*[geo.xy(at % 100 / 10.0 + i / 100.0, at % 70 / 10.0) for i in range(points)])


def restrictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the orders as a snapshot: none to three lines of three points each."""
    k = F.col("o_orderkey")
    return base(spark, sf, "orders").filter(k % 3 != 0).select(
        F.lit(7).alias("source_id"), F.concat(F.lit("x"), k.cast("string")).alias("external_id"), F.concat(F.lit("h"), k.cast("string")).alias("deduplication_hash"),
        F.when(k % 2 == 0, "CARRETERAS CORTADAS").otherwise("TRÁFICO LENTO").alias("kind"), F.concat(F.lit("T "), "o_orderpriority").alias("title"),
        F.concat(F.lit("N-"), (k % 50).cast("string")).alias("road_ref"), F.array_repeat(_path(3, k), (k % 4).cast("int")).alias("paths"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"), F.when(k % 7 == 0, F.col("o_orderdate").cast("timestamp")).alias("expires_at"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("metadata"), F.when(k % 5 == 0, "cnig_local_road_network").otherwise(S.RAW_STRATEGY).alias("strategy"),
    )


def stored_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Older zones, incidents and one to three segments of three quarters of the orders, of two sources."""
    k = F.col("o_orderkey")
    h = F.concat(F.lit("h"), k.cast("string"))
    rows = base(spark, sf, "orders").filter(k % 4 != 1).withColumns({
        "source_id": F.when(k % 11 == 0, 8).otherwise(7), "observed_at": F.lit(None).cast("timestamp"),
        "expires_at": F.when(k % 2 == 0, F.lit("2020-01-01").cast("timestamp")), "metadata": F.create_map(F.lit("status"), F.lit("old")), "m": (k % 3 + 1).cast("int"),
    })
    x = F.concat(F.lit("x"), k.cast("string"))
    zones = rows.withColumns({
        "external_id": F.concat(x, F.lit(":restriction")), "deduplication_hash": F.concat(F.lit("restriction:"), h), "name": F.lit("old"), "restriction_type": F.lit("old"),
        "strategy": F.when(k % 6 == 0, "previous_road_geometry_reuse").otherwise(S.RAW_STRATEGY), "paths": F.array_repeat(_path(2, k), F.col("m")),
    }).select(S.ZONE)
    incidents = rows.filter(k % 13 != 0).withColumns({
        "external_id": F.concat(x, F.lit(":incident")), "deduplication_hash": F.concat(F.lit("incident:"), h), "road_segment_id": F.concat(x, F.lit(":segment:0")), "kind": F.lit("insufficient_data"), "explanation": F.lit("old"),
    }).select(S.INCIDENT)
    parts = rows.withColumn("segment_index", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    i = F.col("segment_index").cast("string")
    segments = parts.withColumns({
        "external_id": F.concat(x, F.lit(":segment:"), i), "deduplication_hash": F.concat(F.lit("segment:"), h, F.lit(":"), i), "name": F.lit("old"), "road_ref": F.lit("old"), "road_class": F.lit("old"), "path": _path(2, k),
    }).select(S.SEGMENT)
    return zones, incidents, segments


@register("snapshot_changes", f"""
WITH o AS (SELECT o_orderkey AS k, 'h' || o_orderkey AS h, o_orderkey % 3 <> 0 AS present, o_orderkey % 4 <> 1 AS stored, o_orderkey % 11 <> 0 AS own, o_orderkey % 4 AS n, 1 + o_orderkey % 3 AS m,
  o_orderkey % 5 = 0 AS rich, CASE WHEN o_orderkey % 5 = 0 THEN 'cnig_local_road_network' ELSE '{S.RAW_STRATEGY}' END AS fresh, CASE WHEN o_orderkey % 6 = 0 THEN 'previous_road_geometry_reuse' ELSE '{S.RAW_STRATEGY}' END AS former,
  'T ' || o_orderpriority AS title, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'given' ELSE 'none' END AS given, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'none' END AS had FROM orders),
z AS (SELECT *, CASE WHEN stored AND present THEN 'reactivated' WHEN stored AND own THEN 'expired' WHEN stored THEN 'kept' WHEN present AND n > 0 THEN 'inserted' END AS action FROM o),
i AS (SELECT *, CASE WHEN stored AND k % 13 = 0 THEN NULL ELSE action END AS inc FROM z),
s AS (SELECT *, unnest(range(greatest(CASE WHEN stored THEN m ELSE 0 END, CASE WHEN present THEN n ELSE 0 END))) AS j FROM z WHERE action IS NOT NULL),
t AS (SELECT *, CASE WHEN stored AND j < m THEN CASE WHEN present AND j < n THEN 'reactivated' WHEN present OR own THEN 'expired' ELSE 'kept' END ELSE 'inserted' END AS seg FROM s)
SELECT 'restriction' AS part, 'restriction:' || h AS hash, action, CASE action WHEN 'expired' THEN 'now' WHEN 'reactivated' THEN 'none' WHEN 'inserted' THEN given ELSE had END AS expires,
  CASE WHEN action IN ('inserted', 'reactivated') THEN title ELSE 'old' END AS title, CASE WHEN action = 'inserted' OR (action = 'reactivated' AND rich) THEN fresh ELSE former END AS strategy,
  CAST(CASE WHEN action = 'inserted' OR (action = 'reactivated' AND rich) THEN 3 * n ELSE 2 * m END AS INT) AS points,
  CASE WHEN action = 'inserted' OR (action = 'reactivated' AND rich) THEN status ELSE 'old' END AS status FROM z WHERE action IS NOT NULL
UNION ALL SELECT 'incident', 'incident:' || h, inc, CASE inc WHEN 'expired' THEN 'now' WHEN 'reactivated' THEN 'none' WHEN 'inserted' THEN given ELSE had END,
  CASE WHEN inc IN ('inserted', 'reactivated') THEN title ELSE 'old' END, '', 0, CASE WHEN inc IN ('inserted', 'reactivated') THEN status ELSE 'old' END FROM i WHERE inc IS NOT NULL
UNION ALL SELECT 'segment', 'segment:' || h || ':' || j, seg, CASE seg WHEN 'expired' THEN 'now' WHEN 'reactivated' THEN 'none' WHEN 'inserted' THEN given ELSE had END,
  CASE WHEN seg IN ('inserted', 'reactivated') THEN title ELSE 'old' END, CAST(j AS STRING), CASE WHEN seg = 'inserted' OR (seg = 'reactivated' AND rich) THEN 3 ELSE 2 END,
  CASE WHEN seg IN ('inserted', 'reactivated') THEN status ELSE 'old' END FROM t""")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the three tables after one snapshot, with what happened to it."""
    out = S.sync_restrictions(restrictions(spark, sf), *stored_tables(spark, sf), 7, F.lit(AS_OF).cast("timestamp"))
    e = F.col("expires_at")
    expires = F.when(e.isNull(), "none").when(e == F.lit(AS_OF).cast("timestamp"), "now").when(e == F.lit("2020-01-01").cast("timestamp"), "old").otherwise("given")

    def shown(df: DataFrame, part: str, title: str, detail: Column, points: Column) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col("deduplication_hash").alias("hash"), F.col("_action").alias("action"), expires.alias("expires"), F.col(title).alias("title"),
                         detail.alias("strategy"), points.cast("int").alias("points"), F.col("metadata")["status"].alias("status"))

    zones = shown(out.zones, "restriction", "name", F.col("strategy"), F.aggregate("paths", F.lit(0), lambda n, p: n + F.size(p)))
    incidents = shown(out.incidents, "incident", "explanation", F.lit(""), F.lit(0))
    return zones.unionByName(incidents).unionByName(shown(out.segments, "segment", "name", F.col("segment_index").cast("string"), F.size("path")))


@register("snapshot_counts", """
WITH z AS (SELECT CASE WHEN k % 4 <> 1 THEN CASE WHEN k % 3 <> 0 THEN 'reactivated' WHEN k % 11 <> 0 THEN 'expired' ELSE 'kept' END WHEN k % 3 <> 0 THEN 'inserted' END AS a FROM (SELECT o_orderkey AS k FROM orders))
SELECT 'restriction' AS kind, count(*) FILTER (a = 'inserted') AS inserted, count(*) FILTER (a = 'reactivated') AS reactivated, count(*) FILTER (a = 'expired') AS expired, count(*) FILTER (a = 'kept') AS kept FROM z""")
def snapshot_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the run for the zones."""
    return S.sync_restrictions(restrictions(spark, sf), *stored_tables(spark, sf), 7, F.lit(AS_OF).cast("timestamp")).counts.filter("kind = 'restriction'")


# ----- replay -----

_EVENTS = """
SELECT event_id, CAST(floor(event_id / 40e0) AS BIGINT) AS b,
  CASE WHEN event_id % 9 = 0 THEN '60.5' ELSE CAST(36 + event_id % 7 AS STRING) || '.' || CAST(event_id % 90 + 10 AS STRING) END AS lat, '-' || CAST(event_id % 9 AS STRING) || '.25' AS lon,
  '2024-01-' || lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0') AS day, lpad(CAST(event_id % 24 AS STRING), 2, '0') || lpad(CAST(user_id % 60 AS STRING), 2, '0') AS clock,
  CASE WHEN event_id % 3 = 0 THEN 'N,20' ELSE 'Aqua' END AS sat FROM {events}"""


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV payload per forty events: repeated lines, lines of the block before, some without a column or without rows."""
    e = spark.sql(_EVENTS.format(events=f"parquet.`{sf}/events.parquet`"))
    line = F.concat_ws(",", "lat", "lon", "day", "clock", F.concat(F.lit('"'), "sat", F.lit('"')), F.lit("n"), F.when(F.col("b") % 17 != 3, F.lit("1.5")))
    rows = e.select("b", "event_id", line.alias("line"))
    more = rows.filter(F.col("event_id") % 10 == 0).unionByName(rows.filter(F.col("event_id") % 25 == 0).withColumn("b", F.col("b") + 1).withColumn("line", F.regexp_replace("line", ",1.5$", "")).withColumn(
        "line", F.when(F.col("b") % 17 != 3, F.concat("line", F.lit(",1.5"))).otherwise(F.col("line"))))
    texts = rows.unionByName(more).groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda v: v["line"]), "\n").alias("body"))
    header = F.concat(F.lit("latitude,longitude,acq_date,acq_time,satellite,confidence"), F.when(F.col("b") % 17 != 3, F.lit(",frp")).otherwise(F.lit("")))
    body = F.when(F.col("b") % 19 == 4, F.lit("")).otherwise(F.col("body"))
    return texts.select("b", F.concat(F.lit("a/"), F.col("b").cast("string")).alias("url"), F.concat(header, F.lit("\r\n"), body).alias("payload"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("b") * 60).alias("fetched_at"))


def replays(spark: SparkSession, sf: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Detections and outcomes of three runs: half of the archive, all of it, all of it again."""
    archive = cut_lineage(payloads(spark, sf), "archive")
    ledger, target = spark.createDataFrame([], replay.LEDGER), spark.createDataFrame([], "deduplication_hash string")
    found, outcomes = [], []
    for rows in (archive.filter("b % 2 = 0"), archive, archive):
        out = replay.replay_detections(rows.drop("b"), ledger, target)
        found.append(out.detections)
        outcomes.append(cut_lineage(out.ledger, "outcomes"))
        ledger, target = ledger.unionByName(outcomes[-1]), target.unionByName(out.detections.select("deduplication_hash"))
    return found, outcomes


_LINES = f"""WITH e AS ({_EVENTS.format(events='events')}),
l AS (SELECT b, event_id FROM e UNION ALL SELECT b, event_id FROM e WHERE event_id % 10 = 0 UNION ALL SELECT b + 1, event_id FROM e WHERE event_id % 25 = 0),
p AS (SELECT b, b % 17 = 3 OR b % 19 = 4 AS bad, count(*) AS received FROM l GROUP BY b),
h AS (SELECT event_id, sha256('|' || sat || '||' || lat || '|' || lon || '|' || day || '|' || clock) AS hash, sat FROM e WHERE event_id % 9 <> 0),
u AS (SELECT l.b, hash, any_value(sat) AS sat, count(*) AS copies FROM l JOIN h USING (event_id) JOIN p USING (b) WHERE NOT bad GROUP BY 1, 2),
f AS (SELECT hash, any_value(sat) AS sat, coalesce(min(b) FILTER (b % 2 = 0), min(b)) AS b, min(b % 2) AS odd FROM u GROUP BY 1)"""


@register("replayed_detections", _LINES + """
SELECT CAST(1 + odd AS INT) AS run, hash AS deduplication_hash, sat AS satellite FROM f""")
def replayed_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Detections that each of three replays added; the last one adds none."""
    found, _ = replays(spark, sf)
    out = [df.select(F.lit(n + 1).alias("run"), "deduplication_hash", "satellite") for n, df in enumerate(found)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("replay_outcomes", _LINES + """,
g AS (SELECT b, CAST(sum(copies) AS BIGINT) AS inside FROM u GROUP BY 1), n AS (SELECT b, count(*) AS persisted FROM f GROUP BY 1),
a AS (SELECT unnest([1, 2, 3]) AS run, b, bad, received FROM p),
w AS (SELECT * FROM a WHERE CASE run WHEN 1 THEN b % 2 = 0 WHEN 2 THEN b % 2 = 1 OR bad ELSE bad END),
-- Payloads that are a header alone are equal: the first one stands for them.
r AS (SELECT * FROM w QUALIFY b % 19 <> 4 OR b = min(b) OVER (PARTITION BY run, b % 19 = 4, b % 17 = 3))
SELECT CAST(run AS INT) AS run, 'a/' || b AS url, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 0 ELSE received END AS received,
  CASE WHEN bad THEN 0 ELSE received - coalesce(inside, 0) END AS discarded, CASE WHEN bad THEN 0 ELSE coalesce(inside, 0) - coalesce(persisted, 0) END AS duplicated, CASE WHEN bad THEN 0 ELSE coalesce(persisted, 0) END AS persisted,
  CASE WHEN NOT bad THEN '' WHEN b % 17 = 3 THEN 'payload is missing required columns: frp' ELSE 'payload has no rows' END AS error
FROM r LEFT JOIN g USING (b) LEFT JOIN n USING (b)""")
def replay_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of three replays: only failed payloads are tried again."""
    _, outcomes = replays(spark, sf)
    out = [df.select(F.lit(n + 1).alias("run"), "url", "status", "received", "discarded", "duplicated", "persisted", F.coalesce("error", F.lit("")).alias("error")) for n, df in enumerate(outcomes)]
    return out[0].unionByName(out[1]).unionByName(out[2])
