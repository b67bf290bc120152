"""Activity sessions: runs of detections without a long pause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "180 minutes"


def activity_sessions(detections: DataFrame, keys: list[str], stamp: str = "observed_at", gap: str = GAP) -> DataFrame:
    """Sessions per key: first and last detection, their number, and the greatest power.

    A detection at most ``gap`` after the one before it goes on with the session. Rows
    without a stamp belong to none. Works on batches and, with a watermark, on streams.
    """
    session = F.session_window(stamp, gap)
    out = detections.groupBy(*keys, session.alias("session")).agg(F.max(stamp).alias("last_at"), F.count(F.lit(1)).alias("detections"), F.max("frp_mw").alias("frp_mw"))
    return out.select(*keys, F.col("session.start").alias("first_at"), "last_at", "detections", "frp_mw")
