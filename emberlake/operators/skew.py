"""Joins that survive hot keys.

Hot keys are measured, not assumed: one partial aggregation counts rows per key,
and only keys above the per-task budget are salted. Inputs that are too small for a
key above the budget skip the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
MAX_HOT_KEYS = 10_000
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes of a row below which even well compressed files rarely fall.
ROW_BYTES = 1


def _rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("emberlake.skew.rowsPerTask", str(ROWS_PER_TASK)))


def _estimated_bytes(df: DataFrame) -> int:
    """Size of the plan's output as the optimizer estimates it from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only for at most ``limit`` rows and ``most_bytes`` bytes, both counted map-side.

    Larger inputs come back unhinted and join by shuffle.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= limit and found["bytes"] <= most_bytes else df


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more rows than one task should take and their salt counts, or None.

    Inputs whose estimated size cannot hold that many rows are not counted. Others take one
    partial aggregation. The list is bounded: a table of N rows has at most N / budget hot
    keys. A list longer than ``MAX_HOT_KEYS`` is left as a plain DataFrame and joins by shuffle.
    """
    budget = _rows_per_task(df)
    if _estimated_bytes(df) <= budget * ROW_BYTES:
        return None
    counts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > budget)
        .select(*keys, F.ceil(F.col("_rows") / budget).cast("int").alias("_salts"))
    )
    head = counts.limit(MAX_HOT_KEYS + 1).collect()
    if not head:
        return None
    if len(head) > MAX_HOT_KEYS:
        return counts
    return F.broadcast(df.sparkSession.createDataFrame(head, counts.schema))


def salted_join(
    probe: DataFrame, build: DataFrame, keys: list[str], spread: Column, how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys``; rows of hot probe keys are spread over several tasks.

    Build rows of a hot key are repeated once per salt, everything else is
    untouched. ``spread`` is any well-distributed probe-side expression.
    Valid for inner, left, left_semi and left_anti joins.
    """
    hot = hot_keys(probe, keys)
    if hot is None:
        return probe.join(build, keys, how)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        probe.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        build.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
