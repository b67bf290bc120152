"""Landing zone reading and admission checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FeedError(ValueError):
    """A payload that must not replace the last good state."""


def raw_zone(spark: SparkSession, root: str, connector: str, day: str | None = None) -> DataFrame:
    """Archived payloads of a connector, one row per file (whole texts)."""
    path = f"{root.rstrip('/')}/connector={connector}" + (f"/dt={day}" if day else "/dt=*")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("fetched_at")
    )


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise FeedError(f"payload is missing required columns: {sorted(missing)}")
    return df


def require_rows(df: DataFrame, what: str, allow_empty: bool = False) -> DataFrame:
    """Refuse an empty payload unless emptiness was announced."""
    if not allow_empty and df.isEmpty():
        raise FeedError(f"empty {what} needs an explicit permission")
    return df


def split_json(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows with column ``doc``, dead letters that are not valid JSON for the schema)."""
    parsed = raw.withColumn("doc", F.from_json("payload", schema))
    bad = F.col("doc").isNull() | F.try_parse_json("payload").isNull()
    return parsed.filter(~bad), parsed.filter(bad).drop("doc").withColumn("rule", F.lit("payload_is_json"))


def region_tiles(spark: SparkSession, bbox: str, size: float) -> DataFrame:
    """Tiles (west, south, east, north) that cover a region, at least 0.1 degrees wide."""
    west, south, east, north = (float(v) for v in bbox.split(","))
    step = max(size, 0.1)
    one = spark.range(1)
    starts = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.lit(max(0, -int(-(hi - lo) // step) - 1))), lambda i: F.lit(lo) + i * step)
    rows = one.select(F.explode(starts(west, east)).alias("west")).select("west", F.explode(starts(south, north)).alias("south"))
    return rows.select("west", "south", F.least(F.col("west") + step, F.lit(east)).alias("east"), F.least(F.col("south") + step, F.lit(north)).alias("north"))


def active_cells(zones: DataFrame, size: float = 0.25) -> DataFrame:
    """Distinct grid cells touched by active restrictions: the region worth reading."""
    points = zones.filter(F.col("expires_at").isNull()).select(F.explode("path").alias("p")).filter(
        F.col("p.x").between(-180, 180) & F.col("p.y").between(-90, 90)
    )
    cells = points.select(F.floor(F.col("p.x") / size).cast("long").alias("cx"), F.floor(F.col("p.y") / size).cast("long").alias("cy")).distinct()
    return cells.select((F.col("cx") * size).alias("west"), (F.col("cy") * size).alias("south"), ((F.col("cx") + 1) * size).alias("east"), ((F.col("cy") + 1) * size).alias("north"))


def union_pages(pages: list[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """Pages of one feature feed as one table without repeated ids."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    out = out.dropDuplicates([key])
    return out if limit is None else out.limit(limit)
