"""Landing archive, dead letters, run ledger, and snapshot tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def archive(raw: DataFrame, root: str, connector: str, stamp: str = "fetched_at") -> None:
    """Append payloads to ``connector=.../dt=...`` folders."""
    rows = raw.withColumns({"connector": F.lit(connector), "dt": F.date_format(stamp, "yyyy-MM-dd")})
    rows.write.mode("append").partitionBy("connector", "dt").parquet(f"{root.rstrip('/')}/raw")


def replay(spark: SparkSession, root: str, connector: str, first_day: str, last_day: str) -> DataFrame:
    """Archived payloads of a connector for a span of days; partitions outside are not read."""
    return spark.read.parquet(f"{root.rstrip('/')}/raw").filter(
        (F.col("connector") == connector) & F.col("dt").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    )


def dead_letter(rows: DataFrame, root: str, connector: str, rule: str | None = None) -> None:
    """Append refused rows as JSON next to the rule they broke."""
    name = F.lit(rule) if rule else F.col("rule")
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "rule"]))
    rows.select(F.lit(connector).alias("connector"), name.alias("rule"), body.alias("record")).write.mode("append").partitionBy("connector").parquet(
        f"{root.rstrip('/')}/dead_letter"
    )


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Attach counters that are filled while the next action runs, without another pass."""
    watch = Observation(f"run-{uuid.uuid4().hex[:8]}")
    return df.observe(watch, *[m.alias(n) for n, m in metrics.items()]), watch


def run_status(received: int, persisted: int, duplicates: int, errors: int) -> str:
    if errors and not persisted + duplicates:
        return "failed"
    return "partial" if errors else "completed"


def append_run(spark: SparkSession, root: str, connector: str, started_at: str, counters: dict[str, int], errors: int = 0) -> None:
    """One ledger row per run."""
    got = {n: int(counters.get(n, 0)) for n in ("received", "discarded", "duplicates", "persisted")}
    status = run_status(got["received"], got["persisted"], got["duplicates"], errors)
    row = spark.range(1).select(
        F.lit(uuid.uuid4().hex).alias("id"), F.lit(connector).alias("connector_name"), F.lit(status).alias("status"),
        F.lit(started_at).cast("timestamp").alias("started_at"), F.current_timestamp().alias("finished_at"), *[F.lit(v).alias(n) for n, v in got.items()],
    )
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/ingestion_runs")


class SnapshotTable:
    """A table kept as numbered snapshot folders plus a small commit log.

    A snapshot becomes visible when its number is logged, after its files are
    complete, so a failed write leaves the last good state in place. One writer per
    table.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """Newest committed snapshot, 0 when there is none."""
        try:
            log = self.spark.read.schema("version int").parquet(f"{self.path}/log")
            return log.agg(F.max("version")).first()[0] or 0
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def read(self) -> DataFrame | None:
        number = self.version()
        return self.spark.read.parquet(f"{self.path}/data/v={number}") if number else None

    def write(self, df: DataFrame, cluster_by: list[str] | None = None) -> int:
        """Write and commit the next snapshot; clustering lets later scans skip row groups."""
        number = self.version() + 1
        out = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
        out.write.mode("overwrite").parquet(f"{self.path}/data/v={number}")
        self.spark.range(1).select(F.lit(number).alias("version")).write.mode("append").parquet(f"{self.path}/log")
        return number

    def mutate(self, change: Callable[[DataFrame | None], DataFrame], allow_empty: bool = False) -> int | None:
        """Apply a change; an empty result never replaces a non-empty state unless allowed."""
        current = self.read()
        following = change(current)
        if not allow_empty and current is not None and following.isEmpty():
            return None
        return self.write(following)


def write_geojson(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line."""
    features.select(F.col("feature").alias("value")).write.mode("errorifexists").text(path)
