"""Plan shaping: evaluate once, and spread small inputs over the cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and expressions read instead of recomputing.

    Filters on a derived column are otherwise pushed below its projection together
    with a copy of its definition, once per use; costly text expressions would run
    many times per row. A one-element generator keeps the value as a plain attribute
    and costs no shuffle.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when a scan has fewer splits than the cluster has cores.

    Large tables have more splits than cores and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
