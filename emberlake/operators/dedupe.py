"""Keep-first, keep-last and keep-latest by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rank filter lets Spark cut every map task to one row per key before the
# shuffle, so a key holding a third of the table stays cheap.


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_rows(df, keys, [F.col(c).asc() for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_rows(df, keys, [F.col(c).desc() for c in order])


def keep_latest(df: DataFrame, keys: list[str], stamp: str, order: str) -> DataFrame:
    """Largest stamp (null is oldest); ties keep the row that came first in ``order``."""
    return top_rows(df, keys, [F.col(stamp).desc_nulls_last(), F.col(order).asc()])


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(received, unique_rows, duplicates) of a batch."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("received"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"),
    )


def only_new(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not stored yet."""
    return batch.join(stored.select(key).distinct(), key, "left_anti")


def already_stored(batch: DataFrame, stored: list[DataFrame], key: str) -> DataFrame:
    """Rows of a batch whose key exists in any of the stored tables."""
    known = stored[0].select(key)
    for table in stored[1:]:
        known = known.unionByName(table.select(key))
    return batch.join(known.distinct(), key, "left_semi")
