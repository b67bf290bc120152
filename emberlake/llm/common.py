"""Helpers the operators of this package share: row identity, components, packed vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.session import cut_lineage, drop_cut


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.encode(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "UTF-8")


def crc_of_id(id_col: str) -> Column:
    """Unsigned crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: rows here carry whole texts or whole blocks of vectors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its smallest node.

    Alternates a large and a small star: larger neighbours of a node, then the node and
    its smaller neighbours, are hung on the smallest neighbour. Every node ends with one
    edge to its root. A round groups edges by node with a map-side minimum and joins the
    minimum back, so a node with very many neighbours stays splittable, and is written to
    the shared folder. Stops when a round changes nothing; edges are never dropped.
    """
    state = cut_lineage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges"
    )
    size = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    while size["n"]:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (
            hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        before, state = state, cut_lineage(small, "edges")
        drop_cut(before)
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == size:
            break
        size = now
    roots = state.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def forest(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Label of each of ``n`` items after linking ``rows[i]`` with ``cols[i]``: its smallest linked item."""
    label = np.arange(n)
    while len(rows):
        low = np.minimum(label[rows], label[cols])
        before = label.copy()
        np.minimum.at(label, rows, low)
        np.minimum.at(label, cols, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label
