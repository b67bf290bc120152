"""Near copies among embeddings by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so the join looks for pairs within
epsilon. Vectors are rotated so that the directions of largest variance come first, sorted
by their grid cells (side epsilon) on the leading directions, and cut into intervals of the
sequence. Intervals form a tree: leaves of at most ``LEAF`` vectors, their ranges, ranges of
ranges. Starting from the root paired with itself, pairs of intervals are expanded into
pairs of their parts; a pair whose bounding boxes are farther apart than epsilon is skipped
with everything below it. Boxes cover the leading coordinates and the length of the rest,
so skipping never loses a link. Pairs of leaves that remain are split once more inside the
task and compared by matrix products in double precision.

Links are counted where they are found; for connectivity each pair of leaves only passes on
a spanning forest, so a dense group costs rows in proportion to its members. Equal vectors
are one vector with a count. The rotation comes from second moments summed over all
vectors; it steers only which blocks can be skipped.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing
and are their own component. Vectors of different length don't link. Rows of equal id are one
vector and one row of the result; where they differ the smallest in array order counts.
Null ids are left out. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import components, forest, small_batches
from emberlake.llm.topk import sound
from emberlake.session import cut_lineage

#: Leading directions that boxes cover, and those of them that define the sort key.
LEADING, KEYED = 16, 6
#: Vectors in a leaf, in the parts that a task compares, and children of an inner interval.
LEAF, PART, FAN_OUT = 4096, 128, 8
#: Allowance for rounding in the skip test.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal directions by falling second moment, from sums over all vectors of one length."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for frame in frames:
            x = unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    sums = (
        vectors.select("embedding").mapInPandas(moments, "i int, row array<double>")
        .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    )
    out = np.zeros((dim, dim))
    for r in sums.toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh(out)[1][:, ::-1]


def reduced(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Leading rotated coordinates and the length of what remains: never longer differences than the vectors'."""
    y = x @ turn
    k = min(LEADING, y.shape[1])
    return np.concatenate([y[:, :k], np.linalg.norm(y[:, k:], axis=1, keepdims=True)], axis=1)


def gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Least distance between boxes."""
    apart = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return np.sqrt((apart * apart).sum(-1))


def _sequence(vectors: DataFrame, dim: int, eps: float, kind: str) -> DataFrame:
    """Leaves of the epsilon grid order: (leaf, ids, copies, data, low, high); data keeps the components as given.

    Every vector gets its number in the sequence, from its place in a sorted range and the
    sizes of the ranges before it; leaves are cut by that number. How many leaves there are
    follows from the vectors alone, not from the number of partitions.
    """
    turn = rotation(vectors, dim)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["embedding"].to_numpy())
            cells = np.floor(reduced(unit(x.astype(np.float64)), turn)[:, :KEYED] / eps).astype(np.int32)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "copies": frame["copies"], "data": [r.tobytes() for r in x.astype(kind)], "cells": list(cells)})

    def full(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("number")
        x = np.frombuffer(b"".join(part["data"]), kind).reshape(-1, dim)
        z = reduced(unit(x.astype(np.float64)), turn)
        ids, copies = part["vec_id"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
        leaf = int(part["number"].iloc[0]) // LEAF
        return pd.DataFrame({"leaf": [leaf], "ids": [ids.tobytes()], "copies": [copies.tobytes()], "data": [x.tobytes()], "low": [z.min(0)], "high": [z.max(0)]})

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cells", "vec_id"]
    sequence = cut_lineage(
        vectors.mapInPandas(keyed, "vec_id long, copies long, data binary, cells array<int>")
        .repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("cells").withColumn("_at", F.monotonically_increasing_id()),
        "sequence",
    )
    sequence = sequence.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1))
    # One row per range of the shuffle goes through this window, whatever the number of vectors.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sequence.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = sequence.join(F.broadcast(starts), "_range").withColumn("number", F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")
    leaves = numbered.groupBy(F.expr(f"number div {LEAF}").alias("leaf")).applyInPandas(full, "leaf int, ids binary, copies binary, data binary, low array<double>, high array<double>")
    return cut_lineage(leaves, "leaves")


def _near(a: str, b: str, eps: float):
    """The boxes of two intervals may hold a pair within epsilon."""
    low, high = (F.zip_with(f"{a}.low", f"{b}.high", lambda x, y: x - y), F.zip_with(f"{b}.low", f"{a}.high", lambda x, y: x - y))
    square = F.aggregate(F.zip_with(low, high, lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    return square <= (eps + SLACK) ** 2


def _leaf_pairs(leaves: DataFrame, width: int, eps: float) -> DataFrame:
    """Pairs of leaves that may hold links, found by expanding pairs of intervals from the root."""
    boxes = cut_lineage(leaves.select("leaf", "low", "high"), "boxes")
    count = boxes.agg(F.coalesce(F.max("leaf"), F.lit(0))).first()[0] + 1
    depth = 0
    while FAN_OUT**depth < count:
        depth += 1

    def level(k: int) -> DataFrame:
        """Intervals of FAN_OUT**k leaves each."""
        sides = [F.min(F.get("low", F.lit(i))).alias(f"l{i}") for i in range(width)] + [F.max(F.get("high", F.lit(i))).alias(f"h{i}") for i in range(width)]
        out = boxes.groupBy(F.expr(f"leaf div {FAN_OUT**k}").alias("node")).agg(*sides)
        return out.select("node", *(F.array(*[f"{c}{i}" for i in range(width)]).alias(n) for c, n in (("l", "low"), ("h", "high"))))

    found = level(depth).select(F.col("node").alias("a"), F.col("node").alias("b"))
    for k in range(depth - 1, -1, -1):
        children = cut_lineage(level(k).withColumn("up", F.expr(f"node div {FAN_OUT}")), "intervals")
        one, two = children.alias("x"), children.alias("y")
        found = (
            found.join(one, F.col("a") == F.col("x.up")).join(two, F.col("b") == F.col("y.up"))
            .filter((F.col("x.node") <= F.col("y.node")) & _near("x", "y", eps))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        )
        found = cut_lineage(found, "interval-pairs")
    return found.select(F.col("a").alias("leaf"), F.col("b").alias("leaf_b"))


def compare(a: np.ndarray, b: np.ndarray | None, copies_a: np.ndarray, copies_b: np.ndarray, eps: float, least: float):
    """Links per unit vector of two leaves (or of one with itself), weighted by copies, and a spanning forest's labels."""
    same = b is None
    b = a if same else b
    na, n = len(a), len(a) if same else len(a) + len(b)
    shift = 0 if same else na
    links = np.zeros(n, np.int64)
    rows, columns = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def boxes(x):
        return [(x[i : i + PART, :LEADING].min(0), x[i : i + PART, :LEADING].max(0)) for i in range(0, len(x), PART)]

    box_b = boxes(b)
    for i, (low_a, high_a) in enumerate(boxes(a)):
        for j, (low_b, high_b) in enumerate(box_b):
            if (same and j < i) or gap(low_a, high_a, low_b, high_b) > eps + SLACK:
                continue
            p, q = i * PART, j * PART
            hit = a[p : p + PART] @ b[q : q + PART].T >= least
            if same and i == j:
                hit = np.triu(hit, 1)
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            np.add.at(links, r + p, copies_b[c + q])
            np.add.at(links, c + q + shift, copies_a[r + p])
            rows, columns = np.append(rows, r + p), np.append(columns, c + q + shift)
            if len(rows) > 1 << 18:  # a forest of these edges says the same
                label = forest(rows, columns, n)
                columns = np.flatnonzero(label != np.arange(n))
                rows = label[columns]
    return links, forest(rows, columns, n)


def _linked(vectors: DataFrame, dim: int, eps: float, least: float, kind: str) -> DataFrame:
    """(vec_id, links, root): a row per leaf pair and linked vector; links other than of the vector's own copies."""
    leaves = _sequence(vectors, dim, eps, kind)
    pairs = _leaf_pairs(leaves, min(LEADING, dim) + 1, eps)
    body = ["ids", "copies", "data"]
    other = leaves.select(F.col("leaf").alias("leaf_b"), *[F.col(c).alias(f"{c}_b") for c in body])
    met = pairs.join(leaves.select("leaf", *body), "leaf").join(other, "leaf_b")

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, copies = np.frombuffer(row.ids, np.int64), np.frombuffer(row.copies, np.int64)
                ids_b, copies_b = np.frombuffer(row.ids_b, np.int64), np.frombuffer(row.copies_b, np.int64)
                a, b = (unit(np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64)) for x in (row.data, row.data_b))
                same = row.leaf == row.leaf_b
                n, label = compare(a, None if same else b, copies, copies_b, eps, least)
                every = ids if same else np.concatenate([ids, ids_b])
                at = np.flatnonzero(n)
                yield pd.DataFrame({"vec_id": every[at], "links": n[at], "root": every[label[at]]})

    return met.mapInPandas(links, "vec_id long, links long, root long")


def near_copies(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; a link is a cosine of ``threshold`` or more."""
    eps = math.sqrt(2 - 2 * threshold)
    small_batches(vectors.sparkSession)
    kind = "<f4" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "<f8"
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(sound("embedding") & F.exists("embedding", lambda x: x != 0), F.col("embedding")))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    alike = cut_lineage(rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("copies")), "alike")
    found = None
    for (dim,) in alike.select(F.size("embedding")).distinct().collect():  # one row per vector length
        part = _linked(alike.filter(F.size("embedding") == dim).select(F.col("lead").alias("vec_id"), "embedding", "copies"), dim, eps, threshold, kind)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found, "links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    leads = (
        alike.join(counts, alike["lead"] == counts["vec_id"], "left").drop("vec_id").join(roots, F.col("lead") == F.col("node"), "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "lead").alias("component"))
    )
    out = rows.join(leads, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE sized AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND a.usable AND b.usable AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id, vec_id AS other FROM sized UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM classes
"""

QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
ORACLE = {"op3_embedding_dedup": SQL}
