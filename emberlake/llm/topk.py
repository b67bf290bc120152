"""Exact top-k search by integer inner product.

Vectors become integers floor(scale * x). Queries and candidates are packed into blocks;
each task multiplies one query block with one candidate block as a matrix product, keeps
the k best candidates of every query, and these short lists are merged in a tree with a
fixed fan-in, so no query's lists ever meet all at once. Equal scores go to the smaller id.

The products run in double precision while every partial sum stays below 2**53, and in
Python integers beyond; scores outside a long are set to its nearest value. Vectors that
are null, empty or hold null or non-finite components take no part. Vectors of different
length are not compared. A query with fewer than k other vectors returns all of them.
Repeated rows count once; of different vectors with one id the smallest in array order
counts. Null ids take no part. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import small_batches
from emberlake.session import cut_lineage

#: Vectors per block.
QUERY_ROWS, CANDIDATE_ROWS = 2048, 4096
#: Lists merged at once.
FAN_IN = 32


def _blocks(df: DataFrame, scale: float, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` integer vectors of one length: ids ascending, then components."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def full(dim, part):
            ids = np.array([i for i, _ in part], np.int64)
            order = np.argsort(ids, kind="stable")
            data = np.array([v for _, v in part], np.float64)[order]
            return pd.DataFrame({"dim": [dim], "n": [len(part)], "ids": [ids[order].tobytes()], "data": [data.tobytes()]})

        for frame in frames:
            for key, vector in zip(frame["vec_id"], frame["embedding"]):
                x = np.floor(np.asarray(vector, np.float64) * scale)
                part = held.setdefault(len(x), [])
                part.append((key, x))
                if len(part) == rows:
                    yield full(len(x), held.pop(len(x)))
        for dim, part in held.items():
            yield full(dim, part)

    packed = df.mapInPandas(pack, "dim int, n int, ids binary, data binary")
    packed = cut_lineage(packed.withColumn("_at", F.monotonically_increasing_id()), "vector-blocks")
    # One row per block passes through this numbering, not per vector.
    at = packed.select("dim", "_at").withColumn("block", F.row_number().over(Window.partitionBy("dim").orderBy("_at")).cast("long") - 1)
    return packed.join(at, ["dim", "_at"]).drop("_at")


def sound(column: str, dtype: str = "double") -> Column:
    """True for a vector without null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(False))


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, as long."""
    bound = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1]
    if bound < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, candidates)]
    return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1).astype(np.int64)


def best(found: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each row; ties to the smaller column; ``own`` marks cells left out.

    A partial selection finds each row's k-th value; only cells at or above it are sorted.
    """
    masked = np.where(own, np.iinfo(np.int64).min, found)
    if masked.shape[1] > k:
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
    else:
        kth = np.full(len(masked), np.iinfo(np.int64).min)
    rows, columns = np.nonzero((masked >= kth[:, None]) & ~own)
    order = np.lexsort((columns, ~masked[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, np.arange(len(found)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], columns[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other vectors of every query row."""
    rows = vectors.filter(sound(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), is_query.alias("_q")
    )
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("_q").alias("_q")), "vectors")
    candidates = _blocks(rows.drop("_q"), scale, CANDIDATE_ROWS)
    queries = _blocks(rows.filter("_q").drop("_q"), scale, QUERY_ROWS)
    counts = queries.groupBy("dim").agg(F.count(F.lit(1)).alias("_queries"))
    # Every candidate block meets every query block once, through an equi-join on block numbers.
    met = candidates.join(counts, "dim").select(
        "dim", F.col("block").alias("tile"), "ids", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_queries") - 1)).alias("block")
    )
    small_batches(vectors.sparkSession)
    pairs = met.join(queries.select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), ["dim", "block"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q_ids, ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
                q, c = (np.frombuffer(x, np.float64).reshape(-1, row.dim) for x in (row.q_data, row.data))
                for lo in range(0, len(q_ids), 256):
                    part = q_ids[lo : lo + 256]
                    found = scores(q[lo : lo + 256], c)
                    i, j = best(found, part[:, None] == ids, k)
                    yield pd.DataFrame({"query_id": part[i], "tile": row.tile, "vec_id": ids[j], "score": found[i, j]})

    lists = pairs.mapInPandas(search, "query_id long, tile long, vec_id long, score long")
    tiles = candidates.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    order = [F.col("score").desc(), F.col("vec_id")]
    while tiles > FAN_IN:
        tiles = -(-tiles // FAN_IN)
        lists = lists.withColumn("tile", F.expr(f"tile div {FAN_IN}"))
        nth = F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(*order))
        lists = lists.withColumn("_nth", nth).filter(F.col("_nth") <= k).drop("_nth")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

QUERIES = {"op5_top_k": op5_top_k}
ORACLE = {"op5_top_k": SQL}
